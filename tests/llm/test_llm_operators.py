"""The training-data operators against brute force, and their edge cases."""

import html
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rentroll.llm import chat, decontaminate, graph, html_extract, language_id, license_scan, near_dedup, packing, sharding, shingle_join, sketch, token_count

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(900)]


def passage(words, seed, n):
    return " ".join(np.random.default_rng(seed).choice(words, n))


def test_components(rows):
    chain = rows([(i + 1, i) for i in range(40)] + [(50, 60), (60, 50), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}
    assert graph.components(rows([], "a bigint, b bigint")).count() == 0


def linked(links, n):
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_vectors(rows):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 8))
    vectors = [*base, *(base[i % 6] + 0.12 * rng.standard_normal(8) for i in range(60)), base[0], 3 * base[1]]
    data = [(i, [float(x) for x in v], 0.5) for i, v in enumerate(vectors)]
    odd = [(200, None, 0.0), (201, [], 0.0), (202, [0.0] * 8, 0.0), (203, [None] + [1.0] * 7, 0.0), (204, [float("nan")] + [1.0] * 7, 0.0)]
    got = {r["vec_id"]: r for r in near_dedup.near_duplicates(rows(data + odd, "vec_id bigint, embedding array<double>, unit double")).collect()}
    u = np.stack(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = u @ u.T >= 0.95
    root = linked(list(zip(*np.nonzero(near), strict=True)), len(u))
    for i in range(len(u)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, root[i], root[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, *_ in odd)
    assert near_dedup.near_duplicates(rows([], "vec_id bigint, embedding array<double>")).count() == 0


def test_near_vectors_of_null_ids(rows):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0])]
    got = near_dedup.near_duplicates(rows(data, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, 0, True), (0, 0, 0, True), (0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False)]


def shingle_set(text):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_join(rows, words):
    texts = [None, "", " \t\n", "one two", "ONE  two", "a b c d e", "a b c d e f", "a b c d e f g h i", "a b c d e f g h i j"]
    common = passage(words, 99, 60)
    for s in range(30):
        body = passage(words, s, 40 + 17 * (s % 5)).split(" ")
        texts.append(" ".join(body) if s % 3 else " ".join(body) + " " + common)
        for k in range(s % 4):
            changed = list(body)
            for at in range(k * 3, len(changed), 75 + 9 * k):
                changed[at] = f"x{s}{k}"
            texts.append(" ".join(changed).upper())
    texts += [passage(words, 1, 57)] * 3 + [passage(words, 5, 9000)] * 2
    data = [(i, t, "x", "s", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in shingle_join.jaccard_components(rows(data, DOC)).collect()}
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = linked(links, len(sets))
    assert len(links) > 20
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(sets))] == [(len(s), r) for s, r in zip(sets, root, strict=True)]
    assert shingle_join.jaccard_components(rows([], DOC)).count() == 0


def test_shared_keys_in_any_lots(spark, rows):
    """Keys come out the same however few of them a task deals at once."""
    texts = [" ".join(f"w{(i * 7 + j) % 40 if j < 12 else i * 100 + j}" for j in range(20)) for i in range(12)]
    table = rows(list(enumerate(texts)), "id bigint, text string")
    counts = np.zeros(shingle_join.BUCKETS + shingle_join.WORD_BUCKETS, np.uint32)
    shared = spark.sparkContext.broadcast((*shingle_join.ordering(counts), 50))
    few, many = ({tuple(r) for r in shingle_join.shared_keys(table, shared, 3, **lot).collect()} for lot in ({"lot": 1}, {}))
    assert few == many and few


def test_shingle_join_of_large_sets(rows, words):
    """Families whose members lie on both sides of the similarity, with sizes on both sides of a power of two."""
    texts = []
    for family, size in enumerate((500, 1000, 1040, 2060)):
        body = passage(words, 200 + family, size).split(" ")
        for k, every in enumerate((150, 100, 70, 56, 50, 46, 40, 30, 25)):
            changed = list(body[k:])
            for at in range(k, len(changed), every):
                changed[at] = f"y{family}z{k}w{at}"
            texts.append(" ".join(changed))
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 5
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(rows([(i, t, "x", "s", 0) for i, t in enumerate(texts)], DOC)).collect()}
    assert [got[i] for i in range(len(texts))] == linked(links, len(texts))


def test_summed_vectors_travel_in_small_chunks(rows):
    """A chunk's size doesn't grow with the vector, and the tasks' vectors add up to what one would count."""
    for length, dtype in ((3, "<u4"), (70_001, "<i8"), (1 << 21, "u1")):
        vectors = []
        for k in range(3):
            vectors.append(np.zeros(length, dtype))
            vectors[-1][k :: 2 + k] = k + 1
        parts = [r for v in vectors for r in sketch.chunk_rows(v)]
        assert max(len(p) for _, p in parts) <= 4096
        assert (sketch.collected(rows(parts, "chunk int, part binary"), length, dtype) == sum(vectors)).all()


def test_star_rounds_end(rows, words, monkeypatch):
    """Rounds are run while keys hold many pairs and the last round made them fewer; the groups are the same after any number."""
    texts = []
    for s in range(6):
        body = passage(words, 300 + s, 60).split(" ")
        for k in range(5):
            texts.append(" ".join([*body[:-k], f"z{s}{k}"] if k else body))
    table, stored = rows([(i, t, "x", "s", 0) for i, t in enumerate(texts)], DOC), []
    monkeypatch.setattr(shingle_join, "durable", lambda df, label, kept=shingle_join.durable: (stored.append(label), kept(df, label))[1])

    def found(*told):
        stored.clear()
        if told:
            left = iter(told)
            monkeypatch.setattr(shingle_join, "_pairs", lambda open_: next(left))
        return {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(table).collect()}, stored.count("stars")

    groups, rounds = found()
    assert rounds == 0 and len(set(groups.values())) == 6
    assert found((900.0, 9), (800.0, 9)) == (groups, 1)
    assert found((900.0, 9), (90.0, 9), (30.0, 9)) == (groups, 2)
    assert found((900.0, 9), (600.0, 9), (400.0, 9)) == (groups, 3)


def test_parities_never_exceed_the_difference():
    drawn = np.random.default_rng(5)
    for n in (1, 2, 511, 512, 513, 1023, 1025, 1300, 4100):
        whole = np.unique(drawn.integers(0, 1 << 63, n).astype(np.uint64))
        for gone, new in ((0, 0), (n // 10, 0), (n // 9, n // 9), (0, n // 5)):
            other = np.unique(np.concatenate([whole[gone:], drawn.integers(0, 1 << 63, new).astype(np.uint64)]))
            x, y = shingle_join.parities(whole), shingle_join.parities(other)
            least = min(len(x), len(y))
            cut = [np.bitwise_xor.reduce(w.reshape(-1, least), axis=0) for w in (x, y)]
            differ = sum(int(w).bit_count() for w in (cut[0] ^ cut[1]).view(np.uint64).tolist())
            narrow = sum(int(w).bit_count() for w in (shingle_join.folded(x) ^ shingle_join.folded(y)).view(np.uint64).tolist())
            assert narrow <= differ <= len(np.setxor1d(whole, other)) and max(len(x), len(y)) <= 2 * least


def test_main_text(rows):
    page = ('<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><div class="text"><h2>T{0} &amp; u</h2>'
            '<p>Body{0} <b>of\n the</b> page {1}<p>More {0}</div><p>Fixed line</p><div id="comments"><p>hi</p></div><footer>f</footer><script>if(a<b)x="</p>"</script></body></html>')
    data = [(i, f"http://h.example/{i}", page.format(i, "long " * 60 + str(i)), "x") for i in range(5)]
    data += [(10, None, None, "x"), (11, "http://one.example", "", "x"), (12, "odd", "<article><p>a<br>b <span class='ads'>no</span>c<li>d", "x"),
             (12, "odd", "<article><p>a<br>b <span class='ads'>no</span>c<li>d", "x")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_text(rows(data, "page_id bigint, url string, html string, main string")).collect())
    want = [(i, t := f"T{i} & u\n\nBody{i} of the page " + "long " * 60 + f"{i}\n\nMore {i}", len(t)) for i in range(5)]
    assert got == [*want, (10, "", 0), (11, "", 0), *[(12, "a b c\n\nd", 8)] * 2]


def extracted(rows, data):
    got = html_extract.main_text(rows(data, "page_id bigint, url string, html string"))
    return {r["page_id"]: r["text"] for r in got.collect()}


def test_main_text_of_templates_with_gaps(rows):
    """A host without articles that holds empty pages, an odd one and a notice on most pages."""
    page = "<html><body><div><p>Site name</p></div><section><p>{1}</p>{0}</section></body></html>"
    bodies = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(40)}
    data = [(i, f"http://gaps.example/{i}", page.format("<p>We moved</p>" if i % 20 else "", b)) for i, b in bodies.items()]
    data += [(90, "http://gaps.example/a", None), (91, "http://gaps.example/b", ""), (92, "http://gaps.example/c", "<html><body><table><tr><td>odd page")]
    assert extracted(rows, data) == {**bodies, 90: "", 91: "", 92: "odd page"}


def test_main_text_of_copies(rows):
    """Copies of a page, and near copies, without an article, keep their text."""
    body = [" ".join(f"p{i}w{k}" for k in range(20)) for i in range(6)]

    def page(head, parts):
        return f"<html><body><h1>{head}</h1><div>" + "".join(f"<p>{x}</p>" for x in parts) + "</div></body></html>"

    data = [(i, f"http://same.example/{i}", page("T", body)) for i in range(5)]
    data += [(10 + i, f"http://near.example/{i}", page("T", [*body[:5], f"end {i}"])) for i in range(5)]
    got = extracted(rows, data)
    assert all("\n\n".join(body) in got[i] for i in range(5))
    assert all("\n\n".join([*body[:5], f"end {i}"]) in got[10 + i] for i in range(5))


def test_main_text_beside_articles(rows):
    """Articles that are cards of other posts do not stand for the body; a lone article does."""
    bodies = {i: " ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)}
    cards = "<aside><p>x</p></aside><section><article><p>Card one</p></article><article><p>Card two</p></article></section>"
    data = [(i, f"http://cards.example/{i}", f"<html><body><div><p>{b}</p></div>{cards}</body></html>") for i, b in bodies.items()]
    data += [(10 + i, f"http://lone.example/{i}", f"<html><body><div><p>Side {i}</p></div><article><h1>H{i}</h1><p>{b}</p></article></body></html>") for i, b in bodies.items()]
    data += [(20, "http://few.example/1", f"<html><body><div><p>{bodies[0]}</p></div>{cards}</body></html>")]
    assert extracted(rows, data) == {**bodies, **{10 + i: f"H{i}\n\n{b}" for i, b in bodies.items()}, 20: bodies[0] + "\n\nCard one\n\nCard two"}


@pytest.mark.parametrize(("page", "want"), [
    ('<article><div class="share-price"><p>A</p></div><p id="notice-of-award">B</p><div class="post related">C</div><div class="ad-box">no</div></article>', "A|B|C"),
    ("<p data-x=it's>Hello world's end</p>", "Hello world's end"),
    ('<p title="x>Text', "Text"),
    ("<p a='x>y<p>z", "y|z"),
    ("<button>Go<p>Rest", "Go|Rest"),
    ("<p>see f(x)=<math><mi>y</mi><annotation>no</annotation></math> holds</p>", "see f(x)=y holds"),
    ("<p>a<script>x='</p>'</script>b <svg><svg></svg><text>no</text></svg> c</p><p>d <select><option>no</select>e</p>", "ab c|d e"),
    ("<p>1 < 2 and 3<>4 &lt;b&gt;</p><p cla", "1 < 2 and 3<>4 <b>"),
    ("<p>x<!-- open <p>no", "x"),
    ("<p>x<script>no", "x"),
    ("<p>a <b>b <i>c</b> d</i><span class='ads'>no <b>no</b></span> e", "a b c d e"),
    ("<div>" * 500 + "<nav>no</nav><p>x</p>" + "</div>" * 500 + "<p>y", "x|y"),
])
def test_parse(page, want):
    assert "|".join(b[2] for b in html_extract.parse(page) if b[0] == "block" and not b[3]) == want


@pytest.mark.parametrize("unit", ['<p a="', "<a ", "<!", "<![", "<", "<div>x", "<b>x</x>", "<svg>", "<svg></svg><svg>", "<a x=\">\" y='", "<i><b>", "<span class=ad>x"])
@pytest.mark.parametrize("tail", ["", ">", " x='"])
def test_parse_takes_time_in_proportion(unit, tail):
    """Broken pages of 400 KB; a scan that starts again at every sign takes minutes for them."""
    began = time.process_time()
    for _ in html_extract.parse(unit * (400_000 // len(unit)) + tail):
        pass
    assert time.process_time() - began < 10


def test_main_text_equals_a_plain_version(spark):
    """On the driver's pages, whose article is one element: its text by replacing tags."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        for gone in (r"<!--.*?-->", r"<(nav|aside|footer|form|script|style)\b.*?</\1>", r'<div class="(?:ad|comments?)">.*?</div>'):
            inner = re.sub(gone, "", inner, flags=re.S)
        parts = re.split(r"</?(?:p|h\d|div|ul|li|section)\b[^>]*>", inner.replace("<br>", " "))
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts]
        want[r["page_id"]] = "\n\n".join(x for x in parts if x)
    assert {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()} == want


def test_shards(rows):
    data = [(i, None if i % 50 == 0 else "héllo" * (i % 37) if i % 3 else "same text " * 9) for i in range(900)] + [(5, "x"), (5, "x")]
    got = sharding.range_shards(rows(data, "doc_id bigint, text string")).collect()
    assert len(got) == len(data)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by_id = dict(data)
    for r in got:
        if r["doc_id"] != 5:
            raw = (by_id[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.range_shards(rows([], "doc_id bigint, text string")).count() == 0


def test_language(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) > 20
    odd = language_id.identify(docs.select(*docs.columns).union(rows([(-1, None, None, "s", 0), (-2, "", "en", "s", 0), (-3, "12 -- 3", "en", "s", 0)], DOC)))
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in odd.filter("doc_id < 0").collect()} == {(i, "und", 0.0) for i in (-1, -2, -3)}
    assert {r["lang_pred"] for r in language_id.identify(rows([(1, "text", None, "s", 4)], DOC)).collect()} == {"und"}


def test_language_costs_follow_escapes():
    """Code lengths of the tables against a direct walk down the contexts."""
    texts = {"a": "abracadabra abba", "b": "bcbcbccb cab"}
    counts = {}
    for lang, t in texts.items():
        s = "   " + t
        for i in range(3, len(s)):
            code = int.from_bytes(s[i - 3 : i + 1].encode(), "big")
            counts[lang, code] = counts.get((lang, code), 0) + 1
    trees = language_id.grow([(x, c, n) for (x, c), n in counts.items()])

    def bits(lang, text):
        s, total = "   " + text, 0.0
        grams = [(int(c).to_bytes(4, "big").decode(), n) for (x, c), n in counts.items() if x == lang]
        for i in range(3, len(s)):
            for order in (3, 2, 1, 0):
                ctx = s[i - order : i]
                seen = {}
                for g, n in grams:
                    if g[3 - order : 3] == ctx:
                        seen[g[3]] = seen.get(g[3], 0) + n
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    total -= np.log2(seen[s[i]] / whole)
                    break
                total -= np.log2(len(seen) / whole)
            else:
                total += 8
        return total

    rows_ = [b"abba cab", b"", b"zzz bcb"]
    got = trees.bits(np.frombuffer(b"".join(rows_), np.uint8), np.array([0, 8, 8, 15]))
    want = [[bits(x, r.decode()) for x in trees.langs] for r in rows_]
    assert np.allclose(got, want, atol=1e-3)


def test_notices(rows):
    texts = ["Released under the MIT License; UNDER  the mit-license!", "Apache Licence, version 2.0 applies", "cc by nd", "under the gnu license", None, "",
             "apache license version 1", "é CC BY-NC 4.0", "x " * 50000 + "undr the mit license"]
    got = {r["doc_id"]: r for r in license_scan.scan_notices(rows(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    spans = {i: [(s["label"], s["first_word"], s["n_words"], s["edits"]) for s in got[i]["spans"]] for i in got}
    assert spans == {0: [("mit", 1, 4, 0), ("mit", 5, 4, 0)], 1: [("apache-2", 0, 4, 1)], 2: [], 3: [], 4: [], 5: [], 6: [],
                     7: [("cc-by-nc", 1, 3, 0)], 8: [("mit", 50000, 4, 1)]}
    assert [got[i]["n_words"] for i in (0, 4, 7)] == [9, 0, 6]


def test_notices_with_edits_on_one_side():
    """Every way to place two edits beside the core word."""
    scan = license_scan.Scanner().scan

    def spans(text):
        return [(s["label"], s["first_word"], s["n_words"], s["edits"]) for s in scan(f"see {text} here")[1]]

    for text in ("under the mit lisence", "under teh mit license", "under the mit licesne", "undr te mit license", "under the mit licns",
                 "undr the mit licence"):
        assert spans(text) == [("mit", 1, 4, 2)], text
    assert [spans(t) for t in ("under the mit lisense", "under the mit license")] == [[("mit", 1, 4, 1)], [("mit", 1, 4, 0)]]
    assert spans("undr te mit licence") == spans("under the mti license") == []


def test_preference_pairs(rows):
    data = [(1, s, t, r, x) for s, turns in {
        "chosen": [(0, "user", "hi"), (1, "assistant", "é"), (2, "user", "so"), (3, "assistant", "yes")],
        "rejected": [(0, "user", "hi"), (1, "assistant", "é"), (2, "user", "so"), (3, "assistant", None)]}.items() for t, r, x in turns]
    data += [(2, "chosen", 0, "user", "a"), (3, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", "a"), (None, "chosen", 0, "user", "a")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(rows(data, "pair_id bigint, side string, turn int, role string, text string")).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi\n<|assistant|>\né\n<|user|>\nso\n" and one["prompt_turns"] == 3
    assert (one["chosen"], one["rejected"]) == ("<|assistant|>\nyes\n", "<|assistant|>\n\n")
    span = one["chosen_mask"][0]
    assert one["chosen"][span["start"] : span["end"]] == "yes\n"
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (0, "<|user|>\na\n", "")
    assert (got[3]["prompt_turns"], got[3]["chosen"], got[3]["rejected"], got[3]["chosen_mask"]) == (1, "", "", [])


TEXTS = [None, "", " ", "a<|endoftext|>b  \n\n c", "  x\t y ́e ’s 'S'll 123 ÀÉ中文\U0001f600", "Σίσυφος ΑΣ. İx ﬁ é\x1cd\x0be\xa0f", "word " * 3000, "\n a"]


def test_token_counts(rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_count.count_tokens(rows(list(enumerate(TEXTS)), "doc_id bigint, text string"), path).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(tok.encode(t or "", add_special_tokens=False).ids), len((t or "").encode()))


def test_packing(rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = TEXTS + ["a b c " * (7 * i % 900) for i in range(60)] + ["q " * 2047]
    got = packing.pack_documents(rows(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == i)
        at = 0
        for start, n, crc, whole in pieces:
            assert (start, whole) == (at, len(ids)) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
        used += at
    assert len(sequences) == -(-used // 2048)
    assert packing.pack_documents(rows([], "doc_id bigint, text string"), path).count() == 0


def test_leaks(rows, words):
    items = [(i, passage(words, 500 + i, 20 + 3 * i)) for i in range(12)] + [(90, None), (91, "")]
    docs = [(i, passage(words, i, 150)) for i in range(40)]
    docs += [(100 + i, passage(words, 200 + i, 70 * i) + " " + items[i][1].upper().replace(" ", "\n") + " " + passage(words, 300 + i, 45)) for i in range(12)]
    body = items[6][1].split(" ")
    changed = [w if i % 3 or i > len(body) - 6 else "zzz" for i, w in enumerate(body)]
    docs += [(200, passage(words, 700, 80) + " " + " ".join(changed)), (201, None), (202, ""), (203, " ".join(reversed(body)))]
    found = decontaminate.leaks(rows(docs, "doc_id bigint, text string"), rows(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {*((100 + i, i) for i in range(12)), (200, 6)}
    assert decontaminate.leaks(rows(docs, "doc_id bigint, text string"), rows([], "item_id bigint, text string")).count() == 0
    assert decontaminate.leaks(rows([], "doc_id bigint, text string"), rows(items, "item_id bigint, text string")).count() == 0


def test_leaks_whatever_words_are_common(rows, words):
    """Copies make the item's words common, and rare words stand around the item elsewhere; items of any length."""
    items = [(i, passage(words, 900 + i, n)) for i, n in enumerate((20, 3, 600, 64, 65, 1))]
    docs = [(1000 + k, passage(words, 40, 30) + " " + items[0][1]) for k in range(60)]
    docs += [(2000 + k, items[0][1] + f" copy{k}") for k in range(60)]
    docs += [(i, " ".join(f"rare{i}x{k}" for k in range(37 + 5 * i)) + " " + items[i][1] + " " + " ".join(f"seldom{i}x{k}" for k in range(41))) for i in range(6)]
    docs += [(50, passage(words, 41, 30))]
    found = decontaminate.leaks(rows(docs, "doc_id bigint, text string"), rows(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    want = {(d, i) for d, t in docs for i, item in items if f" {item} " in f" {t} "}
    assert {*((i, i) for i in range(6)), *((d, 0) for d in (1000, 1059, 2000, 2059))} <= want <= got and (50, 0) not in got


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = corpus_pipeline.identified(spark, docs.union(docs.limit(1).select((F.col("doc_id") - 9).alias("doc_id"), F.lit("1 2").alias("text"), "lang", "source", "n_chars")), SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    one = corpus_pipeline.deduplicated(spark, docs, SF)
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    ids = sorted(sets)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[ids[i]] and 100 * len(sets[ids[i]] & sets[ids[j]]) >= 80 * len(sets[ids[i]] | sets[ids[j]])]
    root = linked(links, len(ids))
    assert one.columns == docs.columns and sorted(r[0] for r in one.select("doc_id").collect()) == [d for i, d in enumerate(ids) if root[i] == i]
    clean = corpus_pipeline.decontaminated(spark, docs, SF)
    items = [" ".join(r[0].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    gone = {r["doc_id"] for r in docs.collect() if any(t in " ".join(r["text"].split()) for t in items)}
    assert {r[0] for r in docs.select("doc_id").subtract(clean.select("doc_id")).collect()} == gone
