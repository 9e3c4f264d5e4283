"""Whole-document packing, structure repair and whitening against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rentroll.llm import grouping, packing, queries, structure_repair, whitening

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- packing of whole documents ----------------------------------------------


def fill(counts, capacity):
    """The plan's sequences as lists of lengths; fails on a gap, an overlap or an overfull sequence."""
    steps, held = grouping.plan(counts, capacity), {}
    for length in np.flatnonzero(counts).tolist():
        n = int(counts[length])
        for s, at in zip(*(a.tolist() for a in grouping.place(steps, np.full(n, length), np.arange(n))), strict=True):
            held.setdefault(s, []).append((at, length))
    for places in held.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= capacity
    assert sorted(held) == list(range(len(held)))
    return held


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        able = [r for r in rooms if r >= n]
        room = min(able) if able else capacity
        if able:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


@pytest.mark.parametrize("low, high, n", [(1, 200, 400), (34, 99, 500), (60, 71, 300), (1, 9, 300), (100, 101, 5), (7, 8, 1)])
def test_plan_places_all(low, high, n):
    lengths = np.random.default_rng(n).integers(low, high, n)
    held = fill(np.bincount(lengths, minlength=202), 201)
    assert -(-int(lengths.sum()) // 201) <= len(held) <= best_fit(lengths.tolist(), 201)


def test_configurations_reach_the_optimum():
    # 60 items of 70 and 60 of 31 in 201: two of 70 with two of 31 need 30 sequences; longest first alone needs more
    counts = np.zeros(202, np.int64)
    counts[70], counts[30] = 60, 60
    assert len(fill(counts, 201)) == 30
    value, pick = grouping.fullest(201, np.array([70, 30]), np.array([0.4, 0.1]))
    assert pick.tolist() == [2, 2] and abs(value - 1.0) < 1e-9


def test_plan_of_nothing():
    assert grouping.plan(np.zeros(202, np.int64), 201).shape == (0, 6)


@lru_cache
def tokenizer():
    return Tokenizer.from_file(WORDS)


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [grouping.END_ID]


def test_whole_packing(rows):
    texts = [None, "", "one", "one", "word " * 5000, "b " * 2046, "b " * 2047, "b " * 2048, "x" * 3000, "Ünï 中文 <|endoftext|> it's"]
    texts += [" ".join(random.Random(i).choices(["ab", "cat", "the", "zq"], k=i * 13)) for i in range(60)]
    data = [(i if i else None, t, "extra", 1) for i, t in enumerate(texts)] + [(2, "one", "extra", 1)]
    found = grouping.pack_whole(rows(data, "doc_id bigint, text string, piece string, length int"), WORDS).collect()
    want = []
    for i, t, *_ in data:
        ids = ids_of(t)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i or -1, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"] or -1, *r[1:5]) for r in found) == sorted(want)
    held = {}
    for r in found:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(held) <= best_fit([w[3] for w in want], 2048)
    assert grouping.pack_whole(rows([], "doc_id bigint, text string"), WORDS).count() == 0


def test_words_store_starts_over(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "KEPT_BYTES", 500)
    monkeypatch.setattr(packing, "SLICE_BYTES", 64)
    words = packing.WordIds(WORDS)
    texts = [None if i % 7 == 0 else "".join(random.Random(i).choices("abÀµ 's\n\t1.中<|>Z", k=i % 50)) for i in range(300)]
    texts.append("<|endoftext|>a <|startoftext|>")
    got = list(packing.encoded(words, pa.array(texts)))
    assert [g.tolist() for g in got] == [ids_of(t)[:-1] for t in texts]


# --- structure repair --------------------------------------------------------


def plain_repair(turns):
    """Cost, audit and repaired turns by recursion over the whole conversation, comparing whole strings."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "twice" if (role, text) in seen else "" if bare[-1] in ".!?" else "cut")
        seen.add((role, text))
    then = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def least(i, state, new):
        found = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        if new < 3:
            role = "assistant" if state == 2 else "user"
            cost, audit, out = least(i, then[state, role[0]], new + 1)
            found.append((cost + 5, "I" + audit, ((role, ""), *out)))
        if i < len(turns):
            _, role, text = turns[i]
            cost, audit, out = least(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, out))
            if faults[i] in ("", "cut"):
                for edit, to, extra in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if (state, to[:1]) in then:
                        cost, audit, out = least(i + 1, then[state, to[:1]], 0)
                        found.append((cost + extra + 5 * (faults[i] == "cut"), edit + audit, ((to, text), *out)))
        return min(found) if found else (1 << 40, "", ())

    for i in range(len(turns), 0, -100):  # keeps the recursion shallow
        least(i, 0, 0)
    return faults, least(0, 0, 0)


def test_cheapest_edits():
    rng = random.Random(5)
    symbols = {(k, f): structure_repair.SYMBOLS["sua-".index(k) + 4 * f] for k in "sua-" for f in range(4)}
    for _ in range(300):
        n = rng.randint(0, 14)
        turns = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", " \n", "a.", f"x{i}.", f"y{i}", "b"])) for i in range(n)]
        faults, (cost, audit, _) = plain_repair(turns)
        coded = "".join(symbols[r[0] if r[0] in "sua" else "-", ["", "cut", "blank", "twice"].index(f)] for (_, r, _), f in zip(turns, faults, strict=True))
        assert structure_repair.cheapest(coded) == (cost, audit)


def test_cheapest_of_a_long_conversation():
    """Checkpoints and blocks give what one table of all vectors gives."""
    rng = random.Random(6)
    coded = "".join(rng.choices(structure_repair.SYMBOLS, k=3000))
    cost, audit = structure_repair.cheapest(coded)
    state, paid, at = 0, 0, 0
    for edit in audit:
        if edit == "I":
            state, paid = structure_repair.DUE[state][1], paid + 5
            continue
        _, c, state = next(e for e in structure_repair.CHOICES[coded[at]][state] if e[0] == edit)
        paid, at = paid + c, at + 1
    assert paid == cost and at == 3000 and state in (0, 3)
    costs = structure_repair.inserted([0, 1 << 60, 1 << 60, 0])
    for s in reversed(coded):
        costs = structure_repair.before(s, costs)
    assert costs[0] == cost


def report(turns):
    faults, (cost, audit, out) = plain_repair(turns)
    numbers = [t for t, _, _ in turns if t is not None]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, "blank": faults.count("blank"),
        "duplicate": faults.count("twice"), "truncated": faults.count("cut"),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def damage(data):
    out = {}
    for conv, turn, role, text in data:
        turns = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    return out


def test_structure_report(rows, monkeypatch):
    monkeypatch.setattr(structure_repair, "BLOCK_TURNS", 7)
    rng = random.Random(8)
    data = [(c, t, rng.choice(["system", "user", "assistant", "assistant", "tool", "", None]),
             rng.choice([None, "", " \t", "Yes.", "No", f"t{t}!", "é? \n", f"{c}.{t}."]))
            for c in range(30) for t in rng.sample(range(40), rng.randint(1, 12))]
    data += [(None, t, "user", "word. " * t) for t in range(300)] + [(77, None, "user", "a."), (77, None, "assistant", "b."), (78, 1, "user", "x" * 200_000)]
    data += data[:40]
    dropped = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    data.append((dropped, 0, "user", "gone."))
    table = rows([(*d, 1) for d in data], "conv_id bigint, turn bigint, role string, text string, cost int")
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in
           structure_repair.structure_report(table, structure_repair.damaged(table)).collect()}
    assert got == {c: report(tuple(t)) for c, t in damage(data).items()}
    assert got[dropped]["audit"] == "" and got[dropped]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    turns = structure_repair.repaired_turns(structure_repair.damaged(table)).collect()
    for conv in (None, 3, 77):
        mine = sorted((r for r in turns if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == got[conv]["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine))


def test_structure_report_of_nothing(rows):
    table = rows([], "conv_id bigint, turn bigint, role string, text string")
    assert structure_repair.structure_report(table, structure_repair.damaged(table)).collect() == []


# --- whitening ---------------------------------------------------------------


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    for d, rank in [(1, 1), (5, 5), (9, 4), (12, 12)]:
        a = rng.standard_normal((d, rank)) * 10.0 ** rng.integers(-2, 3, rank)
        scatter = a @ a.T
        factor = whitening.cholesky(scatter)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, scatter, rtol=1e-12, atol=1e-12 * scatter.max())
        values, parts = whitening.jacobi(factor)
        want = np.sort(np.linalg.eigvalsh(scatter))[::-1][:rank]
        assert np.allclose(values, want, rtol=1e-9, atol=1e-12 * want[0]) and np.allclose(parts.T @ parts, np.eye(rank), atol=1e-9)
    assert whitening.cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_whitened(rows):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((200, 12)) * np.arange(1, 13) + 3.0
    vectors = [*base, base[0], base[0]]
    data = [(i if i != 5 else None, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [], 0), (902, [1.0] * 11 + [None], 0), (903, [float("nan")] * 12, 0), (904, [float("inf")] + [1.0] * 11, 0),
           (905, [1.0, 2.0], 0), (906, [1e300] + [1.0] * 11, 0)]
    got = whitening.whitened(rows(data + odd, "vec_id bigint, embedding array<double>, component int"), 8).collect()
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    values, parts = np.linalg.eigh(c.T @ c / n)
    values, parts = values[::-1], parts[:, ::-1]
    want = c @ parts[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = np.sign([by[1, k + 1]["whitened"] / want[1, k] for k in range(8)])
    for i, (key, *_) in enumerate(data):
        for k in range(8):
            r = by[key, k + 1]
            if i < 200:
                assert abs(r["whitened"] - signs[k] * want[i, k]) < 1e-9
                assert int(r["deviation"]) == int(((n * x[i] - sums) ** 2).sum()) and r["n"] == n
            assert abs(r["explained"] - values[k] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9


def test_deviations_beyond_long():
    x, n = np.array([[10**9, 7], [3, 10**9]]), 10**7
    sums = [4 * 10**15 + 3, 5 * 10**15 + 1]
    assert whitening.deviations(x, n, sums) == [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]


def test_whitened_without_variance(rows):
    schema = "vec_id bigint, embedding array<double>"
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whitened(rows(data, schema), 8).collect() == []
    line = whitening.whitened(rows([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)], schema), 8).collect()
    assert sorted({r["component"] for r in line}) == [1] and abs(line[0]["explained"] - 1) < 1e-12


def test_registered_on_small_tables(spark):
    packed = queries.op11_whole_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in packed) == sorted(
        (d["doc_id"], k, min(2048, n - at)) for d in docs for n in [len(ids_of(d["text"]))] for k, at in enumerate(range(0, n, 2048)))
    conversations = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op12_structure_repair(spark, SF).collect()}
    assert got == {c: report(tuple(t)) for c, t in damage(conversations).items()}
    white = queries.op13_whitening(spark, SF)
    assert dict(white.dtypes)["deviation"] == "bigint"
    assert white.count() == 8 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


# --- the pipeline's stages ---------------------------------------------------

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def kept(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in frame.collect())


def test_stages_judge_rows(spark, rows):
    prose = ["the cat sat on the mat and looked at the door for a while " + f"number {i} went by " * 3 for i in range(12)]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    data = [(i, t, None, "s", 1) for i, t in enumerate(prose)]
    data += [(None, prose[0], None, "s", 1), (None, "", None, "s", 1), (None, leak, None, "s", 1), (5, prose[5], None, "s", 1), (5, "12 34", None, "s", 1)]
    docs = rows(data, DOC)
    # nothing to learn from: only texts without a letter go, rows of the same id stay
    assert kept(corpus_pipeline.identified(spark, docs, SF)) == kept(rows([d for d in data if d[1] not in ("", "12 34")], DOC))
    once = corpus_pipeline.deduplicated(spark, docs, SF).collect()
    assert sum(r["text"] == prose[0] for r in once) == 1 and sum(r["text"] == prose[5] for r in once) <= 1
    assert sum(r["text"] == "" for r in once) == 1 and sum(r["text"] == leak for r in once) == 1
    clean = corpus_pipeline.decontaminated(spark, docs, SF)
    assert kept(clean) == kept(rows([d for d in data if d[1] != leak], DOC))
    none = rows([], DOC)
    for stage in (corpus_pipeline.identified, corpus_pipeline.deduplicated, corpus_pipeline.decontaminated):
        empty = stage(spark, none, SF)
        assert empty.columns == docs.columns and empty.count() == 0
