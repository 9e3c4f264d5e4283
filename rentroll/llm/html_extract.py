"""Main text of web pages by template deduction from occurrence vectors.

A page is a list of tokens: its tags and its text blocks, told apart by the path of open elements around them. Copies of
a page count once, empty pages not at all. Pages of a host whose outer elements are the same are a layout; a layout with
too few pages for a template of its own has that of the whole host. A token on SHARE of the pages belongs to the
template: a path that stands once on so many is a slot, a text outside a lone article is fixed. Slots nest by path; the
order of tokens is not looked at, and classes of equal vectors are not formed, since a token's own vector decides.

The main slot is the innermost that holds nearly all text outside menus, forms, adverts and the like; an article or main
element among the slots takes that part where it holds half of it. The text is what stands in the main slot, less fixed
text. Where most text is fixed, the pages are copies but for little: then nothing is taken for fixed.
A page without a template, or without text in the main slot, is its article or main element if that holds half of the
text, and else all text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentroll.session import durable

SUPPORT = 3  # distinct pages from which a template is told
SHARE = 0.8  # of these, pages that must hold a token of the template
MASS = 0.9  # share of the open text that the main slot must hold
HALF = 0.5  # share that an article must hold, and the most that may be fixed
OUTER = 3  # elements of a path that tell layouts apart

#: Fixed values of HTML and MathML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder "
                   "mover munderover mtable mtr mtd mstyle mpadded mphantom mspace menclose merror mmultiscripts mprescripts semantics".split())
#: Elements that are left out where they stand, within a line of text too: those whose content is no markup, those that
#: show nothing of it, and those that show something else than text.
UNPARSED = frozenset("script style noscript title textarea iframe".split())
UNSEEN = frozenset("script style noscript title template annotation annotation-xml".split())
SEEN = frozenset("textarea iframe svg object canvas audio video select button".split())
#: Elements, and words in class, id or role, that hold no article text.
ASIDE = frozenset("nav footer aside form dialog menu head".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments respond reply "
    "replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination "
    "pager widget toolbar skip contentinfo complementary".split())
#: Words that say nothing beside a marked one, and words of an article's own parts.
PLAIN = frozenset("area bar bottom box block body buttons container content form global group header holder icons inner items js left links "
                  "list main o outer page panel posts primary right row section site slot small the title top unit wrap wrapper zone".split())
OWN = frozenset("article content entry post prose story".split())

#: One tag, comment or run of text. Nothing that has matched is given back, so a match costs no more than its length.
_LEX = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>"""
    r"""|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>|(?P<text>[^<]++)""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>=]*+")
_EQUALS = re.compile(r"=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_NAMING = re.compile("class|id|role", re.I)
_ATTR = re.compile(r"""([^\s=>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_ENDS = {n: re.compile(f"</{n}(?![^\\s/>])" if n in UNPARSED else f"<(/?){n}(?![^\\s/>])", re.I | re.A) for n in UNPARSED | UNSEEN | SEEN}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
DEEP = 128  # open elements that are told apart; what stands deeper counts to the last of them
LONGEST_NAME = 32  # of an element in a path


def marked(name: str) -> bool:
    """Whether a class, id or role names what is not article text: all its words do, but for plain ones."""
    words = _WORD.findall(name.lower())
    return any(w in MARKED for w in words) and all(w in MARKED or w in PLAIN for w in words)


def aside(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element holds no article text; an article's own header holds its heading. The class of an article's own
    part outweighs other names beside it."""
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if name in ("article", "main", "body", "html") or not _NAMING.search(attrs):
        return False
    names = [n for attr, x, y, z in _ATTR.findall(attrs) if attr.lower() in ("class", "id", "role") for n in (x or y or z).split()]
    return any(marked(n) for n in names) and not any(n.lower() in OWN for n in names)


def lexed(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end) of a page's tags and texts: kind is 'open', 'close' or 'text'.

    A quoted value begins after an equals sign only, and a quote that nothing closes is a character like others. A tag cut
    off by the end of the page shows nothing, up to the next sign that could open one. The caller may send the place to go
    on from. A page is gone through forwards, and a second time at most: once a tag's quotes have reached over the rest of
    the page, tags end at the first sign that could end them.
    """
    at, last, careful, quoting = 0, page.rfind(">"), False, True
    unclosed = {'"': len(page), "'": len(page)}  # behind this place no such quote follows

    def tag_end(at: int) -> int:
        while True:
            at = _PLAIN.match(page, at).end()
            if at == len(page) or page[at] == ">":
                return at
            at = _EQUALS.match(page, at).end()
            quote, end = page[at : at + 1], -1
            if quote in ('"', "'") and at < unclosed[quote]:
                end = page.find(quote, at + 1)
                if end < 0:
                    unclosed[quote] = at
            at = end + 1 if end >= 0 else _BARE.match(page, at).end()

    while at < len(page):
        hard = page[at] == "<" and (careful or at > last) and not page.startswith("<!--", at)
        found = None if hard and (at > last or _NAME.match(page, at)) else _LEX.match(page, at)
        if found:
            at = found.end()
            if not (found["name"] or found["text"]):
                continue
            one = ("text", found["text"], "", at) if found["text"] else (
                "close" if found["close"] else "open", found["name"].lower(), found["attrs"], at)
        else:
            named = _NAME.match(page, at)
            if named and at > last:
                at = page.find("<", at + 1)
                if at < 0:
                    return
                continue
            if named:
                careful = True
                end = tag_end(named.end()) if quoting else len(page)
                if end == len(page):
                    quoting, end = False, page.find(">", named.end())
                one = ("close" if page[at + 1] == "/" else "open", named[1].lower(), page[named.end() : end], end + 1)
            else:
                one = "text", "<", "", at + 1
            at = one[3]
        sent = yield one
        if sent is not None:
            at = sent
            yield one


def skipped(page: str, name: str, start: int, missing: set[str]) -> int | None:
    """Where an element that is left out ends, if begun before ``start``; None if nothing ends it. ``missing`` keeps the
    names that no end tag follows for. Elements whose content is markup may hold others of their name."""
    if name in missing:
        return None
    end, inner = None, 1
    for m in _ENDS[name].finditer(page, start):
        if name in UNPARSED or m[1]:
            end, inner = m.end(), inner - 1
            if not inner:
                break
        else:
            inner += 1
    if end is None or inner > 0:
        missing.add(name)  # behind the last end tag there is no other
    if end is None:
        return None
    close = page.find(">", end)
    return len(page) if close < 0 else close + 1


def parse(page: str | None) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, path, text, aside, in article) in page order; kind is 'tag' or 'block'.

    A block is the text between two tags that are not inline, with references decoded and white space joined. Unclosed
    elements end with the element around them, or where another of the same kind begins. What stands in a line without
    being text of it, as scripts, drawings and buttons, is left out without ending the block; where its end is missing, a
    script or style reaches to the end of the page and others hold nothing. Time is in proportion to the page's length.
    """
    page = page or ""
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, path, aside, in article, aside of the block around it
    opened: dict[str, int] = {}  # how many elements of a name are on the stack
    deeper: dict[str, int] = {}  # and how many are open beyond it
    held: list[str] = []
    cut = -1  # where in held the marked inline element began that is open
    hidden: tuple[str, int] | None = None  # the aside that is open beyond the stack
    missing: set[str] = set()

    def push(*entry) -> None:
        nonlocal hidden
        name = entry[0]
        if len(stack) < DEEP:
            stack.append(entry)
            opened[name] = opened.get(name, 0) + 1
        else:
            deeper[name] = deeper.get(name, 0) + 1
            if entry[2] and hidden is None:
                hidden = name, deeper[name]

    def drop(i: int) -> None:
        nonlocal hidden
        for entry in stack[i:]:
            opened[entry[0]] -= 1
        del stack[i:]
        if len(stack) < DEEP:
            deeper.clear()
            hidden = None

    def close_deeper(name: str) -> None:
        nonlocal hidden
        if hidden == (name, deeper[name]):
            hidden = None
        deeper[name] -= 1

    def block() -> Iterator[tuple[str, str, str, bool, bool]]:
        nonlocal cut
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held[:cut] if cut >= 0 else held))).strip()
            held.clear()
            cut = min(cut, 0)
            if text:
                _, path, _, inside, off = stack[-1] if stack else ("", "", False, False, False)
                yield "block", path, text, off or hidden is not None, inside

    tokens = lexed(page)
    for kind, name, attrs, end in tokens:
        if kind == "text":
            if not (stack and stack[-1][4] and name.isspace()):
                held.append(name)
            continue
        empty = name in VOID or attrs.endswith("/")
        if name in UNSEEN or name in SEEN:
            if name in SEEN:
                held.append(" ")
            if kind == "open" and not empty:
                to = skipped(page, name, end, missing)
                if to is None and name in ("script", "style"):
                    to = len(page)
                if to is not None:
                    tokens.send(to)
            continue
        name = name[:LONGEST_NAME]
        if name == "br":
            held.append(" ")
        if name in INLINE and kind == "open":
            if not empty:
                _, path, off, inside, block_off = stack[-1] if stack else ("", "", False, False, False)
                out = not off and cut < 0 and len(stack) < DEEP and aside(name, attrs, inside)
                if out:
                    cut = len(held)
                push(name, path, off or out, inside, block_off)
            continue
        if name in INLINE:
            if deeper.get(name):
                close_deeper(name)
            elif opened.get(name):
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                ends_cut = cut >= 0 and stack[i][2] and not (stack[i - 1][2] if i else False)
                opened[name] -= 1
                del stack[i]
                if ends_cut:
                    del held[cut:]
                    cut = -1
            continue
        yield from block()
        if kind == "close":
            if deeper.get(name):
                close_deeper(name)
            elif opened.get(name):
                drop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                cut = -1
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            stop = {"li": ("ul", "ol", "menu"), "td": ("tr",), "th": ("tr",), "tr": ("table", "tbody", "thead")}.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    drop(i)
                    break
                if stack[i][0] in stop or (name == "p" and stack[i][0] not in INLINE):
                    break
        elif stack and name not in VOID:
            i = len(stack) - 1
            while i >= 0 and stack[i][0] in INLINE:
                i -= 1
            if i >= 0 and stack[i][0] == "p":  # a block element ends a paragraph
                drop(i)
        i = len(stack)
        while i and stack[i - 1][0] in INLINE:  # inline elements left open do not reach into other blocks
            i -= 1
        drop(i)
        cut = -1
        _, path, off, inside, _ = stack[-1] if stack else ("", "", False, False, False)
        path = f"{path}/{name}" if len(stack) < DEEP else path
        off = off or aside(name, attrs, inside)
        inside = inside or name in ("article", "main")
        yield "tag", path, "", off, inside
        if not empty:
            push(name, path, off, inside, off)
    yield from block()


def host_of(url):
    """The host of a url column, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


PARSED = ("page bigint, url string, host string, layout bigint, print bigint, "
          "tokens array<struct<path:string,text:bigint,n:bigint,mass:bigint>>, "
          "blocks array<struct<path:string,key:bigint,text:string,inside:boolean>>, article boolean")


def hashed(parts: Iterator[str]) -> int:
    whole = hashlib.blake2b(digest_size=8)
    for part in parts:
        whole.update(part.encode("utf-8", "surrogatepass") + b"\0")
    return int.from_bytes(whole.digest(), "big", signed=True)


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, host, html) as the page's layout and fingerprint, its tokens outside asides, its blocks, and whether an
    article or main element holds half of its text. A token is a path, or a text block under a hash of path and text."""
    token = pa.list_(pa.struct([("path", pa.string()), ("text", pa.int64()), ("n", pa.int64()), ("mass", pa.int64())]))
    piece = pa.list_(pa.struct([("path", pa.string()), ("key", pa.int64()), ("text", pa.string()), ("inside", pa.bool_())]))
    for batch in batches:
        layouts, prints, tokens, blocks, article = [], [], [], [], []
        for source in batch.column(3):
            counted: dict[tuple[str, int | None], list[int]] = {}
            masses: dict[str, int] = {}
            kept, held, whole, articles = [], 0, 0, 0
            for kind, path, text, off, inside in parse(source.as_py()):
                if off:
                    continue
                if kind == "tag":
                    counted.setdefault((path, None), [0, 0])[0] += 1
                    around = path.split("/")
                    articles += around[-1] in ("article", "main") and not {"article", "main"} & set(around[:-1])
                    continue
                kept.append({"path": path, "key": hashed((path, text)), "text": text, "inside": inside})
                whole += len(text)
                held += len(text) * inside
                masses[path] = masses.get(path, 0) + len(text)
            for path, mass in masses.items():
                while path:
                    counted.setdefault((path, None), [0, 0])[1] += mass
                    path = path.rpartition("/")[0]
            paths = sorted(f"{p} {n}" for (p, _), (n, _) in counted.items())
            layouts.append(hashed(sorted(p for p, _ in counted if p.count("/") <= OUTER)))
            prints.append(hashed([*paths, "", *(f"{b['path']} {b['text']}" for b in kept)]))
            for b in kept:
                if not b["inside"] or articles != 1:
                    one = counted.setdefault((b["path"], b["key"]), [0, 0])
                    one[0] += 1
                    one[1] += len(b["text"])
            tokens.append([{"path": p, "text": t, "n": n, "mass": m} for (p, t), (n, m) in counted.items()])
            blocks.append(kept)
            article.append(held > 0 and held >= HALF * whole)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(layouts, pa.int64()), pa.array(prints, pa.int64()),
             pa.array(tokens, token), pa.array(blocks, piece), pa.array(article, pa.bool_())],
            names=["page", "url", "host", "layout", "print", "tokens", "blocks", "article"])


def template(table: pa.Table) -> pa.Table:
    """The template's tokens of one layout, at most some more than a page's, as its main slot and fixed texts."""
    rows = table.select(["path", "text", "slot", "mass"]).to_pylist()
    fixed = [r for r in rows if r["text"] is not None]
    paths = [r for r in rows if r["text"] is None]
    whole = max((r["mass"] for r in paths), default=0)
    differ = sum(r["mass"] for r in fixed) <= HALF * whole  # else the pages are copies but for little
    by_path: dict[str, int] = {}
    for r in fixed if differ else []:
        path = r["path"]
        while path:
            by_path[path] = by_path.get(path, 0) + r["mass"]
            path = path.rpartition("/")[0]
    open_ = {r["path"]: r["mass"] - by_path.get(r["path"], 0) for r in paths}
    most = max(open_.values(), default=0)
    slots = [r["path"] for r in paths if r["slot"] and most]
    named = [p for p in slots if p.rpartition("/")[2] in ("article", "main") and open_[p] >= HALF * most]
    held = named or [p for p in slots if open_[p] >= MASS * most]
    main = max(held, key=lambda p: (p.count("/"), open_[p], p), default=None)
    return pa.table({"host": table["host"][:1], "layout": table["layout"][:1], "main": pa.array([main], pa.string()),
                     "fixed": pa.array([[r["text"] for r in fixed] if differ else []], pa.list_(pa.int64()))})


def templates(pages: DataFrame) -> DataFrame:
    """Parsed pages as (host, layout, main, fixed): path of the main slot and the template's fixed texts; the layout is
    NULL for the template of all pages of the host.

    Occurrence vectors are never gathered: of a vector only the number of its pages counts, which partial aggregation
    adds up before any shuffle, so a host of any size is one row for each of its tokens. Layouts and hosts with fewer than
    SUPPORT distinct pages have no row.
    """
    once = pages.filter(F.size("tokens") > 0).select("host", "layout", "print", "tokens").dropDuplicates(["host", "layout", "print"])
    both = once.select("host", F.explode(F.array("layout", F.lit(None).cast("bigint"))).alias("layout"), "tokens")
    vectors = both.select("host", "layout", F.explode("tokens").alias("t")).select("host", "layout", "t.*").groupBy(
        "host", "layout", "path", "text").agg(F.count("*").alias("support"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum("mass").alias("mass"))
    counts = both.groupBy("host", "layout").agg(F.count("*").alias("pages")).filter(F.col("pages") >= SUPPORT)
    counts = counts.select(F.col("host").alias("_host"), F.col("layout").alias("_layout"), "pages")
    valid = vectors.join(counts, (F.col("host") == F.col("_host")) & F.col("layout").eqNullSafe(F.col("_layout")))
    valid = valid.filter(F.col("support") >= SHARE * F.col("pages")).select(
        "host", "layout", "path", "text", (F.col("once") >= SHARE * F.col("pages")).alias("slot"), "mass")
    return valid.groupBy("host", "layout").applyInArrow(template, "host string, layout bigint, main string, fixed array<bigint>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages as (id, url, text, n_chars), one row per input row.

    A NULL or empty html has an empty text; a NULL or odd url has the empty host, whose pages share a template too.
    Repeated rows stay; nothing is cut. n_chars counts code points. Other columns are not read. An empty table gives an empty
    one. Elements deeper than DEEP count to the last one above them.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].cast("string").alias("url"),
                        host_of(pages[url_col].cast("string")).alias("host"), pages[html_col].cast("string").alias("html"))
    known_pages = durable(rows.mapInArrow(parsed, PARSED), "parsed-pages")
    # stored, so that its size is known: the planner broadcasts it below its threshold and else joins by host
    known = durable(templates(known_pages.select("host", "layout", "print", "tokens")), "templates")
    own = known.filter("layout is not null").withColumnRenamed("main", "own_main").withColumnRenamed("fixed", "own_fixed")
    general = known.filter("layout is null").select("host", "main", "fixed")
    both = known_pages.select("page", "url", "host", "layout", "blocks", "article").join(own, ["host", "layout"], "left").join(general, "host", "left")
    has_own = F.col("own_fixed").isNotNull()
    main = F.when(has_own, F.col("own_main")).otherwise(F.col("main"))
    fixed = F.coalesce("own_fixed", "fixed", F.array().cast("array<bigint>"))
    both = both.select("page", "url", "blocks", "article", main.alias("main"), fixed.alias("fixed"))

    def in_main(b):
        return F.coalesce((b["path"] == F.col("main")) | F.startswith(b["path"], F.concat("main", F.lit("/"))), F.lit(False))

    def open_(b):
        return F.when(F.col("slotted"), in_main(b) & ~F.array_contains("fixed", b["key"])).when(F.col("article"), b["inside"]).otherwise(
            ~F.array_contains("fixed", b["key"]))

    both = both.withColumn("slotted", F.exists("blocks", in_main))
    text = F.array_join(F.transform(F.filter("blocks", open_), lambda b: b["text"]), "\n\n")
    return both.select(F.col("page").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
