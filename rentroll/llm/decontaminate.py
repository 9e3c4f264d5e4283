"""Benchmark decontamination by latent semantic retrieval.

Texts are TF-IDF vectors over hashed words, document frequencies being counted over distinct texts; every word weighs
something. An item of more than WHOLE words is several probes, overlapping passages of two strides; any other is one
probe. Every document is cut into strides, and two strides are a passage.

The topics are a randomised singular value decomposition of all passages of the distinct texts. Each passage is added,
with a sign, to one of SKETCH rows; tasks add their rows up on Spark, and the TOPICS leading right singular vectors of
the sum approximate those of the passages. Words stand there in LATENT columns, each with a sign of its own. Passages and
probes are folded into the topics, and the text around a passage is a candidate if its cosine there reaches NEAR.

Words that say little in the topics must not hide a copy. So a second space is made for each block of up to RANK probes,
by a randomised decomposition of the probes of as many dimensions as they span. There a place is a candidate if a passage
reaches the cosine CANDIDATE with a probe, or if a run of strides long enough for the probe wherever it begins holds
CONTAINED of the probe's weight. A verbatim probe is held whole, whatever words stand around it, so no verbatim item is missed. There the longest
common subsequence of words decides: with LEAK of the item's words in order it is a leak, and with PARAPHRASE of them
if the item's answer stands in it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentroll.llm.sketch import chunk_rows, collected
from rentroll.llm.words import mixed, separators, slices, word_hashes

FEATURES = 1 << 18  # hashed words
RANK = 256  # dimensions of a latent space, and probes that share one
OVERSAMPLE, POWERS = 16, 2
LATENT = 1 << 13  # columns of the passages that are decomposed, a power of two
SKETCH, TOPICS = 128, 112  # rows that the passages are added to, and leading vectors kept of them
NEAR = 0.8  # cosine in the topics
FAINT = 0.25  # weight of a word that every text holds; rarer ones weigh more
STRIDE = 16  # words; a passage is two strides long
WHOLE = 64  # words of the longest item that is one probe
CANDIDATE = 0.35
CONTAINED = 0.8
LEAK, PARAPHRASE = 0.8, 0.5
ANSWER_WORDS = 5  # the end of an item stands for its answer where the benchmark has none
PROBES_AT_ONCE = 4096  # probes whose spaces are sent to the executors together; more probes take more passes
#: All bytes but digits, ASCII letters and bytes over 127.
APART = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_U = np.uint64


def features(words: np.ndarray) -> np.ndarray:
    return (words >> _U(46)).astype(np.int64)


def columns(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, sign) of features among the passages that are decomposed."""
    h = mixed(f.astype(_U))
    return (h % _U(LATENT)).astype(np.int64), np.where(h >> _U(63), 1, -1)


def strides_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each stride, its first word, first stride of each row and after the last)."""
    strides = -(-np.diff(bounds) // STRIDE)
    row_of = np.repeat(np.arange(len(strides)), strides)
    first = np.concatenate(([0], np.cumsum(strides)))
    return row_of, bounds[row_of] + STRIDE * (np.arange(len(row_of)) - first[row_of]), first


def add_passages(sketch: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> None:
    """Adds the word counts of every passage, each word in one, to a row of the sketch (SKETCH * LATENT).

    Row and sign are drawn by the whole text and the passage's place in it, so passages that many texts share do not
    all meet in one row."""
    lengths = np.diff(bounds)
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    up_to = np.concatenate((np.zeros(1, _U), np.cumsum(words, dtype=_U)))
    place = (np.arange(len(words)) - bounds[row_of]) // (2 * STRIDE)
    draw = mixed((up_to[bounds[1:]] - up_to[bounds[:-1]])[row_of] + mixed(place.astype(_U) + _U(1)))
    column, sign = columns(features(words))
    np.add.at(sketch, (draw % _U(SKETCH)).astype(np.int64) * LATENT + column, np.where(draw >> _U(63), sign, -sign))


def measured(rows: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    """(texts that hold each feature, texts, sketch of their passages) over the distinct texts of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES + 1 + SKETCH * LATENT, np.int64)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(0)):
                words, bounds = word_hashes(data, offsets, APART)
                row = np.repeat(np.arange(high - low), np.diff(bounds))
                pairs = np.sort(row * FEATURES + features(words))
                if len(pairs):
                    once = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
                    np.add.at(counts, once % FEATURES, 1)
                    add_passages(counts[FEATURES + 1 :], words, bounds)
            counts[FEATURES] += batch.num_rows
        parts = chunk_rows(counts)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
                                             names=["chunk", "part"])

    texts = rows.select("text").filter("text is not null").distinct()  # copies would make an item's own words common
    total = collected(texts.mapInArrow(run, "chunk int, part binary"), FEATURES + 1 + SKETCH * LATENT, "<i8")
    return total[:FEATURES].copy(), int(total[FEATURES]), total[FEATURES + 1 :].reshape(SKETCH, LATENT)


class Topics:
    """The leading right singular vectors of the passages: ``basis`` (columns, topics), by weighted columns."""

    def __init__(self, sketch: np.ndarray, held: np.ndarray, texts: int):
        known = np.flatnonzero(held)
        in_column = np.bincount(columns(known)[0], held[known], LATENT).clip(max=texts)
        weight = FAINT + np.log((1.0 + texts) / (1.0 + in_column))
        weighted = sketch * weight
        values, vectors = np.linalg.eigh(weighted @ weighted.T)
        keep = np.argsort(values)[::-1][:TOPICS]
        keep = keep[values[keep] > 1e-9 * max(1e-300, values.max())]
        basis = weighted.T @ (vectors[:, keep] / np.sqrt(values[keep]))
        # words are folded as counts; each topic counts alike, whatever its share of the passages
        basis = (basis * weight[:, None] / np.sqrt(values[keep])).astype(np.float32)
        self.basis = np.concatenate([basis, -basis, np.zeros((1, basis.shape[1]), np.float32)])  # by sign; none

    def folded(self, f: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The topics of strides of features, which begin where told and lie one after the other."""
        out = np.empty((len(begin), self.basis.shape[1]), np.float32)
        column, sign = columns(f)
        stride = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(f))))
        words = np.full((len(begin), STRIDE), 2 * LATENT)  # short strides are filled with no word
        words[stride, np.arange(len(f)) - begin[stride]] = column + LATENT * (sign < 0)
        for low in range(0, len(begin), 512):
            some = words[low : low + 512].T
            np.take(self.basis, some[0], axis=0, out=out[low : low + 512])
            for word in some[1:]:
                out[low : low + 512] += self.basis[word]
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


class Item:
    def __init__(self, item_id: int, words: np.ndarray, answer: list[int]):
        self.item_id, self.words, self.answer = item_id, words.tolist(), answer
        self.known, self.times = np.unique(words, return_counts=True)


def probes(words: np.ndarray) -> list[np.ndarray]:
    """The passages of an item that are looked for; any of them found makes the item a candidate."""
    if len(words) <= WHOLE:
        return [words]
    return [words[at : at + 2 * STRIDE] for at in [*range(0, len(words) - 2 * STRIDE, STRIDE), len(words) - 2 * STRIDE]]


class Space:
    """The latent space of a block of probes, the widest first: ``basis`` (words of the block by weight, rank), the
    probes' unit ``vectors`` in it, their ``lengths`` before, the strides in which each lies ``wide``, and ``item_of``,
    their place in ``items``; ``slot`` gives a feature's row of the basis, ``near`` the probes' unit vectors in the topics.
    A word adds ``most`` at most to the product with any probe, and ``share`` at most to the part of a probe that is held."""

    def __init__(self, words: np.ndarray, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, wide: np.ndarray,
                 item_of: np.ndarray, items: list[Item], near: np.ndarray):
        self.basis = basis.astype(np.float32) * idf[words, None].astype(np.float32)
        self.vectors, self.lengths = vectors.astype(np.float32), lengths.astype(np.float32)
        gain = (self.basis @ self.vectors.T).clip(min=0)
        self.most, self.share = gain.max(1).astype(np.float64), (gain / self.lengths).max(1).astype(np.float64)
        self.wide, self.item_of, self.items, self.near = wide, item_of, items, near
        self.slot = np.full(FEATURES, -1, np.int32)
        self.slot[words] = np.arange(len(words))


def _rows(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, weights) of the unit TF-IDF vector of each probe."""
    for batch in batches:
        for raw in batch.column(0):
            f = np.frombuffer(raw.as_py(), np.int64)
            w = idf[f]
            yield np.searchsorted(vocabulary, f), w / np.sqrt((w * w).sum())


def latent_space(probes: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors (vocabulary, rank) of the probes' TF-IDF rows, by randomised range finding.

    Each pass multiplies the rows by a narrow matrix on the executors and adds the tasks' products; only matrices of
    the block's words by rank reach the driver, where they are made orthonormal.
    """
    spark = probes.sparkSession
    width = rank + OVERSAMPLE

    def product(narrow: np.ndarray, gram: bool) -> np.ndarray:
        held = spark.sparkContext.broadcast((vocabulary, idf, narrow))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, idf, narrow = held.value
            out = np.zeros((width if gram else len(vocabulary), width))
            for at, w in _rows(batches, vocabulary, idf):
                y = w @ narrow[at]
                if gram:
                    out += np.outer(y, y)
                else:
                    np.add.at(out, at, w[:, None] * y)
            parts = chunk_rows(out.ravel())
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
                                                 names=["chunk", "part"])

        shape = (width if gram else len(vocabulary), width)
        total = collected(probes.mapInArrow(run, "chunk int, part binary"), shape[0] * shape[1], "<f8").reshape(shape)
        held.destroy()
        return total

    narrow = np.random.default_rng(5).standard_normal((len(vocabulary), width))
    for _ in range(POWERS):
        narrow = np.linalg.qr(product(narrow, False))[0]
        if narrow.shape[1] < width:
            narrow = np.pad(narrow, ((0, 0), (0, width - narrow.shape[1])))
    values, vectors = np.linalg.eigh(product(narrow, True))
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-9 * max(1e-300, values.max())]
    return narrow @ vectors[:, keep]


def common_words(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each of the item's words."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def holds(text: list[int], run: list[int]) -> bool:
    n = len(run)
    return any(text[i : i + n] == run for i in range(len(text) - n + 1))


def find(words: np.ndarray, bounds: np.ndarray, idf: np.ndarray, spaces: list[Space], topics: Topics) -> Iterator[tuple]:
    """(row, item, cosine, shared, answered, first word, word after the last) of each leak in a slice of texts."""
    if not len(words):
        return
    f = features(words)
    weight = idf[f]
    row_of, begin, first_stride = strides_of(bounds)
    stride_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, bounds[-1])))

    def run(x: np.ndarray, n: int) -> np.ndarray:
        """Sums over n strides of one text from sums over strides."""
        up_to = np.concatenate(([0.0], np.cumsum(x)))
        return up_to[np.minimum(np.arange(len(x)) + n, first_stride[row_of + 1])] - up_to[:-1]

    passages = topics.folded(f, begin)
    follows = np.flatnonzero(row_of[1:] == row_of[:-1])
    passages[follows] += passages[follows + 1]  # the right side is taken before any is added to
    passages = unit(passages)
    norm = np.sqrt(run(np.bincount(stride_of, weight * weight, len(begin)), 2))
    def held_by(space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stride, probe, cosine) of the places that hold a probe's words."""
        at = space.slot[f]
        inside = np.flatnonzero(at >= 0)
        mass = np.bincount(stride_of[inside], weight[inside] ** 2, len(begin))
        widest = int(space.wide[0])
        # a passage's cosine is at most the share of its length that the block's words have; half of that share is
        # asked for, as a word that stands twice counts four times in the folded vector and twice here
        live = run(mass, 2) >= (CANDIDATE * norm) ** 2 / 2
        # and no product is over the sum of what its words can add; the margin is far over what rounding makes
        live &= run(np.bincount(stride_of[inside], space.most[at[inside]], len(begin)), 2) >= CANDIDATE * norm * (1 - 1e-3)
        full = run(np.bincount(stride_of[inside], space.share[at[inside]], len(begin)), widest) >= CONTAINED * (1 - 1e-3)
        wanted = live | full
        for j in range(1, widest):
            same = row_of[j:] == row_of[:-j]
            wanted[j:] |= (full[:-j] | (live[:-j] & (j == 1))) & same
        inside = inside[wanted[stride_of[inside]]]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        rows = np.flatnonzero(wanted)
        local = np.zeros(len(begin), np.int64)
        local[rows] = np.arange(len(rows))
        spread = np.zeros((len(rows), space.basis.shape[1]), np.float32)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(stride_of[inside]) != 0)))
        for low in range(0, len(starts), 1024):
            a, b = starts[low], (starts[low + 1024] if low + 1024 < len(starts) else len(inside))
            part = inside[a:b]
            spread[local[stride_of[part[starts[low : low + 1024] - a]]]] = np.add.reduceat(
                space.basis[at[part]], starts[low : low + 1024] - a, axis=0)
        held = spread @ space.vectors.T
        over = held.copy()  # sums over as many strides as the probe of a column lies in
        for j in range(1, widest):
            some = int((space.wide > j).sum())
            later = (row_of[rows[j:]] == row_of[rows[:-j]]) & (rows[j:] - rows[:-j] == j)
            to = np.flatnonzero(later)
            over[to, :some] += held[to + j, :some]
            if j == 1:
                hit = (over >= CANDIDATE * norm[rows, None].astype(np.float32)) & live[rows, None]
                passage = over.copy() if widest > 2 else over
        hit |= (over >= CONTAINED * space.lengths) & full[rows, None]
        hits, which = np.divmod(np.flatnonzero(hit), hit.shape[1])
        return rows[hits], which, passage[hits, which] / norm[rows[hits]]

    for space in spaces:
        hits, which, cosines = held_by(space)
        by_words = len(hits)
        close = passages @ space.near.T
        there, probe = np.divmod(np.flatnonzero(close >= NEAR), close.shape[1])
        hits, which = np.concatenate([hits, there]), np.concatenate([which, probe])
        cosines = np.concatenate([cosines, close[there, probe]])
        order = np.lexsort((hits, space.item_of[which]))
        stretch: tuple | None = None  # row, item, first word, word after the last, best cosine: by words if there is one, else by topics
        for k in [*order.tolist(), -1]:
            if k >= 0:
                r, probe = int(hits[k]), int(which[k])
                row, item = int(row_of[r]), int(space.item_of[probe])
                n = len(space.items[item].words)
                low = max(int(bounds[row]), int(begin[r]) - n)
                high = min(int(bounds[row + 1]), int(begin[r]) + int(space.wide[probe]) * STRIDE + n)
                score = (k < by_words, float(cosines[k]))
                if stretch and stretch[:2] == (row, item) and low <= stretch[3]:
                    stretch = (*stretch[:3], max(high, stretch[3]), max(score, stretch[4]))
                    continue
            if stretch:
                row_, item_, a, b, best = stretch
                yield from _judged(row_, space.items[item_], words[a:b], a - int(bounds[row_]), best[1])
            if k >= 0:
                stretch = (row, item, low, high, score)


def _judged(row: int, item: Item, text: np.ndarray, first: int, cosine: float) -> Iterator[tuple]:
    """The leak of an item in a stretch, if it is one. The longest common subsequence is taken in windows a half longer
    than the item, so that words picked from all over a long stretch do not add up to one."""
    n = len(item.words)
    size, best, at = n + n // 2 + 1, 0, 0
    word = np.searchsorted(item.known, text).clip(max=len(item.known) - 1)
    known = np.flatnonzero(item.known[word] == text)
    word = word[known]
    if np.minimum(np.bincount(word, minlength=len(item.times)), item.times).sum() < PARAPHRASE * n:
        return  # the whole stretch has too few of the item's words, and so has every window
    lows = np.arange(0, max(1, len(text) - size + 1 + n // 4), max(1, n // 4))
    begins, ends = np.searchsorted(known, lows), np.searchsorted(known, lows + size)
    for low, a, b in zip(lows.tolist(), begins.tolist(), ends.tolist(), strict=True):
        least = max(best + 1, PARAPHRASE * n)
        if b - a < least or np.minimum(np.bincount(word[a:b], minlength=len(item.times)), item.times).sum() < least:
            continue  # too few of the item's words, in whatever order
        got = common_words(item.words, text[known[a:b]].tolist())
        if got > best:
            best, at = got, low
    share = best / n
    if share < PARAPHRASE:
        return
    answered = holds(text[max(0, at - n) : at + size + n].tolist(), item.answer)
    if share >= LEAK or answered:
        yield row, item.item_id, min(1.0, cosine), share, answered, first + at, first + min(len(text), at + size)


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          answer_col: str | None = None) -> DataFrame:
    """(id, item_id, cosine, shared, answered, first_word, end_word), one row per document and item that it leaks.

    Words are runs of digits, letters and bytes over 127, ASCII lower-cased. An item's answer is ``answer_col``'s words,
    or its last ANSWER_WORDS words. A NULL or empty text leaks nothing, and items without words are not looked for;
    repeated items count once for each id, a NULL id being an item of its own; repeated documents count once for each
    id. Whole texts are searched. Empty tables give no rows. Other columns are not read. Runs jobs when called.

    The benchmark is the query set: it is worked through in blocks of RANK probes, each with a latent space of its own,
    and PROBES_AT_ONCE probes travel to the executors together.
    """
    spark = documents.sparkSession
    rows = documents.select(documents[id_col].cast("long").alias("id"), documents[text_col].cast("string").alias("text"))
    answer = benchmark[answer_col].cast("string") if answer_col else F.lit(None).cast("string")
    stated = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark["text"].cast("string").alias("text"), answer.alias("answer"))
    stated = stated.filter("text is not null").distinct()
    held, texts_n, sketch = measured(rows)
    topics = Topics(sketch, held, texts_n)
    del sketch
    idf = FAINT + np.log((1.0 + texts_n) / (1.0 + held))
    schema = "id bigint, item bigint, cosine double, shared double, answered boolean, first_word bigint, end_word bigint"
    out = None
    listed = [p for r in stated.orderBy("item", "text", "answer").collect() for p in _probes(*r)]  # the stated query set
    for low in range(0, len(listed), PROBES_AT_ONCE):
        some = listed[low : low + PROBES_AT_ONCE]
        spaces = [_block(spark, some[start : start + RANK], idf, topics) for start in range(0, len(some), RANK)]
        shared = spark.sparkContext.broadcast((idf, spaces, topics))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            idf, spaces, topics = shared.value
            for batch in batches:
                ids, found = batch.column(0), []
                for start, _, data, offsets in slices(batch.column(1)):
                    words, bounds = word_hashes(data, offsets, APART)
                    found += [(start + r, *rest) for r, *rest in find(words, bounds, idf, spaces, topics)]
                columns = list(zip(*found, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))],
                    names=["id", "item", "cosine", "shared", "answered", "first_word", "end_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = F.max_by(F.struct("cosine", "shared", "answered", "first_word", "end_word"), F.struct("shared", "cosine", -F.col("first_word")))
    return out.groupBy("id", "item").agg(best.alias("b")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.*")


def _probes(item_id: int | None, text: str, answer: str | None) -> list[tuple[Item, np.ndarray]]:
    """(item, words) of each probe of a (item, text, answer) row."""

    def words_of(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return word_hashes(raw, np.array([0, len(raw)]), APART)[0]

    words = words_of(text)
    if not len(words):
        return []
    item = Item(item_id, words, (words_of(answer) if answer else words[-ANSWER_WORDS:]).tolist())
    return [(item, p) for p in probes(words)]


def _block(spark, listed: list[tuple[Item, np.ndarray]], idf: np.ndarray, topics: Topics) -> Space:
    """The space of a block of (item, words) probes."""
    # a probe of n words lies in so many strides wherever it begins
    wide = np.array([max(2, -(-(len(w) - 1) // STRIDE) + 1) for _, w in listed])
    order = np.argsort(-wide, kind="stable")
    listed, wide = [listed[i] for i in order], wide[order]
    held = [features(w) for _, w in listed]
    vocabulary = np.unique(np.concatenate(held))
    rows = spark.createDataFrame([(bytearray(f.tobytes()),) for f in held], "f binary")
    basis = latent_space(rows, vocabulary, idf, min(RANK, len(listed)))
    lengths = np.sqrt([(idf[f] ** 2).sum() for f in held])
    vectors = np.stack([(idf[f] / n) @ basis[np.searchsorted(vocabulary, f)] for f, n in zip(held, lengths, strict=True)])
    items = list({id(i): i for i, _ in listed}.values())
    place = {id(i): k for k, i in enumerate(items)}
    row_of, begin, first = strides_of(np.cumsum([0, *map(len, held)]))
    near = unit(np.add.reduceat(topics.folded(np.concatenate(held), begin), first[:-1], axis=0))
    return Space(vocabulary, idf, basis, vectors, lengths, wide, np.array([place[id(i)] for i, _ in listed]), items, near)
