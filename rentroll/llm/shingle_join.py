"""N-gram Jaccard join with size-aware heavy and light sets.

A document is the set of its distinct five-word shingles. Two documents link when their Jaccard similarity reaches
80 %, so they share at least ceil(0.8 n) shingles, n being the size of either. With shingles in one common order, the
first n - ceil(0.8 n) + l of both then have l in common; here l = 3. Sets below the boundary size are light: every
l of their first shingles become one key, and a shared key makes a candidate. Heavy sets, and light ones large enough
to link with a heavy one, enter the inverted lists of their first shingles, and two sets found together in l lists are
a candidate. The boundary is where the estimated cost is least.

Any order is right; the one taken puts shingles of rare words first and those counted often, such as passages that many
documents share, last. Documents with equal sets form one class and are compared once. Lists of the very same
classes are kept as one that counts for all of them. Links are found in rounds.
Star rounds: each list proposes its members with one that is in most lists, and so among the least altered of its
copies; for copies by the thousand a few rounds find most links. After each the components so far are contracted. They
end as soon as they no longer shrink what is left, or little is there: each costs some fifty jobs at any size. The
last round proposes every pair that is still apart; what it leaves apart has no link. All candidates are verified on the whole sets.
In all rounds a pair is proposed only if the parities of its sets in BITS buckets allow the similarity: no more of them
can differ than the sets have shingles that only one holds, so no link is lost, and most others are never paired. The
last round also asks the parities in as many buckets as a set has shingles, as few buckets say nothing of large sets.
Whole sets are read again for the classes of the proposed pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentroll.llm.graph import components
from rentroll.llm.sketch import chunk_rows, collected
from rentroll.llm.words import mixed, shingles, slices, weighted_shingles, word_hashes
from rentroll.session import durable

WORDS = 5
PERCENT = 80
SHARED = 3  # first shingles that linked sets have in common, or all of a set of fewer
BITS = 512  # parities of a set that every round compares, in 64-bit words; larger sets have more for the last round
PARITIES = [f"p{i}" for i in range(BITS // 64)]
BUCKETS = 1 << 20  # of the shingle counts
WORD_BUCKETS = 1 << 18  # of the word counts; both are four bytes each, at any size of the input
STARS = 4  # partners that a star round tries a class with, and the number of star rounds; the last round tries all the rest
STAR_ROUNDS = 3  # at most: none if the keys hold no more pairs than a round may try, no more after one that left
SHRUNK = 0.75  # over this share of their pairs
KEYS_AT_ONCE = 1 << 17  # keys that a task gathers before it deals them, whatever the size of a batch
ID_BITS = 1 << 25  # of the filter that spares shingling documents again; the join after it decides
_U = np.uint64


def prefix_length(n: int, common: int) -> int:
    """How many first shingles of a set of n hold ``common`` shared ones, if PERCENT of n are shared."""
    return min(n, n - -(-PERCENT * n // 100) + common)


def _subsets(n: int) -> int:
    """Keys of a light set of n."""
    return comb(prefix_length(n, SHARED), min(SHARED, n))


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for low, _, data, offsets in slices(batch.column(column)):
        yield low, shingles(*word_hashes(data, offsets), WORDS)


def signature(shingle_set: np.ndarray) -> int:
    """A number that equal sets share; 0 for the empty set."""
    if not len(shingle_set):
        return 0
    total = mixed(shingle_set).sum(dtype=_U, keepdims=True)
    return int(mixed(total + _U(len(shingle_set))).view(np.int64)[0]) or 1


def parities(shingle_set: np.ndarray) -> np.ndarray:
    """For each bucket, whether it holds an odd number of the shingles, as 64-bit words.

    There are BITS buckets, or more for larger sets: the least power of two that is not below the set's size. Halves
    fold into each other: their exclusive or is what half as many buckets hold."""
    buckets = max(BITS, 1 << (len(shingle_set) - 1).bit_length())
    odd = np.bincount((mixed(shingle_set) % _U(buckets)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(words: np.ndarray) -> np.ndarray:
    """The parities in BITS buckets."""
    return np.bitwise_xor.reduce(words.reshape(-1, len(PARITIES)), axis=0)


def measured(rows: DataFrame) -> DataFrame:
    """(id, text) as a stored table of (id, n, sig) rows and of (chunk, part) rows that count shingles and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + WORD_BUCKETS, np.uint32)
        names = ["id", "n", "sig", "chunk", "part"]
        for batch in batches:
            sizes, sigs = [], []
            for _, _, data, offsets in slices(batch.column(1)):
                words, bounds = word_hashes(data, offsets)
                found = shingles(words, bounds, WORDS)
                sizes += [len(s) for s in found]
                sigs += [signature(s) for s in found]
                if len(words):
                    where = np.concatenate([(np.concatenate(found) >> _U(44)).astype(np.int64), BUCKETS + (words >> _U(46)).astype(np.int64)])
                    counts += np.bincount(where, minlength=len(counts)).astype(np.uint32)
            none = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(none, pa.int32()),
                 pa.array(none, pa.binary())], names=names)
        parts = chunk_rows(counts)
        if parts:
            none = [None] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                 pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=names)

    return durable(rows.mapInArrow(run, "id bigint, n bigint, sig bigint, chunk int, part binary"), "shingle-sets")


def ordering(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level of each shingle bucket, weight of each word bucket); shingles stand in order of level, then word weight.

    The level is 0 up to what chance puts into a bucket and grows with the logarithm above; the weight is the
    logarithm of the word's count."""
    counted = counts[:BUCKETS].astype(np.float64)
    usual = counted.mean() + 6 * np.sqrt(counted.mean()) + 1
    level = np.ceil(8 * np.log2(np.maximum(1.0, counted / usual))).astype(np.int64)
    return level, np.rint(16 * np.log2(1.0 + counts[BUCKETS:])).astype(np.int64)


def boundary(sizes: list[tuple[int, int]], counts: np.ndarray) -> int:
    """The size from which sets are heavy, at least estimated cost; ``sizes``: (size, classes) rows.

    A light set costs its keys; a set in the inverted lists costs each of its first shingles and the mean list found
    there. That mean is the self-join size of the rarer half of the counted buckets over their sum, less what chance
    alone puts there.
    """
    low = np.sort(counts[:BUCKETS][counts[:BUCKETS] > 0].astype(np.float64))
    low = low[: max(1, len(low) // 2)]
    mean_list = 1.0 + (max(0.0, (low**2).sum() / low.sum() - low.mean()) if len(low) else 0.0)
    best, least = 2, None
    for x in [2, *(int(s * 1.25) + 1 for s, _ in sorted(sizes))]:
        total = 0.0
        for n, many in sizes:
            if n < x:
                total += many * _subsets(n)
            if 100 * n >= PERCENT * x:
                total += many * prefix_length(n, SHARED) * (1.0 + mean_list)
        if least is None or total < least:
            best, least = x, total
    return best


def keys_of(shingle_set: np.ndarray, weight: np.ndarray, level: np.ndarray, heavy_from: int) -> tuple[np.ndarray, int]:
    """(keys, how many of them are subsets); the others are inverted lists. A set of one links with equal sets only."""
    n = len(shingle_set)
    if n < 2:
        return np.zeros(0, _U), 0
    place = (level[(shingle_set >> _U(44)).astype(np.int64)] << 32) + weight
    ordered = shingle_set[np.argsort(place, kind="stable")[: prefix_length(n, SHARED)]]  # ties keep the order of hashes
    light = []
    if n < heavy_from:
        for some in combinations(np.sort(ordered).tolist(), min(SHARED, n)):
            key = 0
            for s in some:
                key = (key * 0xA24BAED4963EE407 + s) & (1 << 64) - 1
            light.append(key)
    lists = ordered if 100 * n >= PERCENT * heavy_from else ordered[:0]
    return np.concatenate([mixed(np.array(light, _U)), lists]), len(light)


def shared_keys(rows: DataFrame, shared, partitions: int, lot: int = KEYS_AT_ONCE) -> DataFrame:
    """(key, sig, n, light): the keys that more than one class has, a row for each class that has it, some repeated.

    Keys travel in blocks by hash, some ``lot`` at once. Among those a key that several classes have is written out,
    and one of them goes on; so a key of very many classes costs a row each time, and the task that gathers it keeps one class.
    """

    def dealt(keys: list[np.ndarray], sigs: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        key, sig, n = np.concatenate(keys), np.concatenate(sigs), np.concatenate(sizes)
        order = np.lexsort((sig, key))
        key, sig, n = key[order], sig[order], n[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])))
        key, sig, n = key[new], sig[new], n[new]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        many = np.diff(np.append(np.flatnonzero(first), len(key)))[np.cumsum(first) - 1] > 1
        # what goes on: one class of each key; what is written out: the classes of keys that have several here
        block = (key % _U(partitions)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(partitions + 1))
        rows_out: list[tuple] = []
        for b in range(partitions):
            at = order[cuts[b] : cuts[b + 1]]
            if len(at):
                on, off = at[first[at]], at[many[at]]
                rows_out.append((b, *(x[on].tobytes() for x in (key, sig, n)), *(x[off].tobytes() for x in (key, sig, n))))
        columns = list(zip(*rows_out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            names=["block", "keys", "sigs", "sizes", "own_keys", "own_sigs", "own_sizes"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, word_weight, heavy_from = shared.value
        for batch in batches:
            keys, sigs, sizes, held = [], [], [], 0
            for _, _, data, offsets in slices(batch.column(1)):
                words, bounds = word_hashes(data, offsets)
                for s, weight in weighted_shingles(words, bounds, word_weight[(words >> _U(46)).astype(np.int64)], WORDS):
                    k, light = keys_of(s, weight, level, heavy_from)
                    if len(k):
                        keys.append(k)
                        sigs.append(np.full(len(k), signature(s), np.int64))
                        size = np.full(len(k), len(s), np.int32)
                        size[:light] *= -1  # a subset's key
                        sizes.append(size)
                        held += len(k)
                    if held >= lot:
                        yield dealt(keys, sigs, sizes)
                        keys, sigs, sizes, held = [], [], [], 0
            if keys:
                yield dealt(keys, sigs, sizes)

    kinds = (_U, np.int64, np.int32)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pivot, size, told = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        for batch in batches:
            joined = [b"".join(batch.column(i).to_pylist()) for i in range(1, 7)]
            key, sig, n = (np.frombuffer(c, t) for c, t in zip(joined[:3], kinds, strict=True))
            own = [np.frombuffer(c, t) for c, t in zip(joined[3:], kinds, strict=True)]
            order = np.lexsort((sig, key))
            key, sig, n = (np.concatenate([x, y[order]]) for x, y in zip((known, pivot, size), (key, sig, n), strict=True))
            told = np.concatenate([told, np.zeros(len(key) - len(told), bool)])
            order = np.argsort(key, kind="stable")  # a class kept from before stands first
            key, sig, n, told = key[order], sig[order], n[order], told[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(first) - 1
            pivot_of = sig[first][group]
            several = np.bincount(group, sig != pivot_of, first.sum()) > 0
            give = several[group] & ~told & (first | (sig != pivot_of))
            out = [np.concatenate([x[give], y]) for x, y in zip((key, sig, n), own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0].view(np.int64)), pa.array(out[1]), pa.array(np.abs(out[2]).astype(np.int64)), pa.array(out[2] < 0)],
                names=["key", "sig", "n", "light"])
            known, pivot, size, told = key[first], sig[first], n[first], told[first] | several

    kept = rows.mapInArrow(blocks, "block int, keys binary, sigs binary, sizes binary, own_keys binary, own_sigs binary, own_sizes binary")
    return kept.repartition(partitions, "block").mapInArrow(gathered, "key bigint, sig bigint, n bigint, light boolean")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the keys that still join different components, with their component."""
    placed = members.join(found, F.col("sig") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "sig")).drop("node", "component")
    apart = placed.groupBy("key", "light").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c < d").select("key", "light")
    return placed.join(apart, ["key", "light"], "left_semi")


def _pairs(open_: DataFrame) -> tuple[float, int]:
    """How many pairs the open keys hold, and how many members."""
    each = open_.groupBy("key", "light").agg(F.count("*").cast("double").alias("many"))
    pairs, members = each.agg(F.sum(F.expr("many * (many - 1) / 2")), F.sum("many")).first()
    return pairs or 0.0, members or 0


def _side(placed: DataFrame, name: str) -> DataFrame:
    """Members with their class, size, component and parities named after one side of a pair."""
    wide = [F.col("wide").alias(f"{name}_wide")] if "wide" in placed.columns else []
    return placed.select("key", "light", F.col("lists").alias(f"{name}_lists"), F.col("sig").alias(name), F.col("n").alias(f"{name}n"),
                         F.col("comp").alias(f"{name}_comp"), *(F.col(p).alias(f"{name}_{p}") for p in PARITIES), *wide)


def _differing(x: Column, y: Column) -> Column:
    """How many parities differ, compared in as many buckets as both have. Sets of like size have as many or half as many."""
    words = F.least(F.size(x), F.size(y))

    def cut(a: Column) -> Column:
        half = F.zip_with(F.slice(a, 1, words), F.slice(a, words + 1, words), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) > words, half).otherwise(a)

    return F.aggregate(F.zip_with(cut(x), cut(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, b: t + b)


def _merged(members: DataFrame) -> DataFrame:
    """(key, light, lists): a key for all keys that have the same classes, and how many those are; none for lone classes.

    Keys are told apart by two sums of hashes and the count of their classes."""
    kept = members.groupBy("key", "light").agg(
        F.count("*").alias("many"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.sum(F.shiftright(F.xxhash64("n", "sig"), 20)).alias("y"))
    return kept.filter("many > 1").groupBy("light", "many", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("lists")).select(
        "key", "light", "lists")


def _candidates(left: DataFrame, right: DataFrame, apart) -> DataFrame:
    """(a, b, held): pairs of like size and parities that share a light key, or enough lists.

    Of a linked pair at most (100 - PERCENT) / (100 + PERCENT) of both sizes together are shingles of one set only."""
    like = 100 * F.least("an", "bn") >= PERCENT * F.greatest("an", "bn")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES))
    most = (100 - PERCENT) * (F.col("an") + F.col("bn"))
    near = (100 + PERCENT) * differ <= most
    if "a_wide" in left.columns:
        near = near & ((100 + PERCENT) * _differing(F.col("a_wide"), F.col("b_wide")) <= most)
    both = left.join(right, ["key", "light"]).filter(apart & like & near)
    counted = both.groupBy("a", "b").agg(  # both sides count the same lists; naming both keeps them one shuffle in the last round
        F.sum(F.least("a_lists", "b_lists")).alias("held"), F.max("light").alias("by_subset"), F.first("an").alias("an"), F.first("bn").alias("bn"))
    return counted.filter(F.col("by_subset") | (F.col("held") >= F.least(F.lit(SHARED), "an", "bn"))).select("a", "b", "held")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * common >= PERCENT * (len(s) + len(t) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    centre = sets.join(pairs.select(F.col("a").alias("sig")).distinct(), "sig", "left_semi")
    left = centre.select(F.col("sig").alias("a"), F.col("set").alias("a_set"))
    right = sets.select(F.col("sig").alias("b"), F.col("set").alias("b_set"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "a_set", "b_set")
    return both.mapInArrow(run, "a bigint, b bigint")


def _read_again(rows: DataFrame, first: DataFrame, made: str, make) -> DataFrame:
    """(sig, made) of the classes of ``first``, an (id, sig) table of the document that each is read from; ``make`` gives
    the made columns of a batch of sets. A filter of fixed size lets most other documents pass unread; the join decides."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(ID_BITS // 8, np.uint8)
        for batch in batches:
            h = (mixed(batch.column(0).fill_null(0).to_numpy().astype(_U)) % _U(ID_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
        parts = chunk_rows(bits)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
                                             names=["chunk", "part"])

    bits = collected(first.select("id").mapInArrow(marked, "chunk int, part binary"), ID_BITS // 8, "u1", how=np.bitwise_or)
    held = rows.sparkSession.sparkContext.broadcast(bits)
    names = [column.split()[0] for column in made.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            h = (mixed(batch.column(0).fill_null(0).to_numpy().astype(_U)) % _U(ID_BITS)).astype(np.int64)
            batch = batch.filter(pa.array(bits[h >> 3] >> (h & 7) & 1 == 1))
            for low, found in _sets(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(found)), pa.array([signature(s) for s in found], pa.int64()), *make(found)],
                    names=["id", "sig", *names])

    some = rows.mapInArrow(read, f"id bigint, sig bigint, {made}")
    match = some["id"].eqNullSafe(first["id"]) & (some["sig"] == first["sig"])
    stored = durable(some.join(first, match, "left_semi").select("sig", *names).dropDuplicates(["sig"]), names[0])
    held.destroy()
    return stored


def _parities_of(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(sig, wide, parities): all parities of a class as an array, and those in BITS buckets as columns."""

    def make(found: list[np.ndarray]) -> list[pa.Array]:
        wide = [parities(s) for s in found]
        narrow = np.array([folded(w) for w in wide], np.int64).reshape(len(found), len(PARITIES))
        return [pa.array(wide, pa.list_(pa.int64())), *(pa.array(word) for word in narrow.T.copy())]

    return _read_again(rows, first, f"wide array<bigint>, {', '.join(f'{p} bigint' for p in PARITIES)}", make)


def _sets_of(rows: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sig, set) of the classes of the pairs."""
    classes = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    return _read_again(rows, durable(first.join(classes, "sig", "left_semi").select("id", "sig"), "read"), "set binary",
                       lambda found: [pa.array([s.tobytes() for s in found], pa.binary())])


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents as (id, n_shingles, component_id), one row per input row.

    Words are runs of bytes other than blanks and tab to carriage return, A-Z lower-cased. n_shingles counts the
    distinct five-word shingles of the whole text; fewer words make one shingle, no words (a NULL, empty or blank
    text) none, and such a row links with nothing. component_id is the smallest id that links reach, the row's own
    included; rows under one id are one document with the sets of all of them; a NULL id links with nothing. An empty
    table gives an empty one. Other columns are not read. Runs jobs.
    """
    rows = documents.select(documents[id_col].cast("long").alias("id"), documents[text_col].cast("string").alias("text"))
    stored = measured(rows)
    spark = documents.sparkSession
    every = stored.filter("n is not null").select("id", "n", "sig")
    ids = every.filter("id is not null")
    rows = rows.filter("id is not null")
    counts = collected(stored.filter("chunk is not null").select("chunk", "part"), BUCKETS + WORD_BUCKETS, "<u4")
    binned = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.exp(F.floor(F.log("n") * 8) / 8)).cast("long"))
    classes = ids.filter("n > 1").groupBy("sig").agg(F.first("n").alias("n"))
    sizes = [tuple(r) for r in classes.groupBy(binned.alias("size")).count().collect()]  # at most some 200 rows
    shared = spark.sparkContext.broadcast((*ordering(counts), boundary(sizes, counts)))  # of one size at any input
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    members = durable(shared_keys(rows, shared, partitions).distinct(), "members")
    shared.destroy()
    # a linked class has a light key, or SHARED lists (fewer if smaller), in common with others of like size: theirs is a band of sizes that both belong to, each class being in its own band and the next
    band = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")
    banded = members.withColumn("band", F.explode(F.array(band, band + 1)))
    meeting = banded.groupBy("key", "light", "band").agg(F.min("sig").alias("c"), F.max("sig").alias("d")).filter("c < d")
    met = banded.join(meeting.select("key", "light", "band"), ["key", "light", "band"], "left_semi").groupBy("key", "light", "sig", "n").agg(
        F.lit(1).alias("one"))
    wanted = met.groupBy("sig").agg(F.count("*").alias("keys"), F.max("light").alias("light"), F.first("n").alias("n")).filter(
        F.col("light") | (F.col("keys") >= F.least(F.lit(SHARED), "n"))).select("sig", "keys")
    wanted = durable(wanted, "wanted")
    first = durable(ids.filter("n > 1").groupBy("sig").agg(F.min("id").alias("id")).join(wanted, "sig", "left_semi").select("id", "sig"), "first")
    odd = _parities_of(rows, first)
    members = durable(members.join(wanted, "sig").select("key", "light", "sig", "n", "keys"), "members")
    merged = durable(_merged(members), "merged")
    members = members.join(merged, ["key", "light"]).join(odd.drop("wide"), "sig")
    members = durable(members.select("key", "light", "lists", "sig", "n", "keys", *PARITIES), "members")

    links = found = tried = None
    open_, before = members.withColumn("comp", F.col("sig")), float("inf")
    for _ in range(STAR_ROUNDS):
        held, many = _pairs(open_)
        if held <= STARS * many or held > SHRUNK * before:
            break
        before = held
        central = F.max_by(F.struct("sig", "n", "comp", *PARITIES), F.struct("keys", F.xxhash64("sig", "comp"), "sig")).alias("p")
        pivots = _side(open_.groupBy("key", "light").agg(F.first("lists").alias("lists"), central).select("key", "light", "lists", "p.*"), "a")
        other = _side(open_, "b")
        order = Window.partitionBy("b").orderBy(F.desc("held"), "a")
        pairs = _candidates(pivots, other, F.col("a_comp") != F.col("b_comp"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        stars = durable(pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= STARS).select("a", "b"), "stars")
        tried = stars if tried is None else tried.union(stars)
        fresh = durable(_verified(stars, _sets_of(rows, first, stars)), "links")
        links = fresh if links is None else links.union(fresh)
        found = durable(components(links), "components")
        open_ = durable(_placed(members, found), "open")

    open_ = open_.join(odd.select("sig", "wide"), "sig")
    rest = _candidates(_side(open_, "a"), _side(open_, "b"), (F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp"))).select("a", "b")
    if tried is not None:
        rest = rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = durable(rest, "rest")
    late = durable(_verified(rest, _sets_of(rows, first, rest)), "links")

    # documents tie to their class, and classes to each other; a class's smallest id stands for it
    named = ids.filter("n > 0").groupBy("sig").agg(F.min("id").alias("doc"))
    pairs = late if links is None else links.union(late)
    pairs = pairs.join(named.select(F.col("sig").alias("a"), F.col("doc").alias("x")), "a").join(
        named.select(F.col("sig").alias("b"), F.col("doc").alias("y")), "b").select("x", "y")
    same = ids.filter("n > 0").join(named, "sig").select(F.col("id").alias("x"), F.col("doc").alias("y")).filter("x <> y")
    whole = components(pairs.union(same).select(F.col("x").alias("a"), F.col("y").alias("b")))
    return every.join(whole, every["id"] == whole["node"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
