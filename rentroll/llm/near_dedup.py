"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. After one random rotation, whose coordinates are
split into blocks, some block holds at most its proportional share of that distance (pigeonhole); so each block is
range-joined alone, and what any block finds is verified exactly on the whole vectors.

Vectors are dealt to tasks by the Voronoi cells of sampled pivots in the whole space. A vector is at home in the cell of
its nearest pivot and visits every later cell whose bisector lies within the range and whose farthest vector may be; two
vectors in range of each other meet there, once. Cells are cut into tiles of bounded size, home tiles against home tiles
and visitors, so that a cell that holds a third of all vectors is many tasks. How often a vector is copied grows with the
number of tiles, so tile pairs are dealt in rounds of bounded size, and the copies of a round go before the next begins.

A task joins its pair of tiles block by block. In a block's subspace the vectors of one tile are put into the cells of
pivots amid them, and those of the other are held against the cells that they may reach only. A pair is counted in the first
block that finds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentroll.llm.graph import components
from rentroll.session import durable

BLOCK_DIMENSIONS = 16
#: A table is cut into so many tiles or more, of so many vectors at least; a tile has so many vectors and bytes at most.
TILES, TILE_LEAST, TILE, TILE_BYTES = 16, 2048, 40960, 10 << 20
#: A round deals out so many copies for each vector, or so many in all where that is more.
ROUND_SHARE, ROUND_LEAST = 2, 1 << 18
CELLS_MOST = 1024  # cells of the whole space
ROWS_PER_PIVOT, PIVOTS_MOST, PIVOTS_LEAST = 128, 256, 8  # of a block, by the vectors of a tile
ROWS_PER_MEAN, MEANS = 64, 3  # rows that place a pivot, at most, and how often they do
SLACK = 1e-7  # added to every range against rounding; the verification alone decides
#: The same in single precision: of squared distances and products of unit vectors, and of what a block lets through.
SINGLE, WITHIN = 1e-5, 2e-6
STRIP, HITS = 8192, 1 << 16  # vectors, and pairs, that a task looks at at once
PRODUCTS = 1 << 20  # distances that it holds


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int, size: int = BLOCK_DIMENSIONS) -> list[tuple[int, int]]:
    n = max(1, round(d / size))
    cuts = [d * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as doubles, which rows have one): none where a row is zero or holds a non-finite component. Every
    row is rounded by itself, whatever rows stand beside it."""
    x = x.astype(float)
    top = np.abs(x).max(1)
    ok = np.isfinite(top) & (top > 0)
    x = x[ok] / top[ok, None]  # neither squares overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None], ok


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a column of lists, for each length but 0; a NULL component is NaN."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, values.reshape(-1, d) if len(at) == len(sizes) else values[first[at][:, None] + np.arange(d)]


def _key(unit: np.ndarray) -> bytes:
    """128 bits that stand for a unit vector: equal vectors have one key."""
    return hashlib.blake2b(unit.tobytes(), digest_size=16).digest()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) as (id, d, key); NULL for a vector that is NULL, empty, zero or holds a NULL or non-finite component."""
    for batch in batches:
        keys, sizes = [None] * batch.num_rows, [None] * batch.num_rows
        for at, x in vectors_of(batch.column(1)):
            unit, ok = units(x)
            for row, u in zip(at[ok].tolist(), unit, strict=True):
                keys[row], sizes[row] = _key(u), x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], names=["id", "d", "key"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) as (id, d, key, raw) of the rows that have a key: raw holds the components as they came."""
    for batch in batches:
        for at, x in vectors_of(batch.column(1)):
            unit, ok = units(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at[ok])), pa.array(np.full(len(unit), x.shape[1], np.int32)), pa.array([_key(u) for u in unit], pa.binary()),
                 pa.array([r.tobytes() for r in x[ok]], pa.binary())], names=["id", "d", "key", "raw"])


def matrix(column: pa.Array, d: int, kind: type) -> np.ndarray:
    """The vectors of a binary column as rows, without a copy for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, d), kind)
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset]
    return np.frombuffer(data, kind, len(column) * d, first).reshape(len(column), d)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _visits(far: np.ndarray, own: np.ndarray, home: np.ndarray, gaps: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that visit, cells they visit). Only cells after the home cell are visited, so that two vectors meet in the
    later one of their homes."""
    near = (far - own[:, None]) <= 2 * reach * gaps[home] + SLACK  # distance to the bisector of both pivots
    near &= np.sqrt(far) <= radius[None] + reach + SLACK
    near &= np.arange(far.shape[1])[None] > home[:, None]
    return np.nonzero(near)


def pivots_among(x: np.ndarray, wanted: int) -> np.ndarray:
    """Up to so many pivots amid the rows: rows first, then the means of the cells of some rows. Where they lie decides how
    many vectors are compared, not which pairs are found."""
    some = x[:: -(-len(x) // (wanted * ROWS_PER_MEAN))]
    pivots = some[:: -(-len(some) // wanted)]
    for _ in range(MEANS):
        home = ((pivots * pivots).sum(1) - 2 * (some @ pivots.T)).argmin(1)
        order = np.argsort(home, kind="stable")
        full, first = np.unique(home[order], return_index=True)
        pivots = np.add.reduceat(some[order], first) / np.bincount(home)[full, None].astype(np.float32)
    return pivots


def block_pairs(left: np.ndarray, right: np.ndarray, pivots: np.ndarray, budget: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and right, in single precision, whose squared distance in a block is at most budget, and some more
    within SINGLE of it. same: right is left, and each pair of its rows comes with the lower one first."""
    if not len(left) or not len(right):
        return
    size, reach = (pivots * pivots).sum(1), budget**0.5
    exact = pivots.astype(float)  # pivots may lie close together, where single precision loses their distance
    gaps = (2 * reach * np.sqrt(_distances(exact, exact)) + 2 * SINGLE).astype(np.float32)

    def far(x: np.ndarray) -> np.ndarray:  # squared distances to the pivots, less what is one for all of them
        return size - 2 * (x @ pivots.T)

    home = np.concatenate([far(left[low : low + STRIP]).argmin(1) for low in range(0, len(left), STRIP)])
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(len(pivots) + 1))
    some = [c for c in range(len(pivots)) if ends[c] < ends[c + 1]]
    x = left[order]
    of_left = np.concatenate([x, np.ones((len(x), 1), np.float32), -(x * x).sum(1)[:, None] / 2], 1)
    least, room = np.float32(-(budget + SINGLE) / 2), np.empty(PRODUCTS, np.float32)
    for low in range(0, len(right), STRIP):
        y = right[low : low + STRIP]
        of_right = np.concatenate([y, -(y * y).sum(1)[:, None] / 2, np.ones((len(y), 1), np.float32)], 1)
        apart = far(y)
        nearest = apart.argmin(1)
        apart -= apart[np.arange(len(y)), nearest][:, None]
        near = apart <= gaps[nearest]
        if same:  # two vectors meet in the later one of their homes
            near &= np.arange(len(pivots))[None] >= home[low : low + STRIP, None]
        near = np.ascontiguousarray(near.T)
        for c in some:
            rows = np.flatnonzero(near[c])
            if not len(rows):
                continue
            come = of_right[rows].T
            step = max(1, PRODUCTS // len(rows))
            for s in range(ends[c], ends[c + 1], step):
                e = min(s + step, ends[c + 1])
                found = np.matmul(of_left[s:e], come, out=room[: (e - s) * len(rows)].reshape(e - s, len(rows)))
                if found.max() < least:
                    continue
                i, j = np.divmod(np.flatnonzero(found >= least), len(rows))
                i, j = order[s + i], low + rows[j]
                if same:
                    own = home[i] == home[j]  # such a pair comes twice
                    keep = (i < j) | ~own & (i != j)
                    i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
                yield i, j


def _in_lots(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, some HITS at once."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= HITS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def meet(table: pa.Table, d: int, kind: type, cosine: float, turn: np.ndarray) -> pa.Table:
    """Links of a tile pair: (class, links, other); other names a spanning forest's edge, else NULL.

    Side 0 is held against side 1; where there is a side 2 it is held against itself."""
    side = table.column("side").to_numpy()
    table = table.take(pa.array(np.argsort(side, kind="stable")))
    side = np.sort(side)
    ids, n = table.column("class").to_numpy(), table.column("n").to_numpy()
    raw = matrix(table.column("raw"), d, kind)
    turned = np.empty(raw.shape, np.float32)
    for low in range(0, len(raw), STRIP):
        turned[low : low + STRIP] = units(raw[low : low + STRIP])[0] @ turn
    same = bool(len(side)) and side[-1] == 2
    split = len(side) if same else int(np.searchsorted(side, 1))
    shift = 0 if same else split  # the row of side 1's first vector
    cut = blocks(d)
    budgets = [(2 - 2 * cosine) * (b - a) / d + SLACK for a, b in cut]
    some = min(PIVOTS_MOST, max(PIVOTS_LEAST, split // ROWS_PER_PIVOT))
    links, root, edges = np.zeros(len(ids)), np.arange(len(ids)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (a, b) in enumerate(cut if 0 < split and shift < len(ids) else []):
        left, right = (np.ascontiguousarray(x[:, a:b]) for x in (turned[:split], turned[shift:]))
        for i, j in _in_lots(block_pairs(left, right, pivots_among(left, some), budgets[k] + WITHIN, same)):
            j = j + shift
            for low in range(0, len(i), HITS):
                x, y = i[low : low + HITS], j[low : low + HITS]
                keep = ids[x] != ids[y]
                x, y = x[keep], y[keep]
                for e in range(k, -1, -1):  # a pair is met in this task alone, and always by the same numbers
                    within = ((turned[x, cut[e][0] : cut[e][1]] - turned[y, cut[e][0] : cut[e][1]]) ** 2).sum(1) <= budgets[e] + WITHIN
                    keep = within if e == k else ~within
                    x, y = x[keep], y[keep]
                near = (turned[x] * turned[y]).sum(1).astype(float)
                unsure = np.flatnonzero(np.abs(near - cosine) <= SINGLE)
                near[unsure] = (units(raw[x[unsure]])[0] * units(raw[y[unsure]])[0]).sum(1)
                x, y = x[near >= cosine], y[near >= cosine]
                links += np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
                apart = np.flatnonzero(root[x] != root[y])  # all others are in one tree already
                _, first = np.unique(np.stack([root[x[apart]], root[y[apart]]]), axis=1, return_index=True)
                for v, w in zip(x[apart[first]].tolist(), y[apart[first]].tolist(), strict=True):
                    p, q = top(v), top(w)
                    if p != q:
                        root[p] = q
                        edges.append((v, w))
                while len(first) and (root != root[root]).any():
                    root = root[root]
    linked = np.flatnonzero(links)
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({
        "class": pa.array(np.concatenate([ids[linked], ids[e[:, 0]]]), pa.int64()),
        "links": pa.array(np.concatenate([links[linked], np.zeros(len(e))]).astype(np.int64)),
        "other": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(ids[e[:, 1]], pa.int64())])})


def rounds(shape: dict[int, tuple[int, int, float, float]], most: float) -> Iterator[tuple[int, int, int]]:
    """Cells of (home tiles, tiles of visitors, vectors of a home tile, of a tile of visitors) as (first, end, last cell): the
    tile pairs whose place lies in first to end hold some ``most`` vectors at most, or are one pair. A pair's place is that
    of its cell, its first tile and its other tile in order."""
    base, first, held = 0, 0, 0.0
    for c in sorted(shape):
        t, v, own, come = shape[c]
        for i in range(t):
            for j in range(i, t + v):
                rows = own if i == j else own + (own if j < t else come)
                at = base + i * (t + v) + j
                if held and held + rows > most:
                    yield first, at, c
                    first, held = at, 0.0
                held += rows
        base += t * (t + v)
    if held:
        yield first, base, max(shape)


def pairs_of_tiles(home: np.ndarray, mine: np.ndarray, cell: np.ndarray, row: np.ndarray, come: np.ndarray,
                   shape: dict[int, tuple[int, int, float, float]], first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, side) of every copy that the tile pairs from first to end get. home, mine: each row's cell and tile;
    row, cell, come: the visits and the tile of visitors that each goes to."""
    to, base = [], 0
    for c in sorted(shape):
        t, v = shape[c][:2]
        width = t + v
        if base < end and base + t * width > first:
            own, visit = np.flatnonzero(home == c), np.flatnonzero(cell == c)
            tile, other = mine[own], t + come[visit] % max(1, v)
            for i in range(max(0, (first - base) // width), min(t, -(-(end - base) // width))):
                start = base + i * width
                low, high = max(i, first - start), min(width, end - start)
                one = own[tile == i]
                for j in range(low, high):
                    to.append((one, np.full(len(one), start + j), np.full(len(one), 2 if i == j else 0)))
                for at, j in ((own, tile), (row[visit], other)):
                    picked = (j > i) & (j >= low) & (j < high)
                    to.append((at[picked], start + j[picked], np.ones(picked.sum(), int)))
        base += t * width
    if not to:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*to, strict=True))


def tile_of(d: int, many: int) -> int:
    """Vectors of a tile: few enough that a small table is many tasks, and a task never holds more than two tiles."""
    return max(1, min(TILE, TILE_BYTES // (4 * d), max(TILE_LEAST, many // TILES)))


def drawn(rows: DataFrame, d: int, many: int, wanted: int, kind: type) -> np.ndarray:
    """Up to so many unit vectors of dimension d, many rows having one, by chance. A bounded sample places the pivots; every vector is joined."""
    share = min(1.0, 16 * wanted / max(1, many))
    chance = F.pmod(F.xxhash64("id", "vector", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    found = rows.filter((F.size("vector") == d) & (chance <= share)).mapInArrow(_carried, "id bigint, d int, key binary, raw binary")
    some = found.groupBy("key").agg(F.first("raw").alias("raw")).orderBy(F.xxhash64("key")).limit(wanted).collect()
    return units(np.stack([np.frombuffer(r["raw"], kind) for r in some]))[0] if some else np.eye(1, d)


def join_classes(classes: DataFrame, d: int, kind: type, cosine: float, pivots: np.ndarray) -> DataFrame:
    """Distinct vectors (key, class, n, raw, cell, own) of one dimension, own being the squared distance to the pivot of their cell,
    as rows (class, links, other).

    Where other is NULL: links, the number of vectors of other classes linked directly in one tile pair, n counting each
    class's vectors. Else: class and other are a pair that joins what the links join, in a tile pair a spanning forest.
    """
    spark = classes.sparkSession
    turn, reach = rotation(d), (2 - 2 * cosine + SLACK) ** 0.5
    gaps = np.sqrt(_distances(pivots, pivots))
    plan = spark.sparkContext.broadcast((pivots, gaps, turn))  # CELLS_MOST vectors at most
    radius, homes = np.full(len(pivots), -1.0), {}
    for c, n, own in classes.groupBy("cell").agg(F.count("*"), F.max("own")).collect():  # a row for each pivot
        homes[c], radius[c] = n, own**0.5

    def visiting(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home, own = batch.column("cell").to_numpy(), batch.column("own").to_numpy()
        pivots, gaps = plan.value[:2]
        return home, *_visits(_distances(units(matrix(batch.column("raw"), d, kind))[0], pivots), own, home, gaps, radius, reach)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(visiting(batch)[2], minlength=len(radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

    come = dict(classes.select("raw", "cell", "own").mapInArrow(visits, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect()) if len(homes) > 1 else {}
    many = sum(homes.values())
    tile, shape = tile_of(d, many), {}
    for c, n in homes.items():
        t, v = -(-n // tile), -(-come.get(c, 0) // tile)
        shape[c] = t, v, n / t, come.get(c, 0) / max(1, v)
    tiles = spark.sparkContext.broadcast(shape)

    def deal(batches: Iterator[pa.RecordBatch], first: int, end: int) -> Iterator[pa.RecordBatch]:
        """Every vector to each pair of tiles of a round that it is part of."""
        shape = tiles.value
        homes_of = np.array([shape.get(c, (1,))[0] for c in range(len(radius))])
        for batch in batches:
            if not batch.num_rows:
                continue
            home, row, cell = visiting(batch)
            spread = (matrix(batch.column("key"), 2, np.uint64)[:, 0] >> np.uint64(1)).astype(np.int64)
            mine = spread % homes_of[home]
            picked, place, side = pairs_of_tiles(home, mine, cell, row, spread[row], shape, first, end)
            order = np.argsort(picked, kind="stable")  # copies of a vector side by side compress well
            for low in range(0, len(order), STRIP):
                at = order[low : low + STRIP]
                rows = pa.array(picked[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[at], pa.int64()), pa.array(side[at].astype(np.int32)), *(batch.column(c).take(rows) for c in ("class", "n", "raw"))],
                    names=["place", "side", "class", "n", "raw"])

    def met(table: pa.Table) -> pa.Table:
        return meet(table, d, kind, cosine, plan.value[2])

    found = []
    for first, end, last in rounds(shape, max(ROUND_LEAST, ROUND_SHARE * many)):
        dealt = classes.filter(F.col("cell") <= last).select("key", "class", "n", "raw", "cell", "own").mapInArrow(
            partial(deal, first=first, end=end), "place bigint, side int, class bigint, n bigint, raw binary")
        found.append(durable(dealt.groupBy("place").applyInArrow(met, "class bigint, links bigint, other bigint"), "links"))
    return reduce(DataFrame.union, found)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors as (id, n_links, component_id, kept), one row per input row, by cosine in double precision.

    n_links counts the other vectors linked directly, component_id is the smallest id that links reach, kept marks the
    row of that id. Vectors that are NULL, empty, zero or hold a NULL or non-finite component link with nothing, nor do
    vectors of different lengths. Equal vectors are one class and are joined once; they link with each other. Repeated
    ids are vectors of their own with one component; as in the SQL a NULL id links with nothing, and its component is
    NULL. An empty table gives an empty one. Other columns are not read. Runs jobs when called.

    Vectors are stored once, a row for each class, in the precision in which they come; rows know their class by a key.
    """
    kind, name = (np.float32, "float") if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else (np.float64, "double")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast(f"array<{name}>").alias("vector"))
    member = durable(rows.mapInArrow(_keyed, "id bigint, d int, key binary"), "members")
    named = rows.filter("id is not null")
    counted = member.filter("key is not null and id is not null").groupBy("d").agg(F.count("*"), F.approx_count_distinct("key")).orderBy("d").collect()
    if not counted:
        return member.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                             F.lit(True).alias("kept"))
    pivots = {d: drawn(named, d, many, min(CELLS_MOST, -(-distinct // tile_of(d, distinct))), kind) for d, many, distinct in counted}
    plan = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class's cell and the squared distance to its pivot, told once, as rounding may hang on a batch."""
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            cell, own = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                far = _distances(units(matrix(batch.column("raw").take(pa.array(at)), d, kind))[0], plan.value[d])
                cell[at] = far.argmin(1)
                own[at] = far[np.arange(len(at)), cell[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(own)], names=[*batch.schema.names, "cell", "own"])

    carried = named.mapInArrow(_carried, "id bigint, d int, key binary, raw binary")
    classes = durable(
        carried.groupBy("d", "key").agg(F.count("*").alias("n"), F.min("id").alias("class"), F.first("raw").alias("raw")).mapInArrow(
            place, "d int, key binary, n bigint, class bigint, raw binary, cell int, own double"), "vector-classes")
    met = reduce(DataFrame.union, [
        join_classes(classes.filter(F.col("d") == d), d, kind, cosine, pivots[d]) for d, *_ in counted])
    links = met.filter("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    reach = components(met.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    same = member["id"].isNotNull() & (member["key"] == classes["key"])
    found = member.join(classes, same, "left").select(member["id"], "class", "n")
    found = found.join(links, "class", "left").join(reach, F.col("class") == F.col("node"), "left")
    own = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce(F.col("links"), F.lit(0))
    root = F.coalesce("component", "class", "id")
    return found.select(F.col("id").alias(id_col), own.alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))
