"""Near vectors dealt in rounds of tile pairs."""

from pathlib import Path

import numpy as np

from rentroll.llm import near_dedup


def brute(ids, vectors, cosine=0.95):
    """id -> (n_links, component_id) by the whole matrix of cosines."""
    u = [np.array(v) / np.linalg.norm(v) for v in vectors]
    n, links, label = len(u), [0] * len(u), list(ids)
    near = [[j for j in range(n) if j != i and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine] for i in range(n)]
    for i in range(n):
        links[i] = len(near[i])
    moved = True
    while moved:
        moved = False
        for i in range(n):
            least = min([label[i], *(label[j] for j in near[i])])
            moved |= least < label[i]
            label[i] = least
    return {i: (k, c) for i, k, c in zip(ids, links, label, strict=True)}


def vectors(seed, d, n):
    """Random vectors, a large group of near copies, a chain, scaled and exact copies."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    chain = [np.concatenate([[np.cos(0.3 * k), np.sin(0.3 * k)], np.zeros(d - 2)]) for k in range(12)]
    return [*base, *(base[0] + 0.1 * rng.standard_normal(d) for _ in range(n // 2)), *(3 * x for x in base[:5]), *base[:9], *chain]


def test_every_tile_pair_in_one_bounded_round():
    shape = {4: (3, 2, 10.0, 7.0), 0: (1, 0, 5.0, 0.0), 2: (2, 1, 12.0, 4.0)}
    found = list(near_dedup.rounds(shape, 40.0))
    assert [a for a, *_ in found] == [0, *(b for _, b, _ in found[:-1])] and len(found) > 3
    home, mine, row, cell, come = (np.array(x) for x in ([0, 2, 2, 4, 4, 4], [0, 0, 1, 0, 1, 2], [0, 0, 1, 2], [2, 4, 4, 4], [0, 1, 0, 1]))
    met = {}
    for first, end, last in found:
        at, place, side = near_dedup.pairs_of_tiles(home, mine, cell, row, come, shape, first, end)
        assert ((place >= first) & (place < end)).all() and (home[at] <= last).all()
        for r, p, s in zip(at.tolist(), place.tolist(), side.tolist(), strict=True):
            met.setdefault(p, [set(), set(), set()])[s].add(r)
    pairs = [(i, j) for one, other, same in met.values() for i, j in [*((i, j) for i in one for j in other), *((i, j) for i in same for j in same if i < j)]]
    want = {(3, 4), (3, 5), (4, 5), (1, 2)} | {(i, j) for i, c in zip(row.tolist(), cell.tolist(), strict=True) for j in range(6) if home[j] == c and home[i] < c}
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs}) and {tuple(sorted(p)) for p in pairs} == {tuple(sorted(p)) for p in want}


def test_block_pairs_are_complete():
    rng = np.random.default_rng(3)
    left, right = (0.3 * rng.standard_normal((n, 4)).astype(np.float32) for n in (300, 200))
    for pivots in (left[:1], left[:20]):
        for other, same in ((right, False), (left, True)):
            found = [(i, j) for a, b in near_dedup.block_pairs(left, other, pivots, 0.02, same) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            far = ((left[:, None].astype(float) - other[None]) ** 2).sum(2)
            want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(far <= 0.02)), strict=True) if not same or i < j}
            assert len(found) == len(set(found)) and want <= set(found) and all(far[p] <= 0.02 + 2e-5 for p in found)


def test_near_vectors_in_rounds(rows, monkeypatch):
    stored = {}

    def durable(df, label):
        out = plain(df, label)
        stored.setdefault(label, []).append(sum(p.stat().st_size for f in out.inputFiles() for p in [Path(f.removeprefix("file:"))]))
        return out

    plain = near_dedup.durable
    monkeypatch.setattr(near_dedup, "durable", durable)
    for name, value in (("TILE_LEAST", 30), ("TILES", 1000), ("ROUND_LEAST", 300), ("ROUND_SHARE", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    data = [*vectors(1, 20, 160), *vectors(2, 3, 8)]
    ids = np.random.default_rng(0).permutation(len(data)).tolist()
    data = [[float(np.float32(x)) for x in v] for v in data]
    for kind in ("float", "double"):
        stored.clear()
        got = near_dedup.near_duplicates(rows(list(zip(ids, data, strict=True)), f"vec_id bigint, embedding array<{kind}>")).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute(ids, data)
        assert len(stored["links"]) > 6  # rounds, each of which drops its copies


def test_near_vectors_are_stored_once(rows, monkeypatch):
    stored = []

    def durable(df, label):
        out = plain(df, label)
        stored.append(sum(Path(f.removeprefix("file:")).stat().st_size for f in out.inputFiles()))
        return out

    plain = near_dedup.durable
    monkeypatch.setattr(near_dedup, "durable", durable)
    data = np.random.default_rng(4).standard_normal((2000, 64)).astype(np.float32)
    got = near_dedup.near_duplicates(rows([(i, x) for i, x in enumerate(data.tolist())], "vec_id bigint, embedding array<float>"))
    assert got.filter("kept").count() == 2000
    assert sum(stored) < 1.6 * data.nbytes
