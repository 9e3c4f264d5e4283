"""One row per key against a plain version, and what its plan holds."""

import datetime as dt
import random
import re

import pytest

from rentroll.operators.mutate import one_per_key

DDL = "k string, g int, n bigint, m int, t string, d date"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    return [
        (rng.choice([None, "a", "b", "c", ""]), rng.choice([None, 1, 2]), rng.choice([None, -(2**63), 2**63 - 1, 0, 5, -5]),
         rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y", "z"]), rng.choice([None, dt.date(2024, 1, 1), dt.date(2025, 1, 1)]))
        for _ in range(400)
    ]


def order(row, at):
    return tuple((row[i] is not None, row[i] if row[i] is not None else 0) for i in at)


def plain(data, key, at, last):
    """The rows that may be chosen for each key: all that are first (or last) in the order."""
    groups = {}
    for row in data:
        groups.setdefault(tuple(row[i] for i in key), []).append(row)
    out = {}
    for k, found in groups.items():
        best = (max if last else min)(order(r, at) for r in found)
        out[k] = {r for r in found if order(r, at) == best}
    return out


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("by", [["n"], ["m"], ["n", "m"], ["t", "d"], ["d"], ["n", "m", "t", "d"]])
def test_one_per_key(rows, data, by, last):
    names = [c.split()[0] for c in DDL.split(", ")]
    for key in (["k"], ["k", "g"]):
        got = [tuple(r) for r in one_per_key(rows(data, DDL), key, by, last).collect()]
        want = plain(data, [names.index(c) for c in key], [names.index(c) for c in by], last)
        chosen = {tuple(r[names.index(c)] for c in key): r for r in got}
        assert len(got) == len(chosen) == len(want)
        assert all(chosen[k] in allowed for k, allowed in want.items())


def test_choice_does_not_depend_on_the_order_of_rows(rows, data):
    a = sorted(map(repr, one_per_key(rows(data, DDL), ["k"], ["m"]).collect()))
    assert a == sorted(map(repr, one_per_key(rows(data[::-1], DDL).repartition(7), ["k"], ["m"]).collect()))


def test_equal_rows_are_one(rows):
    assert one_per_key(rows([("a", 1, 1, 1, "x", None)] * 5, DDL), ["k"], ["n"]).count() == 1
    assert one_per_key(rows([], DDL), ["k"], ["n"]).count() == 0


def test_no_full_row_is_aggregated(rows, data):
    plan = one_per_key(rows(data, DDL), ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert re.search(r"functions=\[(partial_)?min\(", plan)
