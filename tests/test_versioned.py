"""Merges that rewrite only the parts they touch."""

import os

import pytest
from pyspark.sql import functions as F

from rentroll.operators.mutate import delete_where, guarded_upsert
from rentroll.schemas import LEASE_TENANT, PROVIDER, Table
from rentroll.sources import versioned

ITEM = Table("item", "id BIGINT, name STRING, year INT", key=("id",))
DDL = "id bigint, name string, year int"


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def held(spark, path, table=ITEM, **options):
    return sorted(tuple(r) for r in versioned.read(spark, path, table, **options).collect())


@pytest.fixture
def stored(rows, tmp_path):
    path = str(tmp_path / "item")
    versioned.create(rows([(i, f"n{i}", 2024) for i in range(300)], DDL), path, ITEM, buckets=32)
    return path


def test_only_touched_buckets_are_rewritten(spark, rows, stored):
    before = files(stored)
    done = versioned.upsert(stored, ITEM, rows([(7, "new", 2024), (1000, "added", 2025), (7, "older", 2024)], DDL).withColumn("at", F.col("name")), ["at"])
    assert done.version == 2 and 1 <= len(done.touched) <= 2
    want = {i: (i, f"n{i}", 2024) for i in range(300)} | {7: (7, "older", 2024), 1000: (1000, "added", 2025)}
    assert held(spark, stored) == sorted(want.values())
    after = files(stored)
    assert before.items() <= after.items()  # nothing is deleted or written anew
    now = set(versioned.read(spark, stored, ITEM).inputFiles())
    was = set(versioned.read(spark, stored, ITEM, version=1).inputFiles())
    fresh = {f for f in now - was}
    assert all(any(f"_bucket={b}/" in f for b in done.touched) for f in fresh | (was - now))
    assert len(now & was) >= 30 - 2
    assert held(spark, stored, version=1) == [(i, f"n{i}", 2024) for i in range(300)]


def test_untouched_buckets_are_not_read(spark, rows, stored):
    seen = []

    def change(old, new):
        seen.extend(old.inputFiles())
        return old.join(new.select("id"), "id", "left_anti").unionByName(new.select(*old.columns))

    done = versioned.merge(stored, ITEM, rows([(5, "x", 1)], DDL), change)
    assert seen and all(f"_bucket={done.touched[0]}/" in f for f in seen)
    found = versioned.read_keys(spark, stored, ITEM, rows([(5,), (9,), (5,), (12345,)], "id int"))
    assert sorted(tuple(r) for r in found.collect()) == [(5, "x", 1), (9, "n9", 2024)]
    assert len({f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles() if "_bucket=" in f}) <= 3


def test_no_rows_change_nothing(spark, rows, stored):
    assert versioned.upsert(stored, ITEM, rows([], DDL)) == (1, [])
    assert versioned.versions(spark, stored) == [1]


def test_a_failed_merge_changes_nothing(spark, rows, stored):
    before = held(spark, stored)
    bad = rows([(1, "x", 1)], DDL)
    with pytest.raises(Exception, match="broken"):
        versioned.merge(stored, ITEM, bad, lambda old, new: new.withColumn("name", F.raise_error(F.lit("broken"))))
    with pytest.raises(ValueError, match="other buckets"):
        versioned.merge(stored, ITEM, bad, lambda old, new: old.withColumn("id", F.col("id") + 1))
    assert held(spark, stored) == before and versioned.versions(spark, stored) == [1]
    assert versioned.upsert(stored, ITEM, bad).version == 2  # and the next one goes through


def test_one_of_two_merges_wins(spark, rows, stored):
    def slow(old, new):
        versioned.upsert(stored, ITEM, rows([(2, "first", 1)], DDL))  # another writer is faster
        return old

    with pytest.raises(versioned.PointerError):
        versioned.merge(stored, ITEM, rows([(1, "second", 1)], DDL), slow)
    got = held(spark, stored)
    assert (2, "first", 1) in got and (1, "n1", 2024) in got


def test_torn_pointer_is_named(spark, rows, stored):
    with open(f"{stored}/versions/{2:020d}.json", "w") as f:
        f.write('{"version": 2, "fol')
    with pytest.raises(versioned.PointerError, match="not whole"):
        versioned.upsert(stored, ITEM, rows([(1, "x", 1)], DDL))
    assert len(held(spark, stored, version=1)) == 300


def test_deletes_and_guards(spark, rows, stored):
    """Other changes that go by the key: rows of a list of keys go; a key of another year is a conflict."""
    gone = versioned.read(spark, stored, ITEM).filter("id < 300").select("id")
    done = versioned.merge(stored, ITEM, gone, lambda old, new: delete_where(old, F.col("id") < 290))
    assert len(held(spark, stored)) == 10 and len(versioned.current(spark, stored).folders) < len(done.touched)
    batch = rows([("a", 2024, 1), ("b", 2024, 2)], "transaction_id string, year int, line int")
    path = stored + "-ledger"
    ledger = Table("ledger", "transaction_id STRING, year INT", key=("transaction_id",))
    versioned.create(rows([("a", 2023)], "transaction_id string, year int"), path, ledger, buckets=4)
    versioned.merge(path, ledger, batch, lambda old, new: guarded_upsert(old, new, "transaction_id", "year", ["line"], True).table)
    assert held(spark, path, ledger) == [("a", 2023), ("b", 2024)]


def test_keys_of_several_columns_and_null(spark, rows, tmp_path):
    path = str(tmp_path / "links")
    versioned.create(rows([(1, 2), (1, 3), (None, 4)], "lease_id bigint, tenant_id bigint"), path, LEASE_TENANT, buckets=8)
    versioned.upsert(path, LEASE_TENANT, rows([(1, 2), (5, 6)], "lease_id int, tenant_id int"))
    got = sorted((r["lease_id"] or 0, r["tenant_id"]) for r in versioned.read(spark, path, LEASE_TENANT).collect())
    assert got == [(0, 4), (1, 2), (1, 3), (5, 6)]
    empty = str(tmp_path / "none")
    versioned.create(rows([], "provider_id bigint"), empty, PROVIDER)
    assert versioned.read(spark, empty, PROVIDER).count() == 0
    with pytest.raises(FileExistsError):
        versioned.create(rows([], "provider_id bigint"), path, PROVIDER)
    with pytest.raises(FileNotFoundError):
        versioned.current(spark, str(tmp_path / "nowhere"))
