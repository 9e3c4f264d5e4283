import pytest
from pyspark.sql import functions as F

from rentroll.operators import lookup, mutate, quality, sequence
from rentroll.schemas import INCOME, LEASE, TENANT


def test_dense_sequence_with_a_hot_group(spark):
    # one year and one leading key hold most of the rows
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, 2024).otherwise(2025).alias("year"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(3).alias("property"),
        (n - F.col("id")).alias("unit"),
    )
    last = spark.createDataFrame([(2025, 100)], "year int, _last bigint")
    out = sequence.dense_sequence(df, ["property", "unit"], ["year"], last)
    # checked by brute force in plain Python
    rows = df.collect()
    want = {}
    for year, base in ((2024, 0), (2025, 100)):
        keys = sorted((r["property"], r["unit"]) for r in rows if r["year"] == year)
        want.update({(year, *k): base + i + 1 for i, k in enumerate(keys)})
    got = {(r["year"], r["property"], r["unit"]): r["seq"] for r in out.collect()}
    assert got == want


def test_dense_sequence_plan_has_no_single_task_window(spark):
    df = spark.range(1000).select(F.lit(2025).alias("year"), "id")
    plan = sequence.dense_sequence(df, ["id"], ["year"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def test_settled_sequence(spark):
    out = sequence.dense_sequence(spark.range(100).filter("id % 9 = 0"), ["id"], settle=True)
    assert sorted(tuple(r) for r in out.collect()) == [(i * 9, i + 1) for i in range(12)]


def test_empty_sequence(spark):
    assert sequence.dense_sequence(spark.range(0), ["id"]).count() == 0


def test_one_per_key(rows):
    df = rows([("a", 1, "x"), ("a", 2, None), ("b", 5, "z")], "k string, n int, v string")
    first = mutate.one_per_key(df, ["k"], ["n"])
    last = mutate.one_per_key(df, ["k"], ["n"], last=True)
    assert sorted(map(tuple, first.collect())) == [("a", 1, "x"), ("b", 5, "z")]
    assert sorted((r["k"], r["n"]) for r in last.collect()) == [("a", 2), ("b", 5)]


def test_upserts(rows):
    ddl = "id int, a string, b string"
    target = rows([(1, "x", "p"), (2, "y", "q")], ddl)
    source = rows([(2, "n1", None, 1), (2, "n2", None, 2), (3, "n3", None, 3)], ddl + ", at int")
    full = mutate.full_upsert(target, source, ["id"], ["at"])
    assert sorted(map(tuple, full.collect())) == [(1, "x", "p"), (2, "n2", None), (3, "n3", None)]
    part = mutate.partial_upsert(target, source, ["id"], ["a"], ["at"])
    assert sorted(map(tuple, part.collect())) == [(1, "x", "p"), (2, "n2", "q"), (3, "n3", None)]
    upd = mutate.update_by_key(target, source, ["id"], ["at"])
    assert sorted(r["id"] for r in upd.collect()) == [1, 2]
    kept = mutate.delete_where(rows([(1,), (None,)], "id int"), F.col("id") == 1)
    assert [r[0] for r in kept.collect()] == [None]


def income(rows, data):
    df = rows(data, "transaction_id string, year int, status string, line_no int")
    from rentroll.schemas import conform
    return conform(df, INCOME.schema, keep_extra=True)


@pytest.mark.parametrize(("overwrite", "status"), [(False, "old"), (True, "n2")])
def test_guarded_upsert(rows, overwrite, status):
    target = income(rows, [("1", 2025, "old", 0), ("9", 2024, "past", 0)]).drop("line_no")
    batch = income(rows, [("1", 2025, "n1", 1), ("1", 2025, "n2", 2), ("9", 2025, "n9", 3), ("5", 2025, "a", 4),
                          ("5", 2025, "b", 5), (None, 2025, "c", 6), ("", 2025, "d", 7)])
    out = mutate.guarded_upsert(target, batch, "transaction_id", "year", ["line_no"], overwrite)
    got = {r["transaction_id"]: r["status"] for r in out.table.collect()}
    assert got == {"1": status, "9": "past", "5": "b" if overwrite else "a"}
    with pytest.raises(ValueError, match="outside its year"):
        mutate.require_no_conflicts(out.actions)


def test_property_and_unit(rows):
    properties = rows([(3, "Main St"), (2, "main st"), (7, "Elm")], "id bigint, name string")
    units = rows([(30, "A", 2), (70, "a", 7)], "id bigint, name string, property bigint")
    df = rows([("MAIN ST ", "a"), ("Elm", "zz"), (None, "a"), ("nowhere", "a")], "p string, u string")
    placed = lookup.resolve_unit(lookup.resolve_property(df, properties, "p"), units, "u")
    got = {(r["p"], r["u"]): (r["property"], r["unit"]) for r in placed.collect()}
    assert got == {("MAIN ST ", "a"): (2, 30), ("Elm", "zz"): (7, None), (None, "a"): (0, None), ("nowhere", "a"): (0, None)}


def test_members_stand_in_pages(rows):
    pairs = rows([(1, i) for i in range(25)] + [(2, 7), (2, 7), (3, None), (None, 4)], "lease bigint, tenant bigint")
    out = lookup.collect_members(pairs, "lease", "tenant", "tenants", page_size=10).collect()
    got = {(r["lease"], r["segment"]): r["tenants"] for r in out}
    assert got == {(1, 0): list(range(10)), (1, 1): list(range(10, 20)), (1, 2): list(range(20, 25)), (2, 0): [7]}


def test_lookups(rows):
    df = rows([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert lookup.key_lookup(df, "id", 2).count() == 1
    assert lookup.key_lookup(df, "id", [1, 3]).count() == 2
    assert lookup.key_lookup(df, "id", rows([(3,), (3,)], "id int")).count() == 1
    tenants = rows([(1, "A", "x@e", ""), (4, "B", "x@e", ""), (5, "C", "", "")], TENANT.ddl)
    assert [r["tenant_id"] for r in lookup.latest_by_email(tenants).collect()] == [4]
    with pytest.raises(ValueError, match="not found"):
        lookup.required_key(df, "v", "id", "zzz")


def test_quality(rows):
    leases = rows([(1, 5, 9, None, None, 2025), (1, 6, None, None, None, 2025), (None, 5, None, None, None, 2025)], LEASE.ddl)
    parents = {"property": rows([(5,)], "id bigint"), "units": rows([(8,)], "id bigint")}
    got = {(r["check_id"], r["key"], r["reason"]) for r in quality.check_table(leases, __import__("rentroll.schemas").schemas.LEASE, parents).collect()}
    assert got == {
        ("primary_key", "1", "duplicate key"), ("primary_key", "NULL", "missing key"),
        ("foreign_key", "6", "property has no parent"), ("foreign_key", "9", "unit has no parent"),
    }
    long = quality.check_lengths(rows([(1, "abcdef")], "id int, name string"), "t", ["id"], {"name": 5})
    assert [r["reason"] for r in long.collect()] == ["name longer than 5"]
    wide = quality.check_money_fits(rows([(1, 1e12), (2, 5.0)], "id int, v double"), "t", ["id"], ["v"])
    assert [r["key"] for r in wide.collect()] == ["1"]
    with pytest.raises(ValueError):
        quality.require_year(0)


def test_hot_name_is_split_among_tasks(spark):
    """A property holding a third of the rows, against a dimension too big to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).cast("string")
        df = spark.range(0, 300_000, 1, 8).select("id", F.concat(F.lit("P"), key).alias("p"))
        dim = spark.range(1000).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"))
        total = lookup.resolve_property(df, dim, "p").agg(F.count(F.lit(1)), F.sum("property"), F.sum("id"))
        want = sum(7 if i % 3 == 0 else i % 1000 for i in range(300_000))
        assert tuple(total.first())[:2] == (300_000, want)
        total.collect()
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_check_table_scans_once(spark, tmp_path):
    from rentroll.schemas import EXPENSE

    rows = spark.createDataFrame(
        [("a", "1.00", 1, "x"), ("a", "1.00", 1, "x"), (None, "-", None, "x"), ("b", "123456789.00", 2, "yy"), ("c|d", "ten", 9, "yy")],
        "transaction string, amount string, property bigint, exclude string")
    for c, kind in (("unit", "bigint"), ("category", "bigint"), ("provider", "bigint")):
        rows = rows.selectExpr("*", f"CAST(NULL AS {kind}) AS {c}")
    rows.write.parquet(str(tmp_path / "expense"))
    stored = spark.read.parquet(str(tmp_path / "expense"))
    out = quality.check_table(stored, EXPENSE, {"property": spark.createDataFrame([(1,), (2,)], "id bigint")})
    assert sorted((r["check_id"], r["key"], r["reason"]) for r in out.collect()) == [
        ("foreign_key", "9", "property has no parent"), ("length", "b", "exclude longer than 1"), ("length", "c|d", "exclude longer than 1"),
        ("primary_key", "NULL", "missing key"), ("primary_key", "a", "duplicate key"),
        ("unreadable", "b", "amount unreadable"), ("unreadable", "c|d", "amount unreadable")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert quality.check_table(stored.limit(0), EXPENSE, {}).count() == 0
