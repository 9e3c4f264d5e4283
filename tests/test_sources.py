import pytest
from pyspark.sql import functions as F

from rentroll.operators.sequence import number_file_rows
from rentroll.plans.dimensions import refresh_dimensions
from rentroll.schemas import EXPENSE, EXPENSE_CATEGORY, PROPERTY, PROVIDER, UNITS, conform
from rentroll.sources import csv, manifest, records, tables


def write(path, content):
    path.write_text(content)
    return str(path)


def test_headers(spark, tmp_path):
    rows = csv.scan_csv(spark, write(tmp_path / "a.csv", "Transaction ID,Status\n1,Paid\n")).rows
    assert rows.columns[:2] == ["transaction id", "status"] and rows.count() == 1
    row = csv.scan_csv(spark, write(tmp_path / "b.CSV", "ID, group_reference\n1, 5\n")).rows.first()
    assert (row["id"], row["group_reference"]) == ("1", "5")


def test_input_guard(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        csv.scan_csv(spark, " ")
    with pytest.raises(FileNotFoundError):
        csv.scan_csv(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError, match="CSV"):
        csv.scan_csv(spark, write(tmp_path / "a.txt", "x\n"))


def test_quoting_short_and_long_records(spark, tmp_path):
    content = 'id,g,c\n1," a ","say ""hi"", ok"\n2,b\n\n3,c,4,5\n4,"two\nlines",\n'
    scan = csv.scan_csv(spark, write(tmp_path / "q.csv", content))
    got = [(r["id"], r["g"], r["c"]) for r in scan.rows.orderBy("id").collect()]
    assert got == [("1", "a", 'say "hi", ok'), ("3", "c", "4"), ("4", "two\nlines", None)]
    assert [r["record"].strip() for r in scan.rejects.collect()] == ["2,b"]
    # selecting few columns must not hide short records
    assert scan.rows.select("id").count() == 3
    with pytest.raises(ValueError, match="lacks"):
        csv.scan_csv(spark, str(tmp_path / "q.csv"), strict=True)


def test_file_order_numbers(spark, tmp_path):
    for name in ("b", "a"):
        write(tmp_path / f"{name}.csv", "v\n" + "".join(f"{name}{i:04d}\n" for i in range(500)))
    rows = csv.scan_csv(spark, str(tmp_path)).rows
    numbered = number_file_rows(rows, last=10)
    got = [r["v"] for r in numbered.orderBy("id").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert numbered.agg(F.min("id"), F.max("id")).first()[:] == (11, 1010)


def test_column_mapping(spark, tmp_path):
    path = write(tmp_path / "i.csv", "Transaction ID,Lease #\n7,12\n")
    row = csv.map_columns(csv.scan_csv(spark, path).rows).first()
    assert (row["transaction_id"], row["leasenum"], row["unit"]) == ("7", "12", None)


def test_dimension_refresh(spark, tmp_path, rows):
    raw = {
        "property": "ID,Name,Full_Address,Number_of_units\n1,Property A,addr,4\n1,Property B,addr,5\n",
        "units": "ID,Name,Property,Bedrooms,Bathrooms,Has_Porch,Has_Back_Yard,Washer_Dryer,IS_Unit_Group, Group_reference\n"
                 "3,U3,1,2,1,Y,N,Y,,\n",
    }
    scans = {n: csv.scan_csv(spark, write(tmp_path / f"{n}.csv", c)).rows for n, c in raw.items()}
    import datetime as dt
    current = {
        "property": rows([(1, "old", "x", 1, dt.date(2020, 1, 1))], PROPERTY.ddl),
        "units": rows([], UNITS.ddl), "expense_category": rows([], EXPENSE_CATEGORY.ddl),
        "provider": rows([], PROVIDER.ddl),
    }
    out = refresh_dimensions(current, scans)
    got = {r["id"]: tuple(r) for r in out["property"].collect()}
    # the last row of a key wins, the stored date stays, the placeholder is there
    assert got[1] == (1, "Property B", "addr", 5, dt.date(2020, 1, 1))
    assert got[0][1] == "Unknown Property"
    unit = out["units"].first()
    assert (unit["id"], unit["is_unit_group"], unit["group_reference"]) == (3, None, None)
    bad = csv.scan_csv(spark, write(tmp_path / "bad.csv", "id,name,full_address,number_of_units\n1,a,b,many\n")).rows
    with pytest.raises(Exception, match="many"):
        refresh_dimensions({"property": current["property"]}, {"property": bad})["property"].collect()


def test_tables_and_evolution(spark, tmp_path, rows):
    path = str(tmp_path / "expense")
    old = rows([("SE-1", 2025)], "transaction string, year int")
    old.write.parquet(path)
    assert tables.read_table(spark, path, EXPENSE).first()["amount"] is None
    fresh = str(tmp_path / "fresh")
    tables.write_table(old, fresh, EXPENSE, ["year"])
    with pytest.raises(Exception, match="exists"):
        tables.write_table(old, fresh, EXPENSE, ["year"])
    tables.append_rows(rows([("SE-2", 2024)], "transaction string, year int"), fresh, EXPENSE, ["year"])
    tables.replace_partitions(rows([("SE-3", 2025)], "transaction string, year int"), fresh, EXPENSE, ["year"])
    got = tables.read_table(spark, fresh, EXPENSE)
    assert sorted(r["transaction"] for r in got.collect()) == ["SE-2", "SE-3"]
    assert conform(old, EXPENSE.schema).schema.names == EXPENSE.names


def test_manifest(spark, rows):
    known = rows([(5, "/a.csv", None, 2024, "t", 3, 2, 1)],
                 "id bigint, file_path string, processed_at timestamp, year int, file_type string, "
                 "total_rows bigint, success_rows bigint, failed_rows bigint")
    files = rows([("/a.csv", 2025), ("/c.csv", 2025), ("/b.csv", 2025)], "file_path string, year int")
    assert {r["file_path"] for r in manifest.unprocessed(files, known).collect()} == {"/a.csv", "/b.csv", "/c.csv"}
    out = manifest.register_files(known, files, manifest.BANK_FILES)
    got = {r["file_path"]: (r["id"], r["year"], r["total_rows"]) for r in out.collect()}
    assert got == {"/a.csv": (5, 2025, 3), "/b.csv": (6, 2025, None), "/c.csv": (7, 2025, None)}
    assert manifest.unprocessed(files, out).count() == 0


def test_no_file_is_read_whole(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "clean a.csv", "Id,Text\n" + "".join(f"{i},plain\n" for i in range(50)))
    write(folder / "spans.csv", 'Id,Text\n100,"two\nlines"\n101,after\n')
    write(folder / "inch.csv", 'Id,Text\n200,1 5" pipe\n201,after\n')
    scan = csv.scan_csv(spark, str(folder))
    got = {r["id"]: r["text"] for r in scan.rows.collect()}
    assert len(got) == 54 and got["100"] == "two\nlines" and got["101"] == got["201"] == "after" and got["200"] == '1 5" pipe'
    assert scan.rejects.count() == 0
    keys = scan.rows.select(*csv.LINE_COLUMNS).distinct().count()
    assert keys == 54
    plan = scan.rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "FileScan parquet" in plan  # the stored lines, not the files again


def plain_records(text):
    """Records by walking over the characters; a quote opens a value only at its start."""
    out, record, inside, start, i = [], "", False, True, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                record, i = record + c, i + 1
            elif c == '"':
                inside = False
        elif c == '"' and start:
            inside = True
        if c == "\n" and not inside:
            out.append(record)
            record, start = "", True
        else:
            start = not inside and c == ","
            record += c
        i += 1
    return [r for r in [*out, record] if r.strip()]


def test_records_span_lines_and_splits(spark, tmp_path):
    """Random records with quotes and line breaks, in files cut into many splits."""
    import random

    rng = random.Random(3)
    pieces = ["a", "", 'x"y', '"q"', '"a""b"', '"two\nlines"', '"\n"', '"l""1\n\n,""\nend"', "5\" pipe", '"tail" x', '" , "']
    texts = {n: "h,i,j\n" + "".join(",".join(rng.choices(pieces, k=3)) + "\n" for _ in range(400)) for n in ("a", "b", "c")}
    texts["long"] = "h,i,j\n" + '1,"' + "line\n" * 300 + '",2\n3,4,5\n'
    for name, text in texts.items():
        write(tmp_path / f"{name}.csv", text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "499")
        lines = records.read_lines(spark, str(tmp_path), "*.csv")
        assert lines.select("source_file", "line_block").distinct().count() > 30
        found, broken = records.records(lines)
        got = {n: [] for n in texts}
        for r in found.orderBy("line_block", "line_at").collect():
            if r["record"].strip():
                got[r["source_file"].rsplit("/", 1)[1][:-4]].append(r["record"])
        assert got == {n: plain_records(t) for n, t in texts.items()}
        assert broken.count() == 0
        rows = csv.scan_csv(spark, str(tmp_path)).rows
        assert rows.rdd.getNumPartitions() > 1
        assert sum(len(plain_records(t)) - 1 for t in texts.values()) == rows.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_records_stay_where_their_lines_lie(spark, tmp_path):
    path = write(tmp_path / "s.csv", "a,b\n" + '1,"two\nlines"\n2,x\n' * 200)
    found, broken = records.records(records.read_lines(spark, path, "*.csv"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("record").count().orderBy("record").collect()[:] == [('1,"two\nlines"', 200), ("2,x", 200), ("a,b", 1)]
    assert broken.count() == 0


def test_quote_that_never_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RECORD_LINES", 5)
    path = write(tmp_path / "q.csv", 'a,b\n1,"two\nlines"\n2,x\n3,"open\n' + "4,y\n" * 9)
    scan = csv.scan_csv(spark, path)
    assert sorted((r["a"], r["b"]) for r in scan.rows.collect()) == [("1", "two\nlines"), ("2", "x")]
    assert sorted(r["record"] for r in scan.rejects.collect()) == ['3,"open'] + ["4,y"] * 9
    with pytest.raises(ValueError, match="does not end"):
        csv.scan_csv(spark, path, strict=True)


def test_headers_of_spanning_files(spark, tmp_path):
    write(tmp_path / "a.csv", '\ufeff"ID\n1",,ID,id\n1,"x\ny",2,3\n')
    rows = csv.scan_csv(spark, str(tmp_path)).rows
    assert rows.columns[:4] == ["id\n1", "_c1", "id2", "id3"] and rows.first()[:4] == ("1", "x\ny", "2", "3")
    write(tmp_path / "b.csv", 'x,y,z,w\n1,"x\ny",2,3\n')
    with pytest.raises(ValueError, match="headers differ"):
        csv.scan_csv(spark, str(tmp_path))
