"""Stored tables of which a merge rewrites only the parts that it touches.

A table is dealt over a fixed number of buckets by a hash of its key. Each merge writes the buckets that its rows fall
into to a folder of its own and then one small pointer, which says for every bucket in which folder its present files
lie. So files of other buckets keep their names and are not read; a reader sees either all of a merge or none of it;
a merge that fails before its pointer is there has changed nothing; and earlier versions stay readable.

    <path>/versions/00000000000000000002.json    the pointer: key, number of buckets, folder of each bucket
    <path>/data/<merge>/_bucket=17/part-...      the files
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rentroll.operators.mutate import full_upsert
from rentroll.schemas import Table, conform
from rentroll.session import durable

BUCKET = "_bucket"
MOST_BUCKETS = 65_536  # what a pointer lists, and so all that reaches the driver of a merge


class State(NamedTuple):
    version: int
    key: list[str]
    buckets: int
    folders: dict[int, str]  # bucket -> folder under the table's path; a bucket without rows has none


class Merged(NamedTuple):
    version: int
    touched: list[int]


class PointerError(RuntimeError):
    """Another merge took the version, or its pointer is not whole."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_names(spark: SparkSession, path: str) -> list[str]:
    found, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def read_text(spark: SparkSession, path: str) -> str:
    found, fs = _files(spark, path)
    stream = fs.open(found)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a name that must be new."""
    found, fs = _files(spark, path)
    if fs.exists(found):
        raise PointerError(f"{path} is there already")
    try:
        stream = fs.create(found, False)
    except Exception as error:
        raise PointerError(f"{path} was taken by another writer") from error
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, state: State) -> None:
    """Write a pointer under a new name, so of two merges from one version only one succeeds."""
    write_new(spark, f"{path}/versions/{state.version:020d}.json", json.dumps(state._asdict(), sort_keys=True))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table, oldest first."""
    return [int(n[:-5]) for n in file_names(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit()]


def current(spark: SparkSession, path: str, version: int | None = None) -> State:
    """The pointer of a version, by default the newest."""
    there = versions(spark, path)
    if not there:
        raise FileNotFoundError(f"no stored table at {path}")
    chosen = there[-1] if version is None else version
    try:
        told = json.loads(read_text(spark, f"{path}/versions/{chosen:020d}.json"))
    except json.JSONDecodeError as error:
        raise PointerError(
            f"the pointer of version {chosen} of {path} is not whole: its writer is at work, or died and left it to be deleted"
        ) from error
    return State(told["version"], told["key"], told["buckets"], {int(b): f for b, f in told["folders"].items()})


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """The bucket of a key; its columns must have the table's types, as the hash depends on them."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, state: State) -> dict[int, str]:
    """Write rows by bucket to a fresh folder; a bucket that holds much of the table is split over several files."""
    folder = f"data/{uuid.uuid4().hex}"
    placed = df.withColumn(BUCKET, bucket_of(state.key, state.buckets)).hint("rebalance", BUCKET)
    placed.write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    written = [n for n in file_names(df.sparkSession, f"{path}/{folder}") if n.startswith(f"{BUCKET}=")]
    return {int(n.split("=")[1]): folder for n in written}


def create(df: DataFrame, path: str, table: Table, buckets: int = 64, key: Sequence[str] | None = None) -> Merged:
    """Store a complete table as version 1; a table that is there already is an error."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    if versions(df.sparkSession, path):
        raise FileExistsError(f"a stored table is at {path}")
    state = State(1, list(key or table.key), buckets, {})
    state = state._replace(folders=_write(conform(df, table.schema), path, state))
    _point(df.sparkSession, path, state)
    return Merged(1, sorted(state.folders))


def read(spark: SparkSession, path: str, table: Table, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """A version of a stored table, or some of its buckets only."""
    state = current(spark, path, version)
    wanted = state.folders if buckets is None else [b for b in buckets if b in state.folders]
    places = [f"{path}/{state.folders[b]}/{BUCKET}={b}" for b in sorted(wanted)]
    return spark.read.schema(table.schema).parquet(*places) if places else spark.createDataFrame([], table.schema)


def read_keys(spark: SparkSession, path: str, table: Table, keys: DataFrame, version: int | None = None) -> DataFrame:
    """The stored rows of the keys in ``keys``; buckets that hold none of them are not read."""
    state = current(spark, path, version)
    schema = {f.name: f.dataType for f in table.schema.fields}
    wanted = durable(keys.select(*[F.col(c).cast(schema[c]).alias(c) for c in state.key]).distinct(), "keys")
    touched = [r[0] for r in wanted.select(bucket_of(state.key, state.buckets).alias(BUCKET)).distinct().collect()]
    return read(spark, path, table, state.version, touched).join(wanted, state.key, "left_semi")


def merge(
    path: str, table: Table, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]
) -> Merged:
    """Replace the buckets that ``rows`` fall into by ``change(stored rows of those buckets, rows)``.

    ``change`` makes a complete new state of what it is given and may look at no other rows, which holds for every
    change that goes by the table's key. Columns of ``rows`` that the table lacks, such as an order, reach it too.
    No rows leave the version as it is. A bucket left without rows has no files any more.
    """
    spark = rows.sparkSession
    state = current(spark, path)
    # the rows decide which buckets are read and are then merged into them, so both must see the same
    given = durable(conform(rows, table.schema, keep_extra=True).withColumn(BUCKET, bucket_of(state.key, state.buckets)), "merged")
    touched = sorted(r[0] for r in given.select(BUCKET).distinct().collect())
    if not touched:
        return Merged(state.version, [])
    new = change(read(spark, path, table, state.version, touched), given.drop(BUCKET))
    written = _write(conform(new, table.schema), path, state)
    if strays := set(written) - set(touched):
        raise ValueError(f"the change moved rows to other buckets: {sorted(strays)[:5]}")
    kept = {b: f for b, f in state.folders.items() if b not in set(touched)}
    _point(spark, path, state._replace(version=state.version + 1, folders=kept | written))
    return Merged(state.version + 1, touched)


def upsert(path: str, table: Table, rows: DataFrame, order_by: Sequence[str] | None = None) -> Merged:
    """Whole rows replace those with the same key, others are added; the last by ``order_by`` counts."""
    key = current(rows.sparkSession, path).key
    return merge(path, table, rows, lambda old, new: full_upsert(old, new, key, order_by))
