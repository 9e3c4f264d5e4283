"""A journal of named, stored steps, so that a long run resumes where it failed.

A step makes tables. They are written to a folder of their own, and then one small record says that the step is done and
where they lie. A step with a record is read, not run again. What a step was given is part of its record's name, and so is
the step before it: with other input a step and all later ones run anew, and earlier records stay for earlier input.

    <path>/steps/0003-loans-5f0c...-<run>.json    the record: tables, their folders and schemas
    <path>/data/<run>-loans/bank_payment/part-...  the files

A record that is not whole, as of a writer that died, counts as none. Of two runs at once each stores its own files; later
ones read the record whose name comes first.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rentroll.functions.prints import exact_sum
from rentroll.sources.versioned import file_names, read_text, write_new


def fingerprint(df: DataFrame) -> str:
    """A text that tables of the very same rows share, whatever their order; reads the table once.

    It holds the columns, the number of rows and two exact sums of hashes, which add up in parts before any shuffle.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    sums = [exact_sum(F.xxhash64(F.lit(seed), *columns)) for seed in (1, 2)]
    return f"{df.schema.simpleString()} {[str(v) for v in df.agg(F.count(F.lit(1)), *sums).first()]}"


class Journal:
    """The steps of one run in order; ``path`` is a folder that all executors reach and that outlives the session."""

    def __init__(self, spark: SparkSession, path: str, given: str = "") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.at = 0
        self.key = hashlib.sha256(given.encode()).hexdigest()
        self.ran: list[str] = []  # the steps that were run, not read

    def _recorded(self, start: str) -> dict[str, dict] | None:
        for name in file_names(self.spark, f"{self.path}/steps"):
            if name.startswith(start) and name.endswith(".json"):
                try:
                    return json.loads(read_text(self.spark, f"{self.path}/steps/{name}"))
                except json.JSONDecodeError:
                    continue
        return None

    def step(self, name: str, make: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a step, as stored: those of its record, or made, written and recorded now.

        ``make`` may use nothing but what the journal was given and what earlier steps gave back.
        """
        self.at += 1
        self.key = hashlib.sha256(f"{self.key} {name}".encode()).hexdigest()
        start = f"{self.at:04d}-{name}-{self.key[:32]}-"
        record = self._recorded(start)
        if record is None:
            run, record = uuid.uuid4().hex, {}
            for table, df in make().items():
                folder = f"data/{run}-{name}/{table}"
                df.write.parquet(f"{self.path}/{folder}")
                record[table] = {"folder": folder, "schema": df.schema.jsonValue()}
            write_new(self.spark, f"{self.path}/steps/{start}{run}.json", json.dumps(record, sort_keys=True))
            self.ran.append(name)
        return {t: self.spark.read.schema(StructType.fromJson(r["schema"])).parquet(f"{self.path}/{r['folder']}") for t, r in record.items()}
