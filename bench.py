"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from rentroll.driver.queries import QUERIES
from rentroll.session import local_session

HEADLINES = (
    "vacancy_loss", "vacancy_loss_recompute", "income_normalized", "income_parsed", "income_ledger",
    "income_upsert_overwrite", "income_view", "expense_view_full", "bank_staging_landed", "loan_payments",
    "utility_expenses", "file_counts", "message_search", "html_to_text", "message_body", "dq_foreign_keys",
    "csv_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("rentroll-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # starts the workers and the Parquet reader, so that the first query is not charged for them
    QUERIES["message_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
