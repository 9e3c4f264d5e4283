"""The shared folder and what stored tables leave behind."""

import time

from rentroll import session


def test_stored_tables_leave_no_shuffle_files(spark, rows):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if "shuffle_" in f}

    before, option = shuffled(), spark.conf.get(session.DROP_SHUFFLES)
    counted = rows([(i % 7, i) for i in range(1000)], "k int, v int").groupBy("k").count()
    stored = session.durable(counted, "test")
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert sorted(tuple(r) for r in stored.collect()) == sorted(tuple(r) for r in counted.collect())
    assert spark.conf.get(session.DROP_SHUFFLES) == option
