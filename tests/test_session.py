"""Lineage cuts, their cleanup, and scan spreading."""

import os

from quire.session import cut, cut_scope, ensure_checkpoint_dir, spread


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_cut_scope_deletes_its_tables(spark):
    base = ensure_checkpoint_dir(spark)
    with cut_scope(spark) as sc:
        a = cut(spark.range(100), "t")
        assert a.count() == 100
        paths = list(sc.paths)
    assert paths and all(p.startswith(base.rstrip("/")) for p in paths)
    assert not any(os.path.exists(_local(p)) for p in paths)


def test_cut_reads_back_in_parallel_and_spread_is_conditional(spark):
    with cut_scope(spark):
        wide = spark.range(0, 400_000, numPartitions=1).selectExpr("id", "sha2(cast(id AS string), 256) AS pad")
        back = cut(wide, "wide")
        assert back.count() == 400_000
        assert back.rdd.getNumPartitions() > 1          # small row groups split
    one = spark.range(0, 10, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() > 1
    many = spark.range(0, 10, numPartitions=64)
    assert spread(many).rdd.getNumPartitions() == 64   # already split: untouched


def test_shuffle_files_go_with_the_cut_that_made_them(spark):
    import time

    from pyspark.sql import functions as F
    from quire import session

    jvm = spark.sparkContext._jvm

    def shuffles():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f.rsplit("/", 1)[-1] for f in files.split("\n") if "/shuffle_" in f}

    before = shuffles()
    sums = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s"))
    with cut_scope(spark):
        back = cut(sums, "sums")
        until = time.time() + 20
        while shuffles() - before and time.time() < until:      # Spark deletes them in the background
            time.sleep(0.1)
        assert not shuffles() - before
        assert back.count() == 97
        again = cut(sums, "sums").agg(F.sum("s")).first()[0]    # the same frame once more
    assert again == sum(range(10_000))
    assert spark.conf.get(session.SHUFFLES_GO, "false") == "false"     # only while the cut is written
