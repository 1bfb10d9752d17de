import os

from pyspark.sql import functions as F

from formline import session


def shuffle_bytes(spark):
    top = spark.conf.get("spark.local.dir", "/tmp")
    ours = [d for d in os.listdir(top) if d.startswith("blockmgr-")]
    return {f for d in ours for _, _, names in os.walk(f"{top}/{d}") for f in names if f.startswith("shuffle") and f.endswith(".data")}


def test_cut_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    grouped = spark.range(50_000).groupBy((F.col("id") % 5003).alias("k")).agg(F.max("id").alias("m"))
    for before in (None, "false"):
        if before is not None:
            spark.conf.set(session.CLEANUP_KEY, before)
        known, held = shuffle_bytes(spark), spark.conf.get(session.CLEANUP_KEY, None)
        assert session.cut(grouped).count() == 5003 == session.cut(grouped).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert len(shuffle_bytes(spark) - known) <= 2  # of the counts themselves
        assert spark.conf.get(session.CLEANUP_KEY, None) == held
    spark.conf.unset(session.CLEANUP_KEY)


def test_the_setting_returns_with_the_last_of_several_writes(spark):
    with session.shuffles_removed(spark):
        with session.shuffles_removed(spark):
            pass
        assert spark.conf.get(session.CLEANUP_KEY) == "true"
    assert spark.conf.get(session.CLEANUP_KEY, None) in (None, "false")
