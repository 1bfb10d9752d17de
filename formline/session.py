"""Session settings shared by the operators: size checks and durable lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS_KEY = "formline.groupRows"
PROBE_BYTES_KEY = "formline.probeBytes"


@dataclass(frozen=True)
class ScalePolicy:
    """When a key group counts as hot.

    group_rows: rows of one group that a single task may take.
    probe_bytes: inputs with a smaller plan size are never probed for hot groups.
    """

    group_rows: int = 2_000_000
    probe_bytes: int = 32 * 1024 * 1024


def scale_policy(spark: SparkSession) -> ScalePolicy:
    """Policy from the session conf (``formline.groupRows``, ``formline.probeBytes``)."""
    default = ScalePolicy()
    return ScalePolicy(
        group_rows=int(spark.conf.get(GROUP_ROWS_KEY, str(default.group_rows))),
        probe_bytes=int(spark.conf.get(PROBE_BYTES_KEY, str(default.probe_bytes))),
    )


def plan_bytes(df: DataFrame) -> int:
    """Size estimate of a plan without running it: Catalyst's, or the sum of its sources if smaller.

    Catalyst multiplies the sides of a join, which overstates lookups by far.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sources = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), sources)


def catalyst_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan: what Spark decides a broadcast by."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_bytes(spark: SparkSession) -> int:
    """Size up to which Spark broadcasts a join side by itself."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


#: Paths and tables written by ``cut`` and ``cut_by`` in this process, in order; ``discard`` takes from it.
MADE: list[str] = []
_TABLE = "table:"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only in local mode, where it is shared by nature."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="formline-ckpt-"))
    return context.getCheckpointDir()


#: Has Spark delete the shuffle files of an execution when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING = threading.Lock()
_WRITES: dict[SparkSession, tuple[int, str | None]] = {}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files behind: what they write replaces them, so disks hold one step's shuffles.

    Writes may overlap; the session's own setting returns with the last of them.
    """
    with _WRITING:
        running, before = _WRITES.get(spark, (0, spark.conf.get(CLEANUP_KEY, None)))
        _WRITES[spark] = (running + 1, before)
        spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        with _WRITING:
            running, before = _WRITES.pop(spark)
            if running > 1:
                _WRITES[spark] = (running - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP_KEY)
            else:
                spark.conf.set(CLEANUP_KEY, before)


def cut(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder and read it back.

    A lost executor costs no recompute, readers take only the columns they need, and the
    planner sees true sizes. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/formline-{uuid.uuid4().hex}.parquet"
    with shuffles_removed(spark):
        df.write.options(**(options or {})).parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Materialise as a warehouse table in hash buckets of ``key``: grouping by it needs no shuffle."""
    name = f"formline_{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.bucketBy(buckets, key).format("parquet").saveAsTable(name)
    MADE.append(_TABLE + name)
    return df.sparkSession.table(name)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete what ``cut`` and ``cut_by`` wrote, once no DataFrame that reads it is needed."""
    for entry in made:
        if entry.startswith(_TABLE):
            spark.sql(f"DROP TABLE IF EXISTS {entry.removeprefix(_TABLE)}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(entry)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if entry in MADE:
            MADE.remove(entry)
