"""Session settings the operators rely on, and materialisation on shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Static and runtime settings for a session this library starts itself. A session
# that already exists keeps its own sizing; only RUNTIME is applied to it.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Row groups carry statistics for this type, so time filters skip them.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}
STATIC = {
    # Plans here hold many small expressions; recording the Python call site of each one
    # takes longer than running a small query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "liftgrid", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**STATIC, **RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on (UTC calendar) in a given session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names, if it names one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder on shared storage; "
            "a machine-local folder would not survive the loss of an executor"
        )
    root = tempfile.mkdtemp(prefix="liftgrid-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative fits (boosted trees) truncate their lineage through this folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


_written: dict[str, list[str]] = {}


def _delete_written(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # stopped before
        return
    for path in _written.pop(context.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder; it is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_delete_written, spark)
    path = f"{scratch_root(spark)}/liftgrid/{label}-{uuid.uuid4().hex}"
    _written[app].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once into a table in the scratch folder and read it back.

    Used where several operators consume one intermediate: a written table is computed
    once, survives executor loss, keeps column pruning and gives the planner true sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_small(df: DataFrame, label: str, max_rows: int = 500) -> DataFrame:
    """``materialize``; a table of at most ``max_rows`` rows comes back as one partition.

    The handful of arm rows of usual runs then needs no further shuffle, however many
    operators group or rank it. A larger table keeps its partitions.
    """
    table = materialize(df, label)
    return table.coalesce(1) if table.count() <= max_rows else table


def lookup_join(large: DataFrame, small: DataFrame, on: list[str], max_rows: int = 200_000) -> DataFrame:
    """Inner join with a table of offsets or centres that is meant to be small.

    The small side is computed first and its rows are counted; only within ``max_rows``
    is it broadcast, beyond that the planner shuffles both sides.
    """
    small = materialize(small, "lookup")
    return large.join(F.broadcast(small) if small.count() <= max_rows else small, on)
