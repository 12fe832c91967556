"""Sessions and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "isobath", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; cluster settings of the caller stay untouched."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; a local session without one, as in tests, gets a temporary one.

    On a cluster a machine's own folder would lose checkpoints, so there the setting is required.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="isobath-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder; later reads survive lost executors.

    A checkpoint keeps the planner's size estimate, which joins multiply; over a long chain of cuts its
    digits would grow without end. So the rows are taken up as a new table, whose size adaptive execution finds.
    """
    spark = df.sparkSession
    ensure_checkpoint_folder(spark)
    written = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, for short chains: the planner's size estimate is kept."""
    ensure_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
