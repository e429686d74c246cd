"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task of text work gets at most, about.
TASK_ROWS = 50_000


def build_session(app: str = "metframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="metframe-shared-"))
    return context.getCheckpointDir()


def stage_folder(spark: SparkSession) -> str:
    """Where the stages of this application are written."""
    return f"{shared_folder(spark)}/metframe-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete the stages of this application, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows out when their source has fewer pieces than there are cores or runs of `task_rows` rows.

    Meant for CPU-bound text work on files, whose rows are counted from their footers. Compact files hold millions of rows in a
    split, so pieces go by rows and the longest task doesn't grow with the table. A source with enough splits is returned as it
    is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = cores * max(1, math.ceil(df.count() / task_rows / cores))
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Used where two branches read the result of costly extraction: each branch then scans
    only the columns it needs, and a lost executor costs a re-read, not a re-extraction.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
