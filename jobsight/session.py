"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "jobsight") -> SparkSession:
    """A session with AQE on, UTC clock and Arrow transfer for pandas UDFs.

    On a cluster the master, memory and shuffle sizing come from spark-submit;
    this helper is for local runs, tests and the bench.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("JOBSIGHT_DRIVER_MEMORY", "16g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.jobsight.inputPartitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


ARROW_BYTES = 12 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_NO_LIMIT = (1 << 31) - 1


def limit_arrow_batches(spark: SparkSession, limit: int = ARROW_BYTES) -> None:
    """Arrow batches to Python hold at most about ``limit`` bytes, unless the session names a limit itself.

    By default a batch holds 10,000 rows whatever their size: 10 GB of 1 MB pages. The setting must hold when the
    DataFrame runs, which may be long after it was built, so it stays set in the session.
    """
    if int(spark.conf.get(_ARROW_LIMIT, str(_NO_LIMIT))) >= _NO_LIMIT:
        spark.conf.set(_ARROW_LIMIT, limit)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Read from the session. Only a local master (one machine, as in tests) may
    leave it unset: a fresh folder is made then. On a cluster that would be a
    machine-local folder, so an unset value is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="jobsight-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet under the shared checkpoint folder: a fraction of the bytes of checkpoint()."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
