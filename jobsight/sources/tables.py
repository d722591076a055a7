"""Driver-table loading (parquet, column pruning and filter pushdown by Catalyst)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; lazily, so only referenced columns are scanned."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin the rows over ``partitions`` before CPU-heavy per-row work.

    The count is the caller's choice: the argument, or the session's
    ``spark.jobsight.inputPartitions`` (set for tables of one large file).
    With neither the input's own splits stay; nothing depends on its size.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.jobsight.inputPartitions", "0"))
    return df.repartition(n) if n else df


def spread_by(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition rows for a CPU-heavy stage (a Python UDF).

    A user-specified partition count is kept by AQE, so a small but
    expensive table (candidate pairs) is not coalesced into one task; the
    count follows the cluster's parallelism and the session's shuffle size.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism * 2,
            int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(n, *cols)
