"""Intermediate tables in the shared folder."""

from __future__ import annotations

import pickle
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from jobsight.session import checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the folder of spark.checkpoint.dir and read again.

    Cuts the lineage as checkpoint() does, and also drops what the optimizer knows of the rows: a checkpoint keeps
    the constraints of its plan, which loops of joins pile up until planning takes minutes. Not compressed: hashes
    do not shrink, and the codecs' direct buffers stay until a full collection.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """Broadcast an object of this package's classes, with their code: workers need not have the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(handle):
    """What ``share`` was given, in a task."""
    return pickle.loads(handle.value)


def free_name(columns: list[str], name: str) -> str:
    """``name``, behind as many underscores as it takes to be no column of ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of ``n`` rows for what is written inside: 10,000 long texts at once are hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)
