"""Registered streaming query (T1): crawl days replayed through Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobsight.plans.catalog import ORACLE, register
from jobsight.plans.q_lifecycle import _ledger_us, _state_us
from jobsight.session import checkpoint_dir
from jobsight.sources.views import observations
from jobsight.streaming.ingest import read_ledger, read_state, stream_ingest


BUCKETS = 16


@register("stream_ingest")
def stream_ingest_q(spark, sf_dir):
    """Observations as one file per day, ingested a day to a micro-batch. The stream runs dry after a third of the
    days and ends; when the others are there it starts again from its checkpoint.

    The result is the published snapshot: it must equal job_state.
    """
    src = checkpoint_dir(spark).rstrip("/") + f"/jobsight-observations-{uuid.uuid4().hex}"
    obs, days = by_day(observations(spark, sf_dir))
    for part in (days[:len(days) // 3], days[len(days) // 3:]):
        write_days(obs, part, src)
        stream_ingest(spark, src, f"{src}-state", max_files_per_trigger=1, stream_checkpoint=f"{src}-stream", buckets=BUCKETS)
    return _state_us(read_state(spark, f"{src}-state"), with_metadata=True)


@register("stream_ledger")
def stream_ledger(spark, sf_dir):
    """L8 from the stream: a ledger row for each day, from the versions that published it; six days to a micro-batch."""
    src = checkpoint_dir(spark).rstrip("/") + f"/jobsight-observations-{uuid.uuid4().hex}"
    write_days(*by_day(observations(spark, sf_dir)), src)
    stream_ingest(spark, src, f"{src}-state", max_files_per_trigger=6, buckets=BUCKETS)
    return _ledger_us(read_ledger(spark, f"{src}-state"))


def by_day(obs):
    """The observations in a folder for each run, and the runs in order (calendar days)."""
    spark = obs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/jobsight-days-{uuid.uuid4().hex}"
    obs.write.partitionBy("run").parquet(path)
    obs = spark.read.schema(obs.schema).parquet(path)
    days = [r["run"] for r in obs.select("run").distinct().orderBy("run").collect()]
    return obs, days


def write_days(obs, days, path):
    """One file for each run, written in the order of the runs: the stream takes files by their time. Each reads its
    own folder only."""
    for day in days:
        obs.where(F.col("run") == day).coalesce(1).write.mode("append").parquet(path)


def _same_sql_as_job_state():
    from jobsight.plans import q_lifecycle  # noqa: F401  (registers job_state)
    ORACLE["stream_ingest"] = ORACLE["job_state"]
    ORACLE["stream_ledger"] = q_lifecycle.plain_ledger_sql()


_same_sql_as_job_state()
