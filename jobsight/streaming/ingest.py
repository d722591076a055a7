"""Crawl cycles as a Structured Streaming job.

Each micro-batch of observation files goes through the lifecycle closed
forms (L1-L8) against the newest published snapshot and publishes the next
snapshot version plus its ledger rows. The state lies in buckets by the hash
of the URL: a batch reads the URLs, companies and flags of the whole state, but
writes only the buckets of URLs that it saw or deactivated. The micro-batch id
is stored with the snapshot pointer: a replayed batch (after a driver restart,
the same id) is skipped, so the sink is idempotent. The streaming checkpoint
and the state folders live under the cluster's shared checkpoint directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.operators import lifecycle as L
from jobsight.session import checkpoint_dir
from jobsight.sources import io

OBS_SCHEMA = ("url string, company string, title string, location string, job_id string, "
              "ts timestamp, seq long, run string, metadata map<string,string>")

OBS_COLUMNS = [c.split()[0] for c in OBS_SCHEMA.split(", ")]


class LateRunError(ValueError):
    """A micro-batch holds a run that is not after the runs already applied."""


def last_applied_run(spark: SparkSession, state_base: str):
    p = io.latest(spark, state_base)
    return p["last_run"] if p else None


def merge(state: io.Manifest, batch: DataFrame, path: str) -> io.Manifest:
    """The state after the runs of ``batch``: only the buckets of URLs that they saw or deactivated are written."""
    urls = batch.select("url").distinct()
    gone = (state.read().filter("is_active").select("url", "company")
            .join(batch.select("company").distinct(), "company", "left_semi").join(urls, "url", "left_anti"))
    touched = urls.union(gone.select("url")).select(io.bucket_of("url", state.buckets).alias("b")).distinct()
    changed = {r["b"] for r in touched.collect()}  # bucket numbers, at most state.buckets
    return state.replace(L.upsert(state.read(changed), batch), changed, path)


def apply_batch(spark: SparkSession, batch: DataFrame, batch_id: int, state_base: str, buckets: int = io.BUCKETS) -> bool:
    """Ingest one micro-batch; returns False when the batch id was already published.

    State, ledger rows and what is needed to go on with the last run are
    published by one pointer, so a crash before it leaves nothing behind that
    a replay could trip over.

    Runs must arrive in order (run ids compare as strings: ISO dates, padded
    numbers). The last run may go on in the next batch: each version keeps a
    manifest of the state before its last run (``open``; its buckets are those
    of earlier versions) and that run's observations (``tail``), and the run is
    then folded again as a whole. A batch that reaches further back raises
    LateRunError. ``buckets`` counts when the first version is written.
    """
    checkpoint_dir(spark)
    known = io.latest(spark, state_base)
    if known is not None and batch_id <= known["batch_id"]:
        return False
    if "metadata" not in batch.columns:
        batch = batch.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    batch = batch.select(*OBS_COLUMNS)
    first, last = batch.agg(F.min(F.col("run").cast("string")), F.max(F.col("run").cast("string"))).first()
    if first is None:
        return False
    if known is not None and first < known["last_run"]:
        raise LateRunError(f"batch {batch_id} starts at run {first}, before the applied run {known['last_run']}")
    goes_on = known is not None and first == known["last_run"]
    state = io.load_manifest(spark, known, L.empty_state(spark), "open" if goes_on else "state", buckets)
    if goes_on:
        batch = batch.unionByName(spark.read.schema(OBS_SCHEMA).parquet(f"{known['path']}/tail"))
    batch = batch.checkpoint()
    path = io.new_folder(state_base)
    before = merge(state, batch.where(F.col("run") < last), f"{path}/open") if first < last else state
    tail = batch.where(F.col("run") == last)
    after = merge(before, tail, f"{path}/state")
    stats = L.site_stats(L.classify_changes(state.read(), batch), L.deactivations(state.read(), batch))
    io.save_manifests(spark, path, open=before, state=after)
    L.run_ledger(L.run_totals(stats), batch).write.parquet(f"{path}/ledger")
    tail.write.parquet(f"{path}/tail")
    io.publish(spark, state_base, path, batch_id, last, known["version"] + 1 if known else 1)
    return True


def read_ledger(spark: SparkSession, state_base: str) -> DataFrame:
    """One row per run from all published versions; a run that went on in a later batch has that version's row.

    One scan of all ledger folders; those of attempts that were not published fall out in the join.
    """
    published = io.pointers(spark, state_base).select("version", F.substring_index("path", "/", -1).alias("attempt"))
    if published.isEmpty():
        raise ValueError("nothing published yet")
    rows = spark.read.parquet(f"{state_base.rstrip('/')}/data/*/ledger")
    cols = rows.columns
    attempt = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    rows = rows.select(*cols, attempt.alias("attempt")).join(published, "attempt")
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*cols), "version").alias("r")).select("r.*")


def stream_ingest(spark: SparkSession, source_dir: str, state_base: str | None = None,
                  max_files_per_trigger: int | None = None, stream_checkpoint: str | None = None,
                  buckets: int = io.BUCKETS) -> str:
    """Run the stream over ``source_dir`` until no data is left (availableNow).

    Returns the state folder; read it with ``read_state``. Files must arrive
    in run order (by modification time) when ``max_files_per_trigger`` splits
    them over batches; a run may be split. A stream that starts again with the
    ``stream_checkpoint`` and ``state_base`` of one that ended goes on where
    that one was. ``stop_after`` ends the stream once so many batches of this
    start are published.
    """
    # the checkpoint folder must be known before foreachBatch runs
    base = checkpoint_dir(spark).rstrip("/") + f"/jobsight-stream-{uuid.uuid4().hex}"
    state_base = state_base or base + "/state"
    reader = spark.readStream.schema(OBS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: apply_batch(spark, df, bid, state_base, buckets))
         .option("checkpointLocation", stream_checkpoint or base + "/stream-checkpoint")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return state_base


def read_state(spark: SparkSession, state_base: str) -> DataFrame:
    return io.load_snapshot(spark, state_base, L.empty_state(spark))
