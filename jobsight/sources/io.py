"""Sources and sinks.

Snapshots of the job-state table are versioned. The state lies in buckets by
the hash of the URL; a version is a manifest that names a folder for each
bucket, and a new version writes the buckets that changed and takes the other
folders over from the version before. A one-row pointer to the new manifests
publishes it; readers take the highest published pointer. Nothing is ever
overwritten, so a failed or replayed write cannot corrupt what readers see.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTING_SCHEMA = ("title string, url string, job_id string, location string, company_url string, "
                  "company string, scraped_at string, metadata map<string,string>, description string")


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, trimmed, blank lines dropped."""
    lines = spark.read.text(path)
    v = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(v.alias("site_url")).filter(F.col("site_url") != "")


def read_postings_json(spark: SparkSession, path: str, json_array: bool = False) -> DataFrame:
    """Postings with a fixed schema, from JSON lines (as S3 writes them).

    ``json_array`` says that each file holds one JSON array instead; such a
    file is read by one task, JSON lines are split.
    """
    df = spark.read.schema(POSTING_SCHEMA).option("multiLine", json_array).json(path)
    return df.withColumn("scraped_at", F.to_timestamp("scraped_at"))


def write_postings_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3: export postings as JSON lines (one part file per task)."""
    df.write.mode(mode).json(path)


def write_postings_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export as CSV with a header; the metadata map is rendered as JSON text."""
    cols = [F.to_json(F.col(c)).alias(c) if dict(df.dtypes)[c].startswith("map") else F.col(c)
            for c in df.columns]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def read_pattern_cache(spark: SparkSession, path: str) -> DataFrame:
    """{site: pattern, ..., 'last_updated': ts} -> (site, pattern); the timestamp key is skipped."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,string>")
    return (raw.select(F.explode(m).alias("site", "pattern"))
            .filter(F.col("site") != "last_updated"))


def write_patterns(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Patterns as Parquet (site, pattern, detected_at)."""
    df.write.mode(mode).parquet(path)


def write_report(lines: DataFrame, path: str, sort_col: str = "sort_key", mode: str = "errorifexists") -> None:
    """A text report from (sort key, line) rows; range-sorted, so part files concatenate in order."""
    lines.orderBy(sort_col).select("line").write.mode(mode).text(path)


# ---- S7 versioned snapshots ------------------------------------------------------------
#
# base/data/<uuid>/<table>/bucket=<n>     the buckets that an attempt wrote
# base/data/<uuid>/manifests              (part, bucket, folder) of whole tables, any attempt's folders
# base/data/<uuid>/ledger, .../tail       plain tables published with it
# base/_pointers                          (version, batch_id, path, last_run) rows

_POINTER = "version int, batch_id long, path string, last_run string"
BUCKETS = 64


def _pointer_path(base: str) -> str:
    return base.rstrip("/") + "/_pointers"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pointers(spark: SparkSession, base: str) -> DataFrame:
    """All published versions. Only a missing folder means that there is none; a failed read is an error."""
    if not path_exists(spark, _pointer_path(base)):
        return spark.createDataFrame([], _POINTER)
    return spark.read.schema(_POINTER).parquet(_pointer_path(base))


def latest(spark: SparkSession, base: str):
    """The newest pointer row, or None."""
    row = pointers(spark, base).agg(F.max_by(F.struct("version", "batch_id", "path", "last_run"), "version")
                                    .alias("p")).first()
    return row["p"] if row else None


def latest_pointer(spark: SparkSession, base: str):
    """(version, batch_id) of the newest published snapshot, or (0, -1)."""
    p = latest(spark, base)
    return (p["version"], p["batch_id"]) if p else (0, -1)


def bucket_of(key, buckets: int):
    """The bucket of a key column."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Manifest:
    """A state table in buckets: the folder of each bucket that has rows, by the hash of the column ``key``."""

    def __init__(self, spark: SparkSession, schema, buckets: int, folders: dict[int, str] | None = None, key: str = "url"):
        self.spark, self.schema, self.buckets, self.folders, self.key = spark, schema, buckets, folders or {}, key

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The whole table, or the rows of some buckets."""
        paths = [f for k, f in sorted(self.folders.items()) if only is None or k in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, changed: set[int], path: str) -> "Manifest":
        """A new version: ``rows`` are the whole new content of the ``changed`` buckets, written under ``path``."""
        folders = {k: f for k, f in self.folders.items() if k not in changed}
        if changed:
            kept = rows.withColumn("bucket", bucket_of(self.key, self.buckets))
            # one task and one file for each bucket
            kept.repartition(len(changed), "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)
            root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            listed = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
            names = [f.getPath().getName() for f in listed if f.isDirectory()]
            folders |= {int(n.removeprefix("bucket=")): f"{path}/{n}" for n in names if n.startswith("bucket=")}
        return Manifest(self.spark, self.schema, self.buckets, folders, self.key)


def new_folder(base: str) -> str:
    """A folder for one attempt to write a version."""
    return f"{base.rstrip('/')}/data/{uuid.uuid4().hex}"


_MANIFEST = "part string, bucket int, folder string, buckets int"


def save_manifests(spark: SparkSession, path: str, **parts: Manifest) -> None:
    """The manifests of a version, as one small table."""
    rows = [(name, k, f, m.buckets) for name, m in parts.items() for k, f in [*sorted(m.folders.items()), (-1, None)]]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifests")


def load_manifest(spark: SparkSession, pointer, empty: DataFrame, part: str = "state", buckets: int = BUCKETS,
                  key: str = "url") -> Manifest:
    """A bucketed table of the version that ``pointer`` (see ``latest``) names; without one, a table without rows."""
    if pointer is None:
        return Manifest(spark, empty.schema, buckets, key=key)
    rows = spark.read.schema(_MANIFEST).parquet(f"{pointer['path']}/manifests").filter(F.col("part") == part).collect()
    return Manifest(spark, empty.schema, rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["folder"]}, key)


def load_snapshot(spark: SparkSession, base: str, empty: DataFrame, part: str = "state", pointer=None) -> DataFrame:
    """The newest published state table, or another table of the snapshot (``empty`` when none)."""
    p = pointer or latest(spark, base)
    if p is None:
        return empty
    if part in ("state", "open"):
        return load_manifest(spark, p, empty, part).read()
    return spark.read.schema(empty.schema).parquet(f"{p['path']}/{part}")


def publish(spark: SparkSession, base: str, path: str, batch_id: int, last_run: str | None, version: int) -> int:
    """Append the pointer row that makes the tables under ``path`` the newest version."""
    row = spark.createDataFrame([(version, int(batch_id), path, last_run)], _POINTER)
    row.coalesce(1).write.mode("append").parquet(_pointer_path(base))
    return version


def save_snapshot(state: DataFrame, base: str, batch_id: int, last_run: str | None = None, buckets: int = BUCKETS,
                  **parts: DataFrame) -> int:
    """Write a whole state table as version n+1, with plain tables beside it; version n stays readable."""
    spark = state.sparkSession
    path = new_folder(base)
    whole = Manifest(spark, state.schema, buckets).replace(state, set(range(buckets)), f"{path}/state")
    save_manifests(spark, path, state=whole, open=whole)
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return publish(spark, base, path, batch_id, last_run, latest_pointer(spark, base)[0] + 1)
