"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A ``RollupStore`` is a folder. ``commit`` takes a batch of changes (doc_id, version, source, lang, n_tokens, kind) where
kind is insert, delete or revise. What every document counts for lies in buckets by the hash of its id; a commit reads
and writes the buckets that the batch touches and takes the others over from the version before. A change becomes signed
rows (what is taken back with -1, what is added with +1), which move a document's tokens between groups too. Their sums,
added to the stored totals, are the new totals: the cost of a commit follows the batch and the number of groups, and
``totals`` reads one small table. The signed rows of each batch stay in a folder of their own.

State and totals of an attempt go to a folder of its own, and one log file, created under the next number, publishes
them. So a batch that failed midway is written again as a whole, a batch whose id is in the log is skipped, and of two
writers one finds its number taken and fails (ConcurrentCommit), its batch to be committed again. A log file that a
crash left empty must be removed by hand.

Kinds: an insert or a revision replaces whatever the document had under that version; a delete takes it back; a
delete of an unknown document changes nothing. If a batch names a document more than once, the greatest of (kind order
delete < insert < revise, source, lang, n_tokens) counts. Null sources and languages are groups of their own; a null
count is 0; rows without a doc_id or version are refused (ValueError), as they could never be taken back.

``count_tokens`` gives the counts: pretokens are encoded once per distinct piece and task. Skew: a hot source meets
only additive aggregates; the lookup joins on (doc_id, version).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import regex
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.llm.bpe import no_cycle_search, read_ranks, shards, units
from jobsight.llm.tables import written
from jobsight.session import limit_arrow_batches
from jobsight.sources import io

KEY = ["source", "lang", "version"]
BUCKETS = 64
STATE = "doc_id long, version string, source string, lang string, n_tokens long"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
SIGNED = "doc_id long, version string, source string, lang string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabularies: dict[str, str], pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, version, *keep, n_tokens): token counts of each text under each vocabulary {version: rank file}."""
    limit_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({v: read_ranks(p) for v, p in vocabularies.items()})
    names = sorted(vocabularies)

    def run(batches):
        coders = [tiktoken.Encoding(v, pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(shared.value[v])},
                                    special_tokens={}).encode_ordinary for v in names]
        cut = regex.compile(pattern)
        for key, texts in shards(batches):
            with no_cycle_search():
                pieces, pretokens = units(texts, cut)
                joined = ["".join(p) for p in pretokens]
            for v, code in zip(names, coders):
                sizes = [len(code(x)) for x in joined]
                n = [sum([sizes[u] for u in d]) for d in pieces]
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array([v] * len(texts)), pa.array(n, pa.int64())], names=["k", "version", "n_tokens"])

    own = F.struct(F.col(id_col).alias("doc_id"), *keep)
    kind = docs.select(own.alias("k")).schema[0].dataType.simpleString()
    out = docs.select(own.alias("k"), F.col(text_col).alias("text")).mapInArrow(
        run, f"k {kind}, version string, n_tokens long")
    return out.select("k.doc_id", "version", *[f"k.{c}" for c in keep], "n_tokens")


class ConcurrentCommit(RuntimeError):
    """Another writer has published the version that this commit was to publish."""


class RollupStore:
    """``folder``/log/<number>, ``folder``/attempts/<uuid> (state buckets, manifest, totals), ``folder``/batches/<id>."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _path(self, kind: str, batch: str) -> str:
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id holds letters, digits, - and _")
        return f"{self.folder}/{kind}/{batch}"

    def _log(self) -> list[tuple[int, str, str]]:
        """(number, batch, attempt) of each commit, in order: as many as there are commits, not documents."""
        if not io.path_exists(self.spark, f"{self.folder}/log"):
            return []
        rows = [r[0].split("\t") for r in self.spark.read.text(f"{self.folder}/log").collect()]
        return sorted((int(n), batch, attempt) for n, batch, attempt in rows)

    def _publish(self, number: int, batch: str, attempt: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{number:09d}")
        try:
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConcurrentCommit(f"version {number} of {self.folder} is taken") from e
            raise
        out.write(bytearray(f"{number}\t{batch}\t{attempt}\n".encode()))
        out.close()

    def committed(self) -> list[str]:
        """Ids of committed batches."""
        return [batch for _, batch, _ in self._log()]

    def signed(self) -> DataFrame:
        """All signed rows of committed batches."""
        batches = self.committed()
        if not batches:
            return self.spark.createDataFrame([], SIGNED)
        return self.spark.read.schema(SIGNED).parquet(*[self._path("batches", b) for b in batches])

    def _totals(self, log) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{log[-1][2]}/totals")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once. False if its id is in the log already; then nothing is read or written."""
        log, signed_path = self._log(), self._path("batches", batch)
        if batch in {b for _, b, _ in log}:
            return False
        new = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "version", F.struct(
            F.when(F.col("kind") == "delete", 0).when(F.col("kind") == "insert", 1).when(F.col("kind") == "revise", 2)
            .alias("kind"), F.col("source"), F.col("lang"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
            .alias("c")).withColumn("c", F.when(
                F.col("doc_id").isNull() | F.col("version").isNull() | F.col("c.kind").isNull(),
                F.raise_error(F.lit("a change needs doc_id, version and a known kind"))).otherwise(F.col("c")))
        new = written(new.groupBy("doc_id", "version").agg(F.max("c").alias("c")))
        state = io.load_manifest(self.spark, {"path": log[-1][2]} if log else None, self.spark.createDataFrame([], STATE),
                                 buckets=self.buckets, key="doc_id")
        touched = {r[0] for r in new.select(io.bucket_of("doc_id", state.buckets)).distinct().collect()}
        old = state.read(touched).select("doc_id", "version", F.struct("source", "lang", "n_tokens").alias("o"))
        both = old.join(new, ["doc_id", "version"], "full_outer")
        put = F.col("c.kind") > 0
        after = both.select("doc_id", "version", F.when(F.col("c").isNull(), F.col("o")).when(
            put, F.struct("c.source", "c.lang", "c.n_tokens")).alias("s")).where("s is not null").select("doc_id", "version", "s.*")

        def row(when, s, sign):
            return F.when(when, F.struct(F.col(f"{s}.source").alias("source"), F.col(f"{s}.lang").alias("lang"),
                                         F.lit(sign).cast("long").alias("n_docs"), (sign * F.col(f"{s}.n_tokens")).alias("n_tokens")))

        rows = F.array_compact(F.array(row(F.col("c").isNotNull() & F.col("o").isNotNull(), "o", -1), row(put, "c", 1)))
        both.select("doc_id", "version", F.explode(rows).alias("r")).select("doc_id", "version", "r.*").write.mode(
            "overwrite").parquet(signed_path)
        signed = self.spark.read.schema(SIGNED).parquet(signed_path)
        attempt = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        io.save_manifests(self.spark, attempt, state=state.replace(after, touched, f"{attempt}/state"))
        (self._totals(log).union(signed.select("source", "lang", "version", "n_docs", "n_tokens")).groupBy(*KEY)
         .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
         .write.parquet(f"{attempt}/totals"))
        self._publish(len(log) + 1, batch, attempt)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of what is there after all committed batches."""
        return self._totals(self._log())


def changes(counts: DataFrame, kind: str) -> DataFrame:
    return counts.withColumn("kind", F.lit(kind))


