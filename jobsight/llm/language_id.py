"""Language of web pages by Bayesian fusion of four kinds of evidence.

P(language | page) is proportional to

* the text's likelihood under a byte-trigram model per language, tempered: a text counts as at most TEXT_WEIGHT
  independent trigrams, as neighbouring ones are not independent;
* P(declared markup language | language), P(address suffix | language) and P(language segment of the path | language);
* the host's prior: its language counts, smoothed towards those of its domain, which are smoothed towards the
  whole table's; a page's own count is left out.

Training. Trigram counts by language come from all labelled texts (documents.lang) by one aggregate over BUCKETS
hashed trigrams per language. Channels and priors come from all pages by grouped aggregates over the languages that
the text alone suggests. The trigram model is broadcast: its size is BUCKETS doubles per language, and more than
MAX_LANGUAGES languages are refused (ISO 639-3 has under 8,000; set the limit as memory allows). Count tables are
written to the checkpoint folder and joined, so a hot host or markup language is a skewed join that Spark splits.

Edge cases: a null or empty page has no text evidence and gets what the other kinds say; a missing or malformed
markup language, suffix, path segment or host is a value of its own; repeated rows count one by one; without any
labelled text there is no language and the result is null; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.llm.warc import plain_text
from jobsight.llm.words import utf8
from jobsight.session import checkpoint_dir

BUCKETS = 1 << 14
MAX_LANGUAGES = 2000
TEXT_WEIGHT = 40
SMOOTHING = 0.5
PSEUDO = 8.0  # weight, in pages, of the level above in a prior


def _lowered(data: np.ndarray) -> np.ndarray:
    upper = (data >= 0x41) & (data <= 0x5A)
    return (data + (upper * 32).astype(np.uint8)).astype(np.uint32)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams of one text or of texts laid end to end (one for each position but two)."""
    x = _lowered(data)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
    return h >> np.uint32(32 - 14)


def train(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, counts array<bigint>): trigram counts of all labelled texts."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            langs = batch.column(0).to_pylist()
            counts: dict[str, np.ndarray] = {}
            for i, lang in enumerate(langs):
                got = trigrams(raw[offsets[i]:offsets[i + 1]])
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(got, minlength=BUCKETS)
            rows = [(lang, b, n) for lang, c in counts.items()
                    for b, n in zip(np.flatnonzero(c).tolist(), c[c > 0].tolist())]
            yield pa.RecordBatch.from_pylist([{"lang": x, "bucket": b, "n": n} for x, b, n in rows], schema=pa.schema(
                [("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))

    labelled = texts.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return (labelled.mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by language and bucket): BUCKETS rows a language at most."""
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    for lang, bucket, n in counts.toLocalIterator():
        table[langs.index(lang), bucket] += n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def log_likelihood(text: str, logs: np.ndarray) -> np.ndarray:
    got = trigrams(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(got):
        return np.zeros(len(logs))
    return logs[:, got].mean(axis=1) * min(len(got), TEXT_WEIGHT)


def _evidence(url: Column, page: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {
        "declared": F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", 1)),
        "suffix": F.regexp_extract(host, r"\.([a-z]{2,24})$", 1),
        "segment": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1)),
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "host": host,
    }


def identify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, url, declared, text_lang, lang, probability) of each page."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    langs, logs = model(train(labelled, lang_col, text_col).checkpoint())
    k = len(langs)
    if not k:
        return pages.select(id_col, url_col, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("declared", "string"), ("text_lang", "string"), ("lang", "string"), ("probability", "double"))])
    shared = spark.sparkContext.broadcast(logs)

    def run(batches):
        for batch in batches:
            like = [log_likelihood(plain_text(p or ""), shared.value).tolist() for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array(like, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names[:2], *batch.schema.names[3:], "text"])

    page = F.coalesce(F.col(html_col), F.lit(""))
    facts = _evidence(F.coalesce(F.col(url_col), F.lit("")), page)
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                          *[c.alias(n) for n, c in facts.items()])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.drop("html").schema)
    seen = narrow.mapInArrow(run, f"{kinds}, text array<double>")
    # the first of equal likelihoods
    seen = seen.withColumn("best", (F.array_position("text", F.array_max("text")) - 1).cast("int")).checkpoint()

    one = [F.sum((F.col("best") == i).cast("long")) for i in range(k)]
    whole = seen.agg(F.array(*one).alias("n")).first()["n"] or [0] * k
    total = sum(x or 0 for x in whole)
    top = [((x or 0) + SMOOTHING) / (total + SMOOTHING * k) for x in whole]

    def own(i):
        return (F.col("best") == i).cast("long")

    out = seen
    for name in facts:
        counts = seen.groupBy(name).agg(F.array(*one).alias(f"n_{name}")).checkpoint()
        out = out.join(counts, name, "left")
    kinds_of = {n: seen.select(n).distinct().count() for n in ("declared", "suffix", "segment")}

    def channel(name, i):
        """log P(value | language), from the other pages' texts."""
        inside = F.col(f"n_{name}")[i] - own(i) + SMOOTHING
        return F.log(inside / (F.lit(float(whole[i] or 0)) - own(i) + SMOOTHING * kinds_of[name]))

    def prior(i):
        domain = ((F.col("n_domain")[i] - own(i)) + PSEUDO * top[i]) / (
            F.aggregate("n_domain", F.lit(0).cast("long"), lambda a, x: a + x) - 1 + PSEUDO)
        return ((F.col("n_host")[i] - own(i)) + PSEUDO * domain) / (
            F.aggregate("n_host", F.lit(0).cast("long"), lambda a, x: a + x) - 1 + PSEUDO)

    logits = F.array(*[F.col("text")[i] + channel("declared", i) + channel("suffix", i) + channel("segment", i)
                       + F.log(prior(i)) for i in range(k)])
    out = out.withColumn("logits", logits).withColumn("most", F.array_max("logits"))
    names = F.array(*[F.lit(x) for x in langs])
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.nullif("declared", F.lit("")).alias("declared"),
        names[F.col("best")].alias("text_lang"),
        names[(F.array_position("logits", F.col("most")) - 1).cast("int")].alias("lang"),
        F.round(1 / F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))), 6).alias("probability"))
