"""Quality rules whose cutoffs come from labelled holdouts with a bound on the false rejections.

Words are [^\\x20\\x09-\\x0D]+. Base measures of a text: word_chars (code points in words), n_symbols (characters of
[#*$%&|<>]), n_dup_lines (\\n-split lines with a word, equal to an earlier line), n_repeat_words (words in 3-word
windows found twice or more). A text fails the base rule with fewer than 50 words, or if more than half of its words
are repeated. Beyond that, four scores in thousandths are compared with a cutoff per stratum (language).

Choice of cutoffs. Good documents (quality 1) of the labels are the holdout: the scores are fixed by the rules, so
nothing was fitted on them. For each stratum and score the cutoffs from the most lenient (nothing is rejected) to the
strictest are tested in this fixed order: with k of n good documents rejected, a cutoff is certified if
P(Binomial(n, a) <= k) <= d, that is if the exact (Clopper-Pearson) upper bound of its false-rejection rate at level
1 - d is at most a. The first cutoff that fails ends the sequence, which needs no correction inside it; over all
strata and scores d = delta / (strata * scores) (Bonferroni), and a = alpha / scores. So with probability 1 - delta
every stratum loses at most a share ``alpha`` of its good documents to the cutoffs. Any choice among certified
cutoffs keeps this; the one with the largest gap between rejected bad and rejected good documents is taken, of
equals the most lenient. A stratum with too few labels to certify anything rejects nothing.

Each labelled document counts once, and so does each text of a stratum: the binomial bound is for independent draws,
which repeated labels, repeated rows and exact copies are not. A document or text whose labels contradict each other
counts as neither good nor bad. All others count: their histogram by (stratum, score, thousandth) is an aggregate, so
the driver and a task see at most a few thousand numbers a stratum. The cutoff table has a row for each stratum; it is broadcast if there are at
most MAX_BROADCAST_STRATA, and joined otherwise.

Edge cases: a null text has no words and fails the base rule; a null stratum is a stratum of its own; rows of a
repeated doc_id are judged one by one, and as a holdout the one with the least text hash counts; labels that are null,
or meet no document, do not count; without labels only the base rule holds. Other columns stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.llm.words import SPACED, Block, cut, mix, word_blocks
from jobsight.session import checkpoint_dir, limit_arrow_batches

SYMBOLS = b"#*$%&|<>"
LINES = np.arange(256) != 0x0A
GRID = 1000
SCORES = ("symbols", "dup_lines", "repeats", "word_length")
MAX_BROADCAST_STRATA = 10_000
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_STRUCT = pa.struct([(m, pa.int64()) for m in _MEASURES])
_STRUCT_SQL = "struct<" + ",".join(f"{m}:bigint" for m in _MEASURES) + ">"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a repeat of an earlier one, occurs at least twice) for each value within its document."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    later, often = np.zeros(len(v), bool), np.zeros(len(v), bool)
    later[order], often[order] = same, twice  # lexsort is stable, so the first of equals comes first
    return later, often


def measure(block: Block) -> list[np.ndarray]:
    """The base measures of each document of a block, in the order of _MEASURES."""
    n_docs = block.hi - block.lo
    n_words = np.diff(block.bounds)
    points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    word_chars = _sums(points[block.ends] - points[block.starts], block.bounds)
    n_symbols = _sums(_SYMBOL[block.data], block.offsets)
    lines = cut(block.data, block.offsets, 0, n_docs, LINES, False)
    with_word = np.searchsorted(block.starts, lines.ends) > np.searchsorted(block.starts, lines.starts)
    line_doc = np.repeat(np.arange(n_docs), np.diff(lines.bounds))
    later, _ = _repeated(lines.hashes[with_word], line_doc[with_word])
    n_lines = np.bincount(line_doc[with_word], minlength=n_docs)
    n_dup = np.bincount(line_doc[with_word][later], minlength=n_docs)
    n_repeat = np.zeros(n_docs, np.int64)
    h = block.hashes
    if len(h) >= 3:
        doc = np.repeat(np.arange(n_docs), n_words)
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        windows = mix(mix(mix(h[whole]) + h[whole + 1]) + h[whole + 2])
        _, often = _repeated(windows, doc[whole])
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[whole[often] + k] = True
        n_repeat = np.bincount(doc[covered], minlength=n_docs)
    return [n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat]


def with_measures(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the base measures of the text in the struct column ``name``."""
    at = docs.columns.index(text_col)
    limit_arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            parts = [measure(b) for b in word_blocks(batch.column(at), SPACED, False)]
            columns = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0, np.int64)] * len(_MEASURES)
            struct = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    quoted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{quoted}, `{name}` {_STRUCT_SQL}")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def scores(m: Column) -> dict[str, Column]:
    """Scores from 0 to GRID: shares in thousandths, mean word length in fiftieths of a code point."""
    def part(x, y, scale=GRID):
        return F.least(F.lit(GRID), F.coalesce(F.floor(scale * x / F.nullif(y, F.lit(0))), F.lit(0))).cast("int")
    return {"symbols": part(m["n_symbols"], m["word_chars"]), "dup_lines": part(m["n_dup_lines"], m["n_lines"]),
            "repeats": part(m["n_repeat_words"], m["n_words"]),
            "word_length": part(m["word_chars"], m["n_words"], 50)}


def most_rejected(n: int, a: float, d: float) -> int:
    """The largest k with P(Binomial(n, a) <= k) <= d; -1 if there is none."""
    if n <= 0 or n * math.log1p(-a) > math.log(d):
        return -1
    top = int(n * a) + 1
    i = np.arange(top)
    steps = np.log((n - i) / (i + 1.0)) + math.log(a) - math.log1p(-a)
    logs = n * math.log1p(-a) + np.concatenate(([0.0], np.cumsum(steps)))
    return int(np.searchsorted(np.cumsum(np.exp(logs)), d, side="right")) - 1


def choose(good: np.ndarray, bad: np.ndarray, a: float, d: float) -> int:
    """The cutoff for one score, from histograms over 0..GRID; documents with a higher score are rejected."""
    rejected_good = good[::-1].cumsum()[::-1] - good  # with a score over c
    rejected_bad = bad[::-1].cumsum()[::-1] - bad
    n, m = int(good.sum()), int(bad.sum())
    certified = rejected_good <= most_rejected(n, a, d)
    if not certified.any() or not m:
        return GRID
    gap = np.where(certified, rejected_bad / m - rejected_good / n, -1.0)
    return int(len(gap) - 1 - np.argmax(gap[::-1]))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, stratum: str, name: str, key_col: str,
            id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, int]:
    """((stratum, one cutoff per score), number of strata) from ``measured`` (id, stratum, hash of the text, measures) and
    labels."""
    each = scores(F.col(name))
    agreed = [F.min("good").alias("good"), F.max("good").alias("most")]
    one = (labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
           .agg(F.min(label_col).alias("good"), F.max(label_col).alias("most")).where("good = most").select("id", "good"))
    rows = measured.where(~base_failed(F.col(name))).select(
        F.col(id_col).alias("id"), F.col(stratum).cast("string").alias("stratum"), F.col(key_col).alias("key"),
        F.array(*[F.struct(F.lit(s).alias("score"), c.alias("value")) for s, c in each.items()]).alias("each"))
    # labelled documents alone are grouped: first by id, then by text
    joined = (rows.join(one, "id").groupBy("id", "good").agg(F.min(F.struct("key", "stratum", "each")).alias("r"))
              .groupBy("r.stratum", "r.key").agg(F.first("r.each").alias("each"), *agreed).where("good = most"))
    histogram = (joined.select("stratum", "good", F.explode("each").alias("e"))
                 .groupBy("stratum", F.col("e.score").alias("score"), F.col("e.value").alias("value"))
                 .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).checkpoint())
    strata = histogram.select("stratum").distinct().count()
    a, d = alpha / len(SCORES), delta / (max(1, strata) * len(SCORES))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": rows["stratum"].iloc[0]}
        for s in SCORES:
            own = rows[rows["score"] == s]
            good, bad = np.zeros(GRID + 1, np.int64), np.zeros(GRID + 1, np.int64)
            good[own["value"]], bad[own["value"]] = own["good"], own["bad"]
            out[s] = choose(good, bad, a, d)
        return pd.DataFrame([out])

    chosen = histogram.groupBy("stratum").applyInPandas(
        pick, "stratum string, " + ", ".join(f"{s} int" for s in SCORES))
    return chosen.select("stratum", F.struct(*SCORES).alias("cut")).checkpoint(), strata


def judged(measured: DataFrame, chosen: DataFrame, strata: int, stratum: str, name: str) -> DataFrame:
    """``measured`` with ``base_failed``, ``failed`` (names of the scores over their cutoff) and ``kept``, in a
    struct column ``name`` + "_verdict"."""
    verdict = name + "_verdict"
    cut_rows = chosen.select(F.col("stratum").alias(name + "_stratum"), F.col("cut").alias(name + "_cut"))
    if strata <= MAX_BROADCAST_STRATA:
        cut_rows = F.broadcast(cut_rows)
    joined = measured.join(cut_rows, F.col(stratum).cast("string").eqNullSafe(F.col(name + "_stratum")), "left")
    failed = F.filter(F.array(*[F.when(c > F.col(f"{name}_cut.{s}"), F.lit(s))
                                for s, c in scores(F.col(name)).items()]), lambda x: x.isNotNull())
    base = base_failed(F.col(name))
    return joined.withColumn(verdict, F.struct(
        base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))).drop(
        name + "_stratum", name + "_cut")


def _free(docs: DataFrame) -> str:
    """A column name that does not occur in ``docs``, nor does any name that starts with it."""
    name = "quality"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05,
                   stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base measures, base_failed, failed, kept) of each document. One pass over the texts."""
    checkpoint_dir(docs.sparkSession)
    m = "m"
    narrow = docs.select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"), F.col(text_col).alias("text"),
                         _text_key(text_col).alias("key"))
    measured = with_measures(narrow, m).drop("text").checkpoint()
    labels = labels.withColumnRenamed(id_col, "id") if id_col != "id" else labels
    chosen, strata = cutoffs(measured, labels, alpha, delta, "stratum", m, "key", "id")
    out = judged(measured, chosen, strata, "stratum", m)
    return out.select(F.col("id").alias(id_col), "m.*", "m_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05,
              stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns of ``docs``; two passes over the texts, which are not shuffled."""
    checkpoint_dir(docs.sparkSession)
    m = _free(docs)
    slim = docs.select(id_col, stratum, text_col, _text_key(text_col).alias(m + "_key"))
    chosen, strata = cutoffs(with_measures(slim, m, text_col).drop(text_col), labels, alpha, delta, stratum, m, m + "_key",
                             id_col)
    out = judged(with_measures(docs, m, text_col), chosen, strata, stratum, m)
    return out.where(F.col(f"{m}_verdict.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
