"""Line deduplication: lines whose key occurs in many documents are dropped everywhere.

DataFrame functions only. A line's key is the line, stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z in lower
case. Keys move as hashes (64 + 32 bits), never as text:

1. each document gives its positions and key hashes, ``posexplode``d and written once to the shared folder, as the
   count and the join both read them;
2. distinct documents per key hash: Spark's two-step distinct count, first by (hash, document), so that a key
   found in every document is counted by many tasks;
3. keys at or over the threshold are written once to the checkpoint folder and joined with the exploded lines;
   both sides of that join come from plain exchanges, so a key holding a third of all lines is split;
4. the positions to drop are collected per document, and each text is put together again from the positions
   that are left, in their order.

Edge cases: a null or empty text is one empty line, and stays null or empty; a key of fewer than ``min_chars``
code points is never dropped; rows with equal (doc_id, text), null ids included, are one document, and each of
them is returned; with ``copies_once`` equal texts count as one document whatever their ids, so that a group of
copies does not lose its own lines; other columns of the input, whatever their names, are returned as they are by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.llm.tables import written
from jobsight.session import checkpoint_dir

STRIP = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_keys(lines: Column) -> Column:
    """The keys of an array of lines. lower() of ASCII text is the translation, at a fraction of its cost."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(STRIP)))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(
        F.translate(x, UPPER, UPPER.lower())))


def _identity(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("__id"), F.xxhash64(text).alias("__t")]


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, copies_once: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __t, drop): for every document that loses lines, their positions."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    # the keys in transforms of their own: a key is made once for each line
    keys = F.transform(line_keys(lines), lambda k: F.when(
        F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))))
    pairs = written(docs.select(*_identity(id_col, text_col), F.posexplode(keys).alias("pos", "key"))
                    .where(F.col("key").isNotNull())
                    .select("__id", "__t", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b")))
    common = (pairs.groupBy("a", "b").agg(F.count_distinct("__t" if copies_once else F.struct("__id", "__t")).alias("n"))
              .where(F.col("n") >= min_docs).select("a", "b").checkpoint())
    return (pairs.join(common, ["a", "b"])
            .groupBy("__id", "__t").agg(F.collect_list("pos").alias("drop")))


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, copies_once: bool = False,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, with n_lines, n_dropped and the ``kept`` text."""
    checkpoint_dir(docs.sparkSession)
    drops = repeated_lines(docs, min_docs, min_chars, copies_once, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *_identity(id_col, text_col))
    drops = drops.withColumnsRenamed({"__id": "__i", "__t": "__u"})
    # the small side is hashed, so that the texts need no sort
    joined = rows.join(drops.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")), "left")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return (joined.withColumn("lines", F.when(F.col("drop").isNotNull(), lines))
            .select("row", F.when(F.col("drop").isNull(),
                                  F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
                    .otherwise(F.size("lines")).cast("long").alias("n_lines"),
                    F.coalesce(F.size(F.array_distinct("drop")), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("drop").isNull(), text)
                    .otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("kept")))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, copies_once: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from the text; null texts stay null, no row is lost."""
    report = line_report(docs, min_docs, min_chars, copies_once, id_col, text_col)
    return report.select(*[
        F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text_col
        else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
