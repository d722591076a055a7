"""Which filter removes what, in every order: path counting over the lattice of applied filter sets.

A document's mask has a bit for each filter it fails. Filters act one after the other, so the documents that filter f
removes after the set S depend on S alone, not on the order inside S: all k! orders are paths through the lattice of
2^k sets, and its k * 2^(k-1) edges S -> S + f hold all counts.

1. Documents are counted by (part, mask, label); from here on the data is at most 2^k rows a part.
2. Each (part, mask) row adds to the edges it takes part in (a table of 2^k masks by edges, fixed by k), and sums per
   (part, edge) give what the edge keeps, removes, and finds already removed.
3. Forward counts F(S), the orders that reach S, and backward counts B(S), those that lead from S to the full set, are
   summed along the edges. F(S) * B(S + f) orders use the edge, so a filter's removals over all orders are
   sum F(S) * B(S + f) * removed(S, f), its Shapley value times k!.
4. Every step of every order is read from its edge.

The five filters of ``failures`` are A: fewer than 50 words [^\\x20\\x09-\\x0D]+; B: 100 * distinct words < 65 * words;
C: 100 * [A-Z] characters > 5 * code points; D: holds any of [#$%&*|]; E: equal to the text of any smaller id. For E
the rows of equal texts (by SHA-256) meet in one aggregate of their least id, combined before the shuffle, so that a
text in a third of all rows is no hot task; the rows that do not fail are counted there and all others fail.

Edge cases: a null text is empty; a null part is the empty string; rows are counted one by one, so a repeated row
counts again, and repeats of the least id do not fail E; rows without an id have no label, do not fail E and make no
other row fail; a document is good (toxic) if any of its label rows says 1; an empty table gives no rows; other
columns of the inputs are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.tables import arrow_rows, written
from jobsight.llm.words import SPACED, Block, word_blocks

#: 7 filters have 5,040 orders; the tables of paths and edges are broadcast
MAX_FILTERS = 7
BATCH_ROWS = 1000
MIN_WORDS = 50
_MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_CAPITAL = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def text_masks(block: Block) -> np.ndarray:
    """Bits 0 to 3 for the filters A to D on each document of a block."""
    words = np.diff(block.bounds)
    doc = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((block.hashes, doc))
    h, d = block.hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=len(words))
    points = _sums((block.data & 0xC0) != 0x80, block.offsets)
    return ((words < MIN_WORDS) | (100 * distinct < 65 * words) << 1
            | (100 * _sums(_CAPITAL[block.data], block.offsets) > 5 * points) << 2
            | (_sums(_MARKS[block.data], block.offsets) > 0) << 3)


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents and labelled documents by part and failed filters, bits 0 to 4 for A to E.

    ``labels`` has the id column, ``quality`` and ``toxic``.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            masks = [text_masks(b) for b in word_blocks(batch.column(3), SPACED, False)]
            mask = np.concatenate(masks) if masks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mask, pa.int32())],
                                             names=["id", "part", "key", "mask"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = written(
            docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
            .mapInArrow(run, f"id {kind}, part string, key binary, mask int"))
    named = rows.where(F.col("id").isNotNull()).groupBy("id", "key", "part", "mask").agg(F.count("*").alias("n"))
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    flags = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    named = written(named.join(one.hint("merge"), "id", "left").select("id", "key", "part", "mask", "n", *flags))
    counted = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
               F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    everyone = named.groupBy("part", "mask").agg(*counted)
    nameless = rows.where(F.col("id").isNull()).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # of equal texts the rows of the least id; an id has few rows here, one for each of its parts
    first = (named.groupBy("key", "id").agg(F.collect_list(F.struct("part", "mask", "n", "good", "toxic")).alias("own"))
             .groupBy("key").agg(F.min_by("own", "id").alias("own"))
             .select(F.explode("own").alias("o")).select("o.*").groupBy("part", "mask").agg(*counted))
    minus = [(-F.col(c)).alias(c) for c in ("n", "good", "toxic")]
    return (first.union(nameless)
            .union(everyone.select("part", F.col("mask").bitwiseOR(16).alias("mask"), "n", "good", "toxic"))
            .union(first.select("part", F.col("mask").bitwiseOR(16).alias("mask"), *minus))
            .groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]))


def path_counts(k: int) -> dict[tuple[int, int], int]:
    """{(set, filter): number of orders of k filters that use this edge}: forward times backward counts."""
    full = (1 << k) - 1
    edges = [(s, f) for s in range(full + 1) for f in range(k) if not s >> f & 1]  # sets in ascending order
    forward, backward = {0: 1}, {full: 1}
    for s, f in edges:
        forward[s | 1 << f] = forward.get(s | 1 << f, 0) + forward[s]
    for s, f in reversed(edges):
        backward[s] = backward.get(s, 0) + backward[s | 1 << f]
    return {(s, f): forward[s] * backward[s | 1 << f] for s, f in edges}


def audit(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``counts`` is (part, mask, n, good, toxic), where bit i of mask is the filter names[i].
    """
    k = len(names)
    if not 1 <= k <= MAX_FILTERS or len(set(names)) != k:
        raise ValueError(f"1 to {MAX_FILTERS} filters with different names")
    spark = counts.sparkSession
    weights = path_counts(k)
    meets = spark.createDataFrame(
        [(m, s, f, w, not m & (s | 1 << f), not m & s and bool(m >> f & 1), bool(m & s) and bool(m >> f & 1), m == 1 << f)
         for m in range(1 << k) for (s, f), w in weights.items()],
        "mask int, done int, filter int, orders long, kept boolean, removed boolean, redundant boolean, unique boolean")

    def total(flag, value="n"):
        return F.sum(F.when(F.col(flag), F.col(value)).otherwise(0))

    # a part has a row for every edge: each mask meets all of them
    edges = counts.join(F.broadcast(meets), "mask").groupBy("part", "done", "filter", "orders").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"),
        total("unique").alias("unique_fails"), total("removed", "good").alias("good_lost"),
        total("removed", "toxic").alias("toxic_lost"))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = []
    for order in itertools.permutations(range(k)):
        done = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[i] for i in order), step, done, f))
            done |= 1 << f
    paths = spark.createDataFrame(steps, "filter_order string, step int, done int, filter int")
    return (edges.join(shapley, ["part", "filter"]).join(F.broadcast(paths), ["done", "filter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                    "toxic_lost", "shapley"))
