"""Importance resampling towards a target distribution: array-scored weights, distributed quickselect.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z. Features are all runs of 1 to ``max_run``
consecutive words, joined by one space, repeats counted; a feature's bucket is the unsigned crc32 of its bytes modulo
``buckets``.

1. One pass over the texts writes each document's buckets, two bytes a feature, to the shared folder. The texts are not
   read again.
2. Bucket counts of the corpus (s, S in all) and of the target texts (t, T in all): every task sums an array of
   ``buckets`` counts, and the arrays' non-zero places are added up by bucket. Nothing is sampled.
3. A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). The gains are one array, broadcast
   (``buckets`` numbers, at most MAX_BUCKETS); a document's weight is the mean of the gains at its buckets, floored.
4. score = weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256("seed:id"): Gumbel
   noise, so that the k highest scores are a draw without replacement with probabilities in proportion to
   exp(weight / 1000).
5. k = floor(percent * N / 100) of the N documents with ``min_words`` words are drawn. The k-th key (score falling, id,
   row number) is found by quickselect: PIVOTS keys at random of those still in question, exact counts of the rows
   below, at and above each in one aggregate, and only the rows between the two pivots around the k-th are kept, by
   writing them. Expected rounds: log N to the base PIVOTS; the driver sees PIVOTS keys a round.
6. Winners alone are sorted, by a range exchange; a rank is the place in the sorted partition plus the sizes of the
   partitions before. All other rows pass through without a shuffle.

Edge cases: a null text has no words, weight 0, and is never drawn; a null id is hashed as an empty string, and comes
after all ids among equal scores; rows that repeat an id are documents of their own (their noise is equal), and equal
keys go by the row number; an empty table or an empty target gives no rows, or gains against T = 0; columns but the
id and the text are not read.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsight.llm.tables import arrow_rows, written
from jobsight.llm.words import ALNUM, Block, word_blocks

MAX_BUCKETS = 1 << 16
BATCH_ROWS = 1000
PIVOTS = 16
#: features longer than this are hashed one by one
LONG_FEATURE = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> np.uint32(1) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of data[starts[i]:ends[i]] for every i, byte by byte over all spans at once."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    n_long = int(np.count_nonzero(size > LONG_FEATURE))
    order = order[n_long:]
    size_left = size[order]
    at = starts[order]
    c = out[order]
    live = len(order)
    for k in range(int(size_left[0]) if live else 0):
        live = int(np.searchsorted(-size_left, -k, side="left"))  # spans with more than k bytes
        part = c[:live]
        c[:live] = _CRC[(part ^ data[at[:live] + k]) & np.uint32(0xFF)] ^ part >> np.uint32(8)
    out[order] = ~c
    for i in np.flatnonzero(size > LONG_FEATURE):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes())
    return out


_TO_LOWER = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def block_buckets(block: Block, buckets: int, max_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): the features of document i are buckets[bounds[i]:bounds[i + 1]], runs of one word first."""
    data = _TO_LOWER[block.data]
    words = np.diff(block.bounds)
    doc = np.repeat(np.arange(len(words)), words)
    found, of = [], []
    if max_run > 1:  # words joined by one space each, so that every run is a span
        size = block.ends - block.starts + 1
        ends = np.cumsum(size)
        joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        at = np.arange(len(joined)) + np.repeat(block.starts - (ends - size), size)
        last = np.zeros(len(joined), bool)
        last[ends - 1] = True
        joined[~last] = data[at[~last]]
        starts, ends = ends - size, ends - 1
        data = joined
    else:
        starts, ends = block.starts, block.ends
    for run in range(1, max_run + 1):
        n = len(starts) - run + 1
        if n <= 0:
            break
        whole = np.flatnonzero(doc[:n] == doc[run - 1:])
        found.append(crc32(data, starts[whole], ends[whole + run - 1]) % np.uint32(buckets))
        of.append(doc[whole])
    if not found:
        return np.zeros(0, np.uint16), np.zeros(len(words) + 1, np.int64)
    of, found = np.concatenate(of), np.concatenate(found).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    return found[order], np.searchsorted(of[order], np.arange(len(words) + 1))


def features(docs: DataFrame, buckets: int, max_run: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n_words, buckets): each row's feature buckets as uint16; ``row`` numbers the rows."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in word_blocks(batch.column(1), ALNUM, True):
                values, bounds = block_buckets(block, buckets, max_run)
                n = block.hi - block.lo
                offsets = pa.array(bounds * 2, pa.int32()).buffers()[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, n), pa.array(range(row, row + n), pa.int64()),
                     pa.array(np.diff(block.bounds), pa.int64()),
                     pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(values.tobytes())])],
                    names=["id", "row", "n_words", "buckets"])
                row += n

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, row long, n_words long, buckets binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a column of uint16 arrays."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(np.uint16), (offsets - offsets[0]) // 2


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in ``rows``: at most ``buckets`` numbers reach the driver."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column(0))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Every bucket's log ratio of target and source in thousandths, with add-one smoothing."""
    n = len(source)
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (float(source.sum()) + n) / ((s + 1) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(seed: int, id_col: str) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) of a row's id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, row, n_words, n_features, weight) from feature rows; the array of gains is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(gain.tobytes())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        gain = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, bounds = _flat(batch.column(3))
            n = np.diff(bounds)
            total = np.concatenate(([0], np.cumsum(gain[values])))
            weight = (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(weight)],
                                             names=["id", "row", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"id {kind}, row long, n_words long, n_features long, weight long")


def _key() -> Column:
    """The composite key of a row, ascending from the first to be drawn."""
    return F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("z"), F.col("id").alias("i"),
                    F.col("row").alias("r"))


def _constant(row, rows: DataFrame) -> Column:
    """The key of a collected row."""
    return F.struct(F.lit(-row["score"]).alias("s"), F.lit(row["id"] is None).alias("z"),
                    F.lit(row["id"]).cast(rows.schema["id"].dataType).alias("i"), F.lit(row["row"]).alias("r"))


def kth(rows: DataFrame, k: int, seed: int):
    """The row (score, id, row) with the k-th smallest key (from 1), by quickselect; ``rows`` holds k at least."""
    rnd = random.Random(seed)
    active, left = rows.select("score", "id", "row"), k
    while True:
        # the rows with the least random numbers, which are drawn anew each round
        pivots = active.orderBy(F.xxhash64(F.lit(rnd.getrandbits(32)), "row")).limit(PIVOTS).orderBy(_key()).collect()
        consts = [_constant(p, rows) for p in pivots]
        sides = active.agg(*[F.count_if(_key() < c).alias(f"b{i}") for i, c in enumerate(consts)],
                           *[F.count_if(_key() <= c).alias(f"a{i}") for i, c in enumerate(consts)]).first()
        below, upto = sides[:len(pivots)], sides[len(pivots):]
        for i, p in enumerate(pivots):
            if below[i] < left <= upto[i]:
                return p
        lo = max((i for i in range(len(pivots)) if upto[i] < left), default=None)
        hi = min((i for i in range(len(pivots)) if below[i] >= left), default=None)
        if lo is not None:
            active, left = active.where(_key() > consts[lo]), left - upto[lo]
        if hi is not None:
            active = active.where(_key() < consts[hi])
        active = written(active)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, max_run: int = 1,
             min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; rank is null where the row was not drawn."""
    if not 0 < buckets <= MAX_BUCKETS or max_run < 1 or not 0 <= percent <= 100:
        raise ValueError(f"buckets from 1 to {MAX_BUCKETS}, runs of one word or more, 0 to 100 per cent")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = written(features(docs, buckets, max_run, id_col, text_col))
        aims = features(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), buckets, max_run, "id", "text")
        gain = gains(bucket_counts(rows, buckets), bucket_counts(aims, buckets))
        scored = written(weighted(rows, gain).withColumn("score", F.col("weight") + noise(seed, "id")))
    able = F.col("n_words") >= min_words
    k = percent * scored.where(able).count() // 100
    plain = ["id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank")).withColumnRenamed("id", id_col)
    drawn = able & (_key() <= _constant(kth(scored.where(able), k, seed), scored))
    ordered = written(scored.where(drawn).orderBy(F.col("score").desc(), F.col("id").isNull(), "id", "row")
                      .select(*plain, F.spark_partition_id().alias("part"),
                              F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    # one row for each sorted partition
    ahead = ordered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    ranked = ordered.join(F.broadcast(ahead), "part").select(*plain, (F.col("ahead") + F.col("place") + 1).alias("rank"))
    rest = scored.where(~drawn).select(*plain, F.lit(None).cast("long").alias("rank"))
    return ranked.union(rest).withColumnRenamed("id", id_col)
