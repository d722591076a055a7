"""An equi-join that no hot key can bind to one task, and a semi-join that shuffles none of the larger side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.session import stored

#: bits of a bitmap of hashes (4 MB)
BITS = 1 << 25


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, heavy: int,
               condition: Column | None = None) -> DataFrame:
    """The inner equi-join on ``keys``, where the rows of a key with more than ``heavy`` rows on a side are dealt.

    Left rows of such a key fall into row blocks, right ones into column blocks of about ``heavy`` each, by the hash of
    their ids, and every (row block, column block) is a join key of its own: no reducer meets all rows of a hot key.
    But for ``keys`` the sides must have different columns; ``condition`` is on both.
    """
    def sizes(side, name, other):
        n = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy)
        return n.select(*keys, F.ceil(F.col("n") / heavy).cast("int").alias(name), F.lit(1).alias(other))

    # the heavy keys alone, at most one for ``heavy`` rows
    blocks = (sizes(left, "rows", "cols").unionByName(sizes(right, "cols", "rows"))
              .groupBy(*keys).agg(F.max("rows").alias("rows"), F.max("cols").alias("cols")))

    def own(n, by):
        return F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))

    x = (left.join(blocks, keys, "left").withColumn("row_block", own(F.col("rows"), left_id))
         .withColumn("col_block", every(F.col("cols"))).drop("rows", "cols"))
    y = (right.join(blocks, keys, "left").withColumn("col_block", own(F.col("cols"), right_id))
         .withColumn("row_block", every(F.col("rows"))).drop("rows", "cols"))
    both = x.join(y, [*keys, "row_block", "col_block"]).drop("row_block", "col_block")
    return both if condition is None else both.filter(condition)


def dealt_self_join(rows: DataFrame, key: str, heavy: int, condition: Column) -> DataFrame:
    """``rows`` joined with themselves on ``key``; the columns of the sides get the suffixes 1 and 2.

    Keys of more than ``heavy`` rows are dealt (``dealt_join``, by the column ``k``); the others are shuffled once for
    both sides. ``rows`` is read several times.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy).select(key)
    hot = stored(hot)

    def sides(df):
        rest = [c for c in df.columns if c != key]
        return [df.withColumnsRenamed({c: c + n for c in rest}) for n in "12"]

    a, b = sides(rows.join(hot, key, "left_anti"))
    x, y = sides(rows.join(hot, key, "left_semi"))
    return a.join(b, key).filter(condition).unionByName(dealt_join(x, y, [key], "k1", "k2", heavy, condition))


def _bit(rows: DataFrame, number: Column, wanted: DataFrame, how: str) -> DataFrame:
    """``rows`` with ``_hit``: whether ``wanted`` has a row of that ``number``. Only the bitmap of the numbers travels."""
    at = F.bitmap_bit_position(number)
    bits = wanted.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    x = rows.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), "_bucket", how)
    return x.withColumn("_hit", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def rows_of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is a value of ``wanted`` (a column of that name).

    ``key`` is from monotonically_increasing_id, so dense inside a partition: the bitmap has about one bit for each of
    ``rows``, and ``rows`` is not shuffled.
    """
    return _bit(rows, F.col(key), wanted, "inner").filter("_hit").drop("_hit")


def likely_rows(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be in the column ``key`` of ``wanted``, rows whose key is not).

    By a bitmap of BITS hashes, whatever the size of ``wanted``: what an exact join would shuffle is mostly left out.
    """
    x = _bit(rows, F.pmod(F.xxhash64(key), F.lit(BITS)), wanted, "left")
    return x.filter("_hit").drop("_hit"), x.filter(~F.col("_hit")).drop("_hit")
