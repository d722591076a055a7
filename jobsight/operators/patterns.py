"""The pattern cache (E10-E12): which listing pattern a site answers to, how long that is believed, and its refresh.

A cache row is (site, pattern, detected_at, last_ok). It is believed for ``max_age`` days after last_ok. A refresh looks
again only at sites whose entry is missing, too old, or contradicted by a fetched page; all others keep their pattern.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.operators.extract import choose_pattern

CACHE = "site string, pattern string, detected_at timestamp, last_ok timestamp"


def judged(cache: DataFrame, candidates: DataFrame, as_of: dt.datetime, max_age: int) -> DataFrame:
    """The cache with ``state``: ok (seen as a listing now), kept (believed, not fetched), expired or contradicted."""
    seen = candidates.groupBy("site", "pattern").agg(F.max(F.col("is_listing").cast("int")).alias("listing"))
    now = F.lit(as_of).cast("timestamp")
    old = F.coalesce(F.col("last_ok"), F.col("detected_at")) < now - F.make_interval(days=F.lit(max_age))
    state = (F.when(F.coalesce(old, F.lit(True)), "expired").when(F.col("listing") == 1, "ok")
             .when(F.col("listing") == 0, "contradicted").otherwise("kept"))
    return cache.join(seen, ["site", "pattern"], "left").select(*cache.columns, state.alias("state"))


def refresh(cache: DataFrame, candidates: DataFrame, as_of: dt.datetime, max_age: int = 14) -> DataFrame:
    """The next version of the cache, with ``origin``: cached or detected.

    ``candidates`` holds (site, pattern, is_listing) for the pages that were fetched. A site whose entry fell and whose
    pages show no listing leaves the cache.
    """
    now = F.lit(as_of).cast("timestamp")
    j = judged(cache, candidates, as_of, max_age)
    good = j.filter(F.col("state").isin("ok", "kept")).select(
        "site", "pattern", "detected_at", F.when(F.col("state") == "ok", now).otherwise(F.col("last_ok")).alias("last_ok"),
        F.lit("cached").alias("origin"))
    again = choose_pattern(candidates.join(good.select("site"), "site", "left_anti"))
    return good.unionByName(again.select("site", "pattern", now.alias("detected_at"), now.alias("last_ok"),
                                         F.lit("detected").alias("origin")))


def cache_stats(cache: DataFrame) -> DataFrame:
    """Sites per pattern ('' shown as '(base URL)'), with the last update of each, and an '(all)' row."""
    named = F.when(F.col("pattern") == "", F.lit("(base URL)")).otherwise(F.col("pattern"))
    counts = [F.count(F.lit(1)).alias("sites"), F.max("last_ok").alias("last_update")]
    per = cache.groupBy(named.alias("pattern_name")).agg(*counts)
    return per.unionByName(cache.agg(*counts).select(F.lit("(all)").alias("pattern_name"), "sites", "last_update"))
