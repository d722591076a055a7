"""Query catalogue: every registered query as (Spark builder, oracle SQL).

Spark builders take (spark, sf_dir) and return a DataFrame over the whole
driver tables. Oracle SQL runs in DuckDB over the same parquet files (the
views of jobsight.sources.views are inlined as CTEs). Column names match one
to one; doubles are rounded to 6 digits and timestamps are compared as epoch
microseconds on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all():
    # importing the modules fills SPARK / ORACLE
    from jobsight.plans import q_postings  # noqa: F401
    from jobsight.plans import q_normalize  # noqa: F401
    from jobsight.plans import q_lifecycle  # noqa: F401
    from jobsight.plans import q_pages  # noqa: F401
    from jobsight.plans import q_listings  # noqa: F401
    from jobsight.plans import q_dedup  # noqa: F401
    from jobsight.plans import q_stream  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(SPARK)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
