"""Reporting queries (Q1-Q15): filters, aggregations, sorts, top-k.

All are single aggregate or TakeOrdered jobs over the state table; the
global ones (Q5, Q9, Q12) are one partial+final hash aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB_COLS = ["url", "company", "title", "location", "job_id", "first_seen", "last_seen",
            "scrape_count"]
ORDER = ["company", "title", "url"]


def _active(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("is_active")) if "is_active" in jobs.columns else jobs


def active_jobs(jobs: DataFrame, company: str | None = None) -> DataFrame:
    """Q1: active rows, 8 columns, ordered by company, title (url breaks ties)."""
    df = _active(jobs)
    if company is not None:
        df = df.filter(F.col("company") == company)
    return df.select(*JOB_COLS).orderBy(*ORDER)


def all_jobs(jobs: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Q2: like Q1, or every row plus is_active rendered 0/1."""
    if not include_inactive:
        return active_jobs(jobs)
    return jobs.select(*JOB_COLS, F.col("is_active").cast("int").alias("is_active")).orderBy(*ORDER)


def job_by_url(jobs: DataFrame, url: str) -> DataFrame:
    """Q3: point lookup (a pushed-down equality filter on a parquet snapshot)."""
    return jobs.filter(F.col("url") == url)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Q4: latest runs by started_at (TakeOrderedAndProject)."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def job_stats(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Q5: total / active / inactive jobs and number of runs."""
    rows = jobs.select(F.lit(True).alias("is_job"), F.col("is_active").alias("a")).unionByName(
        runs.select(F.lit(False).alias("is_job"), F.lit(None).cast("boolean").alias("a")))
    agg = rows.agg(F.count_if(F.col("is_job")).alias("total_jobs"),
                   F.count_if(F.col("is_job") & F.col("a")).alias("active_jobs"),
                   F.count_if(~F.col("is_job")).alias("total_runs"))
    return agg.select("total_jobs", "active_jobs",
                      (F.col("total_jobs") - F.col("active_jobs")).alias("inactive_jobs"), "total_runs")


def jobs_by_company(jobs: DataFrame) -> DataFrame:
    """Q6: active jobs per company, most first."""
    return (_active(jobs).groupBy("company").agg(F.count(F.lit(1)).alias("job_count"))
            .orderBy(F.col("job_count").desc(), F.col("company")))


def last_completed_run(runs: DataFrame) -> DataFrame:
    """Q7: the most recent completed run (zero or one row)."""
    return (runs.filter(F.col("status") == "completed")
            .orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1))


def recently_updated(jobs: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    """Q8: rows whose last_seen lies within ``days`` of an explicit ``as_of``."""
    lo = as_of - dt.timedelta(days=days)
    return jobs.filter((F.col("last_seen") >= F.lit(lo)) & (F.col("last_seen") <= F.lit(as_of)))


def quality_stats(jobs: DataFrame) -> DataFrame:
    """Q9: distinct companies, mean scrape_count, newest last_seen, rows without location."""
    return jobs.agg(
        F.countDistinct("company").alias("companies"),
        F.avg("scrape_count").alias("avg_scrape_count"),
        F.max("last_seen").alias("max_last_seen"),
        F.count_if(F.col("location").isNull() | (F.col("location") == "")).alias("missing_location"))


def top_locations(postings: DataFrame, k: int = 10) -> DataFrame:
    """Q10: postings per location (null -> 'Unknown'), top k, ties by name."""
    loc = F.coalesce(F.col("location"), F.lit("Unknown")).alias("location")
    return (postings.groupBy(loc).agg(F.count(F.lit(1)).alias("job_count"))
            .orderBy(F.col("job_count").desc(), F.col("location")).limit(k))


def top_companies(postings: DataFrame, k: int = 5) -> DataFrame:
    """Q11: postings per company, top k, ties by name."""
    return (postings.groupBy("company").agg(F.count(F.lit(1)).alias("job_count"))
            .orderBy(F.col("job_count").desc(), F.col("company")).limit(k))


def posting_summary(postings: DataFrame) -> DataFrame:
    """Q12: postings, companies, locations (null counts as one), mean per company."""
    agg = postings.agg(
        F.count(F.lit(1)).alias("postings"),
        F.countDistinct("company").alias("companies"),
        (F.countDistinct("location")
         + F.max(F.when(F.col("location").isNull(), 1).otherwise(0))).alias("locations"))
    return agg.select(
        "postings", "companies", F.coalesce("locations", F.lit(0)).cast("bigint").alias("locations"),
        F.when(F.col("companies") > 0,
               F.round(F.col("postings") / F.col("companies"), 6)).alias("avg_per_company"))


def sample_postings(postings: DataFrame, k: int = 5) -> DataFrame:
    """Q13: the first k postings in (company, title, url) order."""
    return postings.orderBy(*ORDER).limit(k)


def company_active_rate(jobs: DataFrame) -> DataFrame:
    """Q15: active / inactive split per company."""
    agg = jobs.groupBy("company").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_active")).alias("active"))
    return agg.select("company", "total", "active", (F.col("total") - F.col("active")).alias("inactive"),
                      F.round(F.col("active") / F.col("total"), 6).alias("active_rate"))


def run_report(ledger: DataFrame, stats: DataFrame, jobs: DataFrame,
               dedup: DataFrame | None = None) -> DataFrame:
    """Q14: a report as rows (section, ord, key, value), built by union of aggregates.

    ``ledger`` run rows, ``stats`` per-site rows, ``jobs`` the state table and
    optionally a one-row dedup stats frame. Nothing is collected: writing the
    report is ``orderBy(section, ord, key)`` then ``write.text``.
    """
    secs = (F.col("completed_at").cast("double") - F.col("started_at").cast("double"))
    run_rows = ledger.select(
        F.col("run_id"), secs.alias("duration_s"), "jobs_found", "jobs_new", "jobs_updated",
        "jobs_unchanged", "jobs_deactivated", "sites_scraped")
    metrics = ["duration_s", "jobs_found", "jobs_new", "jobs_updated", "jobs_unchanged",
               "jobs_deactivated", "sites_scraped"]
    run_part = run_rows.select(
        F.concat(F.lit("run "), F.col("run_id")).alias("section"),
        F.explode(F.arrays_zip(
            F.array(*[F.lit(i) for i in range(len(metrics) + 2)]).alias("ord"),
            F.array(*[F.lit(m) for m in metrics], F.lit("jobs_per_second"), F.lit("new_rate")).alias("key"),
            F.array(*[F.col(m).cast("double") for m in metrics],
                    F.when(F.col("duration_s") > 0, F.col("jobs_found") / F.col("duration_s")),
                    F.when(F.col("jobs_found") > 0, F.col("jobs_new") / F.col("jobs_found"))
                    ).alias("value"))).alias("z"))
    run_part = run_part.select("section", F.col("z.ord").alias("ord"), F.col("z.key").alias("key"),
                               # a fixed form: engines print short and long fractions differently
                               F.when(F.col("z.value").isNotNull(), F.format_string("%.6f", F.round(F.col("z.value"), 6)))
                               .alias("value"))
    site_part = stats.select(
        F.concat(F.lit("site "), F.col("run").cast("string")).alias("section"),
        F.lit(100).alias("ord"), F.col("company").alias("key"),
        F.format_string("found=%d new=%d updated=%d unchanged=%d deactivated=%d",
                        "jobs_found", "jobs_new", "jobs_updated", "jobs_unchanged",
                        "jobs_deactivated").alias("value"))
    totals = jobs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active")).alias("active"))
    table_part = totals.select(F.lit("table").alias("section"), F.explode(F.arrays_zip(
        F.array(F.lit(0), F.lit(1), F.lit(2)).alias("ord"),
        F.array(F.lit("total_jobs"), F.lit("active_jobs"), F.lit("inactive_jobs")).alias("key"),
        F.array(F.col("total").cast("string"), F.col("active").cast("string"),
                (F.col("total") - F.col("active")).cast("string")).alias("value"))).alias("z"))
    parts = [run_part, site_part,
             table_part.select("section", F.col("z.ord").alias("ord"), F.col("z.key").alias("key"),
                               F.col("z.value").alias("value"))]
    if dedup is not None:
        cols = [c for c in dedup.columns]
        dd = dedup.select(F.lit("dedup").alias("section"), F.explode(F.arrays_zip(
            F.array(*[F.lit(i) for i in range(len(cols))]).alias("ord"),
            F.array(*[F.lit(c) for c in cols]).alias("key"),
            F.array(*[F.col(c).cast("string") for c in cols]).alias("value"))).alias("z"))
        parts.append(dd.select("section", F.col("z.ord").alias("ord"), F.col("z.key").alias("key"),
                               F.col("z.value").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
