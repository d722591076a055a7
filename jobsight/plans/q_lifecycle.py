"""Registered lifecycle queries (L1-L8, Q1-Q5, Q7-Q9, Q14, Q15) over observations.

View rule: every calendar day of events is one crawl run; a company is a
site, scraped on the days it has observations; the state starts empty.
Timestamps are reported as epoch microseconds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobsight.operators import lifecycle as L
from jobsight.operators import queries as Q
from jobsight.plans.catalog import register
from jobsight.sources.views import crawl_outcomes, observations, with_views

AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0, tzinfo=dt.timezone.utc)
RECENT_DAYS = 7
LOOKUP_URL = "job/7"


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---- SQL building blocks ----------------------------------------------------------

def _base(complete="1"):
    """Runs of each company with the complete ones counted; ``complete`` says which are (1 or 0)."""
    return f"""
, cr AS (SELECT company, run, complete, upto, upto - complete AS before
         FROM (SELECT company, run, complete, sum(complete) OVER (PARTITION BY company ORDER BY run) AS upto
               FROM (SELECT company, run, {complete} AS complete FROM (SELECT DISTINCT company, run FROM observations))))
, b AS (SELECT o.*, cr.complete, cr.upto, cr.before FROM observations o JOIN cr USING (company, run))"""


_BASE = _base()
_FINISHED = _base("CASE WHEN (company, run) IN (SELECT (company, run) FROM crawl_outcomes WHERE NOT success) THEN 0 ELSE 1 END")
_WHOLE = _base("CASE WHEN (company, run) IN (SELECT (company, run) FROM crawl_outcomes WHERE NOT success OR stopped_early)"
               " THEN 0 ELSE 1 END")

_ACTS = """
, w AS (SELECT b.*, lag(url) OVER win AS p_url, lag(title) OVER win AS p_title,
               lag(location) OVER win AS p_loc, lag(run) OVER win AS p_run, lag(upto) OVER win AS p_upto
        FROM b WINDOW win AS (PARTITION BY url ORDER BY run, seq))
, acts AS (SELECT url, company, seq, run,
                  CASE WHEN p_url IS NULL THEN 'new'
                       WHEN title IS DISTINCT FROM p_title OR location IS DISTINCT FROM p_loc
                            OR NOT (p_run = run OR before = p_upto) THEN 'updated'
                       ELSE 'unchanged' END AS action
           FROM w)"""

_GONE = """
, seen AS (SELECT DISTINCT company, complete, upto, url FROM b)
, gone AS (SELECT cr.run, s.company, s.url FROM (SELECT DISTINCT company, upto + 1 AS nth, url FROM seen) s
           JOIN cr ON cr.company = s.company AND cr.complete = 1 AND cr.upto = s.nth
           WHERE NOT EXISTS (SELECT 1 FROM seen t WHERE t.company = s.company AND t.complete = 1
                             AND t.upto = s.nth AND t.url = s.url))"""

_STATS = """
, site_stats AS (
    SELECT run, company, coalesce(a.jobs_found, 0) AS jobs_found, coalesce(a.jobs_new, 0) AS jobs_new,
           coalesce(a.jobs_updated, 0) AS jobs_updated, coalesce(a.jobs_unchanged, 0) AS jobs_unchanged,
           CAST(coalesce(d.n, 0) AS BIGINT) AS jobs_deactivated, coalesce(o.success, true) AS success, o.error,
           coalesce(o.stopped_early, false) AS stopped_early
    FROM (SELECT run, company, CAST(count(*) AS BIGINT) AS jobs_found,
                 CAST(count(*) FILTER (WHERE action = 'new') AS BIGINT) AS jobs_new,
                 CAST(count(*) FILTER (WHERE action = 'updated') AS BIGINT) AS jobs_updated,
                 CAST(count(*) FILTER (WHERE action = 'unchanged') AS BIGINT) AS jobs_unchanged
          FROM acts GROUP BY run, company) a
    LEFT JOIN (SELECT run, company, count(*) AS n FROM gone GROUP BY run, company) d USING (run, company)
    FULL JOIN crawl_outcomes o USING (run, company))
, run_totals AS (
    SELECT run, CAST(count(*) AS BIGINT) AS sites_scraped,
           CAST(count(*) FILTER (WHERE success) AS BIGINT) AS sites_succeeded,
           CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS sites_failed,
           CAST(coalesce(sum(jobs_found) FILTER (WHERE success), 0) AS BIGINT) AS jobs_found,
           CAST(coalesce(sum(jobs_new) FILTER (WHERE success), 0) AS BIGINT) AS jobs_new,
           CAST(coalesce(sum(jobs_updated) FILTER (WHERE success), 0) AS BIGINT) AS jobs_updated,
           CAST(coalesce(sum(jobs_unchanged) FILTER (WHERE success), 0) AS BIGINT) AS jobs_unchanged,
           CAST(coalesce(sum(jobs_deactivated) FILTER (WHERE success), 0) AS BIGINT) AS jobs_deactivated
    FROM site_stats GROUP BY run)
, ledger AS (
    SELECT t.run AS run_id, epoch_us(x.s) AS started_at_us, epoch_us(x.c) AS completed_at_us,
           t.sites_scraped, t.jobs_found, t.jobs_new, t.jobs_updated, t.jobs_unchanged, t.jobs_deactivated,
           'completed' AS status, CAST(NULL AS VARCHAR) AS error_message
    FROM run_totals t LEFT JOIN (SELECT run, min(ts) AS s, max(ts) AS c FROM observations GROUP BY run) x
         USING (run))"""

_STATE = """
, f AS (SELECT url, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY url)
, lst AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY url ORDER BY run DESC, seq DESC) AS rn
                         FROM b) WHERE rn = 1)
, fst AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY url ORDER BY run, seq) AS rn
                         FROM b) WHERE rn = 1)
, cl AS (SELECT company, max(run) AS c_run FROM cr WHERE complete = 1 GROUP BY company)
, job_state AS (
    SELECT f.url, fst.company, lst.title, lst.location, lst.job_id, f.first_ts, f.last_ts,
           CAST(f.n AS BIGINT) AS scrape_count, lst.metadata, coalesce(lst.run >= cl.c_run, true) AS is_active
    FROM f JOIN lst USING (url) JOIN fst USING (url) LEFT JOIN cl ON cl.company = fst.company)"""


def _sql(tail: str, *blocks: str) -> str:
    return with_views("".join(blocks) + "\n" + tail, "observations", "crawl_outcomes")


def plain_ledger_sql():
    """The ledger of a crawl without outcome rows: every site is a success."""
    return _sql("SELECT * FROM ledger", _BASE, _ACTS, _GONE, _STATS.replace(
        "    FULL JOIN crawl_outcomes o USING (run, company))", "    LEFT JOIN (SELECT * FROM crawl_outcomes WHERE false) o USING (run, company))"))


# ---- Spark building blocks --------------------------------------------------------

def _obs(spark, sf_dir):
    return observations(spark, sf_dir)


def _ingest(spark, sf_dir, complete_only=False):
    obs = _obs(spark, sf_dir)
    return L.ingest(L.empty_state(spark), obs, crawl_outcomes(spark, sf_dir), complete_only), obs


def _state(spark, sf_dir):
    return L.upsert(L.empty_state(spark), _obs(spark, sf_dir))


def _ledger(spark, sf_dir):
    (state, actions, gone, stats, ledger), _ = _ingest(spark, sf_dir)
    return ledger


def _ledger_us(df):
    return df.select("run_id", _us("started_at").alias("started_at_us"),
                     _us("completed_at").alias("completed_at_us"), "sites_scraped", "jobs_found",
                     "jobs_new", "jobs_updated", "jobs_unchanged", "jobs_deactivated", "status",
                     "error_message")


def _metadata_text():
    """The metadata map as text: key=value, sorted."""
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";").alias("metadata")


def _state_us(df, with_active=True, with_metadata=False):
    cols = ["url", "company", "title", "location", "job_id", _us("first_seen").alias("first_seen_us"),
            _us("last_seen").alias("last_seen_us"), "scrape_count"]
    if with_metadata:
        cols.append(_metadata_text())
    return df.select(*cols, *(["is_active"] if with_active else []))


# ---- registered queries -------------------------------------------------------------

@register("change_actions", _sql("SELECT url, seq, run, action FROM acts", _BASE, _ACTS))
def change_actions(spark, sf_dir):
    return L.classify_changes(L.empty_state(spark), _obs(spark, sf_dir)).select("url", "seq", "run", "action")


@register("job_state", _sql("""
    SELECT url, company, title, location, job_id, epoch_us(first_ts) AS first_seen_us,
           epoch_us(last_ts) AS last_seen_us, scrape_count, metadata, is_active FROM job_state""", _BASE, _STATE))
def job_state(spark, sf_dir):
    return _state_us(_state(spark, sf_dir), with_metadata=True)


@register("job_state_complete_only", _sql("""
    SELECT url, company, title, location, job_id, epoch_us(first_ts) AS first_seen_us,
           epoch_us(last_ts) AS last_seen_us, scrape_count, metadata, is_active FROM job_state""", _WHOLE, _STATE))
def job_state_complete_only(spark, sf_dir):
    """L2 / L3 where sites that failed or stopped early in a run deactivate nothing."""
    (state, _, _, _, _), _ = _ingest(spark, sf_dir, complete_only=True)
    return _state_us(state, with_metadata=True)


@register("deactivated_complete_only", _sql("SELECT run, company, url FROM gone", _WHOLE, _GONE))
def deactivated_complete_only(spark, sf_dir):
    (_, _, gone, _, _), _ = _ingest(spark, sf_dir, complete_only=True)
    return gone


@register("change_actions_complete_only", _sql("SELECT url, seq, run, action FROM acts", _WHOLE, _ACTS))
def change_actions_complete_only(spark, sf_dir):
    (_, actions, _, _, _), _ = _ingest(spark, sf_dir, complete_only=True)
    return actions.select("url", "seq", "run", "action")


@register("deactivated_jobs", _sql("SELECT run, company, url FROM gone", _BASE, _GONE))
def deactivated_jobs(spark, sf_dir):
    return L.deactivations(L.empty_state(spark), _obs(spark, sf_dir))


@register("site_stats", _sql("SELECT * FROM site_stats", _FINISHED, _ACTS, _GONE, _STATS))
def site_stats(spark, sf_dir):
    (_, _, _, stats, _), _ = _ingest(spark, sf_dir)
    return stats


@register("run_totals", _sql("SELECT * FROM run_totals", _FINISHED, _ACTS, _GONE, _STATS))
def run_totals(spark, sf_dir):
    (_, _, _, stats, _), _ = _ingest(spark, sf_dir)
    return L.run_totals(stats)


@register("run_ledger", _sql("SELECT * FROM ledger", _FINISHED, _ACTS, _GONE, _STATS))
def run_ledger(spark, sf_dir):
    return _ledger_us(_ledger(spark, sf_dir))


@register("recent_runs", _sql("SELECT * FROM ledger ORDER BY started_at_us DESC, run_id DESC LIMIT 10",
                              _FINISHED, _ACTS, _GONE, _STATS))
def recent_runs(spark, sf_dir):
    return _ledger_us(Q.recent_runs(_ledger(spark, sf_dir), 10))


@register("last_completed_run", _sql(
    "SELECT * FROM ledger WHERE status = 'completed' ORDER BY started_at_us DESC, run_id DESC LIMIT 1",
    _FINISHED, _ACTS, _GONE, _STATS))
def last_completed_run(spark, sf_dir):
    return _ledger_us(Q.last_completed_run(_ledger(spark, sf_dir)))


@register("smart_stop_pages", _sql("""
    SELECT e.site, CAST(coalesce(s.stop_page, e.end_page) AS INTEGER) AS pages_scanned,
           s.stop_page IS NOT NULL AS stopped_early
    FROM ends e LEFT JOIN stops s USING (site)""", """
, pg AS (SELECT run, dense_rank() OVER (ORDER BY run) AS page FROM (SELECT DISTINCT run FROM observations))
, lst AS (SELECT o.company AS site, CAST(pg.page AS INTEGER) AS page, o.url
          FROM observations o JOIN pg USING (run))
, fp AS (SELECT site, url, min(page) AS page FROM lst GROUP BY site, url)
, np AS (SELECT site, page, count(*) AS n_new FROM fp GROUP BY site, page)
, pl AS (SELECT DISTINCT site, page FROM lst)
, present AS (SELECT site, page FROM (SELECT site, page, row_number() OVER (PARTITION BY site ORDER BY page) AS rn
                                      FROM pl) WHERE rn = page)
, p AS (SELECT pr.site, pr.page, coalesce(np.n_new, 0) > 0 AS has_new FROM present pr LEFT JOIN np USING (site, page))
, r AS (SELECT site, page, page - coalesce(max(CASE WHEN has_new THEN page END) OVER (
            PARTITION BY site ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run_len FROM p)
, stops AS (SELECT site, min(page) AS stop_page FROM r WHERE run_len >= 5 GROUP BY site)
, ends AS (SELECT site, max(page) AS end_page FROM p GROUP BY site)"""))
def smart_stop_pages(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    days = obs.select("run").distinct()  # one row per crawl day: a small table
    pages = days.withColumn("page", F.dense_rank().over(Window.orderBy("run")).cast("int"))
    listing = obs.join(pages, "run").select(F.col("company").alias("site"), "page", "url")
    active = spark.createDataFrame([], "site string, url string")
    return L.smart_stop(listing, active, n=5, max_pages=None)


@register("active_jobs", _sql("""
    SELECT url, company, title, location, job_id, epoch_us(first_ts) AS first_seen_us,
           epoch_us(last_ts) AS last_seen_us, scrape_count FROM job_state WHERE is_active""", _BASE, _STATE))
def active_jobs(spark, sf_dir):
    st = _state(spark, sf_dir)
    return _state_us(Q.active_jobs(st), with_active=False)


@register("all_jobs", _sql("""
    SELECT url, company, title, location, job_id, epoch_us(first_ts) AS first_seen_us,
           epoch_us(last_ts) AS last_seen_us, scrape_count, CAST(is_active AS INTEGER) AS is_active
    FROM job_state""", _BASE, _STATE))
def all_jobs(spark, sf_dir):
    st = Q.all_jobs(_state(spark, sf_dir), include_inactive=True)
    return st.select("url", "company", "title", "location", "job_id", _us("first_seen").alias("first_seen_us"),
                     _us("last_seen").alias("last_seen_us"), "scrape_count", "is_active")


@register("job_by_url", _sql(f"""
    SELECT url, company, title, location, job_id, epoch_us(first_ts) AS first_seen_us,
           epoch_us(last_ts) AS last_seen_us, scrape_count, is_active FROM job_state WHERE url = '{LOOKUP_URL}'""",
                             _BASE, _STATE))
def job_by_url(spark, sf_dir):
    return _state_us(Q.job_by_url(_state(spark, sf_dir), LOOKUP_URL))


@register("job_stats", _sql("""
    SELECT CAST(count(*) AS BIGINT) AS total_jobs, CAST(count(*) FILTER (WHERE is_active) AS BIGINT) AS active_jobs,
           CAST(count(*) FILTER (WHERE NOT is_active) AS BIGINT) AS inactive_jobs,
           (SELECT CAST(count(*) AS BIGINT) FROM ledger) AS total_runs
    FROM job_state""", _FINISHED, _ACTS, _GONE, _STATS, _STATE))
def job_stats(spark, sf_dir):
    (state, _, _, _, ledger), _ = _ingest(spark, sf_dir)
    return Q.job_stats(state, ledger)


@register("recently_updated", _sql(f"""
    SELECT url, company, title, location, job_id, epoch_us(first_ts) AS first_seen_us,
           epoch_us(last_ts) AS last_seen_us, scrape_count, is_active FROM job_state
    WHERE last_ts >= TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}' - INTERVAL {RECENT_DAYS} DAY
      AND last_ts <= TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'""", _BASE, _STATE))
def recently_updated(spark, sf_dir):
    return _state_us(Q.recently_updated(_state(spark, sf_dir), RECENT_DAYS, AS_OF))


@register("quality_stats", _sql("""
    SELECT CAST(count(DISTINCT company) AS BIGINT) AS companies, round(avg(scrape_count), 6) AS avg_scrape_count,
           epoch_us(max(last_ts)) AS max_last_seen_us,
           CAST(count(*) FILTER (WHERE location IS NULL OR location = '') AS BIGINT) AS missing_location
    FROM job_state""", _BASE, _STATE))
def quality_stats(spark, sf_dir):
    q = Q.quality_stats(_state(spark, sf_dir))
    return q.select("companies", F.round("avg_scrape_count", 6).alias("avg_scrape_count"),
                    _us("max_last_seen").alias("max_last_seen_us"), "missing_location")


@register("company_active_rate", _sql("""
    SELECT company, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_active) AS BIGINT) AS active,
           CAST(count(*) FILTER (WHERE NOT is_active) AS BIGINT) AS inactive,
           round(count(*) FILTER (WHERE is_active) / count(*), 6) AS active_rate
    FROM job_state GROUP BY company""", _BASE, _STATE))
def company_active_rate(spark, sf_dir):
    return Q.company_active_rate(_state(spark, sf_dir))


_RUN_METRICS = ["duration_s", "jobs_found", "jobs_new", "jobs_updated", "jobs_unchanged", "jobs_deactivated", "sites_scraped",
                "jobs_per_second", "new_rate"]

_REPORT_SQL = """
    SELECT 'run ' || run_id AS section, CAST(k - 1 AS INTEGER) AS ord, %s[k] AS key,
           printf('%%.6f', round(v[k], 6)) AS value
    FROM (SELECT run_id, [d, jobs_found::DOUBLE, jobs_new::DOUBLE, jobs_updated::DOUBLE, jobs_unchanged::DOUBLE,
                          jobs_deactivated::DOUBLE, sites_scraped::DOUBLE, CASE WHEN d > 0 THEN jobs_found / d END,
                          CASE WHEN jobs_found > 0 THEN jobs_new / jobs_found END] AS v
          FROM (SELECT *, (completed_at_us - started_at_us) / 1000000.0::DOUBLE AS d FROM ledger)), range(1, 10) r(k)
    UNION ALL
    SELECT 'site ' || run, 100, company, printf('found=%%d new=%%d updated=%%d unchanged=%%d deactivated=%%d', jobs_found, jobs_new,
                                                jobs_updated, jobs_unchanged, jobs_deactivated) FROM site_stats
    UNION ALL
    SELECT 'table', CAST(k - 1 AS INTEGER), ['total_jobs', 'active_jobs', 'inactive_jobs'][k], CAST(v[k] AS VARCHAR)
    FROM (SELECT [count(*), count(*) FILTER (WHERE is_active), count(*) FILTER (WHERE NOT is_active)] AS v FROM job_state),
         range(1, 4) r(k)""" % _RUN_METRICS


@register("run_report", _sql(_REPORT_SQL, _FINISHED, _ACTS, _GONE, _STATS, _STATE))
def run_report(spark, sf_dir):
    """Q14: the run report as (section, ord, key, value) rows."""
    (state, _, _, stats, ledger), _ = _ingest(spark, sf_dir)
    return Q.run_report(ledger, stats, state)


@register("deactivate_duplicates")
def deactivate_duplicates(spark, sf_dir):
    """The job state after switching every non-canonical duplicate to inactive (rows-only)."""
    from jobsight.operators import dedup as D
    from jobsight.session import checkpoint_dir
    checkpoint_dir(spark)
    state = _state(spark, sf_dir).checkpoint()
    dups = D.find_duplicates(Q.active_jobs(state))
    return _state_us(D.deactivate_duplicates(state, dups))
