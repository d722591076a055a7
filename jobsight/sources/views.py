"""Adapter views: the driver tables re-read as postings, observations and runs.

The driver data holds no job postings, so these views give every operator
real inputs that grow with the tables. Each view exists twice: as a Spark
DataFrame (used by the queries) and as DuckDB SQL text (used by the oracle),
kept side by side so they cannot drift apart.

* doc_postings  documents -> one posting per non-blank line of the text: url
                'doc/<id>/<n>' (n: line number from 1), company = source,
                title = the whole line, location = lang
* page_postings pages -> url, company = first host label, title = <title>
                text, location = language segment of the path
* observations  events -> one observation of URL 'job/<user_id>' per event;
                company 'co<user_id % 6>', title = event_type, location =
                props.k, run = calendar day, seq = (ts, event_id), metadata = props
* crawl_outcomes events -> one row per (calendar day, site 'co<user_id % 7>'):
                every event is a fetched page, an 'error' one a failed page; a
                site fails with 30 % failed pages or more and stops early if
                its last event of the day is a 'view'. Site co6 has no postings
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.functions.text import company_from_url, job_id_from_url
from jobsight.sources.tables import table

_TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
_PATH_LANG = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([a-z]{2})(/|$|[?#])"


def unescape_basic(c):
    """The five XML entities; &amp; last so '&amp;lt;' stays '&lt;'."""
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def utc_instant(ts_ntz):
    """A wall-clock timestamp (TIMESTAMP_NTZ) read as UTC, whatever the session time zone.

    Microseconds since the wall-clock epoch, then an instant: arithmetic only.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ts_ntz))


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "title"))
    n = (F.col("pos") + 1).cast("string")
    doc = F.col("doc_id").cast("string")
    return lines.filter(F.btrim("title", F.lit(" \t\r")) != "").select(
        F.concat(F.lit("doc/"), doc, F.lit("/"), n).alias("url"),
        F.concat(doc, F.lit("-"), n).alias("job_id"),
        "title", F.col("lang").alias("location"), F.col("source").alias("company"))


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("url"),
        job_id_from_url(F.col("url")).alias("job_id"),
        F.trim(unescape_basic(F.regexp_extract(F.col("html"), _TITLE_TAG, 1))).alias("title"),
        F.nullif(F.regexp_extract(F.col("url"), _PATH_LANG, 1), F.lit("")).alias("location"),
        company_from_url(F.col("url")).alias("company"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("job/"), F.col("user_id").cast("string")).alias("url"),
        F.concat(F.lit("co"), (F.col("user_id") % 6).cast("string")).alias("company"),
        F.col("event_type").alias("title"),
        F.get_json_object(F.col("props"), "$.k").alias("location"),
        F.col("user_id").cast("string").alias("job_id"),
        utc_instant(F.col("ts")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("run"),
        F.from_json("props", "map<string,string>").alias("metadata"))


def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sites = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run"),
                      F.concat(F.lit("co"), (F.col("user_id") % 7).cast("string")).alias("company")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.max_by("event_type", "event_id").alias("last_type"))
    ok = 10 * F.col("failed") < 3 * F.col("pages")
    return sites.select("run", "company", ok.alias("success"),
                        F.when(~ok, F.format_string("%d of %d pages failed", "failed", "pages")).alias("error"),
                        (F.col("last_type") == "view").alias("stopped_early"))


# ---- the same views as DuckDB SQL (CTE bodies) -------------------------------

SQL_VIEWS = {
    "doc_postings": """
        SELECT 'doc/' || CAST(doc_id AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS url,
               CAST(doc_id AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS job_id,
               title, lang AS location, source AS company
        FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS title,
                     generate_subscripts(string_split(text, chr(10)), 1) AS n
              FROM documents)
        WHERE trim(title, ' ' || chr(9) || chr(13)) <> ''""",
    "page_postings": r"""
        SELECT url,
               NULLIF(regexp_extract(url, '/(\d+)$', 1), '') AS job_id,
               trim(replace(replace(replace(replace(replace(
                   regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
                   '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), ' ') AS title,
               NULLIF(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([a-z]{2})(/|$|[?#])', 1), '')
                   AS location,
               split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '.', 1) AS company
        FROM pages""",
    "observations": """
        SELECT 'job/' || CAST(user_id AS VARCHAR) AS url,
               'co' || CAST(user_id % 6 AS VARCHAR) AS company,
               event_type AS title,
               json_extract_string(props, '$.k') AS location,
               CAST(user_id AS VARCHAR) AS job_id,
               ts, event_id AS seq,
               strftime(ts, '%Y-%m-%d') AS run,
               'k=' || json_extract_string(props, '$.k') AS metadata
        FROM events""",
    "crawl_outcomes": """
        SELECT run, company, 10 * failed < 3 * pages AS success,
               CASE WHEN 10 * failed >= 3 * pages THEN failed || ' of ' || pages || ' pages failed' END AS error,
               last_type = 'view' AS stopped_early
        FROM (SELECT strftime(ts, '%Y-%m-%d') AS run, 'co' || CAST(user_id % 7 AS VARCHAR) AS company,
                     count(*) AS pages, count(*) FILTER (WHERE event_type = 'error') AS failed,
                     arg_max(event_type, event_id) AS last_type
              FROM events GROUP BY 1, 2)""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the CTEs of the named views."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
