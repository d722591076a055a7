"""Registered queries over listing and detail pages made of the documents, the pattern cache, sinks read back, and P2.

The pages come from ``sources.listings``; the SQL takes the answers from the documents themselves, so a wrong pattern
of an operator cannot agree with itself.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from jobsight.functions import sql_text as S
from jobsight.operators import extract as X
from jobsight.operators import lifecycle as L
from jobsight.operators import patterns as P
from jobsight.operators import sites as C
from jobsight.plans.catalog import register
from jobsight.plans.cycle import run_cycle, summary_cycle
from jobsight.plans.q_pages import _CAND_SQL, _candidates, _host_sql, _pages
from jobsight.session import checkpoint_dir
from jobsight.sources import io
from jobsight.sources.listings import detail_pages, expected, listing_pages
from jobsight.sources.tables import spread
from jobsight.sources.views import doc_postings, with_views

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
MAX_AGE = 14


def _listing(spark, sf_dir):
    return spread(listing_pages(spark, sf_dir))


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/jobsight-{name}-{uuid.uuid4().hex}"


# ---- E1-E8, E14-E18 ------------------------------------------------------------------

@register("listing_postings", expected(
    "SELECT page_url, title, url, job_id, location, date_posted, company, company_url FROM listing_postings"))
def listing_postings(spark, sf_dir):
    """E1-E7 with the default rules: links of three kinds, missing locations, dates as attribute and as text."""
    out = X.extract_postings(_listing(spark, sf_dir))
    return out.select("page_url", "title", "url", "job_id", "location", F.col("metadata")["date_posted"].alias("date_posted"),
                      "company", "company_url")


@register("listing_outcomes", expected("""
    SELECT site_url || '/SearchJobs?page=' || id AS page_url, site_url, CAST(k AS INTEGER) AS postings,
           CAST(NULL AS VARCHAR) AS error FROM listing_docs"""))
def listing_outcomes(spark, sf_dir):
    return X.page_outcomes(X.parse_pages(_listing(spark, sf_dir)))


@register("posting_descriptions", expected("""
    SELECT p.url, p.title, d.description_text AS description, d.description_html
    FROM listing_postings p LEFT JOIN descriptions d USING (url)"""))
def posting_descriptions(spark, sf_dir):
    """Detail pages joined to their postings; half of the documents' first postings have one."""
    found = X.extract_descriptions(spread(detail_pages(spark, sf_dir)))
    return X.attach_descriptions(X.extract_postings(_listing(spark, sf_dir)), found).select(
        "url", "title", "description", "description_html")


@register("detail_descriptions", expected("SELECT url, description_text, description_html, description_tag FROM descriptions"))
def detail_descriptions(spark, sf_dir):
    return X.extract_descriptions(spread(detail_pages(spark, sf_dir)))


@register("listing_endpoints", expected("""
    SELECT d AS page_id, unnest(['url0', 'url1', 'url1', 'url2', 'call0', 'call0', 'call1', 'call3']) AS kind,
           unnest(['/api/jobs/' || s || '/' || id, '/careers/feed/' || id, '/careers/SearchJobs?site=' || s, 'SearchJobs',
                   'api', 'careers', '/api/jobs/' || s || '/' || id, '/careers/feed/' || id]) AS endpoint
    FROM listing_docs"""))
def listing_endpoints(spark, sf_dir):
    return X.extract_endpoints(listing_pages(spark, sf_dir))


@register("listing_json_ld", expected("""
    SELECT d AS page_id, CASE WHEN d % 2 = 0 THEN ['@type', 'identifier'] ELSE ['@type', 'name', 'url'] END AS keys,
           d % 2 = 0 AS is_job_posting FROM listing_docs"""))
def listing_json_ld(spark, sf_dir):
    return X.extract_json_ld(listing_pages(spark, sf_dir)).drop("n")


@register("listing_next_total", expected("""
    SELECT d AS page_id, d % 3 <> 0 AS has_next_page, CAST(k AS VARCHAR) AS declared_total FROM listing_docs"""))
def listing_next_total(spark, sf_dir):
    p = listing_pages(spark, sf_dir).select("page_id", "html")
    return X.has_next_page(p.withColumn("again", F.col("html"))).select(
        "page_id", "has_next_page", F.col("again").alias("html")).transform(X.declared_total)


@register("listing_profile", expected("""
    SELECT d AS page_id, true AS has_article, true AS has_job_class, k > 0 AS has_job_link, true AS has_listing_text,
           true AS has_search_class, true AS is_listing, CAST(k + 1 AS BIGINT) AS n_article, CAST(k AS BIGINT) AS n_job_link,
           CAST(k + 1 + CASE WHEN d % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_link, CAST(1 AS BIGINT) AS n_job_div,
           CAST(1 AS BIGINT) AS n_job_list_class, CAST(1 AS BIGINT) AS n_ext_script, CAST(1 AS BIGINT) AS n_rel_script,
           CAST(1 AS BIGINT) AS n_data_job, CAST(0 AS BIGINT) AS n_job_li, CAST(0 AS BIGINT) AS n_pagination,
           CAST(0 AS BIGINT) AS n_ajax FROM listing_docs"""))
def listing_profile(spark, sf_dir):
    """Flags and element counts that follow from the number of lines."""
    p = listing_pages(spark, sf_dir).select("page_id", "html")
    flags = X.listing_indicators(p.withColumn("again", F.col("html"))).withColumnRenamed("again", "html")
    return X.profile_pages(flags).select(
        "page_id", "has_article", "has_job_class", "has_job_link", "has_listing_text", "has_search_class", "is_listing",
        *[f"n_{k}" for k in ("article", "job_link", "link", "job_div", "job_list_class", "ext_script", "rel_script",
                             "data_job", "job_li", "pagination", "ajax")])


# ---- E10-E12, S5 ---------------------------------------------------------------------

def _cache(spark, sf_dir):
    """An older crawl's cache: of each site the last pattern among its pages of even id, detected on a day of January."""
    c = _candidates(spark, sf_dir).filter(F.col("page_id") % 2 == 0)
    per = c.groupBy("site").agg(F.max("pattern").alias("pattern"), F.min("page_id").alias("p"))
    day = F.timestamp_add("DAY", (F.col("p") % 28).cast("int"), F.lit(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)))
    return per.select("site", "pattern", day.alias("detected_at"), F.timestamp_add("DAY", F.lit(2), day).alias("last_ok"))


_CACHE_SQL = "WITH x AS (SELECT 1)" + _CAND_SQL.replace("SELECT regexp_extract(url,", "SELECT page_id, regexp_extract(url,", 1) + f"""
, cache AS (SELECT site, max(pattern) AS pattern, TIMESTAMP '2024-01-01' + INTERVAL (min(page_id) % 28) DAY AS detected_at
            FROM cand WHERE page_id % 2 = 0 GROUP BY site)
, seen AS (SELECT site, pattern, bool_or(is_listing) AS listing FROM cand GROUP BY site, pattern)
, good AS (SELECT c.site, c.pattern, detected_at, TIMESTAMP '{AS_OF:%Y-%m-%d}' AS last_ok, 'cached' AS origin
           FROM cache c JOIN seen s USING (site, pattern)
           WHERE listing AND detected_at + INTERVAL 2 DAY >= TIMESTAMP '{AS_OF:%Y-%m-%d}' - INTERVAL {MAX_AGE} DAY)
, fresh AS (SELECT * FROM good UNION ALL
            SELECT site, pattern, TIMESTAMP '{AS_OF:%Y-%m-%d}', TIMESTAMP '{AS_OF:%Y-%m-%d}', 'detected' FROM chosen
            WHERE site NOT IN (SELECT site FROM good))
"""


def _fresh(spark, sf_dir):
    """The cache as written to Parquet and read back (S5), refreshed with the pages as candidates."""
    path = _folder(spark, "patterns")
    io.write_patterns(_cache(spark, sf_dir), path)
    return P.refresh(spark.read.schema(P.CACHE).parquet(path), _candidates(spark, sf_dir), AS_OF, MAX_AGE)


@register("pattern_cache", _CACHE_SQL + """
    SELECT site, pattern, epoch_us(detected_at) AS detected_us, epoch_us(last_ok) AS last_ok_us, origin FROM fresh""")
def pattern_cache(spark, sf_dir):
    """E10 with a cache: believed entries stay, expired and contradicted ones are detected again."""
    return _fresh(spark, sf_dir).select("site", "pattern", F.unix_micros("detected_at").alias("detected_us"),
                                        F.unix_micros("last_ok").alias("last_ok_us"), "origin")


@register("pattern_cache_stats", _CACHE_SQL + """
    SELECT CASE WHEN pattern = '' THEN '(base URL)' ELSE pattern END AS pattern_name, CAST(count(*) AS BIGINT) AS sites,
           epoch_us(max(last_ok)) AS last_update_us FROM fresh GROUP BY 1
    UNION ALL SELECT '(all)', CAST(count(*) AS BIGINT), epoch_us(max(last_ok)) FROM fresh""")
def pattern_cache_stats(spark, sf_dir):
    """E11 with the last update."""
    return P.cache_stats(_fresh(spark, sf_dir)).select("pattern_name", "sites", F.unix_micros("last_update").alias("last_update_us"))


@register("invalidated_patterns", "WITH x AS (SELECT 1)" + _CAND_SQL + f"""
    SELECT site, pattern FROM chosen WHERE site <> (SELECT min(site) FROM chosen)""")
def invalidated_patterns(spark, sf_dir):
    """The first site loses its pattern."""
    chosen = X.choose_pattern(_candidates(spark, sf_dir)).checkpoint()
    return X.invalidate_patterns(chosen, chosen.agg(F.min("site")).first()[0])


# ---- C2, C4 --------------------------------------------------------------------------

@register("certificate_sites", f"""
    SELECT DISTINCT name, 'https://' || name || '.example.com/careers' AS site_url
    FROM (SELECT regexp_extract({_host_sql()}, '^(.*)\\.example\\.com$', 1) AS name FROM pages) WHERE name <> ''""")
def certificate_sites(spark, sf_dir):
    """Certificate records with a wildcard and a plain name for each page's host."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    certs = _pages(spark, sf_dir).select(F.concat(F.lit("*."), host, F.lit("\n"), host, F.lit("\nother.org")).alias("name_value"))
    return C.sites_from_certificates(certs, "example.com")


@register("link_sites", expected("""
    SELECT DISTINCT 'https://jobs.' || s || '.example.org/careers' AS site_url FROM listing_lines WHERE n % 3 = 0"""))
def link_sites(spark, sf_dir):
    """C4: hosts that the listing pages link to."""
    return C.sites_from_links(listing_pages(spark, sf_dir), "example.org")


# ---- S1, S4, S6 ----------------------------------------------------------------------

@register("site_list_roundtrip", "SELECT DISTINCT 'https://' || source || '.example.com/careers' AS site_url FROM documents"
                                 " WHERE source IS NOT NULL")
def site_list_roundtrip(spark, sf_dir):
    """A site list with blank lines and padding, written as text and read back."""
    path = _folder(spark, "sites")
    sites = listing_pages(spark, sf_dir).select("site_url").where("site_url not like '%//none.%'").distinct()
    sites.select(F.explode(F.array(F.concat(F.lit("  "), "site_url", F.lit("\t")), F.lit("   "))).alias("value")).write.text(path)
    return io.read_site_list(spark, path)


@register("postings_csv_roundtrip", with_views("SELECT url, company, title, location, job_id FROM doc_postings", "doc_postings"))
def postings_csv_roundtrip(spark, sf_dir):
    """The CSV export with its header, read back."""
    path = _folder(spark, "csv")
    cols = ["url", "company", "title", "location", "job_id"]
    io.write_postings_csv(doc_postings(spark, sf_dir).select(*cols), path)
    back = spark.read.option("header", True).option("escape", "\\").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).schema(", ".join(f"{c} string" for c in cols)).csv(path)
    return back


@register("report_lines", with_views("""
    SELECT company || ': ' || count(*) AS line FROM doc_postings GROUP BY company""", "doc_postings"))
def report_lines(spark, sf_dir):
    """A sorted text report, read back."""
    path = _folder(spark, "report")
    per = doc_postings(spark, sf_dir).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    io.write_report(per.select(F.col("company").alias("sort_key"), F.concat("company", F.lit(": "), F.col("n").cast("string")).alias("line")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---- P2 ------------------------------------------------------------------------------

@register("summary_cycle", expected("""
    SELECT 'postings' AS part, CAST(NULL AS VARCHAR) AS name, CAST(count(*) AS BIGINT) AS n FROM listing_postings
    UNION ALL SELECT 'companies', NULL, CAST(count(DISTINCT company) AS BIGINT) FROM listing_postings
    UNION ALL SELECT 'locations', NULL, CAST(count(DISTINCT location) + max(CASE WHEN location IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM listing_postings
    UNION ALL SELECT 'planned pages', NULL, CAST(3 * count(DISTINCT site_url) AS BIGINT) FROM listing_docs
    UNION ALL SELECT * FROM (SELECT 'location', coalesce(location, 'Unknown') AS name, CAST(count(*) AS BIGINT) AS n
                             FROM listing_postings GROUP BY 2 ORDER BY n DESC, name LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'company', company, CAST(count(*) AS BIGINT) AS n
                             FROM listing_postings GROUP BY 2 ORDER BY n DESC, company LIMIT 5)"""))
def summary_cycle_q(spark, sf_dir):
    """P2 over the listing pages: merged site lists, a page plan, postings and their summary, as one table."""
    pages = _listing(spark, sf_dir).checkpoint()
    sites = pages.select("site_url").distinct()
    out = summary_cycle([sites, sites], pages, max_pages=3)

    def rows(df, part, name, n):
        return df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), n.cast("long").alias("n"))

    none = F.lit(None)
    plan = out["page_plan"].agg(F.count(F.lit(1)).alias("n"))
    parts = [rows(out["summary"], c, none, F.col(c)) for c in ("postings", "companies", "locations")]
    parts += [rows(plan, "planned pages", none, F.col("n")),
              rows(out["top_locations"], "location", F.col("location"), F.col("job_count")),
              rows(out["top_companies"], "company", F.col("company"), F.col("job_count"))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


# ---- P1 ------------------------------------------------------------------------------

@register("cycle_report_plain", expected("""
    , per AS (SELECT company, CAST(count(*) AS BIGINT) AS n FROM listing_postings GROUP BY company)
    , t AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, (SELECT count(DISTINCT s) FROM listing_docs) AS sites FROM per)
    SELECT 'run run-1' AS section, CAST(k - 1 AS INTEGER) AS ord,
           ['duration_s', 'jobs_found', 'jobs_new', 'jobs_updated', 'jobs_unchanged', 'jobs_deactivated', 'sites_scraped',
            'jobs_per_second', 'new_rate'][k] AS key,
           CASE k WHEN 8 THEN NULL WHEN 9 THEN '1.000000' ELSE printf('%.6f', [0, n, n, 0, 0, 0, sites][k]::DOUBLE) END AS value
    FROM t, range(1, 10) r(k)
    UNION ALL SELECT 'site run-1', 100, s, printf('found=%d new=%d updated=0 unchanged=0 deactivated=0', coalesce(n, 0), coalesce(n, 0))
    FROM (SELECT DISTINCT s FROM listing_docs) LEFT JOIN per ON company = s
    UNION ALL SELECT 'table', CAST(k - 1 AS INTEGER), ['total_jobs', 'active_jobs', 'inactive_jobs'][k],
                     CAST([n, n, 0][k] AS VARCHAR) FROM t, range(1, 4) r(k)"""))
def cycle_report_plain(spark, sf_dir):
    """P1 over the listing pages, without the duplicate section: extract, outcomes, ingest as one run, report."""
    out = run_cycle(_listing(spark, sf_dir), L.empty_state(spark), "run-1", dedup=False, scraped_at=dt.datetime(2024, 1, 1))
    return out["report"]
