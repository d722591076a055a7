"""Registered extraction and site queries (E1, E7-E19, C1, C3, C5, C6) over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight import rules
from jobsight.functions import sql_text as S
from jobsight.functions.text import company_from_url, host_of
from jobsight.operators import extract as X
from jobsight.operators import sites as C
from jobsight.plans.catalog import register
from jobsight.sources.tables import spread, table
from jobsight.sources.views import page_postings, with_views

HOST_RX = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
SCHEME_RX = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
SEG_RX = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]*)?"
DOMAINS = ["example.com", "example.net", "example.org"]


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _host_sql(x="url"):
    return f"regexp_extract({x}, {S.lit(HOST_RX)}, 1)"


_MARKUP = (f"regexp_replace(regexp_replace(html, {S.lit(rules.COMMENT_PATTERN)}, '', 'g'), "
           f"{S.lit(rules.SCRIPT_BODY_PATTERN)}, '\\1\\2', 'g')")


def _flags_sql():
    p = X.PAT
    return {
        "has_article": f"regexp_matches({_MARKUP}, {S.lit(p['article'])})",
        "has_job_class": f"regexp_matches({_MARKUP}, {S.lit(p['job_class'])})",
        "has_job_link": f"regexp_matches({_MARKUP}, {S.lit(p['job_link'])})",
        "has_listing_text": f"regexp_matches(html, {S.lit(p['listing_text'])})",
        "has_search_class": f"regexp_matches({_MARKUP}, {S.lit(p['search_class'])})",
    }


@register("company_from_url", f"""
    SELECT page_id, url, split_part({_host_sql()}, '.', 1) AS company FROM pages""")
def company_from_url_q(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", company_from_url(F.col("url")).alias("company"))


def _sites_sql(domain):
    u = "trim(url, ' ')"
    return (f"SELECT DISTINCT regexp_extract({u}, {S.lit(SCHEME_RX)}, 1) || '://' || {_host_sql(u)} || '/careers' "
            f"AS site_url FROM pages WHERE starts_with({u}, 'http') AND contains({u}, {S.lit(domain)})")


@register("sites_from_urls", _sites_sql(DOMAINS[0]))
def sites_from_urls(spark, sf_dir):
    return C.sites_from_urls(_pages(spark, sf_dir), DOMAINS[0], col="url")


@register("merge_sites", "SELECT DISTINCT site_url FROM (" + " UNION ALL ".join(_sites_sql(d) for d in DOMAINS)
          + ") ORDER BY site_url")
def merge_sites(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return C.merge_sites(*[C.sites_from_urls(p, d, col="url") for d in DOMAINS])


@register("candidate_sites", """
    SELECT DISTINCT name, 'https://' || name || '.example.com/careers' AS site_url
    FROM (SELECT unnest([c_mktsegment, replace(c_mktsegment, ' ', ''), replace(c_mktsegment, ' ', '-'),
                         replace(c_mktsegment, ' ', '_')]) AS name FROM customer)
    ORDER BY name""")
def candidate_sites(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    return C.candidate_sites(names)


@register("live_sites", f"""
    SELECT DISTINCT 'https://' || {_host_sql()} || '/careers' AS site_url FROM pages
    WHERE 'https://' || {_host_sql()} || '/careers' IN (
        SELECT 'https://' || {_host_sql()} || '/careers' FROM pages WHERE starts_with(url, 'https://'))""")
def live_sites(spark, sf_dir):
    p = _pages(spark, sf_dir)
    site = F.concat(F.lit("https://"), host_of(F.col("url")), F.lit("/careers"))
    sites = p.select(site.alias("site_url")).distinct()
    checks = p.select(site.alias("site_url"),
                      F.when(F.col("url").startswith("https://"), F.lit(200)).otherwise(F.lit(404)).alias("status"))
    return C.keep_live(sites, checks)


@register("plan_page_urls", f"""
    SELECT search_url, CAST(page AS INTEGER) AS page,
           CASE WHEN page = 1 THEN search_url
                WHEN contains(search_url, '?') THEN search_url || '&page=' || CAST(page AS VARCHAR)
                ELSE search_url || '?page=' || CAST(page AS VARCHAR) END AS page_url
    FROM (SELECT DISTINCT 'https://' || {_host_sql()} || '/careers/SearchJobs' AS search_url FROM pages),
         (SELECT unnest(range(1, 101)) AS page)""")
def plan_page_urls(spark, sf_dir):
    p = _pages(spark, sf_dir)
    sites = p.select(F.concat(F.lit("https://"), host_of(F.col("url")), F.lit("/careers/SearchJobs"))
                     .alias("search_url")).distinct()
    return X.plan_page_urls(sites, 100)


@register("listing_indicators", "SELECT page_id, url, " + ", ".join(f"{v} AS {k}" for k, v in _flags_sql().items())
          + ", (" + " OR ".join(_flags_sql().values()) + ") AS is_listing FROM pages")
def listing_indicators(spark, sf_dir):
    return X.listing_indicators(_pages(spark, sf_dir))


@register("has_next_page", f"""
    SELECT page_id, url, (regexp_matches(html, {S.lit(X.PAT['next_link'])})
                          OR regexp_matches(html, {S.lit(X.PAT['page_href'])})) AS has_next_page FROM pages""")
def has_next_page(spark, sf_dir):
    return X.has_next_page(_pages(spark, sf_dir))


@register("page_profile", "SELECT page_id, url, " + ", ".join(
    f"CAST(len(regexp_extract_all({'html' if k == 'ajax' else _MARKUP}, {S.lit(X.PAT[k])})) AS BIGINT) AS n_{k}"
    for k in X.PROFILE_COUNTS)
    + " FROM pages")
def page_profile(spark, sf_dir):
    return X.profile_pages(_pages(spark, sf_dir))


@register("declared_total", f"""
    SELECT page_id, url, coalesce(NULLIF(regexp_extract(html, {S.lit('(?i)' + rules.TOTAL_PATTERNS[0])}, 1), ''),
                                  NULLIF(regexp_extract(html, {S.lit('(?i)' + rules.TOTAL_PATTERNS[1])}, 1), ''))
           AS declared_total FROM pages""")
def declared_total(spark, sf_dir):
    return X.declared_total(_pages(spark, sf_dir))


def _endpoints_sql():
    blocks = (f"list_concat(regexp_extract_all(html, {S.lit(X.PAT['script_body'])}, 1), "
              f"regexp_extract_all(html, {S.lit(X.PAT['meta_content'])}, 1))")
    scripts = f"regexp_extract_all(html, {S.lit(X.PAT['script_body'])}, 1)"
    parts = []
    for i, pat in enumerate(rules.ENDPOINT_PATTERNS):
        parts.append(f"SELECT page_id, 'url{i}' AS kind, unnest(regexp_extract_all(block, {S.lit(pat)})) AS endpoint "
                     f"FROM (SELECT page_id, unnest({blocks}) AS block FROM pages)")
    for i, pat in enumerate(rules.API_CALL_PATTERNS):
        parts.append(f"SELECT page_id, 'call{i}' AS kind, unnest(regexp_extract_all(block, {S.lit(pat)}, 1)) "
                     f"AS endpoint FROM (SELECT page_id, unnest({scripts}) AS block FROM pages)")
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


@register("page_endpoints", _endpoints_sql())
def page_endpoints(spark, sf_dir):
    return X.extract_endpoints(_pages(spark, sf_dir))


@register("json_ld_blocks", f"""
    SELECT page_id, json_keys(block) AS keys, contains(block, 'JobPosting') AS is_job_posting
    FROM (SELECT page_id, unnest(regexp_extract_all(html, {S.lit(X.PAT['ld_json'])}, 1)) AS block FROM pages)""")
def json_ld_blocks(spark, sf_dir):
    return X.extract_json_ld(_pages(spark, sf_dir)).drop("n")


def _candidates(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumns({"site": X.site_of(F.col("url")),
                                           "pattern": F.regexp_extract("url", SEG_RX, 1)})
    return X.listing_indicators(p).select("page_id", "site", "pattern", "is_listing")


_CAND_SQL = (f", cand AS (SELECT regexp_extract(url, {S.lit(SCHEME_RX)}, 1) || '://' || {_host_sql()} AS site, "
             f"regexp_extract(url, {S.lit(SEG_RX)}, 1) AS pattern, ("
             + " OR ".join(_flags_sql().values()) + ") AS is_listing FROM pages)"
             + ", prio AS (SELECT site, pattern, CASE pattern "
             + " ".join(f"WHEN {S.lit(p)} THEN {i}" for i, p in enumerate(rules.LISTING_PATTERNS))
             + f" ELSE {len(rules.LISTING_PATTERNS)} END AS prio FROM cand WHERE is_listing)"
             + ", chosen AS (SELECT site, pattern FROM (SELECT site, pattern, row_number() OVER "
               "(PARTITION BY site ORDER BY prio, pattern) AS rn FROM prio) WHERE rn = 1)")


@register("choose_pattern", "WITH x AS (SELECT 1)" + _CAND_SQL + " SELECT site, pattern FROM chosen")
def choose_pattern(spark, sf_dir):
    return X.choose_pattern(_candidates(spark, sf_dir))


@register("pattern_stats", "WITH x AS (SELECT 1)" + _CAND_SQL + """
    SELECT CASE WHEN pattern = '' THEN '(base URL)' ELSE pattern END AS pattern_name,
           CAST(count(*) AS BIGINT) AS sites FROM chosen GROUP BY 1
    UNION ALL SELECT '(all)', CAST(count(*) AS BIGINT) FROM chosen""")
def pattern_stats(spark, sf_dir):
    return X.pattern_stats(X.choose_pattern(_candidates(spark, sf_dir)))


_ARTICLE_H1 = r"(?s)<article[^>]*>.*?<h1[^>]*>(.*?)</h1>"


@register("extract_articles", f"""
    SELECT url AS page_url, regexp_replace(replace(replace(replace(replace(replace(
               regexp_replace(regexp_extract(html, {S.lit(_ARTICLE_H1)}, 1), '<[^>]*>', '', 'g'),
               '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
               {S.lit('^' + S.WS + '+|' + S.WS + '+$')}, '', 'g') AS title,
           url, NULLIF(regexp_extract(url, '/(\\d+)$', 1), '') AS job_id, CAST(NULL AS VARCHAR) AS location,
           split_part({_host_sql()}, '.', 1) AS company
    FROM pages WHERE regexp_matches(html, {S.lit(_ARTICLE_H1)})""")
def extract_articles(spark, sf_dir):
    """E1 configured for these pages: article heading as title, the page as posting URL."""
    p = spread(_pages(spark, sf_dir)).select("url", "html", X.site_of(F.col("url")).alias("site_url"))
    out = X.extract_postings(p, link_pattern=None, title_tag="h1")
    return out.select("page_url", "title", "url", "job_id", "location", "company")


@register("extract_postings")
def extract_postings(spark, sf_dir):
    """E1 with the default job-link rule (JobDetail / FolderDetail links in articles); rows-only."""
    p = spread(_pages(spark, sf_dir)).select("url", "html", X.site_of(F.col("url")).alias("site_url"))
    return X.extract_postings(p).drop("scraped_at")


@register("page_descriptions")
def page_descriptions(spark, sf_dir):
    """Description text of every page (rows-only)."""
    return X.extract_descriptions(spread(_pages(spark, sf_dir)))


@register("validate_postings", f"""
    SELECT reason, CAST(count(*) AS BIGINT) AS postings FROM (
        SELECT CASE WHEN title IS NULL OR trim(title, ' ') = '' THEN 'missing_title'
                    WHEN NOT coalesce(regexp_matches(url, '^https?://[^/\\s]+'), false) THEN 'invalid_url'
                    WHEN company IS NULL OR trim(company, ' ') = '' THEN 'missing_company'
                    ELSE 'ok' END AS reason
        FROM page_postings) GROUP BY reason""".replace("FROM page_postings", "FROM page_postings", 1))
def validate_postings(spark, sf_dir):
    v = X.validate_postings(page_postings(spark, sf_dir))
    return v.groupBy("reason").agg(F.count(F.lit(1)).alias("postings"))


# page_postings view CTE for validate_postings
from jobsight.plans.catalog import ORACLE as _ORACLE  # noqa: E402

_ORACLE["validate_postings"] = with_views(_ORACLE["validate_postings"], "page_postings")


@register("cycle_report")
def cycle_report(spark, sf_dir):
    """P1 over the pages: extract, ingest as one run, dedup the active jobs, report (rows-only)."""
    import datetime as dt

    from jobsight.operators import lifecycle as L
    from jobsight.plans.cycle import run_cycle
    p = spread(_pages(spark, sf_dir)).select("url", "html", X.site_of(F.col("url")).alias("site_url"))
    out = run_cycle(p, L.empty_state(spark), "run-1", scraped_at=dt.datetime(2024, 1, 1),
                    link_pattern=None, title_tag="h1")
    return out["report"]
