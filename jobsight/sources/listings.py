"""Listing and detail pages made of the documents: crawl input whose right answers are known from the source rows.

Every document is a listing page of its source's site: an article with a JobDetail link for each non-blank line (the
title), a location and a date for most of them, one article without such a link, a JSON-LD block, a script that names
two endpoints, and a next link on two pages of three. Every second document has a detail page for its first posting.
The SQL twins below give the postings and descriptions from the documents, without any page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.functions import sql_text as S
from jobsight.sources.tables import table

BLANK = " \t\r"


def _escaped(c):
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("d"), F.coalesce("source", F.lit("none")).alias("s"), "lang",
        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return d.withColumns({"id": F.col("d").cast("string"),
                          "site_url": F.concat(F.lit("https://"), "s", F.lit(".example.com/careers"))})


def _path(n):
    """JobDetail/<document>-<line>/<job id> of line ``n`` (from 1)."""
    n = n.cast("string")
    return F.concat(F.lit("JobDetail/"), "id", F.lit("-"), n, F.lit("/"), "id", F.lit("00"), n)


def _href(n):
    jobs = F.concat(F.lit("https://jobs."), "s", F.lit(".example.org/"), _path(n))
    return F.when(n % 3 == 0, jobs).when(n % 3 == 1, F.concat(F.lit("/careers/"), _path(n))).otherwise(_path(n))


def _article(line, i):
    n = i + 1
    day = F.lpad((F.col("d") % 28 + 1).cast("string"), 2, "0")
    place = F.when((n % 4 != 0) & F.col("lang").isNotNull(),
                   F.concat(F.lit('<span class="job-location">'), _escaped(F.col("lang")), F.lit("</span>"))).otherwise("")
    date = (F.when(n % 5 == 0, "").when(n % 2 == 0, F.concat(F.lit('<time datetime="2024-01-'), day, F.lit('">soon</time>')))
            .otherwise(F.concat(F.lit("<time> Posted "), day, F.lit(" </time>"))))
    return F.when(F.btrim(line, F.lit(BLANK)) != "", F.concat(
        F.lit('<article><a href="'), _href(n), F.lit('">'), _escaped(line), F.lit("</a>"), place, date, F.lit("</article>")))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, site_url, html): a listing page for each document."""
    articles = F.array_compact(F.transform("lines", _article))
    block = F.when(F.col("d") % 2 == 0, F.concat(F.lit('{"@type": "JobPosting", "identifier": "'), "id", F.lit('"}'))).otherwise(
        F.concat(F.lit('{"@type": "Organization", "name": "'), "s", F.lit('", "url": "x"}')))
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta name="feed" content="/careers/SearchJobs?site='), "s",
        F.lit('"><script type="application/ld+json">'), block,
        F.lit('</script><script src="/static/job-app.js"></script><script>fetch(\'/api/jobs/'), "s", F.lit("/"), "id",
        F.lit("'); axios.get('/careers/feed/"), "id", F.lit("');</script></head><body><p>"),
        F.size("articles").cast("string"), F.lit(' jobs found</p><div class="job-list search-results" data-job="'), "id",
        F.lit('">'), F.array_join("articles", ""), F.lit('<article class="teaser"><a href="/about">About us</a></article></div>'),
        F.when(F.col("d") % 3 != 0, F.concat(F.lit('<a class="next" href="?start='), "id", F.lit('">next</a>'))).otherwise(""),
        F.lit("</body></html>"))
    url = F.concat("site_url", F.lit("/SearchJobs?page="), "id")
    return (_docs(spark, sf_dir).withColumn("articles", articles)
            .select(F.col("d").alias("page_id"), url.alias("url"), "site_url", html.alias("html")))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): the page of the first posting of every second document, its text in a div or a section."""
    rows = _docs(spark, sf_dir).where(F.col("d") % 2 == 0).withColumn("kept", F.array_compact(F.transform(
        "lines", lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", F.struct((i + 1).alias("n"), x.alias("line"))))))
    rows = rows.where(F.size("kept") > 0).withColumn("n", F.col("kept")[0]["n"])
    tag = F.when(F.col("d") % 4 == 0, F.lit("div")).otherwise(F.lit("section"))
    body = F.array_join(F.transform("kept", lambda k: F.concat(F.lit("<p>"), _escaped(k["line"]), F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><body><h1>Job</h1><article><p>not this</p></article><"), tag, F.lit(' class="Job-Description" id="x&amp;y">'),
                    body, F.lit("<br></"), tag, F.lit("><div>Apply</div></body></html>"))
    jobs = F.concat(F.lit("https://jobs."), "s", F.lit(".example.org/"), _path(F.col("n")))
    site = F.concat(F.lit("https://"), "s", F.lit(".example.com/"))
    url = F.when(F.col("n") % 3 == 0, jobs).when(F.col("n") % 3 == 1, F.concat(site, F.lit("careers/"), _path(F.col("n")))) \
        .otherwise(F.concat(site, _path(F.col("n"))))
    return rows.select(url.alias("url"), html.alias("html"))


# ---- the right answers as DuckDB SQL (CTE bodies over documents) -----------------

_ESCAPED = "replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL = f"""
    listing_lines AS (
        SELECT doc_id AS d, CAST(doc_id AS VARCHAR) AS id, coalesce(source, 'none') AS s, lang, line, n,
               'https://' || coalesce(source, 'none') || '.example.com/careers' AS site_url
        FROM (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
        WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
    listing_docs AS (
        SELECT doc_id AS d, CAST(doc_id AS VARCHAR) AS id, coalesce(source, 'none') AS s,
               'https://' || coalesce(source, 'none') || '.example.com/careers' AS site_url,
               (SELECT count(*) FROM listing_lines l WHERE l.d = doc_id) AS k FROM documents),
    listing_postings AS (
        SELECT d, n, site_url || '/SearchJobs?page=' || id AS page_url, {S.strip_ws('line')} AS title,
               CASE n % 3 WHEN 0 THEN 'https://jobs.' || s || '.example.org/' WHEN 1 THEN site_url || '/'
                    ELSE 'https://' || s || '.example.com/' END
               || 'JobDetail/' || id || '-' || n || '/' || id || '00' || n AS url,
               id || '00' || n AS job_id, CASE WHEN n % 4 <> 0 THEN lang END AS location,
               CASE WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN '2024-01-' || lpad(CAST(d % 28 + 1 AS VARCHAR), 2, '0')
                    ELSE 'Posted ' || lpad(CAST(d % 28 + 1 AS VARCHAR), 2, '0') END AS date_posted,
               s AS company, site_url AS company_url
        FROM listing_lines),
    descriptions AS (
        SELECT p.url, string_agg({S.strip_ws('line')}, chr(10) ORDER BY l.n) AS description_text,
               CASE WHEN d % 4 = 0 THEN 'div' ELSE 'section' END AS description_tag,
               '<' || CASE WHEN d % 4 = 0 THEN 'div' ELSE 'section' END || ' class="Job-Description" id="x&amp;y">'
               || string_agg('<p>' || {_ESCAPED} || '</p>', '' ORDER BY l.n) || '<br/></'
               || CASE WHEN d % 4 = 0 THEN 'div' ELSE 'section' END || '>' AS description_html
        FROM listing_lines l JOIN (SELECT d, arg_min(url, n) AS url FROM listing_postings GROUP BY d) p USING (d)
        WHERE d % 2 = 0 GROUP BY d, p.url)"""


def expected(sql: str) -> str:
    """``sql`` over listing_lines, listing_docs, listing_postings and descriptions."""
    return f"WITH {SQL}\n{sql}"
