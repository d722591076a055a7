"""Registered reporting queries over the posting views (Q6, Q10-Q13)."""

from __future__ import annotations

import uuid

from jobsight.operators import queries as Q
from jobsight.plans.catalog import register
from jobsight.session import checkpoint_dir
from jobsight.sources import io
from jobsight.sources.views import doc_postings, page_postings, with_views


@register("jobs_by_company", with_views("""
    SELECT company, CAST(count(*) AS BIGINT) AS job_count
    FROM doc_postings GROUP BY company""", "doc_postings"))
def jobs_by_company(spark, sf_dir):
    return Q.jobs_by_company(doc_postings(spark, sf_dir))


@register("top_locations", with_views("""
    SELECT coalesce(location, 'Unknown') AS location, CAST(count(*) AS BIGINT) AS job_count
    FROM doc_postings GROUP BY 1 ORDER BY job_count DESC, location LIMIT 10""", "doc_postings"))
def top_locations(spark, sf_dir):
    return Q.top_locations(doc_postings(spark, sf_dir), 10)


@register("top_companies", with_views("""
    SELECT company, CAST(count(*) AS BIGINT) AS job_count
    FROM doc_postings GROUP BY company ORDER BY job_count DESC, company LIMIT 5""", "doc_postings"))
def top_companies(spark, sf_dir):
    return Q.top_companies(doc_postings(spark, sf_dir), 5)


@register("posting_summary", with_views("""
    SELECT CAST(count(*) AS BIGINT) AS postings,
           CAST(count(DISTINCT company) AS BIGINT) AS companies,
           CAST(count(DISTINCT location) + max(CASE WHEN location IS NULL THEN 1 ELSE 0 END) AS BIGINT)
               AS locations,
           CASE WHEN count(DISTINCT company) > 0
                THEN round(count(*) / count(DISTINCT company), 6) END AS avg_per_company
    FROM page_postings""", "page_postings"))
def posting_summary(spark, sf_dir):
    return Q.posting_summary(page_postings(spark, sf_dir))


@register("sample_postings", with_views("""
    SELECT url, job_id, title, location, company FROM page_postings
    ORDER BY company, title, url LIMIT 5""", "page_postings"))
def sample_postings(spark, sf_dir):
    return Q.sample_postings(page_postings(spark, sf_dir), 5)


@register("postings_json_roundtrip", with_views("""
    SELECT url, job_id, title, location, company FROM doc_postings""", "doc_postings"))
def postings_json_roundtrip(spark, sf_dir):
    """S3 then S2: every posting written as JSON lines and read back."""
    path = f"{checkpoint_dir(spark)}/jobsight-postings-{uuid.uuid4().hex}"
    io.write_postings_json(doc_postings(spark, sf_dir), path)
    return io.read_postings_json(spark, path).select("url", "job_id", "title", "location", "company")
