"""Registered normalization queries (N1-N5) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions import sql_text as S
from jobsight.functions import text as T
from jobsight.plans.catalog import register
from jobsight.sources.tables import spread, table
from jobsight.sources.views import doc_postings, with_views


def _title_inputs(spark, sf_dir):
    docs = doc_postings(spark, sf_dir).select(F.col("url").alias("key"), "title")
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_name").alias("title"))
    sups = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("key"),
        F.col("s_name").alias("title"))
    return docs.unionByName(parts).unionByName(sups)


_TITLE_INPUTS_SQL = """
    title_inputs AS (
        SELECT url AS key, title FROM doc_postings
        UNION ALL SELECT 'part/' || CAST(p_partkey AS VARCHAR), p_name FROM part
        UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier)"""


@register("normalized_titles", with_views(
    f", {_TITLE_INPUTS_SQL.strip()}\nSELECT key, title, {S.normalize_title('title')} AS normalized_title "
    "FROM title_inputs", "doc_postings").replace("\n, ", ",\n", 1))
def normalized_titles(spark, sf_dir):
    df = spread(_title_inputs(spark, sf_dir))
    return df.select("key", "title", T.normalize_title("title").alias("normalized_title"))


def _location_inputs(spark, sf_dir):
    docs = doc_postings(spark, sf_dir)
    a = docs.select(F.concat(F.col("url"), F.lit("#title")).alias("key"), F.col("title").alias("location"))
    b = docs.select(F.concat(F.col("url"), F.lit("#lang")).alias("key"), "location")
    c = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("key"),
        F.col("n_name").alias("location"))
    return a.unionByName(b).unionByName(c)


_LOCATION_INPUTS_SQL = """
    location_inputs AS (
        SELECT url || '#title' AS key, title AS location FROM doc_postings
        UNION ALL SELECT url || '#lang', location FROM doc_postings
        UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR), n_name FROM nation)"""


@register("normalized_locations", with_views(
    f", {_LOCATION_INPUTS_SQL.strip()}\nSELECT key, location, "
    f"{S.normalize_location('location')} AS normalized_location FROM location_inputs",
    "doc_postings").replace("\n, ", ",\n", 1))
def normalized_locations(spark, sf_dir):
    df = spread(_location_inputs(spark, sf_dir))
    return df.select("key", "location", T.normalize_location("location").alias("normalized_location"))


def _company_inputs(spark, sf_dir):
    docs = doc_postings(spark, sf_dir)
    a = docs.select(F.col("url").alias("key"), F.col("title").alias("company"))
    b = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("key"),
        F.col("c_name").alias("company"))
    c = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("key"),
        F.col("s_name").alias("company"))
    d = table(spark, sf_dir, "part").select(
        F.concat(F.lit("brand/"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_brand").alias("company"))
    return a.unionByName(b).unionByName(c).unionByName(d)


_COMPANY_INPUTS_SQL = """
    company_inputs AS (
        SELECT url AS key, title AS company FROM doc_postings
        UNION ALL SELECT 'customer/' || CAST(c_custkey AS VARCHAR), c_name FROM customer
        UNION ALL SELECT 'supplier/' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier
        UNION ALL SELECT 'brand/' || CAST(p_partkey AS VARCHAR), p_brand FROM part)"""


@register("normalized_companies", with_views(
    f", {_COMPANY_INPUTS_SQL.strip()}\nSELECT key, company, "
    f"{S.normalize_company('company')} AS normalized_company FROM company_inputs",
    "doc_postings").replace("\n, ", ",\n", 1))
def normalized_companies(spark, sf_dir):
    df = spread(_company_inputs(spark, sf_dir))
    return df.select("key", "company", T.normalize_company("company").alias("normalized_company"))


@register("seniority_levels", with_views(
    f"SELECT url, title, {S.seniority_level('title')} AS seniority_level FROM doc_postings",
    "doc_postings"))
def seniority_levels(spark, sf_dir):
    df = spread(doc_postings(spark, sf_dir))
    return df.select("url", "title", T.seniority_level("title").alias("seniority_level"))


@register("key_terms", with_views(
    f"SELECT url, {S.key_terms('title')} AS key_terms FROM doc_postings", "doc_postings"))
def key_terms(spark, sf_dir):
    df = spread(doc_postings(spark, sf_dir))
    return df.select("url", T.key_terms("title").alias("key_terms"))
