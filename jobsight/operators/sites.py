"""Site candidates (C1-C6): discovery minus the network.

Network probes are out of scope; their outcomes enter as tables (certificate
names, search-result pages, liveness checks) and the work is joins, explodes
and distincts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.functions.text import host_of

DEFAULT_TEMPLATE = "https://{name}.example.com/careers"


def _template(name_col, template: str):
    pre, _, post = template.partition("{name}")
    return F.concat(F.lit(pre), name_col, F.lit(post))


def candidate_sites(names: DataFrame, template: str = DEFAULT_TEMPLATE, col: str = "name") -> DataFrame:
    """Name variations (spaces removed, '-', '_'), distinct, templated to URLs, sorted."""
    n = F.col(col)
    v = names.select(F.explode(F.array(n, F.regexp_replace(n, " ", ""), F.regexp_replace(n, " ", "-"),
                                       F.regexp_replace(n, " ", "_"))).alias("name")).distinct()
    return v.select("name", _template(F.col("name"), template).alias("site_url")).orderBy("name")


def sites_from_certificates(certs: DataFrame, domain: str, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Subdomains named in certificate records (column name_value)."""
    parts = certs.filter(F.col("name_value").contains(domain)).select(
        F.explode(F.split(F.replace(F.col("name_value"), F.lit("*."), F.lit("")), "\n")).alias("part"))
    parts = parts.select(F.trim("part").alias("part")).filter(F.col("part").contains("." + domain))
    sub = F.trim(F.substring_index(F.col("part"), "." + domain, 1))
    subs = parts.select(sub.alias("name")).filter((F.col("name") != "") & (F.col("name") != "*")).distinct()
    return subs.select("name", _template(F.col("name"), template).alias("site_url"))


def sites_from_urls(lines: DataFrame, domain: str, col: str = "value") -> DataFrame:
    """Http lines mentioning the domain, reduced to scheme://host/careers, distinct."""
    x = lines.select(F.trim(F.col(col)).alias("line"))
    x = x.filter(F.col("line").startswith("http") & F.col("line").contains(domain))
    scheme = F.regexp_extract("line", r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    return x.select(F.concat(scheme, F.lit("://"), host_of(F.col("line")), F.lit("/careers")).alias("site_url")) \
        .distinct()


def sites_from_links(pages: DataFrame, domain: str) -> DataFrame:
    """C4: hosts under ``domain`` linked from search-result pages, as https://host/careers."""
    rx = r"https?://([^/\"'\s]+\." + domain.replace(".", r"\.") + ")"
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"""href\s*=\s*["']([^"']*)["']"""), 1))
                         .alias("href"))
    hosts = hrefs.select(F.regexp_extract("href", rx, 1).alias("host")).filter(F.col("host") != "")
    return hosts.select(F.concat(F.lit("https://"), "host", F.lit("/careers")).alias("site_url")).distinct()


def merge_sites(*dfs: DataFrame) -> DataFrame:
    """Set union of site lists, sorted."""
    out = dfs[0].select("site_url")
    for d in dfs[1:]:
        out = out.unionByName(d.select("site_url"))
    return out.distinct().orderBy("site_url")


def keep_live(sites: DataFrame, checks: DataFrame) -> DataFrame:
    """Sites whose check returned status 200 (left-semi join)."""
    ok = checks.filter(F.col("status") == 200).select("site_url")
    return sites.join(ok, "site_url", "left_semi")
