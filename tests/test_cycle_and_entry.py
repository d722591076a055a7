import datetime as dt

import __spark_entry__ as E
from paths import SF001
from jobsight.operators import lifecycle as L
from jobsight.plans.cycle import run_cycle, summary_cycle
from test_extract_sites_io import SITE, TWO


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["company", "job_count"] and df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50


def test_run_cycle(spark):
    pages = spark.createDataFrame([(SITE + "/SearchJobs", SITE, TWO)], "url string, site_url string, html string")
    out = run_cycle(pages, L.empty_state(spark), "r1", scraped_at=dt.datetime(2024, 1, 1))
    assert out["state"].count() == 2
    assert {r["action"] for r in out["actions"].collect()} == {"new"}
    assert out["dedup_stats"].collect()[0]["total_jobs"] == 2
    assert out["report"].count() > 0
    s = summary_cycle([spark.createDataFrame([(SITE,)], "site_url string")], pages, max_pages=3)
    assert s["page_plan"].count() == 3 and s["summary"].collect()[0]["postings"] == 2


def test_oracle_sf0001(spark):
    """Every registered query with oracle SQL agrees with DuckDB at sf0.001."""
    from oracle_harness import compare, duck
    con = duck(SF001)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = {}
    for name, sql in sqls.items():
        probs = compare(spark, con, name, qs[name], sql, SF001)
        if probs:
            bad[name] = probs
    assert not bad, bad
