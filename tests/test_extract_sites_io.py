import json
import os

from jobsight.operators import extract as X
from jobsight.operators import sites as C
from jobsight.sources import io

SITE = "https://bloomberg.example.net/careers"
TWO = """<html><body>
<article><a href="/careers/JobDetail/Software-Engineer/12345">Software Engineer</a>
  <span class="job-location">New York, NY</span><time datetime="2024-01-02">Jan 2</time></article>
<article><a href="/careers/JobDetail/Data-Scientist/67890"> Data <b>Scientist</b> </a>
  <div class="Location">San Francisco, CA</div></article>
<article><a href="/other">no job link</a></article>
<a class="next" href="?page=2">next</a>
</body></html>"""


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "url string, site_url string, html string")


def test_two_articles(spark):
    out = X.extract_postings(pages_df(spark, [(SITE + "/SearchJobs", SITE, TWO)])).orderBy("job_id").collect()
    assert [(r["title"], r["job_id"], r["location"], r["company"]) for r in out] == [
        ("Software Engineer", "12345", "New York, NY", "bloomberg"),
        ("DataScientist", "67890", "San Francisco, CA", "bloomberg")]
    assert out[0]["url"] == "https://bloomberg.example.net/careers/JobDetail/Software-Engineer/12345"
    assert out[0]["metadata"] == {"date_posted": "2024-01-02"}


def test_malformed_and_empty(spark):
    rows = [("u1", SITE, "<html><body></body></html>"), ("u2", SITE, "<html><body><article>Incomplete"),
            ("u3", SITE, "<article><a href='JobDetail/1'>T</a>"), ("u4", SITE, None)]
    out = X.extract_postings(pages_df(spark, rows)).collect()
    assert len(out) == 1 and out[0]["location"] is None and out[0]["job_id"] == "1"


def test_page_level_columns(spark):
    p = spark.createDataFrame([(1, "u", TWO), (2, "v", "<p>12 jobs found</p><p>showing 1 of 40</p>")],
                              "page_id int, url string, html string")
    li = {r["page_id"]: r for r in X.listing_indicators(p).collect()}
    assert li[1]["has_article"] and li[1]["has_job_link"] and li[1]["is_listing"]
    assert li[2]["has_listing_text"] and not li[2]["has_article"]
    assert {r["page_id"]: r["has_next_page"] for r in X.has_next_page(p).collect()} == {1: True, 2: False}
    assert {r["page_id"]: r["declared_total"] for r in X.declared_total(p).collect()} == {1: None, 2: "12"}
    prof = {r["page_id"]: r for r in X.profile_pages(p).collect()}
    assert prof[1]["n_article"] == 3 and prof[1]["n_job_link"] == 2


def test_patterns_and_plans(spark):
    cand = spark.createDataFrame([("s1", "/JobList", True), ("s1", "/SearchJobs", True), ("s1", "", True),
                                  ("s2", "/Opportunities", False), ("s2", "", True)],
                                 "site string, pattern string, is_listing boolean")
    got = {r["site"]: r["pattern"] for r in X.choose_pattern(cand).collect()}
    assert got == {"s1": "/SearchJobs", "s2": ""}
    cache = spark.createDataFrame([("s1", "/JobList")], "site string, pattern string")
    assert {r["site"]: r["pattern"] for r in X.choose_pattern(cand, cache).collect()}["s1"] == "/JobList"
    stats = {r["pattern_name"]: r["sites"] for r in X.pattern_stats(X.choose_pattern(cand)).collect()}
    assert stats == {"/SearchJobs": 1, "(base URL)": 1, "(all)": 2}
    sites = spark.createDataFrame([("https://a/SearchJobs",), ("https://b/S?x=1",)], "search_url string")
    urls = {(r["search_url"], r["page"]): r["page_url"] for r in X.plan_page_urls(sites, 2).collect()}
    assert urls[("https://a/SearchJobs", 1)] == "https://a/SearchJobs"
    assert urls[("https://a/SearchJobs", 2)] == "https://a/SearchJobs?page=2"
    assert urls[("https://b/S?x=1", 2)] == "https://b/S?x=1&page=2"


def test_sites(spark):
    names = spark.createDataFrame([("big co",), ("acme",)], "name string")
    got = [r["name"] for r in C.candidate_sites(names).collect()]
    assert got == ["acme", "big co", "big-co", "big_co", "bigco"]
    certs = spark.createDataFrame([("*.a.example.net\nb.example.net",), ("other.org",)], "name_value string")
    assert sorted(r["name"] for r in C.sites_from_certificates(certs, "example.net").collect()) == ["a", "b"]
    lines = spark.createDataFrame([(" https://x.example.net/careers/Foo ",), ("ftp://y.example.net",),
                                   ("http://z.other.org/",)], "value string")
    s = C.sites_from_urls(lines, "example.net")
    assert [r["site_url"] for r in s.collect()] == ["https://x.example.net/careers"]
    checks = spark.createDataFrame([("https://x.example.net/careers", 200)], "site_url string, status int")
    assert C.keep_live(C.merge_sites(s, s), checks).count() == 1


def test_io_roundtrip(spark, tmpdir_fresh):
    site_file = os.path.join(tmpdir_fresh, "sites.txt")
    with open(site_file, "w") as f:
        f.write("https://a.example.net/careers\n\n  https://b.example.net/careers  \n")
    assert [r["site_url"] for r in io.read_site_list(spark, site_file).collect()] == [
        "https://a.example.net/careers", "https://b.example.net/careers"]
    cache = os.path.join(tmpdir_fresh, "cache.json")
    with open(cache, "w") as f:
        json.dump({"https://a/careers": "/SearchJobs", "https://b/careers": "", "last_updated": "x"}, f)
    assert {r["site"]: r["pattern"] for r in io.read_pattern_cache(spark, cache).collect()} == {
        "https://a/careers": "/SearchJobs", "https://b/careers": ""}
    post = os.path.join(tmpdir_fresh, "postings.json")
    with open(post, "w") as f:
        json.dump([{"title": "T", "url": "u", "job_id": None, "location": None, "company_url": SITE,
                    "company": "bloomberg", "scraped_at": "2024-01-01T00:00:00", "metadata": {"date_posted": "d"},
                    "description": None}], f)
    df = io.read_postings_json(spark, post, json_array=True)
    assert df.collect()[0]["metadata"] == {"date_posted": "d"}
    io.write_postings_csv(df, os.path.join(tmpdir_fresh, "csv"))
    many = df.select("*").unionByName(df).unionByName(df)
    io.write_postings_json(many, os.path.join(tmpdir_fresh, "json"))
    assert io.read_postings_json(spark, os.path.join(tmpdir_fresh, "json")).collect() == many.collect()
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_fresh, "csv")).count() == 1


RICH = """<html><head><meta name="x" content="/careers/SearchJobs?x=1">
<script type="application/ld+json">{"@type": "JobPosting", "title": "T", "hiringOrganization": "O"}</script>
<script src="/static/job-search.js"></script>
<script>fetch('/api/jobs/list'); $.ajax({type: 'GET', url: '/careers/JobDetail/7'}); var d = 'data.json?v=2';</script>
</head><body><div class="job-description">Line one<br>Line two</div>
<a class="result__a" href="https://acme.example.net/careers/x">r</a></body></html>"""


def test_scripts_json_ld_descriptions_links(spark):
    p = spark.createDataFrame([(1, "https://acme.example.net/careers/SearchJobs", RICH)],
                              "page_id int, url string, html string")
    eps = {(r["kind"], r["endpoint"]) for r in X.extract_endpoints(p).collect()}
    assert ("url0", "/api/jobs/list'") not in eps and ("url0", "/api/jobs/list") in eps
    assert ("url1", "/careers/SearchJobs?x=1") in eps and ("url3", "JobDetail") in eps
    assert ("call1", "/api/jobs/list") in eps and ("call2", "/careers/JobDetail/7") in eps
    ld = X.extract_json_ld(p).collect()
    assert len(ld) == 1 and ld[0]["is_job_posting"] and ld[0]["keys"] == ["@type", "title", "hiringOrganization"]
    prof = X.profile_pages(p).collect()[0]
    assert prof["n_ext_script"] == 1 and prof["n_rel_script"] == 1 and prof["n_ajax"] == 1
    d = X.extract_descriptions(p.select("url", "html")).collect()[0]
    assert d["description_tag"] == "div" and d["description_text"] == "Line one\nLine two"
    links = [r["site_url"] for r in C.sites_from_links(p, "example.net").collect()]
    assert links == ["https://acme.example.net/careers"]


def test_invalidate_patterns(spark):
    pats = spark.createDataFrame([("s1", "/SearchJobs"), ("s2", "")], "site string, pattern string")
    assert [r["site"] for r in X.invalidate_patterns(pats, "s1").collect()] == ["s2"]
    assert X.invalidate_patterns(pats).count() == 0


def test_page_outcomes(spark):
    """A page that the parser gives up on keeps what was read, and says so."""
    bad = TWO.replace("</body>", "<![wrong[ x ]]>")
    p = pages_df(spark, [("p1", SITE, TWO), ("p2", SITE, bad), ("p3", SITE, ""), ("p4", "https://other.example.net", None)])
    parsed = X.parse_pages(p).checkpoint()
    got = {r["page_url"]: (r["postings"], r["error"] is None) for r in X.page_outcomes(parsed).collect()}
    assert got == {"p1": (2, True), "p2": (2, False), "p3": (0, True), "p4": (0, True)}
    sites = {r["company"]: r["success"] for r in X.site_outcomes(X.page_outcomes(parsed), "r").collect()}
    assert sites == {"bloomberg": False, "other": True}
    assert X.postings_of(parsed).count() == 4


def test_pattern_cache_refresh(spark):
    import datetime as dt

    from jobsight.operators import patterns as P
    day = lambda d: dt.datetime(2024, 1, d)
    cache = spark.createDataFrame([("ok", "/A", day(1), day(20)), ("old", "/A", day(1), day(2)), ("wrong", "/A", day(1), day(20)),
                                   ("unseen", "/A", day(1), day(20)), ("lost", "/A", day(1), day(2))], P.CACHE)
    cand = spark.createDataFrame([("ok", "/A", True), ("ok", "", True), ("old", "/A", False), ("old", "/JobList", True),
                                  ("wrong", "/A", False), ("wrong", "", True), ("new", "/SearchJobs", True), ("lost", "", False)],
                                 "site string, pattern string, is_listing boolean")
    got = {r["site"]: (r["pattern"], r["origin"], r["last_ok"]) for r in P.refresh(cache, cand, day(25)).collect()}
    assert got == {"ok": ("/A", "cached", day(25)), "unseen": ("/A", "cached", day(20)), "old": ("/JobList", "detected", day(25)),
                   "wrong": ("", "detected", day(25)), "new": ("/SearchJobs", "detected", day(25))}
    stats = {r["pattern_name"]: (r["sites"], r["last_update"]) for r in P.cache_stats(P.refresh(cache, cand, day(25))).collect()}
    assert stats["(all)"] == (5, day(25)) and stats["/A"] == (2, day(25))
