import datetime as dt
import os
import random

from pyspark.sql import functions as F

from jobsight.operators import dedup as D
from jobsight.operators import lifecycle as L
from jobsight.plans.cycle import run_cycle
from jobsight.session import checkpoint_dir, stored
from test_lifecycle import A, obs


def _kept(spark):
    """Bytes under the checkpoint folder."""
    base = checkpoint_dir(spark).removeprefix("file:")
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, files in os.walk(base) for f in files)


def test_cycle_writes_titles_twice(spark):
    """A crawl writes the parsed pages and its batch; neither D11 nor the actions shuffle or write a title again."""
    rnd = random.Random(5)
    titles = ["".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(400)) for _ in range(600)]
    html = "".join(f'<article><a href="/careers/JobDetail/x-{i % 500}/{i % 500}">{t}</a></article>' for i, t in enumerate(titles))
    pages = spark.createDataFrame([("https://a.example.com/careers/SearchJobs", "https://a.example.com/careers", html)],
                                  "url string, site_url string, html string")
    before = _kept(spark)
    out = run_cycle(pages, L.empty_state(spark), "r1", dedup=False, scraped_at=dt.datetime(2024, 1, 1))
    assert _kept(spark) - before < 2.5 * sum(len(t.encode()) for t in titles)
    assert out["postings"].count() == 600
    state = {r["job_id"]: r["title"] for r in out["state"].collect()}
    assert state == {str(i % 500): t for i, t in enumerate(titles)}  # of two articles with one URL, the last
    acts = out["actions"].collect()
    assert len(acts) == 500 and {r["action"] for r in acts} == {"new"} and {r["title"] for r in acts} == set(state.values())


def test_ingest_tells_nulls_and_texts_apart(spark):
    """Actions of a batch of several runs are those of classify_changes on the texts themselves."""
    rows = [A(url=u, title=t, loc=p, seq=n, run=f"r{n // 9}") for n, (u, t, p) in enumerate(
        (u, t, p) for t, p in [(None, None), ("x", None), (None, "x"), ("", None), ("", ""), ("x", "x"), ("x", "x"),
                               ("1:x", ""), ("1", "1:x")] for u in "123")]
    batch = obs(spark, rows)
    _, actions, *_ = L.ingest(L.empty_state(spark), batch)
    plain = L.classify_changes(L.empty_state(spark), batch)
    assert actions.columns == plain.columns
    assert sorted(map(str, actions.collect())) == sorted(map(str, plain.collect()))


def test_numbered_url_duplicates(spark):
    rows = stored(spark.createDataFrame([(u, f"t{i}") for i, u in enumerate(["a", "b", None, "a", None, "c", "a"])],
                                        "url string, title string").withColumn("seq", F.monotonically_increasing_id()))
    plain, numbered = D.drop_exact_url_duplicates(rows), D.drop_exact_url_duplicates(rows, numbered=True)
    assert numbered.columns == plain.columns and sorted(map(str, numbered.collect())) == sorted(map(str, plain.collect()))
    assert numbered.count() == 4
