import datetime as dt

from pyspark.sql import functions as F

from jobsight.operators import lifecycle as L
from jobsight.operators import queries as Q
from jobsight.sources import io
from jobsight.streaming.ingest import apply_batch, read_ledger, read_state

OBS = "url string, company string, title string, location string, job_id string, ts timestamp, seq long, run string"


def t(m):
    return dt.datetime(2024, 1, 1, 0, m)


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def A(title="Software Engineer", seq=1, run="r1", url="A", company="bloomberg", loc="NYC"):
    return (url, company, title, loc, "1", t(seq), seq, run)


def actions(spark, state, rows):
    return [r["action"] for r in L.classify_changes(state, obs(spark, rows)).orderBy("run", "seq").collect()]


def test_insert_update_unchanged_counter(spark):
    e = L.empty_state(spark)
    assert actions(spark, e, [A()]) == ["new"]
    assert actions(spark, e, [A(seq=1), A("Senior Software Engineer", seq=2)]) == ["new", "updated"]
    assert actions(spark, e, [A(seq=1), A(seq=2)]) == ["new", "unchanged"]
    st = L.upsert(e, obs(spark, [A(seq=1), A(seq=2), A(seq=3)])).collect()[0]
    assert st["scrape_count"] == 3 and st["first_seen"] == t(1) and st["last_seen"] == t(3)
    assert st["is_active"]


def test_missing_deactivated_and_reactivated(spark):
    e = L.empty_state(spark)
    day1 = [A(url=u, seq=i) for i, u in enumerate(["1", "2", "3"], 1)]
    day2 = [A(url=u, seq=10 + i, run="r2") for i, u in enumerate(["2", "3"], 1)]
    gone = L.deactivations(e, obs(spark, day1 + day2)).collect()
    assert [(g["run"], g["url"]) for g in gone] == [("r2", "1")]
    state = L.upsert(e, obs(spark, day1 + day2))
    flags = {r["url"]: r["is_active"] for r in state.collect()}
    assert flags == {"1": False, "2": True, "3": True}
    # seen again later: reactivated and counted as updated
    acts = L.classify_changes(state, obs(spark, [A(url="1", seq=20, run="r3")])).collect()
    assert acts[0]["action"] == "updated"


def test_stepwise_equals_closed_form(spark):
    rows = []
    seq = 0
    plan = {"r1": ["a", "b", "c", "a"], "r2": ["b", "d"], "r3": ["a", "d", "d"], "r4": ["c"]}
    for run, urls in plan.items():
        for u in urls:
            seq += 1
            rows.append((u, "co", f"title-{u}-{seq % 3}", "x", u, t(seq), seq, run))
    allb = obs(spark, rows)
    closed = {r["url"]: r.asDict() for r in L.upsert(L.empty_state(spark), allb).collect()}
    closed_acts = [r["action"] for r in L.classify_changes(L.empty_state(spark), allb).orderBy("seq").collect()]
    state = L.empty_state(spark)
    step_acts = []
    for run in plan:
        b = allb.filter(F.col("run") == run)
        step_acts += [r["action"] for r in L.classify_changes(state, b).orderBy("seq").collect()]
        state = spark.createDataFrame(L.upsert(state, b).collect(), state.schema)
    stepped = {r["url"]: r.asDict() for r in state.collect()}
    assert stepped == closed
    assert step_acts == closed_acts


def test_mark_inactive_scopes(spark):
    e = L.empty_state(spark)
    state = L.upsert(e, obs(spark, [A(url="1", seq=1), A(url="2", seq=2, company="fb")]))
    out = {r["url"]: r["is_active"] for r in L.mark_inactive(state, spark.createDataFrame([], "url string"),
                                                             company="bloomberg").collect()}
    assert out == {"1": False, "2": True}


def test_smart_stop(spark):
    rows = [("s", p, f"u{p}") for p in range(1, 4)] + [("s", p, "u1") for p in range(4, 10)]
    listing = spark.createDataFrame(rows, "site string, page int, url string")
    act = spark.createDataFrame([], "site string, url string")
    r = L.smart_stop(listing, act, n=5).collect()[0]
    assert r["pages_scanned"] == 8 and r["stopped_early"]
    rows2 = rows[:3] + [("s", p, "u1") for p in range(4, 8)] + [("s", 8, "new")] + \
        [("s", p, "u1") for p in range(9, 12)]
    r2 = L.smart_stop(spark.createDataFrame(rows2, listing.schema), act, n=5).collect()[0]
    assert r2["pages_scanned"] == 11 and not r2["stopped_early"]


def test_queries_on_state(spark):
    e = L.empty_state(spark)
    rows = [A(url=str(i), seq=i, company="bloomberg" if i < 3 else "fb") for i in range(1, 6)]
    rows += [A(url=str(i), seq=10 + i, run="r2", company="bloomberg" if i < 3 else "fb") for i in (1, 3, 4, 5)]
    state = L.upsert(e, obs(spark, rows))
    ledger = spark.createDataFrame([("r1", t(1), t(2), 1, 1, 1, 0, 0, 0, "completed", None)],
                                   "run_id string, started_at timestamp, completed_at timestamp, sites_scraped long, "
                                   "jobs_found long, jobs_new long, jobs_updated long, jobs_unchanged long, "
                                   "jobs_deactivated long, status string, error_message string")
    s = Q.job_stats(state, ledger).collect()[0]
    assert (s["total_jobs"], s["active_jobs"], s["inactive_jobs"], s["total_runs"]) == (5, 4, 1, 1)
    assert Q.active_jobs(state, "bloomberg").count() == 1
    assert Q.all_jobs(state, include_inactive=True).count() == 5
    assert Q.job_by_url(state, "1").collect()[0]["title"] == "Software Engineer"
    assert Q.last_completed_run(ledger).count() == 1


def test_snapshot_versions_and_replay(spark, tmpdir_fresh):
    base = tmpdir_fresh + "/state"
    b1 = obs(spark, [A(url="1", seq=1), A(url="2", seq=2)])
    assert apply_batch(spark, b1, 0, base)
    assert not apply_batch(spark, b1, 0, base)  # replay of batch 0 changes nothing
    b2 = obs(spark, [A(url="1", seq=3, run="r2")])
    assert apply_batch(spark, b2, 1, base)
    v, bid = io.latest_pointer(spark, base)
    assert (v, bid) == (2, 1)
    st = {r["url"]: (r["scrape_count"], r["is_active"]) for r in
          io.load_snapshot(spark, base, L.empty_state(spark)).collect()}
    assert st == {"1": (2, True), "2": (1, False)}


def test_run_ledger_start_complete_fold(spark):
    schema = ("run_id string, started_at timestamp, completed_at timestamp, sites_scraped long, jobs_found long, "
              "jobs_new long, jobs_updated long, jobs_unchanged long, jobs_deactivated long, status string, "
              "error_message string")
    log = L.start_run(spark.createDataFrame([], schema), "r1", t(1))
    log = L.start_run(log, "r2", t(2))
    totals = spark.createDataFrame([("r1", 2, 2, 0, 5, 3, 1, 1, 0)],
                                   "run string, sites_scraped long, sites_succeeded long, sites_failed long, "
                                   "jobs_found long, jobs_new long, jobs_updated long, jobs_unchanged long, "
                                   "jobs_deactivated long")
    log = L.complete_run(log, "r1", totals, t(9))
    runs = {r["run_id"]: r for r in L.fold_ledger(log).collect()}
    assert runs["r1"]["status"] == "completed" and runs["r1"]["jobs_new"] == 3 and runs["r1"]["started_at"] == t(1)
    assert runs["r2"]["status"] == "running"  # crashed runs stay running
    assert Q.last_completed_run(L.fold_ledger(log)).collect()[0]["run_id"] == "r1"


def test_late_run_rejected(spark, tmpdir_fresh):
    import pytest
    from jobsight.streaming.ingest import LateRunError
    base = tmpdir_fresh + "/state"
    assert apply_batch(spark, obs(spark, [A(url="1", seq=5, run="r2")]), 0, base)
    with pytest.raises(LateRunError):
        apply_batch(spark, obs(spark, [A(url="1", seq=1, run="r1")]), 1, base)


def test_failed_pointer_read_is_an_error(spark, tmpdir_fresh, monkeypatch):
    import pytest
    base = tmpdir_fresh + "/state"
    assert apply_batch(spark, obs(spark, [A(url="1", seq=1)]), 0, base)
    assert apply_batch(spark, obs(spark, [A(url="1", seq=2, run="r2")]), 1, base)
    real = io.pointers

    def broken(*_):
        raise OSError("store not reachable")

    monkeypatch.setattr(io, "pointers", broken)
    with pytest.raises(OSError):
        apply_batch(spark, obs(spark, [A(url="1", seq=3, run="r3")]), 2, base)
    monkeypatch.setattr(io, "pointers", real)
    assert io.latest_pointer(spark, base) == (2, 1)
    assert read_state(spark, base).collect()[0]["scrape_count"] == 2


def test_crash_before_the_pointer_and_replay(spark, tmpdir_fresh, monkeypatch):
    import pytest
    base = tmpdir_fresh + "/state"
    b = obs(spark, [A(url="1", seq=1), A(url="2", seq=2)])
    real = io.publish

    def crash(*_):
        raise KeyboardInterrupt

    assert apply_batch(spark, obs(spark, [A(url="0", seq=0, run="r0")]), 0, base)
    monkeypatch.setattr(io, "publish", crash)
    with pytest.raises(KeyboardInterrupt):
        apply_batch(spark, b, 1, base)  # state and ledger are written, the pointer is not
    monkeypatch.setattr(io, "publish", real)
    assert io.latest_pointer(spark, base) == (1, 0)
    assert apply_batch(spark, b, 1, base)
    assert sorted(r["run_id"] for r in read_ledger(spark, base).collect()) == ["r0", "r1"]
    assert {r["url"]: r["scrape_count"] for r in read_state(spark, base).collect()} == {"0": 1, "1": 1, "2": 1}


def test_run_split_over_batches(spark, tmpdir_fresh):
    rows = [A(url="1", seq=1, run="r1"), A(url="2", seq=2, run="r1"), A(url="1", seq=3, run="r2"),
            A(url="3", seq=4, run="r2"), A(url="2", seq=5, run="r2"), A(url="3", seq=6, run="r3")]
    base = tmpdir_fresh + "/state"
    for k, part in enumerate((rows[:3], rows[3:4], rows[4:])):
        assert apply_batch(spark, obs(spark, part), k, base)
    whole = L.upsert(L.empty_state(spark), obs(spark, rows))
    assert sorted(map(tuple, read_state(spark, base).collect())) == sorted(map(tuple, whole.collect()))
    ledger = {r["run_id"]: (r["jobs_found"], r["jobs_new"], r["jobs_deactivated"]) for r in read_ledger(spark, base).collect()}
    assert ledger == {"r1": (2, 2, 0), "r2": (3, 1, 0), "r3": (1, 0, 2)}


def test_url_seen_under_another_company(spark):
    e = L.empty_state(spark)
    state = L.upsert(e, obs(spark, [A(url="1", seq=1, company="a"), A(url="2", seq=2, company="a")]))
    moved = L.upsert(state, obs(spark, [A(url="1", seq=3, run="r2", company="b")]))
    assert {r["url"]: (r["company"], r["is_active"]) for r in moved.collect()} == {"1": ("a", True), "2": ("a", True)}
    both = L.upsert(state, obs(spark, [A(url="1", seq=3, run="r2", company="b"), A(url="2", seq=4, run="r3", company="a")]))
    assert {r["url"]: r["is_active"] for r in both.collect()} == {"1": False, "2": True}


# ---- incomplete runs, outcomes, metadata ------------------------------------------

def _stepped(spark, rows, plan, incomplete):
    """Run after run, each by the plain rules: upsert every sighting, then deactivate what a complete run missed."""
    state, acts = {}, []
    for run in plan:
        own = [r for r in rows if r[7] == run]
        for url, company, title, loc, job, ts, seq, _ in own:
            old = state.get(url)
            acts.append((seq, "new" if old is None else "updated" if [title, loc] != old[1:3] or not old[4] else "unchanged"))
            state[url] = [company if old is None else old[0], title, loc, (old[3] if old else 0) + 1, True]
        for company in {r[1] for r in own}:
            if (company, run) not in incomplete:
                seen = {r[0] for r in own}
                for url, s in state.items():
                    if s[0] == company and url not in seen:
                        s[4] = False
    return {u: tuple(s) for u, s in state.items()}, acts


def test_incomplete_runs_deactivate_nothing(spark):
    import random
    rnd = random.Random(5)
    plan = [f"r{k}" for k in range(7)]
    home = {f"u{k}": rnd.choice(["a", "b"]) for k in range(12)}
    rows, seq = [], 0
    for run in plan:
        for url in rnd.sample(sorted(home), rnd.randint(2, 7)):
            seq += 1
            rows.append((url, home[url], f"t{rnd.randint(0, 2)}", "x", url, t(seq % 60), seq, run))
    incomplete = {("a", "r0"), ("a", "r2"), ("a", "r3"), ("b", "r4"), ("b", "r6")}
    table = spark.createDataFrame(sorted(incomplete), "company string, run string")
    want, want_acts = _stepped(spark, rows, plan, incomplete)
    got = {r["url"]: (r["company"], r["title"], r["location"], r["scrape_count"], r["is_active"])
           for r in L.upsert(L.empty_state(spark), obs(spark, rows), table).collect()}
    assert got == want
    acts = [(r["seq"], r["action"]) for r in L.classify_changes(L.empty_state(spark), obs(spark, rows), table).orderBy("seq").collect()]
    assert acts == sorted(want_acts)
    # in two batches, the second one against the stored state
    first, second = [r for r in rows if r[7] < "r3"], [r for r in rows if r[7] >= "r3"]
    half = L.upsert(L.empty_state(spark), obs(spark, first), table).checkpoint()
    both = {r["url"]: r["is_active"] for r in L.upsert(half, obs(spark, second), table).collect()}
    assert both == {u: s[4] for u, s in want.items()}
    gone = L.deactivations(half, obs(spark, second), table).collect()
    assert not {(g["company"], g["run"]) for g in gone} & incomplete


def test_outcomes_count_failed_and_empty_sites(spark):
    rows = [A(url="1", seq=1, company="a"), A(url="2", seq=2, company="b"), A(url="1", seq=3, run="r2", company="a")]
    out = spark.createDataFrame([("r1", "a", True, None, False), ("r1", "c", True, None, False), ("r2", "a", False, "boom", False),
                                 ("r3", "d", False, "down", False)],
                                "run string, company string, success boolean, error string, stopped_early boolean")
    state, _, gone, stats, ledger = L.ingest(L.empty_state(spark), obs(spark, rows), out)
    got = {(r["run"], r["company"]): (r["jobs_found"], r["success"], r["error"]) for r in stats.collect()}
    assert got == {("r1", "a"): (1, True, None), ("r1", "b"): (1, True, None), ("r1", "c"): (0, True, None),
                   ("r2", "a"): (1, False, "boom"), ("r3", "d"): (0, False, "down")}
    totals = {r["run"]: (r["sites_scraped"], r["sites_failed"], r["jobs_found"]) for r in L.run_totals(stats).collect()}
    assert totals == {"r1": (3, 0, 2), "r2": (1, 1, 0), "r3": (1, 1, 0)}
    assert gone.count() == 0 and ledger.count() == 3


def test_metadata_of_the_last_sighting(spark):
    rows = [(*A(url="1", seq=1), {"d": "x", "e": "y"}), (*A(url="1", seq=2), {"d": "z"}), (*A(url="2", seq=3), None)]
    df = spark.createDataFrame(rows, OBS + ", metadata map<string,string>")
    state = L.upsert(L.empty_state(spark), df).checkpoint()
    assert {r["url"]: r["metadata"] for r in state.collect()} == {"1": {"d": "z"}, "2": None}
    again = L.upsert(state, obs(spark, [A(url="2", seq=9, run="r2", company="other")]))
    assert {r["url"]: r["metadata"] for r in again.collect()} == {"1": {"d": "z"}, "2": None}


def test_a_small_batch_writes_a_small_part(spark, tmpdir_fresh):
    """1 % of the URLs, of a site of their own: the buckets of these URLs are written, all others are taken over."""
    import os
    base = tmpdir_fresh + "/state"
    site = F.when(F.col("id") < 200, "small").otherwise("large")
    big = spark.range(20_000).select(
        F.concat(F.lit("u"), "id").alias("url"), site.alias("company"), F.sha2(F.col("id").cast("string"), 256).alias("title"),
        F.lit("x").alias("location"), F.col("id").cast("string").alias("job_id"), F.lit(t(1)).alias("ts"),
        F.col("id").alias("seq"), F.lit("r1").alias("run"))
    assert apply_batch(spark, big, 0, base, buckets=1024)
    written = lambda: {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(base + "/data") for f in fs}
    before = written()
    few = big.where("id < 200" if "id" in big.columns else "company = 'small'").withColumn("run", F.lit("r2"))
    assert apply_batch(spark, few, 1, base)
    new = sum(v for k, v in written().items() if k not in before and ("/state/" in k or "/open/" in k))
    whole = sum(v for k, v in before.items() if "/state/" in k)
    assert 0 < new < 0.25 * whole, (new, whole)
    want = L.upsert(L.empty_state(spark), big.unionByName(few))
    rows = lambda df: sorted((r["url"], r["company"], r["title"], r["scrape_count"], r["is_active"]) for r in df.collect())
    assert rows(read_state(spark, base)) == rows(want)
