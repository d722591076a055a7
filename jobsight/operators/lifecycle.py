"""Lifecycle maintenance (L1-L9): classify, upsert, deactivate, run ledger.

The state table ``jobs`` has one row per URL::

    url, company, title, location, job_id, first_seen, last_seen,
    scrape_count, metadata, is_active

A batch is a DataFrame of observations::

    url, company, title, location, job_id, ts, seq, run [, metadata]

``seq`` orders observations of one URL inside a run (ties are impossible when
it is unique), ``run`` orders runs (a crawl cycle: day, run id...). A batch may
hold several runs; the closed forms below give the same result as applying
the runs one after another, each run doing: upsert every observation in seq
order, then deactivate the active URLs of the run's sites that were not seen.
A site is a company: a company with no observation in a run is not scraped
in that run and deactivates nothing. A run of a company that is named as
incomplete (it failed, or stopped before its last page) adds and refreshes
URLs but deactivates none: what it did not see waits for the next complete run.

Skew: per-company run ranks are computed on the distinct (company, run)
table, never with a window over all rows of a company; the fold is a hash
aggregate with map-side combine; the previous-observation lookup is a window
per (url, run) plus a window over one row per run of a URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsight.session import stored

STATE_COLS = ["url", "company", "title", "location", "job_id", "first_seen",
              "last_seen", "scrape_count", "metadata", "is_active"]
ACTION_COLS = ["url", "company", "title", "location", "job_id", "ts", "seq", "run", "action", "changed"]


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame(
        [], "url string, company string, title string, location string, job_id string, "
            "first_seen timestamp, last_seen timestamp, scrape_count bigint, metadata map<string,string>, "
            "is_active boolean")


def company_runs(batch: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """(company, run, complete, done_before, done_upto): the company's complete runs before and up to each run.

    Built on the distinct (company, run) pairs, a table of #sites x #runs
    rows, so a company holding most of the observations costs nothing extra.
    ``incomplete`` names (company, run) pairs.
    """
    pairs = batch.select("company", "run").distinct()
    if incomplete is None:
        pairs = pairs.withColumn("complete", F.lit(True))
    else:
        named = incomplete.select("company", "run").distinct().withColumn("_open", F.lit(True))
        pairs = pairs.join(named, ["company", "run"], "left").select("company", "run", F.col("_open").isNull().alias("complete"))
    w = Window.partitionBy("company").orderBy("run")
    done = F.col("complete").cast("int")
    return pairs.withColumn("done_upto", F.sum(done).over(w)).withColumn("done_before", F.col("done_upto") - done)


def _ranked(batch: DataFrame, incomplete: DataFrame | None) -> DataFrame:
    return batch.join(company_runs(batch, incomplete), ["company", "run"])


def classify_changes(jobs: DataFrame, batch: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """L1 + L4: one action per observation: new / updated / unchanged.

    updated = title or location differ (null-safe) from the row as stored just
    before this observation, or the row was inactive then (reactivation).

    The previous observation is found in two levels so that a URL seen very
    often is spread over tasks: a window per (url, run) for observations
    inside one run, and for the first one of a run the last values of the
    URL's previous run (a max_by aggregate per (url, run), then a window over
    one row per run of the URL) or else the stored state row.
    """
    return _classified(jobs, batch, incomplete).select(*ACTION_COLS)


def _classified(jobs: DataFrame, batch: DataFrame, incomplete: DataFrame | None) -> DataFrame:
    """The rows of ``batch`` with action and changed; url, run, seq, company, title and location are looked at."""
    b = _ranked(batch, incomplete)
    w_in = Window.partitionBy("url", "run").orderBy("seq")
    b = (b.withColumn("p_title", F.lag("title").over(w_in))
         .withColumn("p_location", F.lag("location").over(w_in))
         .withColumn("first_in_run", F.lag("seq").over(w_in).isNull()))
    last = b.groupBy("url", "run").agg(F.max_by("title", "seq").alias("l_title"),
                                       F.max_by("location", "seq").alias("l_location"),
                                       F.max("done_upto").alias("l_upto"))
    w_runs = Window.partitionBy("url").orderBy("run")
    prev_run = last.select(
        "url", "run", F.lag("l_title").over(w_runs).alias("r_title"),
        F.lag("l_location").over(w_runs).alias("r_location"),
        F.lag("l_upto").over(w_runs).alias("r_upto"),
        F.lag("run").over(w_runs).isNotNull().alias("has_prev_run"))
    known = (jobs.join(batch.select("url").distinct(), "url", "left_semi")
             .select("url", F.col("title").alias("s_title"), F.col("location").alias("s_location"),
                     F.col("is_active").alias("s_active"), F.lit(True).alias("s_exists")))
    x = b.join(prev_run, ["url", "run"]).join(known, "url", "left")
    inside = ~F.col("first_in_run")
    from_run = F.col("has_prev_run")
    prev_title = (F.when(inside, F.col("p_title")).when(from_run, F.col("r_title"))
                  .otherwise(F.col("s_title")))
    prev_location = (F.when(inside, F.col("p_location")).when(from_run, F.col("r_location"))
                     .otherwise(F.col("s_location")))
    seen_before = inside | from_run | F.coalesce(F.col("s_exists"), F.lit(False))
    active_before = (F.when(inside, F.lit(True))
                     .when(from_run, F.col("done_before") == F.col("r_upto"))
                     .otherwise(F.coalesce(F.col("s_active"), F.lit(False)) & (F.col("done_before") == 0)))
    changed = (~F.col("title").eqNullSafe(prev_title) | ~F.col("location").eqNullSafe(prev_location)
               | ~active_before)
    action = (F.when(~seen_before, F.lit("new")).when(changed, F.lit("updated"))
              .otherwise(F.lit("unchanged")))
    out = x.withColumn("action", action)
    return out.select(*batch.columns, "action", (F.col("action") != "unchanged").alias("changed"))


def upsert(jobs: DataFrame, batch: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """L2 + L3 folded: the state after applying every run of the batch.

    Observations of one URL are folded with a hash aggregate (count, min/max
    ts, last value by (run, seq)); the state is merged by a full outer join
    on url. ``now`` of the source is the observation's ts. Title, location,
    job id and metadata are those of the last sighting.
    """
    okey = F.struct("run", "seq")
    if "metadata" not in batch.columns:
        batch = batch.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    folded = batch.groupBy("url").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min("ts").alias("b_first"),
        F.max("ts").alias("b_last"),
        # a map cannot be compared, so it travels as a value, never in a key
        *[F.max_by(c, okey).alias("b_" + c) for c in ("title", "location", "job_id", "metadata")],
        F.min_by("company", okey).alias("b_company"),
        F.max("run").alias("b_run"))
    # the last complete run of every scraped company; a URL belongs to the company it is stored under
    scraped = batch.select("company", "run").distinct()
    if incomplete is not None:
        scraped = scraped.join(incomplete.select("company", "run"), ["company", "run"], "left_anti")
    last_run = scraped.groupBy("company").agg(F.max("run").alias("c_run"))
    s = jobs.alias("s")
    f = folded.alias("f")
    merged = s.join(f, F.col("s.url") == F.col("f.url"), "full_outer")
    inb = F.col("f.url").isNotNull()
    merged = merged.select(
        F.coalesce(F.col("s.url"), F.col("f.url")).alias("url"),
        F.coalesce(F.col("s.company"), F.col("f.b_company")).alias("company"),
        *[F.when(inb, F.col("f.b_" + c)).otherwise(F.col("s." + c)).alias(c)
          for c in ("title", "location", "job_id", "metadata")],
        F.coalesce(F.col("s.first_seen"), F.col("f.b_first")).alias("first_seen"),
        F.when(inb, F.col("f.b_last")).otherwise(F.col("s.last_seen")).alias("last_seen"),
        (F.coalesce(F.col("s.scrape_count"), F.lit(0))
         + F.coalesce(F.col("f.n_obs"), F.lit(0))).cast("bigint").alias("scrape_count"),
        F.col("s.is_active").alias("s_active"), F.col("f.b_run").alias("b_run"))
    merged = merged.join(last_run, "company", "left")
    # seen: active unless the stored company was scraped again later; not seen: inactive once it was scraped
    is_active = (F.when(F.col("b_run").isNotNull(), F.coalesce(F.col("b_run") >= F.col("c_run"), F.lit(True)))
                 .otherwise(F.coalesce(F.col("s_active"), F.lit(False)) & F.col("c_run").isNull()))
    return merged.select(*STATE_COLS[:-1], is_active.alias("is_active"))


def deactivations(jobs: DataFrame, batch: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """L3: (run, company, url) for every URL a run switched to inactive.

    Active when a company's complete run begins = seen since its last complete
    run began (or, for the first one in the batch, active in the stored
    state); those not seen in the run itself are deactivated: a left-anti join.
    """
    ranks = company_runs(batch, incomplete)
    # the complete run that decides on a sighting: the run itself does not, the next complete one does
    seen = _ranked(batch, incomplete).select("company", "done_upto", "complete", "url").distinct()
    carried = seen.select("company", (F.col("done_upto") + 1).alias("nth"), "url").distinct()
    firsts = ranks.filter(F.col("complete") & (F.col("done_upto") == 1)).select("company", F.lit(1).cast("long").alias("nth"))
    from_state = jobs.filter(F.col("is_active")).select("company", "url").join(firsts, "company")
    before = carried.unionByName(from_state.select("company", "nth", "url")).distinct()
    now = seen.filter("complete").select("company", F.col("done_upto").alias("nth"), "url")
    deciding = ranks.filter("complete").select("company", "run", F.col("done_upto").alias("nth"))
    gone = before.join(now, ["company", "nth", "url"], "left_anti")
    return gone.join(deciding, ["company", "nth"]).select("run", "company", "url")


def mark_inactive(jobs: DataFrame, seen: DataFrame, company: str | None = None,
                  incomplete: DataFrame | None = None) -> DataFrame:
    """L3 for one run: active rows of the company (or all) not in ``seen``.

    ``seen`` holds a ``url`` column; when it is empty every active row in
    scope is deactivated. Companies in ``incomplete`` (company) keep theirs.
    Returns the new state.
    """
    scope = F.col("is_active") & (F.col("company") == F.lit(company) if company else F.lit(True))
    hit = jobs.join(seen.select("url").distinct().withColumn("_seen", F.lit(True)), "url", "left")
    if incomplete is not None:
        hit = hit.join(incomplete.select("company").distinct().withColumn("_open", F.lit(True)), "company", "left")
        scope = scope & F.col("_open").isNull()
    new_active = F.when(scope & F.col("_seen").isNull(), F.lit(False)).otherwise(F.col("is_active"))
    return hit.select(*[new_active.alias(c) if c == "is_active" else F.col(c) for c in STATE_COLS])


COUNTERS = ["jobs_found", "jobs_new", "jobs_updated", "jobs_unchanged", "jobs_deactivated"]


def site_stats(actions: DataFrame, deactivated: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Per (run, site) counters, with the outcome of the crawl.

    ``outcomes`` (run, company, success, error, stopped_early) has a row for
    each attempted site, those without postings included; they are joined
    from both sides, so a failed or empty site counts with zeros and a site
    without an outcome row counts as a success.
    """
    acts = actions.groupBy("run", "company").agg(
        F.count(F.lit(1)).alias("jobs_found"),
        F.count_if(F.col("action") == "new").alias("jobs_new"),
        F.count_if(F.col("action") == "updated").alias("jobs_updated"),
        F.count_if(F.col("action") == "unchanged").alias("jobs_unchanged"))
    deac = deactivated.groupBy("run", "company").agg(F.count(F.lit(1)).alias("jobs_deactivated"))
    stats = acts.join(deac, ["run", "company"], "left")
    if outcomes is None:
        how = {"success": F.lit(True), "error": F.lit(None).cast("string"), "stopped_early": F.lit(False)}
    else:
        stats = stats.join(outcomes.select("run", "company", "success", "error", "stopped_early"),
                           ["run", "company"], "full_outer")
        how = {"success": F.coalesce("success", F.lit(True)), "error": F.col("error"),
               "stopped_early": F.coalesce("stopped_early", F.lit(False))}
    return stats.select("run", "company", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTERS],
                        *[v.alias(k) for k, v in how.items()])


def run_totals(stats: DataFrame) -> DataFrame:
    """Counters over the successful sites of each run."""
    ok = F.col("success")
    return stats.groupBy("run").agg(
        F.count(F.lit(1)).alias("sites_scraped"),
        F.count_if(ok).alias("sites_succeeded"),
        F.count_if(~ok).alias("sites_failed"),
        *[F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("bigint").alias(c) for c in COUNTERS])


def run_ledger(totals: DataFrame, batch: DataFrame) -> DataFrame:
    """One completed ledger row per run (start/finish = first/last observation)."""
    times = batch.groupBy("run").agg(F.min("ts").alias("started_at"),
                                     F.max("ts").alias("completed_at"))
    # a run whose sites all failed has no observations and no times
    return times.join(totals, "run", "right").select(
        F.col("run").cast("string").alias("run_id"), "started_at", "completed_at",
        "sites_scraped", "jobs_found", "jobs_new", "jobs_updated", "jobs_unchanged",
        "jobs_deactivated", F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("error_message"))


def start_run(ledger: DataFrame, run_id: str, started_at) -> DataFrame:
    """Append a 'running' row; the latest row per run_id wins on read."""
    spark = ledger.sparkSession
    row = spark.createDataFrame(
        [(run_id, started_at, None, 0, 0, 0, 0, 0, 0, "running", None)], ledger.schema)
    return ledger.unionByName(row)


def complete_run(ledger: DataFrame, run_id: str, totals: DataFrame, completed_at,
                 status: str = "completed", error_message: str | None = None) -> DataFrame:
    """Append the finished row of ``run_id`` from one ``run_totals`` row (missing counters are 0).

    Rows are only appended; ``fold_ledger`` gives the latest row per run, so a
    crashed run simply keeps its 'running' row.
    """
    started = ledger.filter((F.col("run_id") == run_id) & (F.col("status") == "running")) \
        .groupBy().agg(F.min("started_at").alias("started_at"))
    counters = ["sites_scraped", "jobs_found", "jobs_new", "jobs_updated", "jobs_unchanged", "jobs_deactivated"]
    t = totals.groupBy().agg(*[F.sum(c).alias(c) for c in counters])
    # two one-row aggregates, combined by a union + max (no cross join)
    s_row = started.select(F.col("started_at"), *[F.lit(None).cast("long").alias(c) for c in counters])
    t_row = t.select(F.lit(None).cast("timestamp").alias("started_at"), *counters)
    both = s_row.unionByName(t_row).agg(F.max("started_at").alias("started_at"),
                                        *[F.max(c).alias(c) for c in counters])
    row = both.select(
        F.lit(run_id).alias("run_id"), "started_at", F.lit(completed_at).cast("timestamp").alias("completed_at"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counters],
        F.lit(status).alias("status"), F.lit(error_message).cast("string").alias("error_message"))
    return ledger.unionByName(row.select(*ledger.columns))


def fold_ledger(ledger_log: DataFrame) -> DataFrame:
    """Latest row per run_id of an append-only ledger log (completed beats running)."""
    prio = F.when(F.col("status") == "running", 0).otherwise(1)
    key = F.struct(prio.alias("p"), F.coalesce("completed_at", "started_at").alias("t"))
    cols = [c for c in ledger_log.columns if c != "run_id"]
    agg = ledger_log.groupBy("run_id").agg(
        *[F.max_by(c, key).alias(c) for c in cols])
    return agg.select(*ledger_log.columns)


def smart_stop(listing: DataFrame, active: DataFrame, n: int = 5, max_pages: int | None = 100) -> DataFrame:
    """Where a site scan stops with smart stopping, in closed form.

    ``listing`` is (site, page, url) as the pages would be read; ``active``
    is the (site, url) snapshot of active postings. A page is new when one
    of its URLs is neither active nor on an earlier page. The scan ends at
    the first empty page, after ``n`` consecutive pages without new
    postings (stopped early), or at ``max_pages`` (None: no limit).

    Output: site, pages_scanned (the last page read), stopped_early.
    """
    pages = listing if max_pages is None else listing.filter(F.col("page") <= max_pages)
    fresh = pages.join(active.select("site", "url"), ["site", "url"], "left_anti")
    first_page = fresh.groupBy("site", "url").agg(F.min("page").alias("page"))
    new_pages = first_page.groupBy("site", "page").agg(F.count(F.lit(1)).alias("n_new"))
    page_list = pages.select("site", "page").distinct()
    # pages present before the first gap: consecutive from 1
    w_site = Window.partitionBy("site").orderBy("page")
    present = (page_list.withColumn("rn", F.row_number().over(w_site))
               .filter(F.col("rn") == F.col("page")))
    p = present.join(new_pages, ["site", "page"], "left").withColumn(
        "has_new", F.coalesce(F.col("n_new"), F.lit(0)) > 0)
    # run length of pages without new postings, counted by the last page with one
    last_new = F.max(F.when(F.col("has_new"), F.col("page"))).over(
        w_site.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = p.withColumn("run_len", F.col("page") - F.coalesce(last_new, F.lit(0)))
    stops = p.filter(F.col("run_len") >= n).groupBy("site").agg(F.min("page").alias("stop_page"))
    ends = p.groupBy("site").agg(F.max("page").alias("end_page"))
    out = ends.join(stops, "site", "left")
    return out.select(
        "site",
        F.coalesce("stop_page", "end_page").cast("int").alias("pages_scanned"),
        F.col("stop_page").isNotNull().alias("stopped_early"))


def ingest(jobs: DataFrame, batch: DataFrame, outcomes: DataFrame | None = None, complete_only: bool = False):
    """One batch (one or more runs) -> (new_state, actions, deactivated, site_stats, ledger).

    The batch is read once and written, with a number for each row; actions and deactivations are written, too, as the
    counters, the ledger and the report all read them. Titles and locations are compared by a digest, so texts are not
    shuffled, and the actions are kept by number and meet their rows again where the rows are wanted. A site that
    failed in a run (``outcomes``, see ``site_stats``) deactivates nothing there; with ``complete_only`` neither does one
    that stopped early.
    """
    batch = stored(batch.withColumn("_at", F.monotonically_increasing_id()))
    incomplete = None
    if outcomes is not None:
        unfinished = ~F.col("success") | (F.col("stopped_early") if complete_only else F.lit(False))
        incomplete = outcomes.filter(unfinished).select("company", "run")
    slim = batch.select("_at", "url", "company", "run", "seq", *_content())
    known = jobs.select("url", "is_active", *_content())
    found = stored(_classified(known, slim, incomplete).select("_at", "company", "run", "action", "changed"))
    batch_rows = batch.select("_at", *[c for c in ACTION_COLS if c in batch.columns])
    actions = found.select("_at", "action", "changed").join(batch_rows, "_at").select(*ACTION_COLS)
    gone = stored(deactivations(jobs, batch, incomplete))
    state = upsert(jobs, batch.drop("_at"), incomplete)
    stats = site_stats(found, gone, outcomes)
    ledger = run_ledger(run_totals(stats), batch)
    return state, actions, gone, stats, ledger


def _content():
    """For title and location, 16 bytes that tell pairs of them apart, nulls too, and an empty column."""
    both = F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in ("title", "location")])
    return [F.substring(F.unhex(F.sha2(both, 256)), 1, 16).alias("title"), F.lit(None).cast("binary").alias("location")]
