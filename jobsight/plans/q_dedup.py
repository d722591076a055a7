"""Registered duplicate-detection queries (N6, D2, D4-D9, D11) over doc_postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight import rules
from jobsight.functions import sql_text as S
from jobsight.functions import text as T
from jobsight.operators import dedup as D
from jobsight.operators.joins import dealt_self_join, rows_of
from jobsight.plans.catalog import register
from jobsight.session import checkpoint_dir, stored
from jobsight.sources.tables import spread
from jobsight.sources.views import doc_postings, observations, with_views


@register("exact_url_dedup", with_views("""
    SELECT url, company, title, location, job_id, epoch_us(ts) AS ts_us, seq, run
    FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rn FROM observations)
    WHERE rn = 1""", "observations"))
def exact_url_dedup(spark, sf_dir):
    d = D.drop_exact_url_duplicates(observations(spark, sf_dir), "seq")
    return d.select("url", "company", "title", "location", "job_id",
                    F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "seq", "run")


@register("normalized_postings", with_views(f"""
    SELECT url, {S.normalize_company('company')} AS company_key,
           {S.normalize_title('title')} AS normalized_title,
           {S.normalize_location('location')} AS normalized_location,
           {S.seniority_level('title')} AS seniority_level,
           {S.key_terms(S.normalize_title('title'))} AS key_terms
    FROM doc_postings""", "doc_postings"))
def normalized_postings(spark, sf_dir):
    n = D.normalize_postings(spread(doc_postings(spark, sf_dir)))
    return n.select("url", "company_key", "normalized_title", "normalized_location",
                    "seniority_level", "key_terms")


@register("candidate_pairs", with_views(f"""
    SELECT company_key, CAST(count(*) AS BIGINT) AS postings,
           CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS block_pairs
    FROM (SELECT {S.normalize_company('company')} AS company_key FROM doc_postings)
    GROUP BY company_key HAVING count(*) > 1""", "doc_postings"))
def candidate_pairs(spark, sf_dir):
    """D4 block sizes: the pairs a plain company blocking would compare."""
    k = doc_postings(spark, sf_dir).select(T.normalize_company("company").alias("company_key"))
    g = k.groupBy("company_key").agg(F.count(F.lit(1)).alias("postings")).filter(F.col("postings") > 1)
    return g.select("company_key", F.col("postings").cast("bigint").alias("postings"),
                    (F.col("postings") * (F.col("postings") - 1) / 2).cast("bigint").alias("block_pairs"))


def _reps(spark, sf_dir):
    """Normalized postings with key terms, numbered in order (spread, then one range sort)."""
    checkpoint_dir(spark)
    p = spread(doc_postings(spark, sf_dir))
    b = p.select("url", T.normalize_company("company").alias("company_key"),
                 T.normalize_title("title").alias("nt"), T.normalize_location("location").alias("nl"),
                 D.order_key(p).alias("ord"))
    return D.numbered(b.withColumn("terms", T.key_terms("nt")))


def _jaccard_links(sets, keys, theta):
    """(i, j, ``keys``, jaccard), i < j: the ``sets`` (k, ``keys``, terms) with equal keys whose Jaccard reaches ``theta``.

    Hashes of keys and rarest terms only propose pairs; the keys and the terms themselves decide, and only those of
    proposed sets are shuffled.
    """
    rarest = D.rarest_terms(sets, theta)
    sets = sets.select("k", *keys, "terms")
    rare = stored(sets.withColumn("r", rarest("terms")).select(
        "k", F.size("terms").alias("tsize"), F.expr(D.PARITY).alias("parity"),
        F.transform("r", lambda t: F.xxhash64(*keys, t)).alias("hashes")))
    x = rare.select("k", "tsize", "parity", F.posexplode("hashes").alias("pos", "h"))
    s1, s2 = F.col("tsize1"), F.col("tsize2")
    fits = ((F.col("k1") < F.col("k2")) & D.prefix_fits(s1, s2, F.col("pos1") + 1, F.col("pos2") + 1, theta)
            & D.parity_fits(s1, s2, F.col("parity1"), F.col("parity2"), theta))
    ids = stored(dealt_self_join(x, "h", D.HEAVY, fits).select(F.col("k1").alias("i"), F.col("k2").alias("j")).distinct())
    own = rows_of(sets, "k", ids.select(F.col("i").alias("k")).union(ids.select("j")))
    pairs = ids.join(own.withColumnsRenamed({"k": "i", "terms": "t1"}), "i").join(
        own.withColumnsRenamed({"k": "j", "terms": "t2"}), ["j", *keys])
    inter, union = F.size(F.array_intersect("t1", "t2")), F.size(F.array_union("t1", "t2"))
    return pairs.filter(inter >= F.lit(theta) * union).select("i", "j", *keys, T.jaccard("t1", "t2").alias("jaccard"))


@register("jaccard_pairs", with_views(f"""
    , t AS (SELECT url, company, title, {S.normalize_company('company')} AS company_key,
                   {S.key_terms(S.normalize_title('title'))} AS terms
            FROM doc_postings)
    SELECT a.url AS url1, b.url AS url2, a.company_key,
           round(len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))), 6)
               AS jaccard
    FROM t a JOIN t b ON a.company_key = b.company_key
         AND (a.company, a.title, a.url) < (b.company, b.title, b.url)
    WHERE len(a.terms) > 0 AND len(b.terms) > 0
      AND len(list_intersect(a.terms, b.terms)) >= {rules.TITLE_THRESHOLD}
          * len(list_distinct(list_concat(a.terms, b.terms)))""", "doc_postings"))
def jaccard_pairs(spark, sf_dir):
    """Pairs inside a company whose key-term Jaccard reaches the title threshold.

    Found with the exact term prefix filter, not by comparing all pairs. Postings of one company and set of key terms are a
    class: classes are linked, and their postings paired by number alone. Only postings in pairs are put in order.
    """
    checkpoint_dir(spark)
    keys, theta = ["company_key"], rules.TITLE_THRESHOLD
    p = spread(doc_postings(spark, sf_dir))
    b = p.select("url", "company", "title", T.normalize_company("company").alias("company_key"),
                 T.key_terms(T.normalize_title("title")).alias("terms"))
    # no part holds a line break, no term a blank
    name = F.concat("company_key", F.lit("\n"), F.array_join("terms", " "))
    b = stored(b.withColumns({"class": F.substring(F.unhex(F.sha2(name, 256)), 1, 16), "k": F.monotonically_increasing_id()}))
    b = b.filter((F.size("terms") > 0) & F.col("class").isNotNull())
    classes = stored(b.groupBy("class").agg(F.min("k").alias("c"), F.count(F.lit(1)).alias("n")))
    links = stored(_jaccard_links(rows_of(b.select("k", *keys, "terms"), "k", classes.select(F.col("c").alias("k"))), keys, theta))
    # the postings of classes that have several, or a link
    linked = links.select(F.col("i").alias("c")).union(links.select("j")).distinct()
    wanted = classes.filter(F.col("n") > 1).select("c").union(linked).distinct()
    members = stored(b.select("class", "k").join(classes.join(wanted, "c").select("class", "c"), "class").select("c", "k"))
    asked = rows_of(b.select("k", *keys, "url", "company", "title"), "k", members.select("k"))
    asked = asked.withColumn("ord", D.order_key(asked)).drop("company", "title")
    places = D.numbered(asked, "k", "url", *keys, place="at")
    members = stored(members.join(places.select("k", "at"), "k").select("c", F.col("at").alias("k")))
    inside = dealt_self_join(members, "c", D.HEAVY, F.col("k1") < F.col("k2")).select("k1", "k2", F.lit(1.0).alias("jaccard"))
    across = (links.join(members.withColumnsRenamed({"c": "i", "k": "x"}), "i")
              .join(members.withColumnsRenamed({"c": "j", "k": "y"}), "j")
              .select(F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2"), "jaccard"))
    urls = places.select("at", "url")
    return (inside.union(across)
            .join(places.select(F.col("at").alias("k1"), F.col("url").alias("url1"), *keys), "k1")
            .join(urls.select(F.col("at").alias("k2"), F.col("url").alias("url2")), "k2")
            .select("url1", "url2", "company_key", F.round("jaccard", 6).alias("jaccard")))


def _dups(spark, sf_dir):
    return D.find_duplicates(doc_postings(spark, sf_dir))


@register("fuzzy_duplicates")
def fuzzy_duplicates(spark, sf_dir):
    """D1+D3+D5: every duplicate with its canonical and score details (rows-only check)."""
    return _dups(spark, sf_dir)


@register("deduplicated")
def deduplicated(spark, sf_dir):
    """The postings that remain after removing duplicates (keep='first')."""
    p = doc_postings(spark, sf_dir)
    unique, _ = D.deduplicate(p, D.find_duplicates(p))
    return unique


@register("dedup_stats")
def dedup_stats(spark, sf_dir):
    p = doc_postings(spark, sf_dir)
    return D.dedup_stats(p, D.find_duplicates(p))


@register("company_dup_stats")
def company_dup_stats(spark, sf_dir):
    p = doc_postings(spark, sf_dir)
    return D.company_dup_stats(p, D.find_duplicates(p))


@register("duplicate_report")
def duplicate_report(spark, sf_dir):
    p = doc_postings(spark, sf_dir)
    return D.duplicate_report(p, D.find_duplicates(p))


def _jaccard_graph_sql():
    theta = rules.TITLE_THRESHOLD
    nt = S.normalize_title("title")
    return ("WITH RECURSIVE doc_postings AS (" + with_views("SELECT 1", "doc_postings")
            .split("doc_postings AS (", 1)[1].rsplit(")\nSELECT 1", 1)[0] + f""")
, n0 AS (SELECT url, company, title, {S.normalize_company('company')} AS company_key, {nt} AS nt,
                {S.normalize_location('location')} AS nl FROM doc_postings)
, t AS (SELECT *, {S.key_terms('nt')} AS terms FROM n0 WHERE nt <> '' AND nl <> '')
, o AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY company, title, url) AS k FROM t)
, e AS (SELECT a.company_key, a.k AS ka, b.k AS kb FROM o a JOIN o b
          ON a.company_key = b.company_key AND a.nl = b.nl AND a.k < b.k
        WHERE len(a.terms) > 0 AND len(b.terms) > 0
          AND len(list_intersect(a.terms, b.terms)) >= {theta} * len(list_distinct(list_concat(a.terms, b.terms))))
, nb AS (SELECT company_key, kb AS k, list(ka) AS lower FROM e GROUP BY company_key, kb)
, seq AS (SELECT o.company_key, o.k, coalesce(nb.lower, []) AS lower FROM o LEFT JOIN nb USING (company_key, k))
, r AS (SELECT company_key, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS canon FROM (SELECT DISTINCT company_key FROM o)
        UNION ALL
        SELECT r.company_key, r.k + 1,
               CASE WHEN list_has_any(s.lower, r.canon) THEN r.canon ELSE list_append(r.canon, r.k + 1) END
        FROM r JOIN seq s ON s.company_key = r.company_key AND s.k = r.k + 1)
, fin AS (SELECT company_key, arg_max(canon, k) AS canon FROM r GROUP BY company_key)
, d AS (SELECT e.company_key, e.kb, min(e.ka) AS ka FROM e JOIN fin USING (company_key)
        WHERE list_contains(fin.canon, e.ka) AND NOT list_contains(fin.canon, e.kb)
        GROUP BY e.company_key, e.kb)
SELECT od.url AS duplicate_url, oc.url AS canonical_url, d.company_key
FROM d JOIN o od ON od.company_key = d.company_key AND od.k = d.kb
       JOIN o oc ON oc.company_key = d.company_key AND oc.k = d.ka""")


def _exact_terms(spark, sf_dir):
    """D5 on a Jaccard-only graph: similar = same company and location, key-term Jaccard >= threshold.

    Postings of one company, location and set of key terms have the same neighbours and each other: a class. Any of its
    postings stands for it in the links, so copies make none. The first posting of a class that is canonical claims the
    others (Jaccard 1); those of a duplicate class are all duplicates of one posting. Edges come from the exact term prefix
    join keyed by (company, location, term); canonicals from the same greedy rounds as fuzzy_duplicates. Only postings of
    linked classes or with copies are put in order. The oracle is the literal sequential greedy scan as a recursive CTE.
    """
    checkpoint_dir(spark)
    keys, theta = ["company_key", "nl"], rules.TITLE_THRESHOLD
    p = spread(doc_postings(spark, sf_dir))
    b = p.select("url", "company", "title", T.normalize_company("company").alias("company_key"),
                 T.normalize_title("title").alias("nt"), T.normalize_location("location").alias("nl"))
    b = b.withColumn("terms", T.key_terms("nt")).withColumn("k", F.monotonically_increasing_id())
    # no part holds a line break, no term a blank
    name = F.concat_ws("\n", "company_key", "nl", F.array_join("terms", " "))
    usable = (F.col("nt") != "") & (F.col("nl") != "") & (F.size("terms") > 0)
    b = b.withColumn("class", F.when(usable, F.substring(F.unhex(F.sha2(name, 256)), 1, 16))).drop("nt")
    b = stored(b).filter(F.col("class").isNotNull())
    classes = stored(b.groupBy("class").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n")))
    links = stored(_jaccard_links(rows_of(b.select("k", *keys, "terms"), "k", classes.select("k")), keys, theta))
    linked = stored(rows_of(classes.select("class", "k"), "k", links.select(F.col("i").alias("k")).union(links.select("j"))))
    # the postings in question, and of each class the first one
    asked = classes.filter(F.col("n") > 1).select("class").union(linked.select("class")).distinct()
    b = stored(rows_of(b.select("class", "k", "company_key", "url", "company", "title"), "k",
                       b.select("class", "k").join(asked, "class").select("k")))
    b = b.withColumn("ord", D.order_key(b)).drop("company", "title")
    firsts = stored(b.groupBy("class").agg(F.min(F.struct("ord", "k")).alias("m"), F.first("company_key").alias("company_key"))
                    .select("class", "company_key", "m.ord", F.col("m.k").alias("first"), F.col("m.ord.u").alias("own")))
    r = D.numbered(firsts.join(linked, "class"), "class", "k", "own", place="at")
    places = r.select("k", "at")
    ends = (links.join(places.withColumnsRenamed({"k": "i", "at": "a"}), "i")
            .join(places.withColumnsRenamed({"k": "j", "at": "b"}), "j"))
    best = D.smallest_canonicals(ends.select("company_key", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"),
                                             "jaccard"))
    best = (best.join(r.select(F.col("at").alias("lo"), F.col("own").alias("claimed_by")), "lo")
            .join(r.select(F.col("at").alias("hi"), "class"), "hi")
            .select("class", "claimed_by", F.col("jaccard").alias("score"), F.lit(True).alias("claimed")))
    whole = firsts.select("class", "company_key", "first", "own").join(best, "class", "left")
    own = F.col("claimed").isNull()
    return (b.select("class", "k", F.col("url").alias("duplicate_url")).join(whole, "class")
            .filter(~own | (F.col("k") != F.col("first")))
            .select("duplicate_url", F.when(own, F.col("own")).otherwise(F.col("claimed_by")).alias("canonical_url"),
                    "company_key", F.when(own, F.lit(1.0)).otherwise(F.col("score")).alias("score")))


@register("deduplicated_exact_terms", _jaccard_graph_sql())
def deduplicated_exact_terms(spark, sf_dir):
    return _exact_terms(spark, sf_dir).drop("score")


def _on_exact_terms(sql):
    """SQL over ``dup`` (the rows of deduplicated_exact_terms) and doc_postings."""
    head, _, last = _jaccard_graph_sql().rpartition("\nSELECT od.url")
    return f"{head}\n, dup AS (SELECT od.url{last})\n{sql}"


@register("deduplicated_terms_first", _on_exact_terms(
    "SELECT url, company, title FROM doc_postings WHERE url NOT IN (SELECT duplicate_url FROM dup)"))
def deduplicated_terms_first(spark, sf_dir):
    """D6, keep='first', on the key-term graph."""
    p = doc_postings(spark, sf_dir)
    return D.deduplicate(p, _exact_terms(spark, sf_dir))[0].select("url", "company", "title")


@register("deduplicated_terms_last", _on_exact_terms("""
, grp AS (SELECT canonical_url, duplicate_url AS url FROM dup UNION SELECT canonical_url, canonical_url FROM dup)
, ranked AS (SELECT g.url, row_number() OVER (PARTITION BY canonical_url
                 ORDER BY coalesce(company, '') DESC, coalesce(title, '') DESC, g.url DESC) AS k
             FROM grp g JOIN doc_postings p ON p.url = g.url)
SELECT url, company, title FROM doc_postings WHERE url NOT IN (SELECT url FROM ranked WHERE k > 1)"""))
def deduplicated_terms_last(spark, sf_dir):
    """D6, keep='last': of each group the last posting in (company, title, url) order stays."""
    p = doc_postings(spark, sf_dir)
    return D.deduplicate(p, _exact_terms(spark, sf_dir), keep="last")[0].select("url", "company", "title")


@register("dedup_stats_terms", _on_exact_terms("""
SELECT CAST(p.n AS BIGINT) AS total_jobs, CAST(p.n - d.n AS BIGINT) AS unique_jobs,
       CAST(d.g AS BIGINT) AS duplicate_groups, CAST(d.n AS BIGINT) AS total_duplicates,
       CASE WHEN p.n > 0 THEN round(d.n / p.n, 6) ELSE 0.0 END AS duplicate_rate
FROM (SELECT count(*) AS n FROM doc_postings) p,
     (SELECT count(*) AS n, count(DISTINCT canonical_url) AS g FROM dup) d"""))
def dedup_stats_terms(spark, sf_dir):
    """D7 on the key-term graph."""
    return D.dedup_stats(doc_postings(spark, sf_dir), _exact_terms(spark, sf_dir))


@register("company_dup_stats_terms", _on_exact_terms("""
, per AS (SELECT p.company, count(*) AS n FROM dup JOIN doc_postings p ON p.url = dup.canonical_url GROUP BY p.company)
SELECT t.company, CAST(t.n AS BIGINT) AS total, CAST(coalesce(per.n, 0) AS BIGINT) AS duplicates,
       round(coalesce(per.n, 0) / t.n, 6) AS duplicate_rate
FROM (SELECT company, count(*) AS n FROM doc_postings GROUP BY company) t
LEFT JOIN per ON per.company IS NOT DISTINCT FROM t.company"""))
def company_dup_stats_terms(spark, sf_dir):
    """D8 on the key-term graph."""
    return D.company_dup_stats(doc_postings(spark, sf_dir), _exact_terms(spark, sf_dir))


@register("duplicate_report_terms", _on_exact_terms("""
, o2 AS (SELECT url, terms FROM t)
, sims AS (SELECT dup.*, round(100 * len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))), 2) AS sim
           FROM dup JOIN o2 a ON a.url = canonical_url JOIN o2 b ON b.url = duplicate_url)
SELECT printf('## Group: %d duplicate(s) | canonical: %s | %s | %s | %s', g.n, coalesce(p.title, 'N/A'), coalesce(p.company, 'N/A'),
              coalesce(p.location, 'N/A'), p.url) AS line
FROM (SELECT canonical_url, count(*) AS n FROM dup GROUP BY canonical_url) g JOIN doc_postings p ON p.url = g.canonical_url
UNION ALL
SELECT printf('  - %s | %s | similarity %.2f%% | %s', coalesce(p.title, 'N/A'), coalesce(p.location, 'N/A'), s.sim, p.url)
FROM sims s JOIN doc_postings p ON p.url = s.duplicate_url
UNION ALL SELECT 'No duplicates found.' WHERE NOT EXISTS (SELECT 1 FROM dup)"""))
def duplicate_report_terms(spark, sf_dir):
    """D9 on the key-term graph, its Jaccard as the score."""
    checkpoint_dir(spark)
    dups = _exact_terms(spark, sf_dir).checkpoint()
    return D.duplicate_report(doc_postings(spark, sf_dir), dups).select("line")


@register("deactivated_terms", _on_exact_terms(
    "SELECT url, url NOT IN (SELECT duplicate_url FROM dup) AS is_active FROM doc_postings"))
def deactivated_terms(spark, sf_dir):
    """D10 on the key-term graph: every posting as an active job, duplicates switched off."""
    jobs = doc_postings(spark, sf_dir).withColumn("is_active", F.lit(True))
    return D.deactivate_duplicates(jobs, _exact_terms(spark, sf_dir)).select("url", "is_active")


@register("pruned_candidates")
def pruned_candidates(spark, sf_dir):
    """Pairs of representatives that all exact bounds leave to be scored, per company (tests compare all pairs)."""
    checkpoint_dir(spark)
    r = _reps(spark, sf_dir).filter((F.col("nt") != "") & (F.col("nl") != ""))
    reps = D.numbered(r.groupBy("company_key", "nt", "nl").agg(F.min("ord").alias("ord")).withColumn("terms", T.key_terms("nt")))
    compat = D.location_compat(reps, rules.LOCATION_THRESHOLD).checkpoint()
    pairs = D.candidate_pairs(reps, compat, rules.TITLE_THRESHOLD)
    of = pairs.join(reps.select(F.col("k").alias("i"), "company_key"), "i").groupBy("company_key").agg(
        F.count(F.lit(1)).alias("candidates"))
    return reps.groupBy("company_key").agg(F.count(F.lit(1)).alias("representatives")).join(of, "company_key", "left").select(
        "company_key", "representatives", F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"))
