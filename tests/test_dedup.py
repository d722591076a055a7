import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import properties as P
from jobsight.functions.lcs import Strings, lcs_lengths, near_pairs
from jobsight.operators import dedup as D
from jobsight.operators.joins import dealt_join
from jobsight.session import checkpoint_dir

SCHEMA = "url string, company string, title string, location string"

FIVE = [
    ("job1", "TechCorp", "Sr. Software Engineer", "NYC"),
    ("job2", "TechCorp", "Senior Software Engineer", "New York"),
    ("job3", "TechCorp", "Software Engineer", "NYC"),
    ("job4", "OtherCorp", "Sr. Software Engineer", "SF"),
    ("job5", "TechCorp", "Senior SWE - Machine Learning", "New York, NY"),
]


def _dups(spark, rows, **th):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["duplicate_url"]: (r["canonical_url"], r["score"]) for r in D.find_duplicates(df, **th).collect()}
    normalized = [r.asDict() for r in D.normalize_postings(df).collect()]
    P.check(normalized, out, **{k.removesuffix("_threshold"): v for k, v in th.items()})
    return out


def test_five_row_fixture(spark):
    got = _dups(spark, FIVE)
    # canonical by (company, title, url) order: "Senior Software Engineer" (job2) sorts first
    assert {u: c for u, (c, _) in got.items()} == {"job1": "job2", "job3": "job2"}


def test_chain_is_not_connected_components(spark):
    # A~B, B~C, A!~C  -> canonicals A and C
    rows = [("a", "Co", "software engineer", "Boston"),
            ("b", "Co", "software engineer ii", "Boston"),
            ("c", "Co", "software engineer iii xx", "Boston")]
    assert {u: c for u, (c, _) in _dups(spark, rows).items()} == {"b": "a"}


def test_null_location_never_duplicate(spark):
    rows = [("a", "Co", "Data Scientist", None), ("b", "Co", "Data Scientist", None),
            ("c", "Co", "Data Scientist", "")]
    assert _dups(spark, rows) == {}


def test_exact_copies_collapse(spark):
    rows = [(f"u{i:03d}", "Co", "Data Scientist", "Austin, TX") for i in range(40)]
    got = _dups(spark, rows)
    assert len(got) == 39 and {v[0] for v in got.values()} == {"u000"}


WORDS = ["software", "engineer", "senior", "data", "scientist", "ml", "sr.", "ii", "lead",
         "product", "manager", "swe", "analyst", "qa", "dev", "ops", "remote", "the"]
LOCS = ["NYC", "New York", "New York, NY", "SF", "San Francisco, CA", "Remote", "remote - US",
        "Austin, TX", "Austin", None, "Boston, MA", "Bostn, MA"]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_random_postings(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(70):
        co = rnd.choice(["Acme Inc", "acme", "Beta LLC", "Gamma"])
        title = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))
        if rows and rnd.random() < 0.3:
            title = rnd.choice(rows)[2]
        rows.append((f"https://x/{i:03d}", co, title, rnd.choice(LOCS)))
    assert _dups(spark, rows)


@pytest.mark.parametrize("th", [dict(title_threshold=0.6, location_threshold=0.6, combined_threshold=0.5),
                                dict(title_threshold=0.95, location_threshold=0.99, combined_threshold=0.9)])
def test_other_thresholds(spark, th):
    rnd = random.Random(7)
    rows = [(f"r{i:03d}", rnd.choice(["A", "B"]), " ".join(rnd.choice(WORDS) for _ in range(3)),
             rnd.choice(LOCS)) for i in range(60)]
    _dups(spark, rows, **th)


def test_stats_and_split(spark):
    df = spark.createDataFrame(FIVE, SCHEMA)
    dups = D.find_duplicates(df)
    st = D.dedup_stats(df, dups).collect()[0].asDict()
    assert st == dict(total_jobs=5, unique_jobs=3, duplicate_groups=1, total_duplicates=2,
                      duplicate_rate=0.4)
    uniq, removed = D.deduplicate(df, dups)
    assert uniq.count() == 3 and removed.count() == 2
    last_u, _ = D.deduplicate(df, dups, keep="last")
    assert last_u.count() == 3
    cs = {r["company"]: (r["total"], r["duplicates"]) for r in D.company_dup_stats(df, dups).collect()}
    assert cs == {"TechCorp": (4, 2), "OtherCorp": (1, 0)}
    assert D.duplicate_report(df, dups).count() == 3


def test_keep_most_recent_and_deactivate(spark):
    import datetime as dt
    rows = [("a", "Co", "Data Scientist", "Austin, TX", dt.datetime(2024, 1, 1), True),
            ("b", "Co", "Data Scientist", "Austin, TX", dt.datetime(2024, 1, 5), True),
            ("c", "Co", "Data Scientist", "Austin, TX", dt.datetime(2024, 1, 5), True),
            ("d", "Co", "Nurse", "Austin, TX", dt.datetime(2024, 1, 2), True)]
    df = spark.createDataFrame(rows, "url string, company string, title string, location string, "
                                     "last_seen timestamp, is_active boolean")
    dups = D.find_duplicates(df)
    uniq, removed = D.deduplicate(df, dups, keep="most_recent")
    assert sorted(r["url"] for r in uniq.collect()) == ["b", "d"]
    assert sorted(r["url"] for r in removed.collect()) == ["a", "c"]
    flags = {r["url"]: r["is_active"] for r in D.deactivate_duplicates(df, dups).collect()}
    assert flags == {"a": True, "b": False, "c": False, "d": True}


def test_report_without_duplicates(spark):
    df = spark.createDataFrame([("a", "Co", "Nurse", "Austin"), ("b", "Co", "Teacher", "Austin")], SCHEMA)
    lines = [r["line"] for r in D.duplicate_report(df, D.find_duplicates(df)).collect()]
    assert lines == ["No duplicates found."]


def test_driver_postings(spark):
    """Every line of the sf0.001 documents (real multilingual text)."""
    from paths import SF001
    from jobsight.sources.views import doc_postings
    p = doc_postings(spark, SF001)
    rows = [(r["url"], r["company"], r["title"], r["location"]) for r in p.collect()]
    assert len(_dups(spark, rows)) > 0


# ---- the parts of the plan ------------------------------------------------------

def _lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for k, d in enumerate(y):
            new.append(row[k] + 1 if c == d else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("few,batch", [(1, 64), (1, 1 << 14), (10_000, 1)])
def test_lcs_lengths(monkeypatch, few, batch):
    """Batches of several words, of one pair, and strings one by one."""
    from jobsight.functions import lcs
    monkeypatch.setattr(lcs, "FEW", few)
    monkeypatch.setattr(lcs, "BATCH", batch)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aabcdé ß日😀") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 130, 200]))) for _ in range(30)]
    strings = Strings(texts)
    a, b = (np.array([rnd.randrange(30) for _ in range(200)]) for _ in range(2))
    assert lcs_lengths(strings, a, b).tolist() == [_lcs(texts[x], texts[y]) for x, y in zip(a, b)]


def test_near_pairs_miss_none():
    from difflib import SequenceMatcher
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.choice([3, 20, 40, 220]))) for _ in range(12)]
    texts = base + [t[:k] + rnd.choice("xy") + t[k + rnd.randint(0, 2):] for t in base for k in (0, len(t) // 2)]
    everyone = np.arange(len(texts))
    for theta in (0.6, 0.85, 1.0):
        i, j = near_pairs(Strings(texts), everyone, everyone, theta)
        found = set(zip(i.tolist(), j.tolist()))
        for x in range(len(texts)):
            for y in range(len(texts)):
                if SequenceMatcher(None, texts[x], texts[y]).ratio() >= theta:
                    assert (x, y) in found


def test_near_pairs_of_long_texts_miss_none(monkeypatch):
    """Around the length from which difflib leaves popular characters out; parts moved; several stretches of pairs."""
    from difflib import SequenceMatcher
    from jobsight.functions import lcs
    monkeypatch.setattr(lcs, "PAIRS", 50)
    monkeypatch.setattr(lcs, "FEW", 1)
    monkeypatch.setattr(lcs, "CHECK", 3)
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh  éß日") for _ in range(n)) for n in (150, 190, 199, 200, 205, 230, 400)]

    def edited(t):
        t = list(t)
        for _ in range(rnd.randint(1, len(t) // 7)):
            k = rnd.randrange(len(t))
            t[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "X", "Y"])
        k = rnd.choice([0, 0, rnd.randrange(len(t))])
        return "".join(t[k:] + t[:k])

    texts = base + [edited(t) for t in base for _ in range(4)]
    rnd.shuffle(texts)
    everyone = np.arange(len(texts))
    for theta in (0.6, 0.85):
        similar = {(x, y) for x in range(len(texts)) for y in range(len(texts))
                   if SequenceMatcher(None, texts[x], texts[y]).ratio() >= theta}
        found = set(zip(*(v.tolist() for v in near_pairs(Strings(texts), everyone, everyone, theta))))
        assert similar <= found
        once = set(zip(*(v.tolist() for v in near_pairs(Strings(texts), everyone, everyone, theta, once=True))))
        assert all((x, y) in once or (y, x) in once for x, y in similar if x != y)
        assert len({frozenset(p) for p in once}) == len(once) and all(x != y for x, y in once)


def test_long_texts_of_one_language_seldom_reach_the_lcs(monkeypatch):
    """Long texts have most characters in common, but few runs of them."""
    from jobsight.functions import lcs
    rnd = random.Random(6)
    words = ["".join(rnd.choice("eeeetttaaooinnshrrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)).capitalize() + ". Q%dzx-K" % n for n in range(120)]
    seen = []
    real = lcs.lcs_lengths
    monkeypatch.setattr(lcs, "lcs_lengths", lambda strings, a, b, *rest: seen.append(len(a)) or real(strings, a, b, *rest))
    near_pairs(Strings(texts), np.arange(60), np.arange(60, 120), 0.85)
    assert sum(seen) < 36


def _similar(texts, theta):
    from difflib import SequenceMatcher
    return {(x, y) for x in range(len(texts)) for y in range(len(texts))
            if SequenceMatcher(None, texts[x], texts[y]).ratio() >= theta}


def test_long_texts_are_paired_by_rare_runs(monkeypatch):
    """Of long texts, only those that share rare runs of characters are held against each other."""
    from jobsight.functions import lcs
    rnd = random.Random(8)
    words = ["".join(rnd.choice("eeeetttaaooinnshrrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(50, 70))) + ". q%dzx-k" % n for n in range(280)]
    texts += [t[:90] + "some other" + t[95:] for t in texts[:20]]
    seen = []
    real = lcs.differing_runs
    monkeypatch.setattr(lcs, "differing_runs", lambda strings, x, y: seen.append(len(x)) or real(strings, x, y))
    everyone = np.arange(len(texts))
    i, j = near_pairs(Strings(texts), everyone, everyone, 0.85, True)
    assert {(k, 280 + k) for k in range(20)} <= {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert sum(seen) < 0.005 * len(texts) ** 2


def test_texts_without_rare_runs_miss_none(monkeypatch):
    """Near copies of one text, texts of many blocks, and little room for runs and pairs."""
    from jobsight.functions import lcs
    monkeypatch.setattr(lcs, "HELD", 600)
    monkeypatch.setattr(lcs, "MOST", 3)
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcde fgh") for _ in range(240))
    copies = [base[:k] + rnd.choice("xyz") * rnd.randint(0, 9) + base[k + rnd.randint(0, 9):] for k in range(3, 240, 20)]
    signs = ["".join(chr(33 + (k * 7 + n) % 90) for k in range(210 + n)) for n in range(4)]
    texts = copies + signs + [s[:40] + "::" + s[50:] for s in signs] + [t[:170] for t in copies[:4] + signs]
    everyone = np.arange(len(texts))
    for theta in (0.5, 0.85, 1.0):
        similar = _similar(texts, theta)
        assert similar <= set(zip(*(v.tolist() for v in near_pairs(Strings(texts), everyone, everyone, theta))))
        once = {frozenset(p) for p in zip(*(v.tolist() for v in near_pairs(Strings(texts), everyone, everyone, theta, True)))}
        assert {frozenset(p) for p in similar if p[0] != p[1]} <= once
        half = len(texts) // 2
        i, j = near_pairs(Strings(texts), everyone[:half], everyone[half:], theta)
        assert {p for p in similar if p[0] < half <= p[1]} <= set(zip(i.tolist(), (j + half).tolist()))


@pytest.mark.parametrize("few,batch", [(1, 64), (1, 7), (10_000, 64)])
def test_lcs_that_is_enough(monkeypatch, few, batch):
    """Close to the diagonal, in batches, and one by one: what difflib matches is enough, and what is too short is not."""
    from difflib import SequenceMatcher
    from jobsight.functions import lcs
    monkeypatch.setattr(lcs, "FEW", few)
    monkeypatch.setattr(lcs, "BATCH", batch)
    rnd = random.Random(10)
    base = ["".join(rnd.choice("abcdé ß日") for _ in range(n)) for n in (1, 2, 30, 64, 65, 130, 199, 300) for _ in range(3)]
    texts = base + ["".join(rnd.choice(["", c, c, c, c, c, c, c + "x"]) for c in t) + "y" for t in base]
    strings = Strings(texts)
    a, b = (v.ravel() for v in np.indices((len(texts), len(texts))))
    for theta in (0.6, 0.85, 1.0):
        need = theta * (strings.lengths[a] + strings.lengths[b]) / 2 - 1e-9
        enough = lcs_lengths(strings, a, b, need) >= need
        for x, y, n, ok in zip(a.tolist(), b.tolist(), need.tolist(), enough.tolist()):
            if ok:
                assert _lcs(texts[x], texts[y]) >= n
            else:
                assert sum(m.size for m in SequenceMatcher(None, texts[x], texts[y]).get_matching_blocks()) < n


def test_ratio_from_a_floor_on(monkeypatch):
    from jobsight.functions import similarity
    from jobsight.functions.similarity import ratio_floor_py, ratio_py
    monkeypatch.setattr(similarity, "FLOOR_CHARS", 300)
    rnd = random.Random(12)
    texts = [None, "", "A"] + [" ".join(rnd.choice(WORDS).title() for _ in range(rnd.randint(1, 50))) for _ in range(12)]
    texts += [t[:5] + "x" + t[6:] for t in texts[3:]]
    pairs = [(x, y) for x in texts for y in texts]
    got = ratio_floor_py(pairs, 0.85)
    assert all(g == ratio_py(x, y) or (g == -1.0 and ratio_py(x, y) < 0.85) for g, (x, y) in zip(got, pairs))
    assert -1.0 in got and len(got) == len(pairs)


def test_small_blocks_give_the_same(spark, monkeypatch):
    """Many tiles, length bands, dealt terms and several greedy rounds."""
    rnd = random.Random(11)
    rows = [(f"s{i:03d}", rnd.choice(["A", "A", "B"]), " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5))),
             rnd.choice(LOCS)) for i in range(90)]
    want = _dups(spark, rows, title_threshold=0.7)
    monkeypatch.setattr(D, "TILE", 6)
    monkeypatch.setattr(D, "HEAVY", 3)
    monkeypatch.setattr(D, "LOCAL_EDGES", 4)
    assert _dups(spark, rows, title_threshold=0.7) == want


def test_a_long_chain_needs_few_rounds(spark, monkeypatch):
    """10,000 postings, each similar to the next one: 5,000 dependent decisions."""
    monkeypatch.setattr(D, "LOCAL_EDGES", 1000)
    base = checkpoint_dir(spark)
    local = base.removeprefix("file:")
    before = set(os.listdir(local))
    n = 10_000
    chain = spark.range(n - 1).select(F.lit("c").alias("company_key"), F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"))
    marked = sorted(r["k"] for r in D.greedy_canonicals(chain).collect())
    assert marked == list(range(1, n, 2))
    folder, = [f for f in set(os.listdir(local)) - before if f.startswith("greedy-")]
    assert len([t for t in os.listdir(f"{local}/{folder}") if t.startswith("turn=")]) <= 20


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_order_on_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(D, "LOCAL_EDGES", 20)
    rnd = random.Random(seed)
    edges = {(c, *sorted(rnd.sample(range(60), 2))) for c in ("x", "y", None) for _ in range(80)}
    marked = {(r["company_key"], r["k"]) for r in D.greedy_canonicals(
        spark.createDataFrame(sorted(edges, key=str), "company_key string, lo long, hi long").filter("company_key is not null")).collect()}
    for c in ("x", "y"):
        canonical = []
        for k in sorted({n for e in edges if e[0] == c for n in e[1:]}):
            if any((c, x, k) in edges for x in canonical):
                assert (c, k) in marked
            else:
                canonical.append(k)
                assert (c, k) not in marked


def test_a_hot_key_is_dealt(spark):
    """One key holds all rows but a few: no task gets much more than the others."""
    left = spark.range(2000).select(F.lit("hot").alias("key"), F.col("id").alias("i"))
    left = left.union(spark.createDataFrame([("cold", 5000)], "key string, i long"))
    right = left.withColumnRenamed("i", "j")
    near = dealt_join(left, right, ["key"], "i", "j", 100, (F.col("i") < F.col("j")) & (F.col("j") - F.col("i") < 3))
    assert {(r["i"], r["j"]) for r in near.collect()} == {(i, i + d) for i in range(2000) for d in (1, 2) if i + d < 2000}
    sizes = sorted(r["count"] for r in dealt_join(left, right, ["key"], "i", "j", 100).groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 2000 * 2000 + 1 and sizes[-1] <= 5 * sizes[len(sizes) // 2]


def test_copies_of_key_terms_make_no_links(spark, tmp_path, monkeypatch):
    """300 postings of one key-term set: the same rows as the plain scan, and the copies are not paired."""
    from jobsight.plans import q_dedup as Q
    common = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota"
    text = "\n".join([common + " Kappa"] * 150 + [common] * 150 + ["Nothing Alike Here"])
    spark.createDataFrame([(1, text, "en", "src"), (2, common, "fr", "src"), (2, common, "fr", "src"), (None, common, "en", "src")],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    links = Q._jaccard_links

    def counted(*args):
        out = links(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(Q, "_jaccard_links", counted)
    rows = [(r["duplicate_url"], r["canonical_url"], r["score"]) for r in Q._exact_terms(spark, str(tmp_path)).collect()]
    assert seen == [1]
    # in (company, title, url) order the posting without a URL, then those of the shorter title
    first, = {c for u, c, _ in rows if u != "doc/2/1"}
    assert first in (None, "doc/1/151") and len(rows) == 300 + 1
    assert [(u, c, s) for u, c, s in rows if u == "doc/2/1"] == [("doc/2/1", "doc/2/1", 1.0)]
    assert sorted(s for _, _, s in rows) == pytest.approx([0.9] * 150 + [1.0] * 151)


def test_rows_by_bitmap(spark):
    """Wanted ids and keys as bitmaps: the same rows as the plain joins, ids of several partitions, nulls and repeats."""
    from jobsight.operators.joins import likely_rows, rows_of
    rows = spark.range(0, 70_000, 1, 3).select(F.monotonically_increasing_id().alias("k"), F.when(
        F.col("id") % 1000 > 0, F.concat(F.lit("u"), F.col("id") % 50_000)).alias("url")).localCheckpoint()
    for share in (0, 7919):
        wanted = rows.filter(F.col("k") % share == 0 if share else F.lit(False))
        got = rows_of(rows, "k", wanted.select("k"))
        assert sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in wanted.collect())
        assert "Exchange hashpartitioning(k" not in got._jdf.queryExecution().toString()
        likely, rest = likely_rows(rows, "url", wanted.select("url"))
        urls = {r["url"] for r in wanted.collect()}
        assert likely.count() + rest.count() == 70_000
        assert not urls & {r["url"] for r in rest.select("url").collect()}
        assert sum(r["url"] not in urls for r in likely.collect()) <= 70_000 * len(urls) / (1 << 24)


def test_single_postings_are_stored_once(spark, tmp_path):
    """Postings without any similar one: titles and key terms are written once, not with every step of the graph."""
    from jobsight.plans import q_dedup as Q
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(8)) for _ in range(60)) for _ in range(1200)]
    spark.createDataFrame([(i, "\n".join(texts[i::40]), "en", "src") for i in range(40)],
                          "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    local = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(local))
    assert Q.deduplicated_terms_last(spark, str(tmp_path)).count() == 1200
    written = sum(os.path.getsize(os.path.join(d, f)) for top in set(os.listdir(local)) - before
                  for d, _, files in os.walk(f"{local}/{top}") for f in files)
    assert written < 2 * sum(map(len, texts))
