import os
import random

from jobsight.operators import dedup as D
from jobsight.session import checkpoint_dir
from test_dedup import LOCS, WORDS, _dups


def _used(spark):
    """Bytes under the checkpoint folder and the folders of shuffle files."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    tops = [checkpoint_dir(spark).removeprefix("file:"), *[d.getPath() for d in local]]
    return sum(os.lstat(os.path.join(d, f)).st_size for t in tops for d, _, files in os.walk(t) for f in files)


def test_titles_are_not_shuffled_once_a_tile(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 6)
    rnd = random.Random(3)
    titles = ["".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(150)) for _ in range(300)]
    titles.append(titles[7][:-3] + "xyz")
    reps = spark.createDataFrame([("co", "x", k, t) for k, t in enumerate(titles)],
                                 "company_key string, nl string, k long, nt string")
    compat = spark.createDataFrame([("co", "x", "x")], "company_key string, a string, b string")
    before = _used(spark)
    assert [(r.i, r.j) for r in D.ratio_pairs(reps, compat, 0.85).collect()] == [(7, 300)]
    # once shuffled, once packed; 50 blocks would have made 50 copies
    assert _used(spark) - before < 8 * sum(len(t.encode()) for t in titles)


def test_large_and_small_locations_meet(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 3)
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        title = rnd.choice(rows)[2] + rnd.choice(["", " x"]) if rows and rnd.random() < 0.4 else " ".join(rnd.choices(WORDS, k=rnd.randint(1, 4)))
        rows.append((f"https://x/{i:03d}", rnd.choice(["Acme Inc", "acme", None]), title, rnd.choice([*LOCS[:4], *LOCS[-2:]])))
    assert _dups(spark, rows)


def test_postings_beside_copies(spark):
    """Copies under other spellings, and a repeated row, of which no row is a duplicate of the other."""
    rows = [("b", "Acme", "Sr. Data Scientist", "NYC"), ("a", "Acme Inc", "Senior Data Scientist", "New York"),
            ("c", "Acme", "Senior Data Scientist", "New York"), ("d", "Acme", "Chef", "Boston"), ("d", "Acme", "Chef", "Boston")]
    df = spark.createDataFrame(rows, "url string, company string, title string, location string")
    out = sorted((r.duplicate_url, r.canonical_url, r.score) for r in D.find_duplicates(df).collect())
    assert out == [("a", "c", 1.0), ("b", "c", 1.0)]
