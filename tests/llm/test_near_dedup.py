import random

import numpy as np
import pytest

import brute
from jobsight.llm import near_dedup
from jobsight.llm.components import components

SCHEMA = "doc_id long, text string, n_shingles string, component_id int, band long"


def _report(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return near_dedup.near_duplicates(df, **how).collect()


def _corpus(seed, n_groups, copies):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(n_groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 4, 12, 60, 200]))]
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            docs.append(" ".join(w.upper() if rnd.random() < .1 else w for w in own))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("n", [2, 5])
def test_groups_equal_all_pairs(spark, n):
    docs = _corpus(n, 60, 6) + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, ""), (9005, "Zz"), (9006, "zz")]
    got = {r[0]: (r[1], r[2]) for r in _report(spark, docs, shingle_words=n)}
    assert got == brute.near_groups(docs, n)
    assert got[9002] == (0, 9002) and got[9006] == (1, 9005)


def test_large_group_of_near_copies(spark):
    """Members that are not similar to a centre are found by later rounds and by the last comparison."""
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for i in range(150):
        own = list(base)
        for at in rnd.sample(range(120), rnd.randint(0, 10)):
            own[at] = f"x{i}_{at}"
        docs.append((i, " ".join(own)))
    got = {r[0]: (r[1], r[2]) for r in _report(spark, docs, shingle_words=2)}
    assert got == brute.near_groups(docs, 2)


def test_repeated_rows_null_ids_and_long_text(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here now"), (2, "a b c d e f"),
            (None, "a b c d e f"), (None, None), (3, long), (4, long + " end")]
    got = sorted(map(tuple, _report(spark, rows)), key=repr)
    named = {r[0]: r for r in got if r[0] is not None}
    assert len(named) == len([r for r in got if r[0] is not None]) == 4
    assert named[4][2] == 3 and named[3][3] and not named[4][3]
    assert [r[3] for r in got if r[0] is None] == [True, True]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r[0] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r[0] for r in got if r[0] is not None and r[3]})
    assert ids.count(None) == 2


def test_the_compared_row_of_an_id_stays(spark):
    """The group is told from the smallest set under an id, so the row that stays must be the one with that set."""
    rows = [(i, f"long{i} text of many more words than the other one {i}") for i in range(40)]
    rows += [(i, f"short{i} {i}") for i in range(40)] + [(i, f"short{i} {i}") for i in range(0, 40, 3)] + [(50, "one row")]
    for parts in (1, 3, 7):
        df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(parts)
        got = sorted((r[0], r[1]) for r in near_dedup.drop_near_duplicates(df).collect())
        assert got == sorted([(i, f"short{i} {i}") for i in range(40)] + [(50, "one row")])


def test_clashing_names(spark):
    """Columns with the names of helper columns, and a repeated id."""
    names = ["doc_id", "text", "again", "again_id", "best", "best_id", "_best", "n", "label", "registers", "held"]
    rows = [(1, "a b c d e f", *"pqrstuvwx"), (1, "x", *"pqrstuvwx"), (2, "a b c d e f", *"pqrstuvwx"), (3, "other", *"pqrstuvwx")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == names and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [
        (1, "x"), (2, "a b c d e f"), (3, "other")]


def test_bucket_of_unlike_members(spark, monkeypatch):
    """Many documents share a passage that fills whole bands: they meet in one bucket, dealt to blocks, and only
    those that are similar link."""
    monkeypatch.setattr(near_dedup, "HEAVY", 7)
    rnd = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for i in range(90):
        own = [f"w{i}_{k}" for k in range(25)]
        docs.append(" ".join(passage + own))
        if i % 6 == 0:
            docs.append(" ".join(passage + own[:-2] + ["new", "end"]))
    rnd.shuffle(docs)
    docs = list(enumerate(docs))
    got = {r[0]: (r[1], r[2]) for r in _report(spark, docs, shingle_words=2)}
    assert got == brute.near_groups(docs, 2)


def test_empty_table_and_threshold(spark):
    assert _report(spark, []) == []
    with pytest.raises(ValueError):
        _report(spark, [(1, "a")], threshold=70)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [
        (rnd.randrange(200, 240), rnd.randrange(200, 240)) for _ in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    from jobsight.session import checkpoint_dir
    checkpoint_dir(spark)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    values, starts = [], [0]
    for _ in range(200):
        common, a, b = (rng.integers(0, 2 ** 63, 60, dtype=np.uint64) for _ in range(3))
        for own in (a, b):
            values.append(np.concatenate((common, own)))
            starts.append(starts[-1] + 120)
    r = near_dedup.registers(np.concatenate(values), np.array(starts[:-1])).reshape(200, 2, near_dedup.BUCKETS)
    n = np.full(200, 120)
    assert abs(near_dedup.estimate(r[:, 0], r[:, 1], n, n).mean() - 1 / 3) < 0.01
