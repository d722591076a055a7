"""Packing, filter audit and resampling against plain definitions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
from jobsight.llm import filter_audit, packing, resampling
from jobsight.llm.words import ALNUM, word_blocks

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "The Long Text of words, 123! " * 9000
#: columns whose names also occur inside the operators
CLASHING = "doc_id long, text string, source string, id string, piece long, ids string, part int, mask int, score long, row long"


def _table(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, s, "x", 1, "y", 2, 3, 4, 5) for i, t, s in rows], CLASHING)
    return df.repartition(parts) if rows else df


def _corpus(seed, n):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "x", "É", "naïve", "日本", "#", "don't", "B2B", "...", "NASA"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 30, 60, 200]))) for _ in range(n)]
    return [(i, rnd.choice(texts[:n // 2] + [texts[i]]), rnd.choice(["a", "a", "b", None])) for i in range(n)]


EDGES = [(9001, None, "a"), (9002, "", None), (9003, " \n\t", "c"), (None, "alpha beta", "a"), (None, None, None),
         (9004, LONG, "a"), (9005, "same row", "b"), (9005, "same row", "b"), (9006, "same row", "a")]


# ---- packing -----------------------------------------------------------------

def test_first_fit_by_tree_equals_scan():
    rnd = random.Random(1)
    for n in (1, 2, 5, 64, 300):
        lengths = np.array(sorted((rnd.randint(1, 1023) for _ in range(n)), reverse=True))
        bins, room = [], []
        for i, need in enumerate(lengths.tolist()):
            at = next((k for k, r in enumerate(room) if r >= need), len(room))
            if at == len(room):
                room.append(1024)
                bins.append([])
            room[at] -= need
            bins[at].append(i)
        assert packing.first_fit_decreasing(lengths, 1024) == bins


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200])
def test_groups_lose_nothing_and_need_no_padding(n):
    rnd = random.Random(n)
    lengths = np.array(sorted((rnd.randint(1, 1023) for _ in range(n)), reverse=True), dtype=int)
    sequences = packing.pack_group(lengths, 1024)
    got = sorted((i, k) for own in sequences for i, a, b in own for k in range(a, b))
    assert got == [(i, k) for i, size in enumerate(lengths) for k in range(size)]
    for own in sequences:
        size = sum(b - a for _, a, b in own)
        assert 0 < size <= 1024 and size & (size - 1) == 0
    # rests stay whole but for the few sequences that fill the others
    assert sum(len(own) for own in sequences) <= n + len(sequences) + 11


@pytest.mark.parametrize("parts", [1, 5])
def test_pack(spark, parts, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rows = _corpus(2, 120) + EDGES
    out = packing.pack(_table(spark, rows, parts), TOKENIZER, seq_len=256).collect()
    coder = Tokenizer.from_file(TOKENIZER)
    coder.encode_special_tokens = True
    want = Counter((i, tuple([*coder.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, _ in rows)
    ids = {r: np.frombuffer(r["ids"], "<u4").tolist() for r in out}
    assert all(len(v) == r["length"] for r, v in ids.items())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, own in by_doc.items():
        wanted = [list(t) for (j, t), n in want.items() if j == i for _ in range(n)]
        assert sum(r["length"] for r in own) == sum(map(len, wanted))
        assert {r["doc_tokens"] for r in own} == {len(t) for t in wanted}
        if len(wanted) == 1:
            own.sort(key=lambda r: r["start"])
            at = 0
            for r in own:
                assert r["start"] == at
                at += r["length"]
            assert [x for r in own for x in ids[r]] == wanted[0]
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0 and set(by_doc) == {i for i, _, _ in rows}


def test_encoder_equals_tokenizers_on_every_code_point():
    import tiktoken
    tokens, pattern = packing.vocabulary(TOKENIZER)
    fast = tiktoken.Encoding("t", pat_str=pattern, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(tokens)})
    coder = Tokenizer.from_file(TOKENIZER)
    coder.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 50_000):
        texts = [f"ab{c}cd {c} 1{c}2 !{c}? {c}\n{c}  {c}'s" for c in map(chr, points[lo:lo + 50_000])]
        for t, e in zip(texts, coder.encode_batch_fast(texts, add_special_tokens=False)):
            assert fast.encode_ordinary(t) == e.ids, t
    for t in (LONG, "<|endoftext|>", "a" * 50_000, " " * 50_000 + "x"):
        assert fast.encode_ordinary(t) == coder.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        packing.vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_pack_empty_and_wrong_length(spark):
    assert packing.pack(_table(spark, []), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(_table(spark, []), TOKENIZER, seq_len=1000)


# ---- filter audit ------------------------------------------------------------

def _fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, source in rows:
        t = t or ""
        w = brute.SPACED.findall(t)
        yield i, source or "", "".join(name for name, bad in (
            ("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)),
            ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search("[#$%&*|]", t))),
            ("E", i is not None and least[t] < i)) if bad)


def _audit(rows, good, toxic):
    """Every order acted out, document by document."""
    out = Counter()
    docs = list(_fails(rows))
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                now = {k for k, (_, x) in enumerate(own) if f in x and k not in gone}
                key = (part, "".join(order), step)
                out[key + ("removed",)] = len(now)
                out[key + ("redundant",)] = sum(f in own[k][1] for k in gone)
                out[key + ("unique_fails",)] = sum(x == f for _, x in own)
                out[key + ("good_lost",)] = sum(own[k][0] in good for k in now)
                out[key + ("toxic_lost",)] = sum(own[k][0] in toxic for k in now)
                gone |= now
                out[key + ("kept",)] = len(own) - len(gone)
                out[(part, f, "shapley")] += len(now)
    return out


def test_audit(spark):
    rows = _corpus(3, 150) + EDGES
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(1, 1, None), (1, 0, 1), (None, 1, 1), (777, 1, 1)]
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(filter_audit.failures(_table(spark, rows), table)).collect()
    want = _audit(rows, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None})
    parts = {s or "" for _, _, s in rows}
    assert len(got) == 600 * len(parts) == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[key + (name,)], (key, name)
        assert r["shapley"] == want[(r["part"], r["filter_order"][r["step"] - 1], "shapley")]


def test_audit_without_documents_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(_table(spark, []), none)).count() == 0
    got = filter_audit.audit(filter_audit.failures(_table(spark, [(1, "a", "s")], 1), none)).collect()
    assert len(got) == 600 and not any(r["good_lost"] or r["toxic_lost"] for r in got)


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_path_counts(k):
    uses = Counter()
    for order in itertools.permutations(range(k)):
        done = 0
        for f in order:
            uses[(done, f)] += 1
            done |= 1 << f
    assert filter_audit.path_counts(k) == uses


def test_audit_with_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(counts, "XY").collect()}
    assert len(got) == 4 and got[("YX", 1)]["removed"] == 2 and got[("YX", 2)]["redundant"] == 2
    assert got[("XY", 1)]["shapley"] == 2
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "ABCDEFGH")


# ---- resampling --------------------------------------------------------------

def test_crc32_of_runs():
    texts = ["", "Ab ab é\x0bx", "  ", "a" * 3000 + " b", "日本 語-x1_y", None] + [t for _, t, _ in _corpus(5, 60)]
    import pyarrow as pa
    for run in (1, 2, 3):
        for b in word_blocks(pa.array(texts), ALNUM, True, block_bytes=200):
            values, bounds = resampling.block_buckets(b, 997, run)
            for d in range(b.hi - b.lo):
                w = brute.ALNUM.findall((texts[b.lo + d] or "").translate(brute.LOWER))
                want = [zlib.crc32(" ".join(w[a:a + n]).encode()) % 997 for n in range(1, run + 1) for a in range(len(w) - n + 1)]
                assert values[bounds[d]:bounds[d + 1]].tolist() == want


def _resampled(rows, target, percent, buckets, run, min_words, seed):
    def found(t):
        w = brute.ALNUM.findall((t or "").translate(brute.LOWER))
        return len(w), [zlib.crc32(" ".join(w[a:a + n]).encode()) % buckets for n in range(1, run + 1) for a in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    docs = [(i, *found(x)) for i, x, _ in rows]
    for _, _, f in docs:
        s.update(f)
    for x in target:
        t.update(found(x)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))))
    able = sorted(((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= min_words))
    return out, able[:percent * len(able) // 100]


@pytest.mark.parametrize("percent,run,parts", [(10, 1, 4), (55, 2, 1), (100, 1, 7), (0, 3, 2)])
def test_resample(spark, percent, run, parts):
    rows = _corpus(6, 300) + EDGES
    target = ["alpha beta", None, "", "naïve 日本 NASA", "never seen"]
    aims = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id int, text string, id int")
    got = resampling.resample(_table(spark, rows, parts), aims, percent=percent, buckets=97, max_run=run, min_words=2).collect()
    want, drawn = _resampled(rows, target, percent, 97, run, 2, 2024)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(
        (i, f, w, s) for i, _, f, w, s in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn


def test_resample_empty(spark):
    aims = spark.createDataFrame([], "item_id int, text string")
    assert resampling.resample(_table(spark, []), aims).count() == 0
    got = resampling.resample(_table(spark, [(1, "a b " * 20, "s"), (2, None, "s")], 1), aims, percent=100).collect()
    assert {r["doc_id"]: r["rank"] for r in got} == {1: 1, 2: None}
    with pytest.raises(ValueError):
        resampling.resample(_table(spark, []), aims, buckets=1 << 20)


def test_kth_key_of_many_rows(spark):
    """More rows than pivots, many equal scores."""
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 2, 2, 2, 3]), rnd.choice([None, *range(50)]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "score long, id long, row long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 999, 1999, 2000):
        r = resampling.kth(df, k, seed=k)
        assert (r["score"], r["id"], r["row"]) == order[k - 1]
