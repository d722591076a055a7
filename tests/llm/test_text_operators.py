"""Line dedup, decontamination, BPE and quality rules against plain definitions."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken

import brute
from jobsight.llm import bpe, decontaminate, line_dedup, quality_rules
from jobsight.llm.fm_index import FmIndex
from jobsight.llm.words import ALNUM, SPACED, word_blocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(seed, n, alphabet):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90))) for _ in range(n)]


# ---- words -------------------------------------------------------------------

def test_words_and_hashes():
    texts = [None, "", "Ab ab é\x0bx", "  ", "a" * 3000] + _texts(0, 300, "aB é-\n ü1_")
    for word, pattern in ((SPACED, brute.SPACED), (ALNUM, brute.ALNUM)):
        by_hash = {}
        for b in word_blocks(pa.array(texts).slice(1), word, True, block_bytes=64):
            for d in range(b.hi - b.lo):
                lo, hi = b.bounds[d], b.bounds[d + 1]
                own = [bytes(b.data[s:e]).decode() for s, e in zip(b.starts[lo:hi], b.ends[lo:hi])]
                want = pattern.findall((texts[1 + b.lo + d] or "").translate(brute.LOWER))
                assert [w.translate(brute.LOWER) for w in own] == want
                for w, h in zip(own, b.hashes[lo:hi].tolist()):
                    assert by_hash.setdefault(h, w.translate(brute.LOWER)) == w.translate(brute.LOWER)
        assert len(set(by_hash.values())) == len(by_hash)


# ---- line dedup --------------------------------------------------------------

def test_line_dedup(spark):
    rnd = random.Random(4)
    lines = ["", " ", "Foot ER", "foot er\r", "\tx", "X", "é", "É", "unique"]
    docs = [(i, "\n".join(rnd.choice(lines) + (str(i) if rnd.random() < .3 else "") for _ in range(rnd.randint(1, 9))))
            for i in range(40)] + [(90, None), (91, ""), (92, "\n\n"), (93, "x\n" * 5000 + "end")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, lines int, kept string")
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in
           line_dedup.line_report(df, min_docs=5).collect()}
    assert got == brute.kept_lines(docs, 5)
    out = line_dedup.drop_lines(df, min_docs=5)
    assert out.columns == df.columns and out.count() == len(docs)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[90] is None and texts[91] == ""


def test_line_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "a\nc"), (None, "a\nd"), (None, "a\nd"), (2, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # documents: (1, a b), (1, a c), (null, a d), (2, q)
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.drop_lines(df, min_docs=3).collect()), key=repr)
    assert got == sorted([(1, "b"), (1, "b"), (1, "c"), (None, "d"), (None, "d"), (2, "q")], key=repr)
    assert line_dedup.drop_lines(df, min_docs=4).where("text like 'a%'").count() == 5
    copies = spark.createDataFrame([(i, "same\ntext") for i in range(20)], "doc_id long, text string")
    assert line_dedup.drop_lines(copies, 10, copies_once=True).where("text = 'same\ntext'").count() == 20
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


# ---- decontamination ---------------------------------------------------------

def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sigma = int(rng.integers(2, 7))
        text = np.concatenate([np.append(rng.integers(1, sigma, int(rng.integers(1, 30))), 0)
                               for _ in range(int(rng.integers(1, 6)))]).astype(np.int32)
        index = FmIndex(text, sigma)
        for k in (1, 2, 3):
            rows = rng.integers(1, sigma, (10, k))
            lo, hi = index.search(rows)
            for row, a, b in zip(rows, lo, hi):
                want = [i for i in range(len(text) - k + 1) if (text[i:i + k] == row).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["a", "B", "c1", "é", "Ü"]
    mk = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    docs = [(i, mk(rnd.randint(0, 80))) for i in range(60)] + [(90, None), (91, ""), (92, mk(3000))]
    items = [(i, mk(rnd.randint(1, 9))) for i in range(12)] + [(50, None), (51, ""), (None, "a b a b"), (3, "é é c1")]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in docs], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.benchmark_hits(docs, items, 4)
    for block in (decontaminate.BLOCK_BYTES, 60):  # one block of items, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in
               decontaminate.find_benchmark(df, bench, 4).collect()}
        assert got == want
    cleaned = decontaminate.remove_benchmark(df, bench, 4)
    assert cleaned.schema == df.schema
    for r in cleaned.collect():
        assert (r["text"] == dict(docs)[r["doc_id"]]) == (want[r["doc_id"]][1] == 0)
        left = brute.ALNUM.findall((r["text"] or "").translate(brute.LOWER))
        assert len(left) == want[r["doc_id"]][0] - want[r["doc_id"]][1]
    assert decontaminate.find_benchmark(df.limit(0), bench).count() == 0
    assert decontaminate.find_benchmark(df, bench.limit(0)).where("n_hit > 0").count() == 0


# ---- byte-level BPE ----------------------------------------------------------

def test_bpe_equals_tiktoken(spark):
    tokens = bpe.read_ranks(RANKS)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(tokens)})
    texts = ["", "   ", " a", "a ", "\na b", "a  b", "a" * 4000, "hahaha" * 300, "<|endoftext|> it's", "١٢٣ ⅷ",
             "\x1c\x1d x\x85y　q", "né " * 9000]
    texts += _texts(1, 800, "ab é\n 1_'stl\x1c\x85​ ") + _texts(2, 200, "abcdefghij kl")
    rnd = random.Random(9)
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0x2ff), rnd.randint(0x2000, 0x20ff), rnd.randint(0, 0xd7ff)]))
                      for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(9999, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    want = {i: coder.encode_ordinary(t or "") for i, t in rows}
    got = {r["doc_id"]: r for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, ids in want.items():
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["round_trip"]
    for r in bpe.encode_digest(df, RANKS, public_tokenizers.PATTERN).collect():
        t = dict(rows)[r["doc_id"]] or ""
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want[r["doc_id"]])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and r["round_trip"]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_lower_rank_made_by_a_merge():
    """A merge that makes a pair of a lower rank: that pair goes first, as in step-by-step merging."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab"]
    merges = bpe.Merges(tokens)
    rank = {t: i for i, t in enumerate(tokens)}

    def slow(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not found:
                return [rank[p] for p in parts]
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(0)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    ids, bounds = bpe.replay(words, merges)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [slow(w) for w in words]


def test_bpe_units_cover_the_text():
    cut = regex.compile(public_tokenizers.PATTERN)
    texts = _texts(3, 500, "ab \n\t.'s")
    docs, pretokens = bpe.units(texts, cut)
    assert [[w for u in d for w in pretokens[u]] for d in docs] == [cut.findall(t) for t in texts]


# ---- quality rules -----------------------------------------------------------

def test_measures():
    texts = [None, "", "\n", "a\n\na", "é é é é é"] + _texts(2, 1500, "ab é\n #\t $ ")
    got = []
    for b in word_blocks(pa.array(texts, pa.string()), SPACED, False, block_bytes=500):
        got += list(zip(*[x.tolist() for x in quality_rules.measure(b)]))
    assert got == [brute.quality(t) for t in texts]


def test_exact_binomial_bound():
    for n, a, d in ((100, .05, .05), (500, .0125, .003), (3000, .01, .003), (10, .5, .4), (0, .1, .1)):
        k, total = -1, 0.0
        for i in range(n + 1):
            total += math.comb(n, i) * a ** i * (1 - a) ** (n - i)
            if total > d:
                break
            k = i
        assert quality_rules.most_rejected(n, a, d) == (k if n else -1)


def test_risk_controlled_cutoffs(spark):
    rnd = random.Random(8)
    words = [f"word{k}" for k in range(3000)]
    plain = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(2400):
        bad = i % 5 == 0
        text = " ".join(w + "%%%" if rnd.random() < .5 else w for w in plain(60).split()) if bad else plain(60)
        docs.append((i, text, "en" if i % 3 else None, "x"))
        labels.append((i, int(not bad), 0))
    docs += [(5000, None, "en", "x"), (5001, "", "en", "x"), (5002, plain(49), "en", "x"),
             (5003, "a b c " * 40, "en", "x"), (5004, plain(60) + " %%%", "few", "x"), (None, plain(60), "en", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, failed string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.quality_report(df, lab).collect()}
    for i, text, _, _ in docs:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) \
            == brute.quality(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    good = [i for i, q, _ in labels if q]
    assert sum(not got[i]["kept"] for i in good) <= 0.05 * len(good)
    assert sum(got[i]["kept"] for i, q, _ in labels if not q) <= 0.02 * len(labels)
    assert got[5004]["kept"] and got[None]["kept"]  # no labels, no cutoff
    kept = quality_rules.keep_good(df, lab)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.quality_report(df, lab.limit(0)).where("kept <> (not base_failed)").count() == 0
    assert quality_rules.quality_report(df.limit(0), lab).count() == 0


# ---- quality cutoffs by brute force -------------------------------------------

def _labelled(seed, n):
    rnd = random.Random(seed)
    docs = []
    for i in range(n):
        words = [f"w{rnd.randrange(5000)}" for _ in range(60)]
        bad = rnd.random() < 0.4
        if bad or rnd.random() < 0.01:
            words = [w + "$#" if rnd.random() < 0.3 else w for w in words]
        docs.append((i, rnd.choice("xy"), " ".join(words), 0 if bad else 1))
    return docs


def _cutoffs(docs, alpha, delta):
    """{stratum: cutoff of each score} from exact binomial sums over one label for each text."""
    from fractions import Fraction
    strata = sorted({s for _, s, _, _ in docs})
    a, d = Fraction(alpha) / 4, Fraction(delta) / (4 * len(strata))
    out = {}
    for stratum in strata:
        texts = {}
        for _, s, t, good in docs:
            if s == stratum:
                texts.setdefault(t, set()).add(good)
        rows = [(brute.quality(t), next(iter(g))) for t, g in texts.items() if len(g) == 1]
        for name in quality_rules.SCORES:
            def value(m):
                n, chars, symbols, lines, dup, again = m
                x, y, scale = {"symbols": (symbols, chars, 1000), "dup_lines": (dup, lines, 1000), "repeats": (again, n, 1000),
                               "word_length": (chars, n, 50)}[name]
                return min(1000, scale * x // y if y else 0)
            good = [value(m) for m, g in rows if g == 1]
            bad = [value(m) for m, g in rows if g == 0]
            best, gap = 1000, Fraction(0)
            for c in range(1000, -1, -1):
                k = sum(v > c for v in good)
                tail = sum(Fraction(math.comb(len(good), i)) * a ** i * (1 - a) ** (len(good) - i) for i in range(k + 1))
                if tail > d:
                    break
                own = Fraction(sum(v > c for v in bad), len(bad)) - Fraction(k, len(good))
                if own > gap:
                    best, gap = c, own
            out.setdefault(stratum, {})[name] = best
    return out


def test_cutoffs_by_exact_sums_and_repeated_labels(spark):
    docs = _labelled(7, 900)
    alpha, delta = 0.25, 0.25
    want = _cutoffs(docs, alpha, delta)
    assert any(c < 1000 for own in want.values() for c in own.values())
    copies = [(10_000 + i, s, t, g) for i, s, t, g in docs[:50] for _ in range(1)]  # exact copies count once
    df = spark.createDataFrame([(i, s, t, "z") for i, s, t, _ in docs + copies], "doc_id long, lang string, text string, quality_key string")
    results = []
    for times in (1, 32):
        labels = spark.createDataFrame([(i, g) for i, _, _, g in docs + copies] * times + [(3, None), (None, 1)], "doc_id long, quality int")
        got = quality_rules.quality_report(df, labels, alpha, delta).collect()
        results.append({r["doc_id"]: (r["kept"], tuple(r["failed"])) for r in got})
    assert results[0] == results[1]
    for i, s, t, _ in docs:
        n, chars, symbols, lines, dup, again = brute.quality(t)
        scores = {"symbols": 1000 * symbols // chars, "dup_lines": 1000 * dup // lines, "repeats": 1000 * again // n,
                  "word_length": min(1000, 50 * chars // n)}
        failed = tuple(x for x in quality_rules.SCORES if scores[x] > want[s][x])
        assert results[0][i] == (not failed, failed), i
    # labels that contradict each other say nothing
    both = spark.createDataFrame([(i, g) for i, _, _, _ in docs for g in (0, 1)], "doc_id long, quality int")
    assert all(not r["failed"] for r in quality_rules.quality_report(df, both, alpha, delta).collect())


def test_a_shard_of_the_replay_is_small():
    """Its tables take many times the bytes of its texts, in every worker of an executor."""
    import pyarrow as pa
    from jobsight.llm import bpe
    texts = [f"{n} " * (1 << 18) for n in range(10, 34)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = [part for _, part in bpe.shards(iter([batch]))]
    assert [t for part in found for t in part] == texts
    assert max(sum(map(len, part)) for part in found) <= 4 << 20
