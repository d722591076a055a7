"""The pipeline's stages against plain definitions, and the registered queries' contracts."""

import public_tokenizers
import tiktoken

import __spark_entry__ as E
import brute
import corpus_pipeline
from jobsight.llm import queries
from jobsight.llm.bpe import read_ranks

SF001 = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").checkpoint()
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, SF001).checkpoint()
    assert kept.columns == columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    measured = {i: brute.quality(t) for i, t in texts.items()}
    failed = {i for i, (n, *_, again) in measured.items() if n < 50 or 100 * again > 50 * n}
    assert not failed & {r["doc_id"] for r in kept.collect()}

    lined = corpus_pipeline.lines(spark, kept, SF001).checkpoint()
    one_of_each = {t: i for i, t in sorted(((r["doc_id"], r["text"]) for r in kept.collect()), reverse=True)}
    want = brute.kept_lines([(i, t) for t, i in one_of_each.items()], 10)
    assert lined.columns == columns and lined.count() == kept.count()
    for r in lined.collect():
        assert r["text"] == want[one_of_each[texts[r["doc_id"]]]][2] and r["n_chars"] == len(r["text"])

    single = corpus_pipeline.near_duplicates(spark, lined, SF001).checkpoint()
    groups = brute.near_groups([(r["doc_id"], r["text"]) for r in lined.collect()], 5)
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({g for _, g in groups.values()})

    clean = corpus_pipeline.benchmark(spark, single, SF001).checkpoint()
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.benchmark_hits([(r["doc_id"], r["text"]) for r in single.collect()], items, 10)
    assert clean.columns == columns and clean.count() == single.count()
    for r in clean.collect():
        n, hit, _ = hits[r["doc_id"]]
        assert len(brute.ALNUM.findall(r["text"].translate(brute.LOWER))) == n - hit

    tokens = corpus_pipeline.tokens(spark, clean, SF001)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(read_ranks(path))})
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    got = tokens.collect()
    assert len(got) == len(left)
    assert all(r["ids"] == coder.encode_ordinary(left[r["doc_id"]]) and r["round_trip"] for r in got)


def test_registered(spark):
    names = E.queries()
    for n in range(1, 11):
        assert [x for x in names if x.startswith(f"op{n}_")], n
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_against_sql(spark):
    from oracle_harness import compare, duck
    con = duck(SF001)
    for name, sql in queries.oracle_sql().items():
        assert not compare(spark, con, name, E.queries()[name], sql, SF001), name
