"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.llm import bpe, decontaminate, filter_audit, html_extract, language_id, license_scan, line_dedup
from jobsight.llm import near_dedup, packing, quality_rules, resampling, token_rollups, warc
from jobsight.session import checkpoint_dir

QUERIES = {}
ORACLE = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op4_line_dedup", r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    common AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                           FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
    FROM keyed GROUP BY doc_id""")
def op4_line_dedup(spark, sf_dir):
    report = line_dedup.line_report(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return report.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                         F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    templates = spark.createDataFrame(license_scan.library(), "license string, template string")
    return license_scan.scan(table(spark, sf_dir, "documents"), templates, least=0.8)


@register("op2_warc_derivatives")
def op2_warc_derivatives(spark, sf_dir):
    # the pages carry no crawl date
    responses = warc.page_responses(table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z")
    records = warc.derive(responses)
    return records.select("record_id", "record_type", "refers_to", F.col("headers")["WARC-Target-URI"].alias("url"),
                          F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"),
                          F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
                          F.col("headers")["Content-Length"].cast("long").alias("content_length"), "block")


@register("op3_hyperminhash", rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
            ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
        FROM words),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    common AS (
        SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
        FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
            AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
        GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT u, v FROM common WHERE 100 * c >= 80 * (n + m - c)),
    reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
    SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.v), s.doc_id)) AS component_id,
           s.doc_id = least(s.doc_id, coalesce(min(r.v), s.doc_id)) AS kept
    FROM sets s LEFT JOIN reach r ON s.doc_id = r.u GROUP BY s.doc_id, s.s""")
def op3_hyperminhash(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, threshold=80)


@register("op5_fm_index", rf"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    cut AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM items WHERE len(w) > 0),
    phrases AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM cut),
    places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
               FROM docs, (SELECT DISTINCT k FROM phrases) WHERE len(w) >= k),
    found AS (SELECT doc_id, i, pl.k AS k, item_id FROM places pl JOIN phrases ph
              ON pl.k = ph.k AND array_to_string(pl.w[pl.i:pl.i + pl.k - 1], ' ') = ph.p),
    hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
                SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (
                  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
           sha256(coalesce(i.x, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named i USING (doc_id)""")
def op5_fm_index(spark, sf_dir):
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                         window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@register("op6_line_blocks")
def op6_line_blocks(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@register("op7_language_fusion")
def op7_language_fusion(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@register("op8_token_rollups")
def op8_token_rollups(spark, sf_dir):
    """Four commits: all documents; those whose texts hold symbols lose them and are counted again; toxic ones are
    deleted; the deletion arrives a second time and is skipped."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
    files = {v: public_tokenizers.path(f) for v, f in names.items()}
    store = token_rollups.RollupStore(spark, f"{checkpoint_dir(spark)}/rollups-{uuid.uuid4().hex}")
    store.commit("load", token_rollups.changes(
        token_rollups.count_tokens(docs, files, public_tokenizers.PATTERN), "insert"))
    plain = docs.where(F.col("text").rlike("[#*$%&|<>]")).withColumn("text", F.regexp_replace("text", "[#*$%&|<>]", ""))
    store.commit("rewrite", token_rollups.changes(
        token_rollups.count_tokens(plain, files, public_tokenizers.PATTERN), "revise"))
    toxic = labels.where("toxic = 1").select("doc_id", F.explode(F.array(*map(F.lit, names))).alias("version"),
                                             F.lit(None).cast("string").alias("source"),
                                             F.lit(None).cast("string").alias("lang"), F.lit(0).alias("n_tokens"))
    store.commit("takedown", token_rollups.changes(toxic, "delete"))
    store.commit("takedown", token_rollups.changes(toxic, "delete"))
    return store.totals()


@register("op9_merge_replay")
def op9_merge_replay(spark, sf_dir):
    return bpe.encode_digest(table(spark, sf_dir, "documents"),
                             public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op10_risk_controlled")
def op10_risk_controlled(spark, sf_dir):
    report = quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_lines", "failed")


@register("op11_packing")
def op11_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), seq_len=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@register("op12_filter_audit", r"""
    WITH texts AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                      max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    failed AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
            || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text)
                THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
            || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
        FROM texts LEFT JOIN marked USING (doc_id)),
    counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT o, k, o[k] AS f, o[1:k - 1] AS done FROM orders, range(1, 6) r(k)),
    rows AS (
        SELECT part, o, k, f,
               sum(n) FILTER (fails = '' OR NOT regexp_matches(fails, '[' || done || f || ']')) AS kept,
               sum(n) FILTER (contains(fails, f) AND (done = '' OR NOT regexp_matches(fails, '[' || done || '0]'))) AS removed,
               sum(n) FILTER (contains(fails, f) AND regexp_matches(fails, '[' || done || '0]')) AS redundant,
               sum(n) FILTER (fails = f) AS unique_fails,
               sum(good) FILTER (contains(fails, f) AND NOT regexp_matches(fails, '[' || done || '0]')) AS good_lost,
               sum(toxic) FILTER (contains(fails, f) AND NOT regexp_matches(fails, '[' || done || '0]')) AS toxic_lost
        FROM counted, steps GROUP BY part, o, k, f)
    SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
           CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
           CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
           CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM rows""")
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@register("op13_resampling", rf"""
    WITH crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(range(8),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
    docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    aims AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    own AS (SELECT doc_id, unnest(w) AS x FROM docs),
    wanted AS (SELECT unnest(w) AS x FROM aims),
    words AS (SELECT DISTINCT x FROM (SELECT x FROM own UNION ALL SELECT x FROM wanted)),
    placed AS (
        SELECT x, xor(list_reduce(list_transform(range(0, length(hex(x)), 2),
                   lambda k: CAST('0x' || substr(hex(x), k + 1, 2) AS BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
        FROM words, crc),
    s AS (SELECT b, count(*) AS n FROM own JOIN placed USING (x) GROUP BY b),
    t AS (SELECT b, count(*) AS n FROM wanted JOIN placed USING (x) GROUP BY b),
    gain AS (
        SELECT p.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM own) + 10000)
                   / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM wanted) + 10000)))) AS BIGINT) AS g
        FROM (SELECT DISTINCT b FROM placed) p LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
    scored AS (
        SELECT doc_id, len(any_value(w)) AS n, CAST(coalesce(floor(sum(g)::DOUBLE / count(g)), 0) AS BIGINT) AS weight
        FROM docs LEFT JOIN own USING (doc_id) LEFT JOIN placed USING (x) LEFT JOIN gain USING (b) GROUP BY doc_id),
    noised AS (
        SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                               / 4294967296))) AS BIGINT) AS score FROM scored),
    drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM noised WHERE n >= 20)
    SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
           CASE WHEN rank <= 10 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
    FROM noised LEFT JOIN drawn USING (doc_id)""")
def op13_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
