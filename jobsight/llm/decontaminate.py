"""Benchmark decontamination: each shard of the corpus gets an FM-index, and benchmark phrases are searched in it.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z. A phrase is ``window`` consecutive words of an
item, or all its words if it has fewer. A shard is a stretch of a task's documents; its index holds those runs of
words that could contain a phrase: all words from the benchmark's vocabulary, and at least as many as the
shortest phrase (any other word lies in no occurrence). Backward search through wavelet-tree ranks gives each
phrase's rows, sampled suffix positions locate them, and overlapping occurrences merge to removal spans.

Nothing is shuffled, so a hot source or a group of copies costs no more than other rows. The benchmark is read
in blocks of at most about BLOCK_BYTES of text (their number follows its measured size); a block's phrases are
broadcast, documents pass through one block after the other, and their spans and items add up. A corpus pass
over several blocks is cut by checkpoints, so that only one block is held at a time.

Edge cases: null or empty texts and items have no words; repeated rows and items are treated one by one (an
item_id that repeats is one item); items without an id are reported as "null"; columns other than id and text
do not matter and are returned as they are by ``remove_benchmark``.
"""

from __future__ import annotations


from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.fm_index import FmIndex
from jobsight.llm.tables import share, shared_value
from jobsight.llm.words import ALNUM, word_blocks
from jobsight.session import checkpoint_dir, limit_arrow_batches

BLOCK_BYTES = 16 << 20
SHARD_SYMBOLS = 1 << 20
SHARD_BYTES = 16 << 20


class Phrases(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes; symbol k + 1 is vocabulary[k]
    groups: list  # (symbols of phrases of one length, first row of each phrase in ``owners``)
    shortest: int


def phrases_of(items: list[tuple[str, str | None]], window: int) -> tuple[Phrases, list[str]]:
    """The phrases of a block of items and the ids their owners' numbers stand for."""
    ids = sorted({"null" if i is None else str(i) for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    seen: dict[int, dict[bytes, set]] = {}
    words = []
    for b in word_blocks(pa.array([t for _, t in items], pa.large_string()), ALNUM, True):
        for d in range(b.hi - b.lo):
            words.append(b.hashes[b.bounds[d]:b.bounds[d + 1]])
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    for (i, _), w in zip(items, words):
        if not len(w):
            continue
        symbols = (np.searchsorted(vocabulary, w) + 1).astype(np.int64)
        k = min(window, len(symbols))
        owner = number["null" if i is None else str(i)]
        for at in range(len(symbols) - k + 1):
            seen.setdefault(k, {}).setdefault(symbols[at:at + k].tobytes(), set()).add(owner)
    groups = []
    for k, own in sorted(seen.items()):
        rows = np.frombuffer(b"".join(own), np.int64).reshape(-1, k)
        groups.append((rows, [np.array(sorted(x)) for x in own.values()]))
    return Phrases(vocabulary, groups, min(seen, default=0)), ids


def _symbols(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


class _Shard:
    """Documents whose words wait for the index: runs of symbols, and where their words are."""

    def __init__(self):
        self.n_words, self.spans, self.runs, self.homes = [], [], [], []
        self.words = self.size = 0

    def add(self, block, p: Phrases) -> None:
        """``spans`` holds byte positions in its document for the words of runs only."""
        bounds, base = block.bounds, self.words
        self.n_words += np.diff(bounds).tolist()
        symbols = _symbols(block.hashes, p.vocabulary)
        known = symbols > 0
        edge = np.zeros(len(known) + 1, bool)
        edge[bounds] = True  # a run ends with its document
        before = np.concatenate(([False], known[:-1])) & ~edge[:-1] if len(known) else known
        after = np.concatenate((known[1:], [False])) & ~edge[1:] if len(known) else known
        starts = np.flatnonzero(known & ~before)
        ends = np.flatnonzero(known & ~after) + 1
        long = ends - starts >= max(1, p.shortest)
        starts, ends = starts[long], ends[long]
        first_doc = len(self.n_words) - (len(bounds) - 1)
        if len(starts):
            sizes = ends - starts + 1  # and the closing 0
            total = int(sizes.sum())
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at = np.arange(total) - np.repeat(begin - starts, sizes)
            closing = begin + sizes - 1
            text = symbols[np.minimum(at, len(symbols) - 1)]
            text[closing] = 0
            doc = np.repeat(np.searchsorted(bounds, starts, side="right") - 1, sizes)
            word = np.minimum(at, len(symbols) - 1)
            self.runs.append(text)
            self.homes.append(np.stack([doc + first_doc, word - bounds[doc], block.starts[word] - block.offsets[doc],
                                        block.ends[word] - block.offsets[doc]]))
            self.size += total
        self.words = base + len(symbols)

    def hits(self, p: Phrases, ids: list[str]) -> tuple[dict, dict]:
        """(document -> merged spans of (first word, words, first byte, end byte), document -> items)."""
        if not self.runs:
            return {}, {}
        text = np.concatenate(self.runs)
        home = np.concatenate(self.homes, axis=1)
        index = FmIndex(text, len(p.vocabulary) + 1)
        covered = np.zeros(len(text) + 1, np.int32)
        items: dict[int, set] = {}
        for rows, owners in p.groups:
            lo, hi = index.search(rows)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            sizes = (hi - lo)[found]
            which = np.repeat(found, sizes)
            row = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - lo[found], sizes)
            at = index.locate(row)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + rows.shape[1], -1)
            pairs = np.unique(home[0][at] * len(rows) + which)
            for d, w in zip((pairs // len(rows)).tolist(), (pairs % len(rows)).tolist()):
                items.setdefault(d, set()).update(owners[w].tolist())
        hit = np.cumsum(covered[:-1]) > 0
        starts = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
        ends = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
        spans: dict[int, list] = {}
        for a, b in zip(starts.tolist(), ends.tolist()):
            spans.setdefault(int(home[0][a]), []).append(
                (int(home[1][a]), b - a + 1, int(home[2][a]), int(home[3][b])))
        return spans, {d: {ids[k] for k in own} for d, own in items.items()}


def _scan(batches: Iterator[pa.RecordBatch], text: int, shared):
    """(batch, n_words, spans by row, items by row) of each stretch of rows that makes a shard."""
    p, ids = shared_value(shared)
    for batch in batches:
        column = batch.column(text)
        shard, lo, size = _Shard(), 0, 0
        for block in word_blocks(column, ALNUM, True):
            shard.add(block, p)
            size += len(block.data)
            if shard.size >= SHARD_SYMBOLS or size >= SHARD_BYTES or block.hi == len(column):
                spans, items = shard.hits(p, ids)
                yield batch.slice(lo, block.hi - lo), shard.n_words, spans, items
                shard, lo, size = _Shard(), block.hi, 0


def _n_blocks(benchmark: DataFrame, text_col: str) -> int:
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return -(-total // BLOCK_BYTES) or 1


def _block(benchmark: DataFrame, k: int, n: int, window: int, item_col: str, text_col: str):
    """The phrase table of block ``k`` of ``n`` of the items, broadcast. The driver holds one block at a time."""
    at = F.pmod(F.xxhash64(F.col(item_col), F.col(text_col)), F.lit(n))
    rows = benchmark.where(at == k).select(item_col, text_col).collect()
    return share(benchmark.sparkSession, phrases_of([tuple(r) for r in rows], window))


def _merge(spans: list) -> list:
    """Spans of several blocks: those that touch or overlap, by words, become one."""
    out: list = []
    for w, n, a, b in sorted(spans):
        if out and w <= out[-1][0] + out[-1][1]:
            w0, n0, a0, b0 = out[-1]
            out[-1] = (w0, max(n0, w + n - w0), a0, max(b0, b))
        else:
            out.append((w, n, a, b))
    return out


_SPAN = pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_SQL = "array<struct<word:bigint,n_words:bigint,start:bigint,end:bigint>>"


def _span_array(rows: list[list]) -> pa.Array:
    return pa.array([[dict(zip(("word", "n_words", "start", "end"), s)) for s in own] for own in rows], pa.list_(_SPAN))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, spans): spans in word numbers and UTF-8 byte positions [start, end)."""
    checkpoint_dir(docs.sparkSession)
    limit_arrow_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, items array<string>, spans {_SPAN_SQL}"
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
                     F.array().cast("array<string>").alias("items"), F.array().cast(_SPAN_SQL).alias("spans"))
    blocks = _n_blocks(benchmark, item_text_col)
    for k in range(blocks):
        shared, last = _block(benchmark, k, blocks, window, item_col, item_text_col), k == blocks - 1

        def run(batches, shared=shared, last=last):
            for batch, n_words, spans, items in _scan(batches, 1, shared):
                n = batch.num_rows
                own_items = batch.column(3).to_pylist()
                own_spans = batch.column(4).to_pylist()
                texts = pa.nulls(n, batch.schema.field(1).type) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), texts, pa.array(n_words, pa.int64()),
                    pa.array([sorted({*own_items[i], *items.get(i, ())}) for i in range(n)], pa.list_(pa.string())),
                    _span_array([_merge([tuple(x.values()) for x in own_spans[i]] + spans.get(i, []))
                                 for i in range(n)])], names=["id", "text", "n_words", "items", "spans"])

        df = df.mapInArrow(run, schema)
        if not last:
            df = df.checkpoint()
            shared.unpersist()
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n_words"])
    return df.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "items", "spans")


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with every occurrence of a benchmark phrase cut out of the text; rows and columns as they were."""
    checkpoint_dir(docs.sparkSession)
    limit_arrow_batches(docs.sparkSession)
    at, name = docs.columns.index(text_col), "spans"
    while name in docs.columns:
        name = "_" + name
    df = docs.withColumn(name, F.array().cast(_SPAN_SQL))
    blocks = _n_blocks(benchmark, item_text_col)
    for k in range(blocks):
        shared, last = _block(benchmark, k, blocks, window, item_col, item_text_col), k == blocks - 1

        def run(batches, shared=shared, last=last):
            for batch, _, spans, _ in _scan(batches, at, shared):
                before = [[tuple(x.values()) for x in own] for own in batch.column(len(batch.columns) - 1).to_pylist()]
                merged = [_merge(own + spans.get(i, [])) for i, own in enumerate(before)]
                columns = batch.columns[:-1]
                if not last:
                    columns.append(_span_array(merged))
                elif any(merged):
                    texts = columns[at].to_pylist()
                    for i, own in enumerate(merged):
                        if own:
                            raw = texts[i].encode("utf-8")
                            cuts = [0, *(x for s in own for x in s[2:]), len(raw)]
                            texts[i] = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode("utf-8")
                    columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:len(columns)])

        df = df.mapInArrow(run, docs.schema if last else df.schema)
        if not last:
            df = df.checkpoint()
            shared.unpersist()
    return df
