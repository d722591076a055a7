"""Byte-level BPE by merge replay over a shard of the corpus.

A task's documents form shards. The distinct pretokens of a shard are laid out as one array of byte symbols
with links to their neighbours, and an inverted index takes each rank to the positions whose pair merges to it.
Ranks are replayed in ascending order from a heap; a merge touches only the merged positions and their
neighbours, whose new pairs enter the index. Documents are then put together from their pretokens' ids.

The replay equals merging the lowest rank of each pretoken step by step, leftmost first:

* all places of a rank are merged at once if no pair made by the merge can have a lower or equal rank;
* the few ranks for which the vocabulary allows such a pair (``eager``) merge one place per pretoken at a time,
  so that the lower rank goes first.

Why per shard: an index over the whole corpus needs each occurrence of a pretoken to be joined with its ids,
which shuffles every word of every text; here nothing is shuffled and a hot source or a group of copies costs
nothing extra. The vocabulary (at most MAX_RANKS ranks, checked) is read by the driver and broadcast.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from jobsight.session import limit_arrow_batches

MAX_RANKS = 1 << 20
SHARD_BYTES = 4 << 20
NONE = np.int32(2 ** 31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, of a file with a base64 token and its rank on each line."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if len(ranks) > MAX_RANKS or sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps and stay under MAX_RANKS")
    return [ranks[i] for i in range(len(ranks))]


class Merges:
    """The merge table: which pair of tokens makes which token, and the eager ranks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys, values, eager = [], [], set()
        for r, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
                    eager.update(x for x in (a, b) if x >= r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int32)[order]
        self.eager = eager

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE).astype(np.int32)


def _add(index: dict, heap: list, ranks: np.ndarray, places: np.ndarray) -> None:
    if len(places) > 1:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        parts, firsts = np.split(places, cuts), ranks[np.concatenate(([0], cuts))].tolist()
    else:
        parts, firsts = [places], ranks.tolist()
    for r, part in zip(firsts, parts):
        if r in index:
            index[r].append(part)
        else:
            index[r] = [part]
            heapq.heappush(heap, r)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Ascending, without repeats. Sorting is quicker here than the hash table of np.unique: stretches are in order."""
    values = np.sort(values, kind="stable")
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def replay(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the ids of word i are ids[bounds[i]:bounds[i + 1]]."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    n = int(begin[-1])
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    # position n stands for "no neighbour"
    sym = np.append(m.byte[np.frombuffer(b"".join(words), np.uint8)], -1)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    nxt = np.arange(1, n + 2, dtype=np.int32)
    prv = np.arange(-1, n, dtype=np.int32)
    held = lengths > 0
    nxt[begin[1:][held] - 1] = n
    prv[begin[:-1][held]] = n
    nxt[n] = prv[n] = n
    alive = np.ones(n + 1, bool)
    alive[n] = False
    pair = np.full(n + 1, NONE, np.int32)
    at = np.flatnonzero(nxt[:n] < n)
    pair[at] = m.rank_of(sym[at], sym[nxt[at]])
    at = at[pair[at] < NONE].astype(np.int32)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    if len(at):
        _add(index, heap, pair[at], at)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        left = found[0] if len(found) == 1 else _distinct(np.concatenate(found))
        left = left[pair[left] == r]
        if not len(left):
            continue
        if len(left) > 1:
            if r in m.eager:
                w = word[left]
                first = np.concatenate(([True], w[1:] != w[:-1]))
                rest, left = left[~first], left[first]
                if len(rest):
                    _add(index, heap, pair[rest], rest)
            else:
                follows = np.concatenate(([False], nxt[left[:-1]] == left[1:]))
                if follows.any():  # a run of overlapping places: every second one, from the left
                    place = np.arange(len(left))
                    start = np.maximum.accumulate(np.where(follows, 0, place))
                    left = left[(place - start) % 2 == 0]
        gone = nxt[left]
        after = nxt[gone]
        sym[left] = r
        nxt[left] = after
        prv[after] = left
        prv[n] = n
        alive[gone] = False
        pair[gone] = NONE
        before = prv[left]
        touched = np.concatenate((left, before[before < n]))
        if len(left) > 1:
            touched = _distinct(touched)
        right = nxt[touched]
        new = np.where(right < n, m.rank_of(sym[touched], sym[right]), NONE).astype(np.int32)
        pair[touched] = new
        some = new < NONE
        if some.any():
            _add(index, heap, new[some], touched[some])
    ids = sym[:n][alive[:n]]
    return ids, np.concatenate(([0], np.cumsum(alive[:n])))[begin]


def units(texts: list[str], pattern) -> tuple[list[list[int]], list[list[str]]]:
    """(units of each text, pretokens of each distinct unit).

    A single space between two other characters always begins a pretoken, so a text is first split there and the
    pattern runs once for each distinct piece. A unit is a piece after such a space, or " " and the piece that
    begins a text, or two spaces and a pretoken. A text in which white space touches one of its spaces is cut by
    the pattern as a whole.
    """
    number = defaultdict(count().__next__)
    unit = number.__getitem__
    docs, unsafe, seen = [], set(), 0
    for t in texts:
        head, *rest = t.split(" ")
        if head:
            rest[:0] = [" " + head]
        doc = list(map(unit, rest))
        if len(number) > seen:
            for c in islice(reversed(number), len(number) - seen):
                if not c or c[0 if c[0] != " " else 1].isspace() or c[-1].isspace():
                    unsafe.add(number[c])
            seen = len(number)
        if unsafe and not unsafe.isdisjoint(doc):
            doc = [unit("  " + w) for w in pattern.findall(t)]
            seen = len(number)
        docs.append(doc)
    cut = pattern.findall
    return docs, [[c[2:]] if c[:2] == "  " else cut(c[1:]) if c[:1] == " " else cut(" " + c) for c in number]


def encode_shard(texts: list[str], m: Merges, pattern) -> tuple[list[list[int]], list[list[int]]]:
    """(units of each text, ids of each unit): a text's ids are those of its units, one after the other."""
    docs, pretokens = units(texts, pattern)
    number = defaultdict(count().__next__)
    parts = [list(map(number.__getitem__, p)) for p in pretokens]
    words = [w.encode("utf-8", "surrogatepass") for w in number]
    del pretokens, number  # each takes several times the bytes of the texts, and the replay needs none
    ids, bounds = replay(words, m)
    del words
    each, cuts = ids.tolist(), bounds.tolist()
    spans = [each[a:b] for a, b in zip(cuts, cuts[1:])]
    return docs, [spans[p[0]] if len(p) == 1 else list(chain.from_iterable([spans[w] for w in p])) for p in parts]


def decode(ids, tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in ids])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about SHARD_BYTES, or of one longer text."""
    for batch in batches:
        texts, lo, size = batch.column(1), 0, 0
        for i, k in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
            if size + k > SHARD_BYTES and i > lo:
                yield batch.column(0).slice(lo, i - lo), [t or "" for t in texts.slice(lo, i - lo).to_pylist()]
                lo, size = i, 0
            size += k
        if lo < len(texts):
            yield batch.column(0).slice(lo), [t or "" for t in texts.slice(lo).to_pylist()]


@contextmanager
def no_cycle_search():
    """Without Python's search for reference cycles: a shard's lists hold none, and it walks all of them many times."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _merges(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


_cache: dict = {}


def _table(shared) -> Merges:
    """One merge table per worker process."""
    tokens = shared.value
    if _cache.get("tokens") is not tokens:
        _cache.update(tokens=tokens, merges=Merges(tokens))
    return _cache["merges"]


def _gather(docs: list[list[int]], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds): the units' ids, laid one after the other for each text."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
    units = np.fromiter(chain.from_iterable(docs), np.int64, sum(map(len, docs)))
    each = sizes[units]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat((np.cumsum(sizes) - sizes)[units] - (ends - each), each)
    of_doc = np.concatenate(([0], np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)))))
    return flat[at], np.concatenate(([0], ends))[of_doc]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>, round_trip): the token ids of each text, and whether they decode to it.
    A null text has no ids; other columns are left out."""
    limit_arrow_batches(docs.sparkSession)
    shared = _merges(docs.sparkSession, path)

    def shard(key, texts, m, cut):
        parts, ids = encode_shard(texts, m, cut)
        back = [decode(x, m.tokens) for x in ids]
        same = [b"".join([back[u] for u in d]) == t.encode("utf-8", "surrogatepass") for d, t in zip(parts, texts)]
        flat, bounds = _gather(parts, ids)
        return pa.RecordBatch.from_arrays(
            [key, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
             pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids", "round_trip"])

    def run(batches):
        m, cut = _table(shared), regex.compile(pattern)
        for key, texts in shards(batches):
            with no_cycle_search():
                out = shard(key, texts, m, cut)  # a shard's tables go before the next one's are made
            yield out

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, n_tokens long, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def encode_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip): encode each text, decode its ids again, and
    compare; the ids themselves never leave the task."""
    limit_arrow_batches(docs.sparkSession)
    shared = _merges(docs.sparkSession, path)

    def shard(key, texts, m, cut):
        parts, ids = encode_shard(texts, m, cut)
        sizes = [len(x) for x in ids]
        shown = [",".join(map(str, x)).encode() for x in ids]
        back = [decode(x, m.tokens) for x in ids]
        sums, a, b, same = [], [], [], []
        for d, t in zip(parts, texts):
            sums.append(sum([sizes[u] for u in d]))
            a.append(hashlib.sha256(b",".join([shown[u] for u in d])).hexdigest())
            decoded = b"".join([back[u] for u in d])
            b.append(hashlib.sha256(decoded).hexdigest())
            same.append(decoded == t.encode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays(
            [key, pa.array(sums, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()),
             pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    def run(batches):
        m, cut = _table(shared), regex.compile(pattern)
        for key, texts in shards(batches):
            with no_cycle_search():
                out = shard(key, texts, m, cut)  # a shard's tables go before the next one's are made
            yield out

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
