"""Packing of tokenized documents into training sequences: first-fit decreasing with a tournament tree, by groups.

1. Tokens: one pass over the texts gives each document's ids and one end id, cut into pieces of ``seq_len`` ids and a
   rest of fewer. A whole piece is a sequence of its own. The pieces are numbered and written once to the shared
   folder, two bytes an id if the vocabulary allows, so nothing is tokenized twice and a repeated task changes nothing.
   The vocabulary is a byte-level BPE file of ``tokenizers``; its ids are the ranks of its merges, so the encoder of
   ``tiktoken`` gives the same ids at a fifth of the time (the tests compare both on every code point).
2. Groups: rests are dealt to groups by a seeded hash of their number, about GROUP_PIECES to a group. The number of
   groups follows the number of rests, so a group is bounded (16 MB of ids on average), whatever source, id or text is
   frequent.
3. First-fit decreasing in each group: by falling length, every rest goes to the first sequence with room. The
   sequences' free places are leaves of a tournament tree whose inner nodes hold the larger of their children, so the
   first fit is found and the tree mended along one path.
4. What FFD leaves open: the emptiest sequences of a group are cut to fill the gaps of the fullest; the one that is
   left over is split at powers of two, which need no padding. Only the rests of those few sequences are cut.

Edge cases: a null or empty text is its end id alone; an empty table gives no rows; rows that repeat an id or a whole
row are documents of their own; a null id stays null; other columns of the input are not read. Equal lengths go in
the order of the seeded hash, then of the number.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.tables import arrow_rows, written

#: rests in a group: at most 4,096 * 1,024 ids of 4 bytes, 16 MB, on average
GROUP_PIECES = 4096
BATCH_ROWS = 200
#: how the byte-level pre-tokenizer splits texts (fixed value)
BYTE_LEVEL_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: texts of a batch are tokenized and given out in slices of so many characters
SLICE_CHARS = 1 << 20


class TournamentTree:
    """Free places of up to ``size`` sequences; ``first_fit`` finds the first with at least ``need``."""

    def __init__(self, size: int, room: int):
        self.leaves = 1 << max(0, size - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first sequence with ``need`` free places, which are taken; -1 if there is none."""
        best = self.best
        if best[1] < need:
            return -1
        k = 1
        while k < self.leaves:
            k *= 2
            if best[k] < need:
                k += 1
        at = k - self.leaves
        best[k] -= need
        while k > 1:
            k //= 2
            best[k] = max(best[2 * k], best[2 * k + 1])
        return at


def first_fit_decreasing(lengths: np.ndarray, seq_len: int) -> list[list[int]]:
    """For each sequence the positions of its pieces in ``lengths``, which must fall."""
    tree = TournamentTree(len(lengths), seq_len)
    out: list[list[int]] = []
    for i, need in enumerate(lengths.tolist()):
        at = tree.first_fit(need)
        if at == len(out):
            out.append([])
        out[at].append(i)
    return out


def _cut(pieces: list[tuple[int, int, int]], sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """The first ``sum(sizes)`` ids of ``pieces``, in parts of these sizes; what is cut off stays in ``pieces``."""
    out = []
    for size in sizes:
        own = []
        while size:
            piece, a, b = pieces.pop(0)
            if b - a > size:
                pieces.insert(0, (piece, a + size, b))
                b = a + size
            own.append((piece, a, b))
            size -= b - a
        out.append(own)
    return out


def pack_group(lengths: np.ndarray, seq_len: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, to) for falling ``lengths``: FFD, then the emptiest sequences fill the others."""
    bins = [[(i, 0, int(lengths[i])) for i in own] for own in first_fit_decreasing(lengths, seq_len)]
    bins.sort(key=lambda own: sum(b - a for _, a, b in own), reverse=True)
    held = [sum(b - a for _, a, b in own) for own in bins]
    full, last = 0, len(bins) - 1
    while full < last:
        take = min(seq_len - held[full], held[last])
        if take:
            bins[full] += _cut(bins[last], [take])[0]
        held[full] += take
        held[last] -= take
        full += held[full] == seq_len
        last -= not held[last]
    n = held[full] if bins else 0
    return bins[:full] + _cut(bins[full], [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]) if n else []


def vocabulary(path: str) -> tuple[list[bytes], str]:
    """(tokens by id, pattern) of a byte-level BPE file of ``tokenizers`` whose ids follow the order of its merges.

    Anything else (other models, normalizers, prefix spaces, other splits) is an error.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    tokens = sorted(model["vocab"], key=model["vocab"].get)
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    known = (model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and spec["normalizer"] is None
             and not model.get("ignore_merges") and [model["vocab"][t] for t in tokens] == list(range(len(tokens)))
             and tokens[256:256 + len(merges)] == merges and len(tokens) == 256 + len(merges))
    if not known:
        raise ValueError(f"{path} is no plain byte-level BPE whose ids are the order of its merges")
    return [bytes(byte[c] for c in t) for t in tokens], BYTE_LEVEL_PATTERN


def id_type(n_tokens: int, end_id: int) -> np.dtype:
    """The shortest little-endian type of the ids."""
    return np.dtype("<u2" if max(n_tokens - 1, end_id) < 1 << 16 else "<u4")


def _wide(ids: bytes, code: np.dtype) -> bytes:
    return np.frombuffer(ids, code).astype("<u4").tobytes()


def tokenize(docs: DataFrame, path: str, seq_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, doc_tokens, start, length, ids): the pieces of each row, ids as little-endian integers."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    tokens, pattern = vocabulary(path)
    code = id_type(len(tokens), end_id)
    shared = docs.sparkSession.sparkContext.broadcast(tokens)  # a vocabulary, not data

    def run(batches):
        import tiktoken
        coder = tiktoken.Encoding("packing", pat_str=pattern, special_tokens={},
                                  mergeable_ranks={t: i for i, t in enumerate(shared.value)})
        piece = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= SLICE_CHARS:
                    size += len(texts[hi])
                    hi += 1
                row, totals, starts, ids = [], [], [], []
                for k in range(lo, hi):
                    own = np.array([*coder.encode_ordinary(texts[k]), end_id], code)
                    at = range(0, len(own), seq_len)
                    row += [k] * len(at)
                    totals += [len(own)] * len(at)
                    starts += at
                    ids += [own[a:a + seq_len].tobytes() for a in at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())),
                     pa.array(range(piece, piece + len(row)), pa.int64()), pa.array(totals, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array([len(x) // code.itemsize for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=["id", "piece", "doc_tokens", "start", "length", "ids"])
                piece += len(row)
                lo = hi

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece long, doc_tokens long, start long, length long, ids binary")


def pack(docs: DataFrame, path: str, seq_len: int = 1024, end_id: int = 0, seed: int = 7,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents in their sequences.

    ``path`` is a file of the ``tokenizers`` library that every executor can read; ``seq_len`` a power of two.
    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; ``ids`` are little-endian uint32.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        pieces = written(tokenize(docs, path, seq_len, end_id, id_col, text_col))
    rests = pieces.where(F.col("length") < seq_len)
    groups = max(1, -(-rests.count() // GROUP_PIECES))
    order = F.xxhash64(F.lit(seed), "piece")
    code = id_type(len(vocabulary(path)[0]), end_id)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def widen(batches):
        for batch in batches:
            ids = pa.array([_wide(x, code) for x in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids, *batch.columns[4:]], names=names)

    kind = pieces.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    # whole pieces have even sequence numbers, groups odd ones
    whole = pieces.where(F.col("length") == seq_len).select(
        "id", "start", "length", "ids", "doc_tokens", (2 * F.col("piece")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset")).mapInArrow(widen, schema)

    def place(table: pa.Table) -> pa.Table:
        length, start = table["length"].to_numpy(), table["start"].to_numpy()
        by = np.lexsort((table["piece"].to_numpy(), table["order"].to_numpy(), -length))
        ids = [_wide(x, code) for x in table["ids"].to_pylist()]
        first = table["group"][0].as_py() << 32
        row, begin, size, part, number, offset = [], [], [], [], [], []
        for k, own in enumerate(pack_group(length[by], seq_len)):
            at = 0
            for i, a, b in own:
                j = int(by[i])
                row.append(j)
                begin.append(int(start[j]) + a)
                size.append(b - a)
                part.append(ids[j][4 * a:4 * b])
                number.append(2 * (first + k) + 1)
                offset.append(at)
                at += b - a
        taken = pa.array(row, pa.int64())
        return pa.table({"id": table["id"].take(taken), "start": pa.array(begin, pa.int64()),
                         "length": pa.array(size, pa.int64()), "ids": pa.array(part, pa.binary()),
                         "doc_tokens": table["doc_tokens"].take(taken), "sequence_id": pa.array(number, pa.int64()),
                         "offset": pa.array(offset, pa.int64())})

    grouped = (rests.withColumn("order", order).withColumn("group", F.pmod("order", F.lit(groups)))
               .groupBy("group").applyInArrow(place, schema))
    return whole.union(grouped).withColumnRenamed("id", id_col)
