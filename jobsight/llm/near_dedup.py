"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimate, exact check.

Words are [^\\x20\\x09-\\x0D]+ after A-Z became a-z; a document's set holds its distinct ``shingle_words``-word
shingles (as 64-bit hashes), or its whole word sequence as one if it has fewer words. Documents link if
100 * |A & B| >= threshold * |A | B|, and components of links are groups.

1. One pass over the texts gives each document BUCKETS registers. A bucket has a permutation of its own (so that
   a text of one shingle fills all of them) and keeps the least hash as its count of leading zeros and its next
   MANTISSA bits: 16 bits instead of 64.
2. Documents with equal sets are one class from here on (a partial aggregate); the least id stands for it.
3. Bands of ROWS compressed registers are hashed. At similarity 0.8 a pair misses all 32 bands of 4 with
   probability 5e-8.
4. Within a band's bucket nothing is paired with everything. Members are compared with one centre and components are
   taken; as long as buckets hold many pairs across components, the members outside a bucket's largest component are
   compared with CENTRES of its members. What is left after CENTRE_ROUNDS rounds at most (members of one bucket in
   different components) meets inside the bucket, but for pairs that the triangle inequality of the Jaccard distance
   excludes; the registers travel with the members, so that a pair is estimated inside the join and only survivors
   leave it. Hot buckets are dealt to row and column blocks. So no link between different texts is lost, and a group
   of copies costs a few comparisons per member.
5. A comparison first estimates the similarity from registers, less the collisions that registers of different
   hashes have by chance; pairs more than 5 standard deviations under the threshold are dropped. All others are
   confirmed on the full sets. Only members with a measured distance to one centre skip the estimate: they are compared
   on their full sets, in tiles.

Edge cases: null or empty texts, and texts without words, have an empty set and link with nothing; rows that
repeat an id are one document, represented by its smallest (set size, set hash) and reported once; rows without
an id are not linked, are reported one by one with a null component, and are kept. Only the id and text columns
are read. Ties between members of a group go to the least id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.components import components, salted_join
from jobsight.llm.tables import arrow_rows, free_name, written
from jobsight.llm.words import SPACED, Block, mix, shingles, word_blocks

BUCKETS = 128
ROWS = 4
MANTISSA = 8
BATCH_ROWS = 1000
CENTRE_ROUNDS = 2
#: centres of a bucket in the rounds after the first
CENTRES = 4
#: stands for a similarity under 2 * threshold - 1 that was not measured
FAR = -1.0
#: the last comparisons take sets of at most SMALL_SET shingles in tiles of TILE times TILE documents
SMALL_SET = 2048
TILE = 512
#: members of a bucket in a row or column block of the last join
HEAVY = 1000
#: registers estimate a similarity s with variance s (1 - s) / BUCKETS
MARGIN = 5 * (0.25 / BUCKETS) ** 0.5 * 0.8
_MULTIPLIERS = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def block_shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the shingles of document i are hashes[bounds[i]:bounds[i + 1]], with repeats."""
    sizes = np.diff(block.bounds)
    count = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(int(bounds[-1])) + np.repeat(block.bounds[:-1] - bounds[:-1], count)
    out = np.zeros(len(at), np.uint64)
    if len(block.hashes) >= n:
        rolled = shingles(block.hashes, n)
        out = rolled[np.minimum(at, len(rolled) - 1)]
    for i in np.flatnonzero((sizes > 0) & (sizes < n)):
        out[bounds[i]] = shingles(block.hashes[block.bounds[i]:block.bounds[i + 1]], n)[0]
    return out, bounds


def distinct_shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``block_shingles``, without repeats and in ascending order."""
    values, bounds = block_shingles(block, n)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(bounds)))


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BUCKETS compressed registers for each non-empty stretch of hashes that begins at ``starts``."""
    least = np.empty((BUCKETS, len(starts)), np.uint64)
    for k in range(BUCKETS):
        v = values * _MULTIPLIERS[k]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        least[k] = np.minimum.reduceat(v, starts)
    # leading zeros from the exponent of the upper 53 bits, which convert without rounding
    upper = least >> np.uint64(11)
    zeros = 53 - np.frexp(upper.astype(np.float64))[1]
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << MANTISSA | mantissa.astype(np.uint16)).T


def set_hash(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each document's distinct hashes; equal sets have equal sums."""
    a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values))))
    return ((a[bounds[1:]] - a[bounds[:-1]]).view(np.int64), (b[bounds[1:]] - b[bounds[:-1]]).view(np.int64))


def signatures(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, a, b, registers): set size, set hash and registers of each row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block in word_blocks(batch.column(1), SPACED, True):
                values, bounds = distinct_shingles(block, shingle_words)
                n = np.diff(bounds)
                regs = np.full(len(n), None, object)
                held = np.flatnonzero(n)
                if len(held):
                    regs[held] = [row.tobytes() for row in registers(values, bounds[:-1][held])]
                a, b = set_hash(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(n, pa.int64()),
                     pa.array(a), pa.array(b), pa.array(regs.tolist(), pa.binary())],
                    names=["id", "n", "a", "b", "registers"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n long, a long, b long, registers binary")


def _sets(docs: DataFrame, wanted: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, a, b)."""
    # the small side is hashed, so that the texts need no sort
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(
        wanted.hint("shuffle_hash"), "node")
    kind = wanted.select("node").schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block in word_blocks(batch.column(1), SPACED, True):
                values, bounds = distinct_shingles(block, shingle_words)
                a, b = set_hash(values, bounds)
                lo, n = block.lo, block.hi - block.lo
                same = ((a == np.asarray(batch.column(2).slice(lo, n))) &
                        (b == np.asarray(batch.column(3).slice(lo, n))))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), lists], names=["node", "shingles"])
                yield out.filter(pa.array(same))

    return texts.select("node", "text", "a", "b").mapInArrow(run, f"node {kind}, shingles array<long>")


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two tables of registers, corrected for chance collisions.

    Registers of two different hashes with n and m elements below them are equal with probability
    nm / (n + m)^2 * 2^-MANTISSA / (2 ln 2), their least values being nearly exponential.
    """
    equal = (left == right).mean(axis=1)
    n, m = n.astype(float), m.astype(float)
    chance = n * m / (n + m) ** 2 * 2.0 ** -MANTISSA / (2 * np.log(2))
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) with their estimate and set sizes."""
    kind = pairs.select("u").schema[0].dataType.simpleString()
    one = classes.select("node", "n", "registers")
    # merge joins: no hash table of document data is built on the driver, and hot centres can be split
    both = (pairs.join(one.withColumnsRenamed({"node": "u", "n": "nu", "registers": "ru"}).hint("merge"), "u")
            .join(one.withColumnsRenamed({"node": "v", "n": "nv", "registers": "rv"}).hint("merge"), "v")
            .select("u", "v", "nu", "nv", "ru", "rv"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                    for k in (4, 5))
            s = estimate(x, y, np.asarray(batch.column(2)), np.asarray(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(s)], names=["u", "v", "nu", "nv", "s"])

    return both.mapInArrow(run, f"u {kind}, v {kind}, nu long, nv long, s double")


def _with_lanes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the registers as an array of numbers in place of their bytes (column ``registers``)."""
    at = nodes.columns.index("registers")

    def run(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.int16)
            lanes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BUCKETS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lanes, *batch.columns[at + 1:]], names=batch.schema.names)

    schema = ", ".join(f"{f.name} {'array<short>' if f.name == 'registers' else f.dataType.simpleString()}"
                       for f in nodes.schema)
    return nodes.mapInArrow(run, schema)


def _near_enough(x: str, y: str, least: float):
    """Whether the estimate of two rows with registers as arrays reaches ``least``: ``estimate`` as a Column."""
    n, m = F.col(f"{x}n").cast("double"), F.col(f"{y}n").cast("double")
    chance = n * m / ((n + m) * (n + m)) * (2.0 ** -MANTISSA / (2 * float(np.log(2))))
    equal = F.size(F.filter(F.zip_with(f"{x}registers", f"{y}registers", lambda a, b: a == b), lambda e: e)) / BUCKETS
    return (equal - chance) / (1 - chance) >= least


def _met(rows: DataFrame, key: str, held: str, outside, condition):
    """Pairs (u, v, nu, nv) of ``rows`` with the same key that meet ``condition`` on their columns x_* and y_*; x rows
    are ``outside``.

    ``held`` says how many rows a key has. Those of a key with more than HEAVY fall into row blocks as x and into column
    blocks as y, and every pair of blocks is a join key of its own.
    """
    blocks = F.ceil(F.col(held) / HEAVY).cast("int")
    own, every = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))

    def side(df, name, mine, other):
        placed = df.withColumn(mine, own).withColumn(other, every)
        return placed.select(key, "row_block", "col_block",
                             *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (key, held)])

    x = side(rows if outside is None else rows.where(outside), "x", "row_block", "col_block")
    y = side(rows, "y", "col_block", "row_block")
    return x.join(y.hint("merge"), [key, "row_block", "col_block"]).where(condition).select(
        F.col("x_node").alias("u"), F.col("y_node").alias("v"), F.col("x_n").alias("nu"), F.col("y_n").alias("nv"))


def _exact(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, common, united) from the full sets of pairs (u, v, nu, nv)."""
    return (near.join(sets.withColumnsRenamed({"node": "u", "shingles": "x"}).hint("merge"), "u")
            .join(sets.withColumnsRenamed({"node": "v", "shingles": "y"}).hint("merge"), "v")
            .select("u", "v", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), "nu", "nv")
            .select("u", "v", "common", (F.col("nu") + F.col("nv") - F.col("common")).alias("united")))


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v, similarity): exact for pairs whose estimate reaches ``least``, else null."""
    est = written(_estimated(pairs, classes))
    exact = _exact(est.where(F.col("s") >= least).select("u", "v", "nu", "nv"), sets)
    far = est.where(F.col("s") < least).select("u", "v", F.lit(None).cast("long").alias("common"),
                                               F.lit(None).cast("long").alias("united"))
    return exact.union(far)


def _links(compared: DataFrame, threshold: int) -> DataFrame:
    return compared.where(100 * F.col("common") >= threshold * F.col("united")).select("u", "v")


def _tile_links(known: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) between members of one centre in different components, one of them outside the largest.

    Members outside the largest component are dealt to ``xs`` blocks, all members to ``ys`` blocks of about TILE; a
    task compares one block with another, on full sets, by one product of their incidence matrices. Only sets of at
    most SMALL_SET shingles are compared here.
    """
    small = known.where(F.col("n") <= SMALL_SET).select("centre", "node", "label", "n", "shingles", "largest", "xs", "ys")
    x = small.where("label <> largest").select(
        "centre", F.pmod(F.xxhash64("node"), "xs").cast("int").alias("xb"),
        F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("yb"), F.lit(True).alias("outside"), "node", "label", "n", "shingles")
    y = small.select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"),
        F.pmod(F.xxhash64("node"), "ys").cast("int").alias("yb"), F.lit(False).alias("outside"), "node", "label", "n", "shingles")

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        out = tile["outside"].to_numpy(zero_copy_only=False)
        label, n, node = (tile[c].to_numpy() for c in ("label", "n", "node"))
        lists = tile["shingles"].combine_chunks()
        values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(out)), sizes)
        mine = out[row]
        shared = np.intersect1d(values[mine], values[~mine])
        at = np.searchsorted(shared, values)
        held = (at < len(shared))
        held[held] = shared[at[held]] == values[held]
        row, at = row[held], at[held]
        place = np.empty(len(out), np.int64)
        place[out], place[~out] = np.arange(out.sum()), np.arange((~out).sum())
        common = np.zeros((int(out.sum()), int((~out).sum())), np.float32)
        for lo in range(0, len(shared), 4096):
            part = (at >= lo) & (at < lo + 4096)
            width = min(4096, len(shared) - lo)
            sides = []
            for flag, k in ((True, common.shape[0]), (False, common.shape[1])):
                own = part & (out[row] == flag)
                m = np.zeros((k, width), np.float32)
                m[place[row[own]], at[own] - lo] = 1
                sides.append(m)
            common += sides[0] @ sides[1].T
        union = n[out][:, None] + n[~out][None, :] - common
        i, j = np.nonzero((100 * common >= threshold * union) & (label[out][:, None] != label[~out][None, :]))
        kept = tile.schema.field("node").type
        return pa.table({"u": pa.array(node[out][i], kept), "v": pa.array(node[~out][j], kept)})

    kind = known.select("node").schema[0].dataType.simpleString()
    return x.union(y).groupBy("centre", "xb", "yb").applyInArrow(compare, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): the group of each document; ``kept`` is its least id.

    ``threshold`` is in per cent, 80 or more (the bands are laid out for that).
    """
    if not 80 <= threshold <= 100:
        raise ValueError("threshold must be from 80 to 100")
    distance = 1 - threshold / 100
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = written(signatures(docs, shingle_words, id_col, text_col))
    # one document per id; equal sets are one class
    found = written(rows.where(F.col("id").isNotNull()).groupBy("id")
             .agg(F.min(F.struct("n", "a", "b", "registers")).alias("s")).select("id", "s.*"))
    classes = written(found.where(F.col("n") > 0).groupBy("a", "b", "n")
               .agg(F.min("id").alias("node"), F.first("registers").alias("registers")))
    size = 2 * ROWS
    keys = F.expr(f"transform(sequence(0, {BUCKETS // ROWS - 1}), "
                  f"i -> xxhash64(i, substring(registers, i * {size} + 1, {size})))")
    bands = classes.select("node", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = written(salted_join(bands, shared, "band", "node"))
    scores = members.groupBy("node").agg(F.sum("n").alias("score")).join(
        classes.select("node", "a", "b").hint("merge"), "node")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        sets = written(_sets(docs, scores.select("node", "a", "b"), shingle_words, id_col, text_col))

    # first centre of a bucket: the member whose buckets are the fullest, as an original among its copies
    order = F.struct(F.col("score"), F.xxhash64("node"))
    centres = (members.join(scores.select("node", "score").hint("merge"), "node").groupBy("band")
               .agg(F.max_by("node", order).alias("centre"))
               .select("band", "centre", F.col("centre").alias("c_label")))
    labelled = members.select("band", "node", F.col("node").alias("label"))
    first_turn = links = last = None
    for turn in range(CENTRE_ROUNDS):
        pairs = (salted_join(labelled, centres, "band", "node").where("label <> c_label")
                 .select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct())
        new = written(_verified(pairs, classes, sets, 2 * (threshold / 100) - 1 - MARGIN))
        first_turn = first_turn or new
        more = _links(new, threshold)
        links = written(components(more if links is None else links.union(more)).select(
            F.col("node").alias("u"), F.col("component").alias("v")))
        labelled = members.select("band", "node").join(
            links.withColumnsRenamed({"u": "node", "v": "label"}).hint("merge"), "node", "left").select(
            "band", "node", F.coalesce("label", "node").alias("label"))
        # buckets with members in different components stay open; next centres: members of the largest component
        picks = F.array(*[F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "node"), "node"))["node"]
                          for k in range(CENTRES)])
        per_label = labelled.groupBy("band", "label").agg(F.count("*").alias("n"), picks.alias("centres"))
        top = written(per_label.groupBy("band").agg(
            F.max_by(F.struct("label", "centres"), F.struct("n", "label")).alias("c"), F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("labels"))
            .where(F.col("labels") > 1)
            .select("band", "c.label", "c.centres", "n", ((F.col("n") * F.col("n") - F.col("within")) / 2)
                    .alias("across")))
        labelled = written(salted_join(labelled, top.select("band", F.col("n").alias("held")), "band", "node"))
        centres = top.select("band", F.col("label").alias("c_label"), "centres")
        n, across = top.agg(F.sum("n"), F.sum("across")).first()
        if not across or across <= 2 * n or (turn and across > last / 2):
            break
        last = across
        centres = centres.withColumn("centre", F.explode(F.array_distinct("centres"))).drop("centres")
    # what is left: members of open buckets that are in different components. Those whose similarity to the same
    # first centre is known are compared once per centre, all others once per pair in the first bucket they share
    popular = first_turn.groupBy("v").agg(F.count("*").alias("popular"))
    near = salted_join(first_turn, popular, "v", "u").groupBy("u").agg(F.max(F.struct(
        "popular", F.col("v").alias("centre"),
        F.coalesce(F.col("common") / F.col("united"), F.lit(FAR)).alias("s"))).alias("c"))
    nodes = written(_with_lanes(
        labelled.select("node", "label").distinct()
        .join(near.select(F.col("u").alias("node"), "c.s", "c.centre").hint("merge"), "node", "left")
        .join(classes.select("node", "n", keys.alias("keys"), "registers").hint("merge"), "node")))
    known = nodes.where(F.col("s") > FAR).drop("keys").join(
        sets.where(F.size("shingles") <= SMALL_SET).hint("merge"), "node", "left")
    biggest = (known.groupBy("centre", "label").agg(F.count("*").alias("n")).groupBy("centre")
               .agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("most"),
                    F.sum("n").alias("members"))
               .where("most < members")
               .select("centre", "largest", "members", F.ceil((F.col("members") - F.col("most")) / TILE).cast("int").alias("xs"),
                       F.ceil(F.col("members") / TILE).cast("int").alias("ys")))
    known = written(salted_join(known, biggest, "centre", "node"))
    direct = _tile_links(known, threshold)
    # the members of a centre with large sets, then those of an open bucket; distances to the centre that differ by more
    # than the allowed distance exclude a link
    least = threshold / 100 - MARGIN
    sized = 100 * F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n")
    big = (F.col("x_n") > SMALL_SET) | (F.col("y_n") > SMALL_SET)
    rest = _met(known.drop("shingles", "xs", "ys"), "centre", "members", "label <> largest",
                big & sized & (F.col("x_label") != F.col("y_label"))
                & ((F.col("y_label") == F.col("y_largest")) | (F.col("x_node") < F.col("y_node")))
                & (F.abs(F.col("x_s") - F.col("y_s")) <= distance + 1e-9) & _near_enough("x_", "y_", least))

    inside = labelled.select("band", "held", "node").join(nodes.hint("merge"), "node")
    met = F.coalesce((F.col("x_centre") == F.col("y_centre")) & (
        ((F.col("x_s") > FAR) & (F.col("y_s") > FAR))
        # a similarity under 2 * threshold - 1 beside one of the threshold or more
        | ((F.col("x_s") == FAR) & (F.col("y_s") >= 1 - distance))
        | ((F.col("y_s") == FAR) & (F.col("x_s") >= 1 - distance))), F.lit(False))
    same = F.zip_with("x_keys", "y_keys", lambda a, b: a == b)
    first = F.col("x_keys")[(F.array_position(same, F.lit(True)) - 1).cast("int")] == F.col("band")
    others = _met(inside, "band", "held", None,
                  (F.col("x_label") < F.col("y_label")) & sized & ~met
                  & (F.col("x_centre").isNull() | (F.col("x_centre") != F.col("y_node")))
                  & (F.col("y_centre").isNull() | (F.col("y_centre") != F.col("x_node")))
                  & first & _near_enough("x_", "y_", least))
    found_last = _exact(written(rest.union(others).distinct()), sets)
    groups = components(links.union(direct).union(_links(found_last, threshold)))

    by_class = written(classes.join(groups.hint("merge"), "node", "left")
                .select("a", "b", "n", F.coalesce("component", "node").alias("component")))
    named = (found.join(by_class.hint("merge"), ["a", "b", "n"], "left")
             .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                     F.coalesce("component", "id").alias("component_id")))
    named = named.withColumn("kept", F.col(id_col) == F.col("component_id"))
    nameless = rows.where(F.col("id").isNull()).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"),
        F.lit(True).alias("kept"))
    return named.union(nameless)


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: int = 80,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the least id, with all its columns. Of rows that repeat an id the one
    whose set was compared stays (of rows with equal sets the one with the least hash); rows without an id stay."""
    report = near_duplicates(docs, shingle_words, threshold, id_col, text_col)
    kept = report.where(F.col(id_col).isNotNull() & F.col("kept")).select(id_col)
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").select(
        *[F.col(f"`{c}`") for c in docs.columns])
    nameless = docs.where(F.col(id_col).isNull())
    # helper columns whose names the input does not have
    again, best = (free_name(docs.columns, x) for x in ("again", "best"))
    repeated = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(again))
                       .agg(F.count("*").alias("n")).where("n > 1").select(again))
    if repeated.isEmpty():
        return named.union(nameless)
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    among = F.col(f"`{id_col}`") == F.col(f"`{again}`")
    rows = docs.join(repeated, among, "left_semi").select(
        F.struct(F.col(id_col).alias("id"), F.md5(text_col).alias("text"), F.xxhash64(*plain).alias("row")).alias("key"),
        F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        found = written(signatures(rows, shingle_words, "key", "text").select("id", "n", "a", "b"))
    least = (found.groupBy(F.col("id.id").alias("i")).agg(F.min(F.struct("n", "a", "b", "id.text", "id.row")).alias("s"))
             .select(F.struct("i", F.col("s.text").alias("text"), F.col("s.row").alias("row")).alias(best)))
    single = named.join(repeated, among, "left_anti")
    own = (F.col(f"`{id_col}`") == F.col(f"{best}.i")) & F.md5(text_col).eqNullSafe(F.col(f"{best}.text")) & (
        F.xxhash64(*plain) == F.col(f"{best}.row"))
    several = named.join(least, own, "left_semi").dropDuplicates([id_col])  # only equal rows are left under an id
    return single.union(several).union(nameless)
