"""Fuzzy duplicate detection and its reports.

Semantics (per company_key block, postings in (company, title, url) order):
scan postings in order; a posting not yet marked as a duplicate claims every
later unmarked posting it is similar to. The canonicals are therefore the
lexicographically-first maximal independent set of the similarity graph and
each duplicate belongs to its smallest similar canonical.

Plan, all on DataFrames:

1. normalize (Catalyst only) and drop rows with an empty title or location
   (their scores are 0, below any positive threshold);
2. exact collapse: rows sharing (company_key, title, location) after
   normalization keep one representative; the others inherit its fate with
   score 1.0 (or the representative's score). One group of copies holding a
   third of all rows becomes one row here: a partial aggregate;
3. representatives travel as longs (``k``); those of candidate pairs alone are
   numbered in the order of their block by one range sort;
4. location compatibility: distinct (company_key, location) strings, exact
   character-multiset prefix filtering, difflib ratio on survivors, both
   directions (the ratio is asymmetric);
5. title candidates for the sequence ratio: representatives of compatible
   locations meet in tiles (blocks of at most TILE, of near lengths where a
   block is large). A tile drops pairs by exact bounds of the ratio: rare runs
   of characters in common for long titles, characters in common for others,
   and the length of the longest common subsequence (functions/lcs.py). It
   gives out the few that are left. Blocks are packed and written once; those
   of a hot company meet in a product of the files, so no title is shuffled
   once for each tile;
6. title candidates for Jaccard: a prefix filter on the rarest key terms, as
   an equi-join; a term that more than HEAVY postings of a block share is dealt
   to row blocks x column blocks, so that no reducer holds it alone;
7. verification of candidates (pandas UDF for D1 on distinct title pairs);
8. greedy order: a block with at most LOCAL_EDGES open links is scanned in
   order by one task; of a larger one a whole prefix of the order is decided at
   once, together with all nodes that have no lower neighbour. A chain of
   links thus costs one round per LOCAL_EDGES, not one per link.
"""

from __future__ import annotations

import math
import uuid
import zlib
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from jobsight import rules
from jobsight.functions import text as T
from jobsight.functions.lcs import Strings, near_pairs
from jobsight.functions.similarity import (jaccard_size_ok, min_overlap_jaccard_py, min_overlap_ratio,
                                           ratio_length_ok, sequence_ratio, sequence_ratio_floor)
from jobsight.operators.joins import dealt_self_join, likely_rows, rows_of
from jobsight.session import checkpoint_dir, limit_arrow_batches, stored
from jobsight.sources.tables import spread, spread_by

#: titles in a block of a tile, on either side, and their characters (about)
TILE = 8192
TILE_CHARS = 1 << 21
#: length bands of blocks that do not fit one tile; at the title threshold, a band meets itself and its two neighbours
BAND = 1.36
#: a key term shared by more postings of a block is dealt to several reducers, each with at most HEAVY of either side
HEAVY = 2000
#: buckets in which the occurrences of key terms are counted
BUCKETS = 1 << 17
#: open links that one task scans in order (16 bytes each)
LOCAL_EDGES = 500_000

DETAIL_COLS = ["title1", "title2", "location1", "location2", "title_similarity",
               "terms_similarity", "title_score", "location_score", "combined_score"]


# ---- N6 ------------------------------------------------------------------------

def order_key(df: DataFrame):
    """Total order of postings: (company, title, url), nulls as ''."""
    return F.struct(F.coalesce(F.col("company"), F.lit("")).alias("c"),
                    F.coalesce(F.col("title"), F.lit("")).alias("t"),
                    F.col("url").alias("u"))


def normalize_postings(df: DataFrame) -> DataFrame:
    """Add company_key, normalized_title, normalized_location, seniority_level, key_terms.

    key_terms come from the already normalized title (normalized twice), as
    the pair scoring does.
    """
    out = df.select(
        *df.columns,
        T.normalize_company("company").alias("company_key"),
        T.normalize_title("title").alias("normalized_title"),
        T.normalize_location("location").alias("normalized_location"),
        T.seniority_level("title").alias("seniority_level"))
    return out.withColumn("key_terms", T.key_terms("normalized_title"))


def drop_exact_url_duplicates(df: DataFrame, seq: str = "seq", numbered: bool = False) -> DataFrame:
    """One row per URL, the last by ``seq`` wins.

    A hash aggregate with max_by (map-side combine), so one URL repeated
    millions of times costs no single-task window. ``numbered``: ``seq`` is
    from monotonically_increasing_id and written with the rows; then only URLs
    and numbers are shuffled, and the rows are picked by a bitmap.
    """
    if numbered:
        return rows_of(df, seq, df.groupBy("url").agg(F.max(seq).alias(seq)).select(seq))
    cols = [c for c in df.columns]
    packed = df.groupBy("url").agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_r"))
    return packed.select("_r.*")


# ---- prefix tokens ------------------------------------------------------------

def _char_prefix(strings: DataFrame, sid: str, s: str, theta: float) -> DataFrame:
    """(sid, slen, tok) for the rarest characters of each string.

    Tokens are (character, occurrence number), so a multiset overlap is a set
    overlap. If ratio(a, b) >= theta then the overlap is at least
    ceil(theta*len/(2-theta)) for each side, and the two prefixes of length
    len - that + 1 in one global token order (character frequency, character,
    occurrence) share a token.

    Per string: character counts (one hash aggregate), joined to the global
    character frequencies (one row per distinct character: bounded by the
    alphabet, so a broadcast at runtime), then the prefix is cut with a
    running sum over the string's distinct characters; tokens are only
    materialized for the kept prefix.
    """
    # length computed below the explode: a column derived next to a generator is
    # evaluated above it, which would drag the whole string along every character
    low = strings.select(sid, F.lower(F.col(s)).alias("_low")).withColumn("slen", F.length("_low"))
    chars = low.select(sid, "slen", F.explode(F.split("_low", "")).alias("ch"))
    counts = (chars.filter(F.col("ch") != "").groupBy(sid, "slen", "ch")
              .agg(F.count(F.lit(1)).alias("n")))
    freq = counts.groupBy("ch").agg(F.sum("n").alias("f"))
    ranked = counts.join(freq, "ch")
    # running count of tokens before each (string, character) in the global order:
    # a window over one row per distinct character of a string, not per token
    w = (Window.partitionBy(sid).orderBy("f", "ch")
         .rowsBetween(Window.unboundedPreceding, -1))
    keep = F.col("slen") - min_overlap_ratio(F.col("slen"), theta) + 1
    runs = ranked.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    runs = runs.filter(F.col("start") < keep)
    last = F.least(F.col("n"), keep - F.col("start"))
    return (runs.select(sid, "slen", "start", F.explode(F.sequence(F.lit(1).cast("bigint"), last.cast("bigint")))
                        .alias("k"), "ch")
            .select(sid, "slen", F.struct("ch", "k").alias("tok"), (F.col("start") + F.col("k")).alias("pos")))


def rarest_terms(sets: DataFrame, theta: float):
    """A UDF for the key terms of ``sets``: the rarest ones of a posting, the rarest first, as a prefix filter needs them.

    Postings that reach a Jaccard of ``theta`` share one of them. Any one order of all terms will do for that; here it is
    the occurrences in the term's bucket, then the term. The buckets are a table of fixed size, so no term is shuffled.
    """
    counted = sets.select(F.explode("terms").alias("t")).groupBy(F.pmod(F.crc32("t"), F.lit(BUCKETS)).alias("b")).count()
    seen = [0] * BUCKETS
    for b, n in counted.collect():
        seen[b] = n
    shared = sets.sparkSession.sparkContext.broadcast(seen)

    @pandas_udf("array<string>")
    def rarest(terms: pd.Series) -> pd.Series:
        f = shared.value

        def cut(own):
            own = sorted(own, key=lambda t: (f[crc32(t.encode()) % BUCKETS], t))
            return own[:len(own) - min_overlap_jaccard_py(len(own), theta) + 1]

        return pd.Series([None if own is None else cut(own) for own in terms], dtype=object)

    return rarest


def prefix_fits(si, sj, pi, pj, theta: float):
    """Column: sets of ``si`` and ``sj`` terms whose first shared one is at ``pi`` and ``pj`` may reach ``theta``.

    At most min(si - pi, sj - pj) more can be shared; Jaccard >= theta needs an overlap of theta * (si + sj) / (1 + theta).
    """
    return jaccard_size_ok(si, sj, theta) & (
        F.least(si - pi, sj - pj) + 1 >= F.lit(theta) * (si + sj) / (1.0 + theta) - F.lit(1e-9))


#: bit b is set if an odd number of the terms has the hash b: two sets differ in as many terms as bits, or more
PARITY = "aggregate(terms, 0L, (x, t) -> x ^ shiftleft(1L, cast(pmod(xxhash64(t), 64) AS INT)))"


def parity_fits(si, sj, p, q, theta: float):
    """Column: sets of ``si`` and ``sj`` terms with the parities ``p`` and ``q`` (PARITY) may reach ``theta``."""
    return F.bit_count(p.bitwiseXOR(q)) <= F.lit((1 - theta) / (1 + theta)) * (si + sj) + 1e-9


def term_pairs(reps: DataFrame, compat: DataFrame, theta: float, parity: bool = False) -> DataFrame:
    """(i, j), i before j, of ``reps`` in compatible locations that may reach a Jaccard of ``theta``: no such pair is missed.

    Hashes of (company, location, rarest term) meet. A posting has them for its own location, and for each other one that
    is compatible with its own a second set, which meets the first sets there. ``parity``: pairs whose sets differ in too
    many terms are dropped, too, by the parity of each set's term hashes.
    """
    rarest = rarest_terms(reps, theta)
    other = compat.filter(F.col("a") != F.col("b")).select("company_key", F.col("a").alias("nl"), "b")
    known = reps.filter(F.col("company_key").isNotNull() & F.col("nl").isNotNull())

    # away from home the size is negative: both sides of the join read the same columns, so one shuffle serves both
    def hashes(df, at, sign):
        return df.select("k", (F.lit(sign) * F.size("terms")).alias("tsize"), F.expr(PARITY if parity else "0L").alias("parity"),
                         F.posexplode(rarest("terms")).alias("pos", "t"), "company_key", at) \
            .select("k", "tsize", "parity", "pos", F.xxhash64("company_key", at, "t").alias("h"))

    away, _ = likely_rows(known.select("k", "company_key", "nl", "terms"), "nl", other.select("nl"))
    rows = stored(hashes(known, "nl", 1).union(hashes(away.join(other, ["company_key", "nl"]), "b", -1)))
    s1, s2 = F.abs("tsize1"), F.col("tsize2")
    # a test of one side alone would be pushed below its shuffle
    fits = (F.signum(s1) * s2 > 0) & (F.col("k1") < F.col("k2")) & prefix_fits(s1, s2, F.col("pos1") + 1, F.col("pos2") + 1, theta)
    if parity:
        fits = fits & parity_fits(s1, s2, F.col("parity1"), F.col("parity2"), theta)
    return dealt_self_join(rows, "h", HEAVY, fits).select(F.col("k1").alias("i"), F.col("k2").alias("j")).distinct()


# ---- D3 pieces -----------------------------------------------------------------

def location_compat(reps: DataFrame, theta_l: float) -> DataFrame:
    """Directed (company_key, a, b, loc_ratio) with ratio(a, b) >= theta_l (or both Remote)."""
    locs = reps.select("company_key", F.col("nl")).distinct().withColumn(
        "lid", F.monotonically_increasing_id()).checkpoint()
    pre = _char_prefix(locs, "lid", "nl", theta_l).join(locs.select("lid", "company_key"), "lid")
    l, r = pre.alias("l"), pre.alias("r")
    pos_ok = (F.least(F.col("l.slen") - F.col("l.pos"), F.col("r.slen") - F.col("r.pos")) + 1
              >= F.lit(theta_l) * (F.col("l.slen") + F.col("r.slen")) / 2.0 - F.lit(1e-9))
    ids = (l.join(r, (F.col("l.company_key") == F.col("r.company_key"))
                  & (F.col("l.tok") == F.col("r.tok")) & (F.col("l.lid") < F.col("r.lid")))
           .filter(ratio_length_ok(F.col("l.slen"), F.col("r.slen"), theta_l) & pos_ok)
           .select(F.col("l.lid").alias("la"), F.col("r.lid").alias("lb")).distinct())
    cand = (ids.join(locs.select(F.col("lid").alias("la"), "company_key", F.col("nl").alias("a")), "la")
            .join(locs.select(F.col("lid").alias("lb"), F.col("nl").alias("b")), "lb")
            .select("company_key", "a", "b"))
    both = spread_by(cand.unionByName(cand.select("company_key", F.col("b").alias("a"), F.col("a").alias("b"))),
                     "a", "b")
    remote = (F.lower("a") == "remote") & (F.lower("b") == "remote")
    scored = both.withColumn("loc_ratio", F.when(remote, F.lit(1.0)).otherwise(sequence_ratio("a", "b")))
    same = locs.select("company_key", F.col("nl").alias("a"), F.col("nl").alias("b"),
                       F.lit(1.0).alias("loc_ratio"))
    return scored.filter(F.col("loc_ratio") >= theta_l).unionByName(same)


def _pack(k: np.ndarray, titles: list[str]) -> bytes:
    """The titles of a block with their numbers, compressed."""
    texts = [t.lower().encode("utf-8", "surrogatepass") for t in titles]
    return zlib.compress(k.astype("<i8").tobytes() + np.array([len(t) for t in texts], "<i4").tobytes() + b"".join(texts))


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, list[str]]:
    raw = zlib.decompress(data)
    ends = 12 * n + np.cumsum(np.frombuffer(raw, "<i4", n, 8 * n), dtype=np.int64)
    return np.frombuffer(raw, "<i8", n), [raw[lo:hi].decode("utf-8", "surrogatepass")
                                          for lo, hi in zip([12 * n, *ends[:-1].tolist()], ends.tolist())]


def ratio_pairs(reps: DataFrame, compat: DataFrame, theta: float) -> DataFrame:
    """(i, j), i before j, of representatives in compatible locations whose title ratio may reach ``theta``.

    Exact bounds only (functions/lcs.py). A location with at most TILE representatives, of at most TILE_CHARS characters,
    is one block; a larger one falls into bands of length, and these into blocks, and blocks meet where their lengths
    allow the ratio. Each block is packed into one row and written once. The blocks of a larger location meet in a
    product of the files with themselves, which reads them again and again but shuffles nothing: what is on disk grows
    with the titles, not with the tiles.
    """
    limit_arrow_batches(reps.sparkSession)
    near = math.log((2 - theta) / theta) if theta > 0 else math.inf
    width = math.log(BAND)
    def blocks_of(n, chars):
        return F.ceil(F.greatest(F.col(n) / TILE, F.least(F.col(n), F.col(chars) / TILE_CHARS), F.lit(1.0))).cast("int")

    chars = F.sum(F.length("nt"))
    n_loc = stored(reps.groupBy("company_key", "nl").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars")).select(
        "company_key", "nl", blocks_of("n", "chars").alias("nb_loc")))
    band = F.when(F.col("nb_loc") > 1, F.floor(F.log(F.length(F.lower("nt")).cast("double")) / width)).otherwise(-1)
    # of a location in one block nothing needs to be looked up
    large = F.broadcast(n_loc.filter(F.col("nb_loc") > 1))
    placed = (reps.select("company_key", "nl", "k", "nt").filter(F.col("company_key").isNotNull() & F.col("nl").isNotNull())
              .join(large, ["company_key", "nl"], "left").withColumn("nb_loc", F.coalesce("nb_loc", F.lit(1)))
              .withColumn("band", band.cast("int")))
    blocks = (placed.filter(F.col("nb_loc") > 1).groupBy("company_key", "nl", "band")
              .agg(F.count(F.lit(1)).alias("n"), chars.alias("chars"))
              .select("company_key", "nl", "band", blocks_of("n", "chars").alias("nb")))
    keys = ["company_key", "nl", "nb_loc", "band", "x"]
    rows = (placed.join(F.broadcast(stored(blocks)), ["company_key", "nl", "band"], "left")
            .withColumn("x", F.pmod(F.xxhash64("k"), F.coalesce("nb", F.lit(1))).cast("int")).select(*keys, "k", "nt"))

    def pack(block: pa.Table) -> pa.Table:
        data = _pack(block["k"].to_numpy(), block["nt"].to_pylist())
        return block.select(keys).slice(0, 1).append_column("n", pa.array([len(block)], pa.int32())).append_column(
            "data", pa.array([data], pa.binary()))

    # dealt by hand: the blocks are few bytes and much work, which must not be put into one task
    packs = stored(spread_by(rows, *keys).groupBy(*keys).applyInArrow(
        pack, "company_key string, nl string, nb_loc int, band int, x int, n int, data binary"))
    cells = compat.select("company_key", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    for c in "pq":
        cells = cells.join(n_loc.withColumnsRenamed({"nl": c, "nb_loc": "nb_" + c}), ["company_key", c])
    cells = stored(cells)
    hot = cells.filter((F.col("nb_p") > 1) | (F.col("nb_q") > 1))

    def side(blocks, c):
        return blocks.select("company_key", F.col("nl").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("band", "x", "n", "data")],
                             *[x for x in blocks.columns if x == "qs"])

    tile = ["n_p", "data_p", "n_q", "data_q"]
    none = [F.lit(None).cast("int").alias("n_q"), F.lit(None).cast("binary").alias("data_q")]
    inside = side(packs.filter((F.col("nb_loc") == 1) & (F.col("n") > 1)), "p").select("n_p", "data_p", *none)
    beside = (cells.filter((F.col("nb_p") == 1) & (F.col("nb_q") == 1) & (F.col("p") != F.col("q")))
              .join(side(packs, "p"), ["company_key", "p"]).join(side(packs, "q"), ["company_key", "q"]))
    beside = spread_by(beside.select("company_key", "p", "q", *tile), "company_key", "p", "q").select(*tile)
    partners = hot.groupBy("company_key", F.col("p").alias("nl")).agg(F.collect_set("q").alias("qs"))
    left = side(packs.join(F.broadcast(partners), ["company_key", "nl"]), "p").withColumnRenamed("company_key", "company_p")
    right = side(packs.join(F.broadcast(hot.select("company_key", F.col("q").alias("nl")).distinct()),
                            ["company_key", "nl"], "left_semi"), "q")
    apart = (F.abs(F.col("band_p") - F.col("band_q")) - 1) * width
    same = (F.col("p") == F.col("q")) & (F.col("band_p") == F.col("band_q"))
    itself = same & (F.col("x_p") == F.col("x_q"))
    met = left.join(right.hint("shuffle_replicate_nl"), (F.col("company_p") == F.col("company_key"))
                    & F.expr("array_contains(qs, q)")
                    & ((F.col("band_p") < 0) | (F.col("band_q") < 0) | (apart <= near + 1e-9))
                    & ((F.col("p") != F.col("q")) | (F.col("band_p") < F.col("band_q")) | (same & (F.col("x_p") <= F.col("x_q"))))
                    & (~itself | (F.col("n_p") > 1)))
    met = met.select("n_p", "data_p", *[F.when(~itself, F.col(c)).alias(c) for c in ("n_q", "data_q")])

    def compare(batches):
        for batch in batches:
            for n, data, m, other in zip(*(batch.column(c) for c in tile)):
                k, titles = _unpack(data.as_py(), n.as_py())
                a = np.arange(len(k))
                b, once = a, not other.is_valid
                if not once:
                    more, texts = _unpack(other.as_py(), m.as_py())
                    b = np.arange(len(k), len(k) + len(more))
                    k, titles = np.concatenate((k, more)), titles + texts
                i, j = near_pairs(Strings(titles), a, b, theta, once)
                u, v = k[a[i]], k[b[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["i", "j"])

    return inside.union(beside).union(met.select(*tile)).mapInArrow(compare, "i long, j long")


def candidate_pairs(reps: DataFrame, compat: DataFrame, theta_t: float, parity: bool = False) -> DataFrame:
    """D4 with exact pruning: (i, j) pairs of representatives by their number ``k``, i before j (``parity``: see term_pairs)."""
    return ratio_pairs(reps, compat, theta_t).unionByName(term_pairs(reps, compat, theta_t, parity)).distinct()


def score_pairs(pairs: DataFrame, reps: DataFrame, compat: DataFrame,
                title_floor: float | None = None) -> DataFrame:
    """D3 on candidate pairs (i before j, by number ``k``): all detail columns, not yet thresholded.

    D1 runs once per distinct title pair, hash-spread over the cluster so the
    Python stage is never coalesced into a single task. With ``title_floor``
    a pair whose LCS bound is below the floor gets title_similarity
    -1.0 (exactly: it cannot reach the floor); callers that report details
    recompute it for the pairs they keep.
    """
    ri = reps.select(F.col("k").alias("i"), F.col("company_key"), F.col("nt").alias("title1"),
                     F.col("nl").alias("location1"), F.col("terms").alias("terms1"))
    rj = reps.select(F.col("k").alias("j"), F.col("nt").alias("title2"),
                     F.col("nl").alias("location2"), F.col("terms").alias("terms2"))
    p = pairs.join(ri, "i").join(rj, "j")
    titles = spread_by(p.select("title1", "title2"), "title1", "title2").dropDuplicates()
    if title_floor is None:
        titles = titles.withColumn("title_similarity", sequence_ratio("title1", "title2"))
    else:
        titles = titles.withColumn("title_similarity", sequence_ratio_floor("title1", "title2", float(title_floor)))
    p = (p.join(titles, ["title1", "title2"])
         .join(compat.select("company_key", F.col("a").alias("location1"), F.col("b").alias("location2"),
                             F.col("loc_ratio").alias("location_score")),
               ["company_key", "location1", "location2"]))
    p = p.withColumn("terms_similarity", T.jaccard("terms1", "terms2"))
    p = p.withColumn("title_score", F.greatest("title_similarity", "terms_similarity"))
    p = p.withColumn("combined_score", F.lit(rules.TITLE_WEIGHT) * F.col("title_score")
                     + F.lit(rules.LOCATION_WEIGHT) * F.col("location_score"))
    return p


# ---- D5 greedy order ------------------------------------------------------------

def numbered(postings: DataFrame, *keep: str, place: str = "k") -> DataFrame:
    """``postings`` (company_key, ord, ...) with the number ``place``, which rises with the order inside every company_key.

    One range sort; the number is the place in the sorted partitions, written before anything reads it. The rows are
    written before, too: a range sort looks at its input twice, and titles are costly to normalize. ``keep`` names the
    columns that are wanted beside it (default: all).
    """
    ranked = stored(postings).orderBy("company_key", "ord").withColumn(place, F.monotonically_increasing_id())
    return stored(ranked.select(*(keep or postings.columns), place))


def _scan(edges: pa.Table) -> pa.Table:
    """The sequential scan over the links (lo, hi) of one company: (k, canonical) for each of their nodes."""
    lo, hi = edges["lo"].to_numpy(), edges["hi"].to_numpy()
    nodes = np.union1d(lo, hi)
    order = np.argsort(hi, kind="stable")
    lo, hi = np.searchsorted(nodes, lo[order]), np.searchsorted(nodes, hi[order])
    bounds = np.searchsorted(hi, np.arange(len(nodes) + 1)).tolist()
    lower = lo.tolist()
    canonical = bytearray(len(nodes))
    for k in range(len(nodes)):
        canonical[k] = not any(canonical[x] for x in lower[bounds[k]:bounds[k + 1]])
    return pa.table({"company_key": pa.repeat(edges["company_key"][0], len(nodes)), "k": nodes,
                     "canonical": np.frombuffer(bytes(canonical), np.uint8).astype(bool)})


def greedy_canonicals(edges: DataFrame) -> DataFrame:
    """Duplicates among the nodes of ``edges`` (company_key, lo, hi; lo before hi): those the scan marks.

    Nodes that are no duplicate are canonical: together the lexicographically-first MIS of each company's graph. The
    rounds write the nodes they mark to one folder, which is read as one table at the end.
    """
    spark = edges.sparkSession
    base = f"{checkpoint_dir(spark)}/greedy-{uuid.uuid4().hex}"
    left = edges.select("company_key", "lo", "hi").distinct().checkpoint()
    schema = left.select("company_key", F.col("lo").alias("k")).schema
    halves = [0.5 ** n for n in range(1, 41)]
    turn = 0
    while True:
        # the prefix: all nodes of a company with few open links, else up to the hi under which LOCAL_EDGES links lie
        sizes = left.groupBy("company_key").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("hi", halves, F.lit(10_000)).alias("cuts"))
        cuts = sizes.select("company_key", F.when(F.col("n") > LOCAL_EDGES, F.element_at(
            "cuts", F.least(F.lit(len(halves)), F.ceil(F.log2(F.col("n") / LOCAL_EDGES)).cast("int")))).alias("cut"))
        prefix = left.join(cuts, "company_key").filter(F.col("cut").isNull() | (F.col("hi") <= F.col("cut")))
        scanned = prefix.select("company_key", "lo", "hi").groupBy("company_key").applyInArrow(
            _scan, "company_key string, k long, canonical boolean").checkpoint()
        # beyond the prefix: nodes without a lower neighbour
        lowest = left.select("company_key", F.col("lo").alias("k")).distinct().join(
            left.select("company_key", F.col("hi").alias("k")), ["company_key", "k"], "left_anti")
        canon = scanned.filter("canonical").select("company_key", "k").union(lowest).distinct()
        marked = (left.join(canon.withColumnRenamed("k", "lo"), ["company_key", "lo"], "left_semi")
                  .select("company_key", F.col("hi").alias("k")).distinct())
        path = f"{base}/turn={turn}"
        marked.write.parquet(path)
        now = spark.read.schema(schema).parquet(path)
        left = (left.join(now.withColumnRenamed("k", "lo"), ["company_key", "lo"], "left_anti")
                .join(now.withColumnRenamed("k", "hi"), ["company_key", "hi"], "left_anti").checkpoint())
        turn += 1
        if left.isEmpty():
            return spark.read.schema(schema).parquet(base).select("company_key", "k")


def smallest_canonicals(edges: DataFrame) -> DataFrame:
    """The links (lo, hi, ...) from each duplicate (hi) to its smallest similar canonical (lo)."""
    keys = ["company_key", "lo"]
    edges = edges.checkpoint()
    marked = greedy_canonicals(edges)
    from_canon = edges.join(marked.withColumnRenamed("k", "lo"), keys, "left_anti")
    rest = [c for c in edges.columns if c not in ("company_key", "hi")]
    return from_canon.groupBy("company_key", "hi").agg(F.min_by(F.struct(*rest), "lo").alias("b")).select(
        "company_key", "hi", *[F.col("b." + c).alias(c) for c in rest])


def find_duplicates(postings: DataFrame,
                    title_threshold: float = rules.TITLE_THRESHOLD,
                    location_threshold: float = rules.LOCATION_THRESHOLD,
                    combined_threshold: float = rules.COMBINED_THRESHOLD) -> DataFrame:
    """One row per duplicate posting.

    Input: unique ``url`` plus company, title, location. Output columns:
    company_key, canonical_url, duplicate_url, score and the detail columns.
    """
    base = spread(postings.select("url", "company", "title", "location"))
    base = base.select("url", "company", "title",
                       T.normalize_company("company").alias("company_key"),
                       T.normalize_title("title").alias("nt"),
                       T.normalize_location("location").alias("nl"))
    # materialized first: the regex chains run once. A class is a group of equal (company_key, nt, nl)
    name = F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in ("company_key", "nt", "nl")])
    base = stored(base.withColumns({"class": F.substring(F.unhex(F.sha2(name, 256)), 1, 16),
                                    "k": F.monotonically_increasing_id()}))
    eligible = base.filter(F.col("company_key").isNotNull() & (F.col("nt") != "") & (F.col("nl") != ""))
    # exact collapse: the first posting of a class stands for it; only texts of classes with copies are shuffled
    classes = stored(eligible.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")))
    several = classes.filter(F.col("n") > 1).select("class")
    copies = stored(rows_of(eligible, "k", eligible.select("class", "k").join(several, "class").select("k")))
    copies = copies.withColumn("ord", order_key(copies)).drop("company", "title")
    firsts = stored(copies.groupBy("class").agg(F.min(F.struct("ord", "k")).alias("m")).select(
        "class", F.col("m.ord").alias("rep_ord"), F.col("m.k").alias("rep")))
    members = (copies.join(firsts, "class").filter(F.col("ord") != F.col("rep_ord"))
               .select("company_key", "nt", "nl", F.col("url").alias("member"), "rep", F.col("rep_ord.u").alias("rep_url")))
    kept = stored(classes.filter(F.col("n") == 1).select("k").union(firsts.select("rep")))
    reps = rows_of(eligible, "k", kept)
    compat = location_compat(reps, location_threshold).checkpoint()
    # by number in any order, so in either direction; only representatives of candidates are put in order
    either = compat.select("company_key", "a", "b").union(compat.select("company_key", "b", "a")).distinct()
    pairs = stored(candidate_pairs(reps.withColumn("terms", T.key_terms("nt")), either, title_threshold, parity=True))
    asked = rows_of(reps, "k", pairs.select(F.col("i").alias("k")).union(pairs.select("j")))
    asked = asked.withColumnRenamed("k", "at").withColumns({"ord": order_key(asked), "terms": T.key_terms("nt")})
    linked = numbered(asked.drop("company", "title", "class"), "company_key", "nt", "nl", "url", "terms", "at")
    places = linked.select("k", "at")
    ends = (pairs.join(places.withColumnsRenamed({"k": "x", "at": "i"}), "i")
            .join(places.withColumnsRenamed({"k": "y", "at": "j"}), "j"))
    ends = ends.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    scored = score_pairs(ends, linked, compat, title_floor=title_threshold)
    is_dup = ((F.col("title_score") >= title_threshold)
              & (F.col("location_score") >= location_threshold)
              & (F.col("combined_score") >= combined_threshold))
    edges = scored.filter(is_dup)
    # pairs that passed on Jaccard alone skipped the ratio: report its exact value
    edges = edges.withColumn("title_similarity", F.when(
        F.col("title_similarity") < 0, sequence_ratio("title1", "title2")).otherwise(F.col("title_similarity")))
    best = smallest_canonicals(edges.select("company_key", F.col("i").alias("lo"), F.col("j").alias("hi"), *DETAIL_COLS))
    dups = (best.join(linked.select(F.col("k").alias("lo"), F.col("url").alias("canonical_url")), "lo")
            .join(linked.select(F.col("k").alias("hi"), "at", F.col("url").alias("duplicate_url")), "hi")
            .select("at", "company_key", "canonical_url", "duplicate_url", F.col("combined_score").alias("score"),
                    *DETAIL_COLS))
    rep_dups = dups.drop("at")
    # members of a canonical representative: duplicates with score 1.0
    # (equal strings: ratio 1.0, Jaccard 1.0 unless the term set is empty)
    m = members.join(dups.select(F.col("at").alias("rep"), "canonical_url", "score", *DETAIL_COLS), "rep", "left")
    own = F.col("canonical_url").isNull()
    self_terms = F.when(F.size(T.key_terms("nt")) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    same = {"title_similarity": F.lit(1.0), "terms_similarity": self_terms, "title_score": F.lit(1.0),
            "location_score": F.lit(1.0), "combined_score": F.lit(1.0)}
    member_rows = m.select(
        "company_key",
        F.when(own, F.col("rep_url")).otherwise(F.col("canonical_url")).alias("canonical_url"),
        F.col("member").alias("duplicate_url"),
        F.when(own, F.lit(1.0)).otherwise(F.col("score")).alias("score"),
        F.when(own, F.col("nt")).otherwise(F.col("title1")).alias("title1"),
        F.col("nt").alias("title2"),
        F.when(own, F.col("nl")).otherwise(F.col("location1")).alias("location1"),
        F.col("nl").alias("location2"),
        *[F.when(own, v).otherwise(F.col(c)).alias(c) for c, v in same.items()])
    return rep_dups.unionByName(member_rows.select(*rep_dups.columns))


# ---- D6-D10 --------------------------------------------------------------------

def deduplicate(postings: DataFrame, duplicates: DataFrame, keep: str = "first"):
    """(unique, removed).

    keep='first' keeps the canonical (the source's behaviour); 'last' keeps
    the last posting of each group in order; 'most_recent' the one with the
    newest last_seen (ties: earliest in order). Per-group choices are
    aggregates (max_by), never a collected group. Postings that are surely in
    no group are not shuffled (likely_rows).
    """
    if keep == "first":
        drop = duplicates.select(F.col("duplicate_url").alias("url"))
    else:
        groups = stored(duplicates.select("canonical_url", F.col("duplicate_url").alias("url")).unionByName(
            duplicates.select("canonical_url", F.col("canonical_url").alias("url")).distinct()))
        members, _ = likely_rows(postings, "url", groups)
        g = groups.join(members.withColumn("_ord", order_key(members)), "url")
        if keep == "last":
            keep_rows = g.groupBy("canonical_url").agg(F.max_by("url", "_ord").alias("keep"))
        elif keep == "most_recent":
            # newest last_seen; among equals, the earliest posting
            newest = g.groupBy("canonical_url").agg(F.max("last_seen").alias("mx"))
            tie = (g.join(newest, "canonical_url")
                   .filter(F.col("last_seen").eqNullSafe(F.col("mx"))))
            keep_rows = tie.groupBy("canonical_url").agg(F.min_by("url", "_ord").alias("keep"))
        else:
            raise ValueError(f"unknown keep strategy {keep!r}")
        drop = groups.join(keep_rows, "canonical_url").filter(F.col("url") != F.col("keep")).select("url")
    drop = stored(drop)
    likely, rest = likely_rows(postings, "url", drop)
    return rest.unionByName(likely.join(drop, "url", "left_anti").select(*rest.columns)), likely.join(drop, "url", "left_semi")


def dedup_stats(postings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Total, unique, groups, duplicates, rate (0.0 when there are no postings)."""
    rows = postings.select(F.lit(1).alias("p"), F.lit(None).cast("string").alias("c"),
                           F.lit(0).alias("d")).unionByName(
        duplicates.select(F.lit(0).alias("p"), F.col("canonical_url").alias("c"), F.lit(1).alias("d")))
    agg = rows.agg(F.sum("p").alias("total_jobs"), F.countDistinct("c").alias("duplicate_groups"),
                   F.sum("d").alias("total_duplicates"))
    return agg.select(
        F.coalesce("total_jobs", F.lit(0)).cast("bigint").alias("total_jobs"),
        (F.coalesce("total_jobs", F.lit(0)) - F.coalesce("total_duplicates", F.lit(0))).cast("bigint")
        .alias("unique_jobs"),
        F.col("duplicate_groups").cast("bigint").alias("duplicate_groups"),
        F.coalesce("total_duplicates", F.lit(0)).cast("bigint").alias("total_duplicates"),
        F.when(F.coalesce("total_jobs", F.lit(0)) > 0,
               F.round(F.coalesce("total_duplicates", F.lit(0)) / F.col("total_jobs"), 6))
        .otherwise(F.lit(0.0)).alias("duplicate_rate"))


def company_dup_stats(postings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Per raw company, postings and duplicates (credited to the canonical's company)."""
    totals = postings.groupBy("company").agg(F.count(F.lit(1)).alias("total"))
    canon_co = postings.select(F.col("url").alias("canonical_url"), "company")
    dups = (duplicates.join(canon_co, "canonical_url").groupBy("company")
            .agg(F.count(F.lit(1)).alias("duplicates")))
    out = totals.join(dups, "company", "left")
    return out.select("company", F.col("total").cast("bigint").alias("total"),
                      F.coalesce("duplicates", F.lit(0)).cast("bigint").alias("duplicates"),
                      F.round(F.coalesce("duplicates", F.lit(0)) / F.col("total"), 6).alias("duplicate_rate"))


def duplicate_report(postings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Report lines (sort_key, line); 'No duplicates found.' when empty.

    One line per group header and per duplicate, so a group of any size is
    spread over tasks; writing is orderBy('sort_key').select('line').
    """
    p = postings.select("url", "company", "title", "location", order_key(postings).alias("o"))
    canon = duplicates.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n"))
    head = canon.join(p.withColumnRenamed("url", "canonical_url"), "canonical_url").select(
        F.struct(F.col("o"), F.lit(0).alias("k"), F.lit(None).cast(p.schema["o"].dataType).alias("d"))
        .alias("sort_key"),
        F.format_string("## Group: %d duplicate(s) | canonical: %s | %s | %s | %s", F.col("n"),
                        F.coalesce("title", F.lit("N/A")), F.coalesce("company", F.lit("N/A")),
                        F.coalesce("location", F.lit("N/A")), F.col("canonical_url")).alias("line"))
    dl = (duplicates.join(p.withColumnRenamed("url", "duplicate_url"), "duplicate_url")
          .join(p.select(F.col("url").alias("canonical_url"), F.col("o").alias("co")), "canonical_url"))
    lines = dl.select(
        F.struct(F.col("co").alias("o"), F.lit(1).alias("k"), F.col("o").alias("d")).alias("sort_key"),
        F.format_string("  - %s | %s | similarity %.2f%% | %s", F.coalesce("title", F.lit("N/A")),
                        F.coalesce("location", F.lit("N/A")), F.round(F.col("score") * 100, 2),
                        F.col("duplicate_url")).alias("line"))
    # "No duplicates found." exactly when there is no duplicate: a constant row
    # anti-joined with one marker row of the duplicates
    spark = postings.sparkSession
    none = spark.range(1).select(F.lit(1).alias("k")).join(
        duplicates.select(F.lit(1).alias("k")).limit(1), "k", "left_anti")
    empty = none.select(F.lit(None).cast(head.schema["sort_key"].dataType).alias("sort_key"),
                        F.lit("No duplicates found.").alias("line"))
    return head.unionByName(lines).unionByName(empty)


def deactivate_duplicates(jobs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Set is_active = false on every non-canonical duplicate."""
    d = duplicates.select(F.col("duplicate_url").alias("url"), F.lit(True).alias("_dup"))
    j = jobs.join(d, "url", "left")
    return j.select(*[F.when(F.col("_dup"), F.lit(False)).otherwise(F.col("is_active")).alias("is_active")
                      if c == "is_active" else F.col(c) for c in jobs.columns])
