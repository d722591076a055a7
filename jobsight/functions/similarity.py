"""Similarity functions (D1, D2) and the exact candidate bounds used for pruning.

D1 is difflib's Ratcliff-Obershelp ratio 2M/T on lower-cased strings. It is
asymmetric (argument order matters) and has no Catalyst equivalent, so it is
an Arrow-batched pandas UDF over the stdlib; it only ever runs on candidate
pairs that survived the exact bounds below, on distinct string pairs.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from jobsight.functions.lcs import Strings, lcs_lengths
from jobsight.functions.text import jaccard  # noqa: F401  (re-exported: D2)

#: characters of the pairs whose LCS is computed together
FLOOR_CHARS = 1 << 20
_EPS = 1e-9


def ratio_py(a, b) -> float:
    """D1 in plain Python: 0.0 when either side is empty."""
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """D1 as a vectorised UDF (one Arrow batch of pairs per call)."""
    return pd.Series([ratio_py(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_floor_py(pairs: list[tuple], floor: float) -> list[float]:
    """D1 of each pair that can reach ``floor``, else -1.0 (known to be below it).

    The LCS of all pairs together (functions/lcs.py) is an upper bound of what difflib matches, so skipping its full
    computation below the floor loses no pair that could pass.
    """
    out = [0.0] * len(pairs)
    lo = 0
    while lo < len(pairs):
        texts, own = {}, []
        size, hi = 0, lo
        while hi < len(pairs) and (hi == lo or size < FLOOR_CHARS):
            if pairs[hi][0] and pairs[hi][1]:
                a, b = (x.lower() for x in pairs[hi])
                own.append((hi, texts.setdefault(a, len(texts)), texts.setdefault(b, len(texts))))
                size += len(a) + len(b)
            hi += 1
        if own:
            strings = Strings(list(texts))
            at, a, b = (np.array(x) for x in zip(*own))
            need = floor * (strings.lengths[a] + strings.lengths[b]) / 2 - _EPS
            reach = lcs_lengths(strings, a, b, need) >= need
            for k, i, j, ok in zip(at.tolist(), a.tolist(), b.tolist(), reach.tolist()):
                out[k] = SequenceMatcher(None, strings.texts[i], strings.texts[j]).ratio() if ok else -1.0
        lo = hi
    return out


def sequence_ratio_floor(a, b, floor: float):
    """Column: D1 with an exact early exit below ``floor`` (see ratio_floor_py)."""
    @pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratio_floor_py(list(zip(a, b)), floor), dtype="float64")

    return ratio(a, b)


def register_sql(spark) -> None:
    """Make D1 callable from SQL as sequence_ratio(a, b)."""
    spark.udf.register("sequence_ratio", sequence_ratio)


# ---- exact bounds --------------------------------------------------------------
# ratio = 2M/(la+lb) with M <= multiset overlap O <= min(la, lb). From
# M >= theta*(la+lb)/2 and M <= lb follows lb >= theta*la/(2-theta), hence
# O >= theta*la/(2-theta): a lower bound that depends on one side only, which
# is what prefix filtering needs.


def min_overlap_ratio(length, theta: float):
    """Column: least multiset overlap a string of ``length`` needs with any partner."""
    return F.ceil(F.lit(theta) * length / F.lit(2.0 - theta) - F.lit(_EPS))


def ratio_length_ok(la, lb, theta: float):
    """Column: 2*min(la, lb) >= theta*(la+lb), necessary for ratio >= theta."""
    return F.least(la, lb) * 2.0 >= F.lit(theta) * (la + lb) - F.lit(_EPS)


def min_overlap_jaccard(size, theta: float):
    """Column: |A ∩ B| >= theta*|A ∪ B| >= theta*|A|."""
    return F.ceil(F.lit(theta) * size - F.lit(_EPS))


def jaccard_size_ok(sa, sb, theta: float):
    return (F.least(sa, sb) >= F.lit(theta) * F.greatest(sa, sb) - F.lit(_EPS))


def min_overlap_ratio_py(length: int, theta: float) -> int:
    return math.ceil(theta * length / (2.0 - theta) - _EPS)


def min_overlap_jaccard_py(size: int, theta: float) -> int:
    return math.ceil(theta * size - _EPS)
