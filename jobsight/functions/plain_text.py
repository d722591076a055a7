"""N1 and N5 of plain texts (ASCII and most of Latin-1) as Arrow-batched helpers; any other text gives null.

For these characters Python's ``re``, ``str.title`` and ``str.lower`` agree with Java's (?U) classes and Spark's own
functions, so the Catalyst expressions of functions/text.py remain the definition: they take the texts left null here.
One pass over a text replaces one pass for each of the 34 title rules or 21 seniority words.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from jobsight import rules

#: no other control characters, no letters whose other case lies outside, no number signs (\w in Python only)
_PLAIN = re.compile("[\t-\r -~\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xfe]*").fullmatch
_RULES = [(re.compile(pattern, re.I), repl) for pattern, repl in rules.TITLE_RULES]
_WORDS = {re.sub(r"\\b|\\\.\?", "", pattern).capitalize(): repl for pattern, repl in rules.TITLE_RULES}
_DOTTED = "|".join(re.sub(r"\\b|\\\.\?", "", pattern).capitalize() for pattern, _ in rules.TITLE_RULES if "?" in pattern)
_GLUED = re.compile(rf"(?:{_DOTTED})\.\w").search
# no boundary test in front of the words: a search for their letters is much faster, and few are found
_WORD = re.compile("(?:" + "|".join(sorted(_WORDS, key=len, reverse=True)) + r")\b")
_CLEAN = re.compile("[" + re.escape("".join(c for c in map(chr, range(256)) if _PLAIN(c) and re.match(r"[^\w\s\-/()&]", c))) + "]+")
_NAMES = [name for name, _ in rules.SENIORITY_LEVELS]
# a name that holds an earlier one is never met: that one has been taken out of it
_MET = [n for k, n in enumerate(_NAMES) if not any(re.search(rf"\b{re.escape(x)}\b", n) for x in _NAMES[:k])]
_SENIORITY = re.compile("(?:" + "|".join(map(re.escape, _MET)) + r")\b")
_FILLER = frozenset(rules.FILLER_WORDS)


def _inside(m: re.Match) -> bool:
    """Whether a word character stands before the match."""
    before = m.string[m.start() - 1:m.start()]
    return before.isalnum() or before == "_"


def _expanded(m: re.Match) -> str:
    return m.group() if _inside(m) else _WORDS[m.group()]


def _dropped(m: re.Match) -> str:
    return m.group() if _inside(m) else ""


def plain_title_py(s: str | None) -> str | None:
    """N1 of a plain text, else None."""
    if s is None or not _PLAIN(s):
        return None
    t = s.strip().title()
    if _GLUED(t):  # the dot goes, and what follows it begins at no boundary any more: rules in their order
        for rx, repl in _RULES:
            t = rx.sub(repl, t)
    else:  # no replacement holds a word of a rule: the order does not matter
        t = _WORD.sub(_expanded, t)
    t = _CLEAN.sub("", " ".join(t.split())).replace("/", " / ")
    return " ".join(t.split())


def plain_terms_py(t: str | None) -> list[str] | None:
    """N5 of a plain normalized title, else None.

    A seniority word that is gone leaves two separators, so no other one can arise from what stood around it.
    """
    if t is None or not _PLAIN(t):
        return None
    words = _SENIORITY.sub(_dropped, t.lower()).split()
    return sorted({w for w in words if len(w) >= 3} - _FILLER)


@pandas_udf(StringType())
def plain_title(s: pd.Series) -> pd.Series:
    return pd.Series([plain_title_py(x) for x in s], dtype=object)


@pandas_udf(ArrayType(StringType()))
def plain_terms(t: pd.Series) -> pd.Series:
    return pd.Series([plain_terms_py(x) for x in t], dtype=object)
