"""Text normalizers (N1-N5) as Catalyst column expressions.

Everything here is built from pyspark.sql.functions, so it runs inside
whole-stage codegen with no Python worker. Java regex needs the (?U) flag to
get Unicode \\w, \\s and \\b as in Python's re, and (?i) with (?U) gives
Unicode case folding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsight import rules
from jobsight.functions.plain_text import plain_terms, plain_title

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_WS = r"(?U)\s+"
_EDGE_WS = r"(?U)^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python str.strip(): remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), _EDGE_WS, "")


def collapse_ws(c) -> Column:
    """re.sub(r'\\s+', ' ', s).strip()."""
    return strip_ws(F.regexp_replace(_col(c), _WS, " "))


def py_title(c) -> Column:
    """Python str.title(): a letter is upper-cased after any non-letter.

    Spark's initcap only capitalises after spaces, so the string is cut into
    runs of cased / uncased characters and each run gets its first character
    upper-cased and the rest lower-cased.
    """
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(f"[{_CASED}]+|[^{_CASED}]+"), 0)

    def first_upper(x):
        # letters whose upper case expands (e.g. a sharp s -> 'SS') title-case to 'Ss'
        up = F.upper(F.substring(x, 1, 1))
        return F.when(F.length(up) > 1, F.concat(F.substring(up, 1, 1), F.lower(F.substring(up, 2, 8))))\
            .otherwise(up)

    return F.array_join(
        F.transform(runs, lambda x: F.concat(first_upper(x), F.substring(x, 2, 1 << 30))), "")


def _empty_to_blank(c: Column, result: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(result)


def normalize_title(c) -> Column:
    """Strip, title-case, expand abbreviations in rule order, clean up; plain texts in one pass."""
    return F.coalesce(plain_title(_col(c)), _title_by_rules(_col(c)))


def _title_by_rules(c: Column) -> Column:
    t = py_title(strip_ws(c))
    for pattern, repl in rules.TITLE_RULES:
        t = F.regexp_replace(t, "(?iU)" + pattern, repl)
    t = collapse_ws(t)
    t = F.regexp_replace(t, r"(?U)[^\w\s\-/()&]", "")
    t = F.replace(t, F.lit("/"), F.lit(" / "))
    t = collapse_ws(t)
    return _empty_to_blank(c, t)


def normalize_location(c) -> Column:
    """Remote detection, city synonyms, ', XX' state expansion, cleanup."""
    c = _col(c)
    n = strip_ws(c)
    remote = n.rlike("(?iU)" + rules.REMOTE_PATTERN)
    for abbrev, full in rules.LOCATION_SYNONYMS:
        n = F.regexp_replace(n, r"(?iU)\b" + rules.regex_escape(abbrev) + r"\b", full)
    states = n
    for abbrev, full in rules.STATE_ABBREVIATIONS:
        # case-sensitive on purpose: only upper-case codes after a comma
        states = F.regexp_replace(states, r"(?U),\s*" + abbrev + r"\b", ", " + full)
    # one gate avoids 51 regex passes on rows without a ', XX' code
    gate = n.rlike(r"(?U),\s*[A-Z]{2}\b")
    n = collapse_ws(F.when(gate, states).otherwise(n))
    return _empty_to_blank(c, F.when(remote, F.lit("Remote")).otherwise(n))


def normalize_company(c) -> Column:
    """Strip, drop legal suffixes at the end (in order), collapse, title-case."""
    c = _col(c)
    n = strip_ws(c)
    for suffix in rules.COMPANY_SUFFIXES:
        n = F.regexp_replace(n, "(?iU)" + suffix, "")
    n = py_title(collapse_ws(n))
    return _empty_to_blank(c, n)


def seniority_level(c) -> Column:
    """Substring test on the lower-cased title, longest word first."""
    low = F.lower(_col(c))
    out = None
    for name, level in rules.seniority_by_length():
        cond = low.contains(name)
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit(None).cast("int"))


def key_terms_of_normalized(t) -> Column:
    """N5 on an already normalized title: drop seniority words, split, filter, set.

    Returned as a sorted array so that equal sets compare equal.
    """
    return F.coalesce(plain_terms(_col(t)), _terms_by_rules(_col(t)))


def _terms_by_rules(t: Column) -> Column:
    for name, _ in rules.SENIORITY_LEVELS:
        t = F.regexp_replace(t, r"(?iU)\b" + rules.regex_escape(name) + r"\b", "")
    words = F.split(strip_ws(F.lower(t)), _WS)
    filler = F.array(*[F.lit(w) for w in rules.FILLER_WORDS])
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(filler, w))
    return F.array_sort(F.array_distinct(kept))


def key_terms(c) -> Column:
    """Key terms of a raw title (normalizes first)."""
    return key_terms_of_normalized(normalize_title(c))


def jaccard(a, b) -> Column:
    """|A ∩ B| / |A ∪ B| of two term arrays; 0.0 when either is empty."""
    a, b = _col(a), _col(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return (F.when((F.size(a) <= 0) | (F.size(b) <= 0) | a.isNull() | b.isNull(), F.lit(0.0))
            .otherwise(inter.cast("double") / union.cast("double")))


def host_of(url) -> Column:
    """Network location of a URL (scheme://NETLOC/...), as urlparse().netloc."""
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def company_from_url(url) -> Column:
    """First DNS label of the site host."""
    return F.split(host_of(url), r"\.", 2).getItem(0)


def job_id_from_url(url) -> Column:
    """Trailing digits of the URL path, null when absent."""
    return F.nullif(F.regexp_extract(_col(url), rules.JOB_ID_PATTERN, 1), F.lit(""))
