"""The N1-N5 normalizers as DuckDB SQL text, for the correctness oracle.

RE2 has no look-around and its \\b is ASCII-only, so a Unicode word boundary
is emulated with capture groups: ``(^|NW)WORD(NW|$)`` -> ``\\1REPL\\2``. The
trailing boundary character is consumed, so two occurrences separated by a
single character need a second pass; no replacement contains its own
pattern as a word, so a second pass adds nothing else. ``WORD\\.?\\b`` keeps
Python's backtracking: the dot is taken only when a word character follows.
The word class mirrors Java's (?U)\\w: letters, Nl, Nd, marks, Pc.
"""

from __future__ import annotations

import re

from jobsight import rules

W = r"\p{L}\p{Nl}\p{Nd}\p{M}\p{Pc}"
NW = f"[^{W}]"
WS = r"[\t\n\x{0b}\f\r\x{85}\p{Z}]"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse_ws(x: str) -> str:
    return strip_ws(f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')")


def py_title(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), {lit(f'[{CASED}]+|[^{CASED}]+')})"
    special = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.TITLECASE_EXPANSIONS)
    first = f"(CASE substring(r, 1, 1) {special} ELSE upper(substring(r, 1, 1)) END)"
    return f"array_to_string(list_transform({runs}, lambda r: {first} || substring(r, 2)), '')"


def _word_rule(x: str, word: str, optional_dot: bool, repl: str, flags: str) -> str:
    """One `\\bword(\\.?)\\b` replacement applied twice."""
    if optional_dot:
        pat = f"(^|{NW}){word}(?:\\.([{W}])|({NW}|$))"
        rep = f"\\1{repl}\\2\\3"
    else:
        pat = f"(^|{NW}){word}({NW}|$)"
        rep = f"\\1{repl}\\2"
    once = f"regexp_replace({x}, {lit(pat)}, {lit(rep)}, {lit(flags)})"
    return f"regexp_replace({once}, {lit(pat)}, {lit(rep)}, {lit(flags)})"


_RULE = re.compile(r"^\\b([A-Za-z]+)(\\\.\?)?\\b$")


def _empty_to_blank(x: str, expr: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {expr} END)"


def normalize_title(x: str) -> str:
    t = py_title(strip_ws(x))
    for pattern, repl in rules.TITLE_RULES:
        m = _RULE.match(pattern)
        t = _word_rule(t, m.group(1), bool(m.group(2)), repl, "gi")
    t = collapse_ws(t)
    keep = W + r"\t\n\x{0b}\f\r\x{85}\p{Z}\-/()&"
    t = f"regexp_replace({t}, {lit(f'[^{keep}]')}, '', 'g')"
    t = f"replace({t}, '/', ' / ')"
    return _empty_to_blank(x, collapse_ws(t))


def normalize_location(x: str) -> str:
    n = strip_ws(x)
    remote = f"regexp_matches({n}, {lit(f'(^|{NW})(remote|work from home|wfh)({NW}|$)')}, 'i')"
    for abbrev, full in rules.LOCATION_SYNONYMS:
        n = _word_rule(n, rules.regex_escape(abbrev), False, full, "gi")
    for abbrev, full in rules.STATE_ABBREVIATIONS:
        pat = f",{WS}*{abbrev}({NW}|$)"
        once = f"regexp_replace({n}, {lit(pat)}, {lit(', ' + full + chr(92) + '1')}, 'g')"
        n = f"regexp_replace({once}, {lit(pat)}, {lit(', ' + full + chr(92) + '1')}, 'g')"
    n = collapse_ws(n)
    return _empty_to_blank(x, f"(CASE WHEN {remote} THEN 'Remote' ELSE {n} END)")


def normalize_company(x: str) -> str:
    n = strip_ws(x)
    for suffix in rules.COMPANY_SUFFIXES:
        m = re.match(r"^\\b([A-Za-z]+)(\\\.\?)?\$$", suffix)
        word, dot = m.group(1), "\\.?" if m.group(2) else ""
        n = f"regexp_replace({n}, {lit(f'(^|{NW}){word}{dot}$')}, '\\1', 'i')"
    return _empty_to_blank(x, py_title(collapse_ws(n)))


def seniority_level(x: str) -> str:
    whens = " ".join(f"WHEN contains(lower({x}), {lit(name)}) THEN {level}"
                     for name, level in rules.seniority_by_length())
    return f"(CASE {whens} ELSE NULL END)"


def key_terms_of_normalized(t: str) -> str:
    for name, _ in rules.SENIORITY_LEVELS:
        t = _word_rule(t, rules.regex_escape(name), False, "", "gi")
    words = f"string_split_regex({strip_ws(f'lower({t})')}, {lit(WS + '+')})"
    filler = "[" + ", ".join(lit(w) for w in rules.FILLER_WORDS) + "]"
    kept = f"list_filter({words}, lambda w: length(w) >= 3 AND NOT list_contains({filler}, w))"
    return f"list_sort(list_distinct({kept}))"


def key_terms(x: str) -> str:
    return key_terms_of_normalized(normalize_title(x))
