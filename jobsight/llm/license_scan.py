"""License notices in documents: winnowed fingerprints pick candidates, banded alignment measures them.

Words are maximal runs of letters, digits and non-ASCII characters, A-Z in lower case. Fingerprints are hashes of
GRAM consecutive words; of every WINNOW consecutive ones the least is kept (the rightmost of equals), so a template
and a document that share GRAM + WINNOW - 1 words in a row share a fingerprint. The templates' fingerprints form an
inverted index, fingerprint -> (template, position). A document's hits name candidate templates and, by the difference
of positions, places. An alignment goes word by word, match 1, mismatch and gap -1, in a band of BAND words around the
diagonal of a place, with the document's ends free; it gives coverage (matched words / words of the template) and the
span. A place where too few of the template's words occur in the band at all is left out before.

Templates of at most NOTICE words are aligned once at each place (hits within BAND words are one place). They must be
found with all their deciding words (names, NC/SA/ND, versions), and with none that make another license of them, so
that a notice of a license without a template is not reported as its sibling.

Longer templates are full texts, which people cut and extend: words that are put in or left out move all that follows to
another place. Their hits are gathered into runs (the same place, no more than RUN words apart), and the best chain of runs
that follow each other in the template and in the document is taken, a run counting its hits less the change of place
from the one before. Each run is aligned with its own part of the template, in its own band; the matched words add up,
and words put in between the runs count against the template's coverage only in deciding whether it is found. A
document may hold the text again before or after a chain, so what is left of the hits there is chained anew.

The registered query takes ``library()``: short notices and, in the folder ``licenses``, full texts. "BSD" is a notice
that does not say which BSD license is meant.

Documents are scanned where they lie, in one pass without a shuffle; the templates' index is broadcast in blocks of at
most MAX_WORDS words of templates, and more templates mean more passes, whose finds meet by document (its id and the
MD5 of its text) in one shuffle, so that the blocks do not show in the result. Of overlapping finds in a document the one with
more matched words is reported (ties: higher coverage, then the lesser name).

Edge cases: null or empty texts and templates without words match nothing; a template of fewer than
GRAM + WINNOW - 1 words keeps all its fingerprints, one of fewer than GRAM words is hashed as a whole and found by
that; repeated rows are scanned one by one; other columns of the input are left out.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.llm.tables import share, shared_value
from jobsight.llm.words import ALNUM, shingles, word_blocks
from jobsight.session import limit_arrow_batches

GRAM = 3
WINNOW = 3
BAND = 6
#: words between two hits of one run
RUN = 50
MAX_WORDS = 1 << 20

#: fixed values: the usual short notices and opening paragraphs of public licenses, as (name, text)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: words that tell a license from its siblings: a notice that has one is found only with it
DECIDING = set("""apache mit bsd isc mozilla gpl lgpl agpl mpl gfdl epl lesser affero documentation cc cc0 zero attribution nc
    sa nd noncommercial commercial sharealike alike noderivatives noderivs derivatives derivative derivs eclipse artistic
    unlicense zlib boost v1 v2 v3""".split())
#: words that make another license of a notice without them
FOREIGN = set("""lesser affero documentation lgpl agpl gfdl nc sa nd noncommercial commercial sharealike alike noderivatives
    noderivs derivatives derivative derivs""".split())
NUMBERS = {str(i) for i in range(1, 100)}
#: the deciding words count in templates of at most this many words; longer ones are told apart by their text
NOTICE = 100


def notices() -> list[tuple[str, str]]:
    """Short notices of the licenses that are not in TEMPLATES, and other wordings of those that are."""
    out = [("BSD", "Licensed under the BSD License."), ("MIT", "Licensed under the MIT License."),
           ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
            "(at your option) any later version."),
           ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
            "rights to this work under CC0 1.0.")]
    for v in ("2.1", "3"):
        out.append((f"LGPL-{v}" if "." in v else f"LGPL-{v}.0", "This library is free software; you can redistribute it "
                    "and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
                    f"Software Foundation; either version {v} of the License, or (at your option) any later version."))
    out.append(("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."))
    for name, title in (("GPL-1.0", "General Public License"), ("GPL-2.0", "General Public License"),
                        ("GPL-3.0", "General Public License"), ("LGPL-2.0", "Library General Public License"),
                        ("LGPL-2.1", "Lesser General Public License"), ("LGPL-3.0", "Lesser General Public License"),
                        ("AGPL-3.0", "Affero General Public License"), ("GFDL-1.2", "Free Documentation License"),
                        ("GFDL-1.3", "Free Documentation License")):
        short, v = name.split("-")
        v = v.removesuffix(".0")
        out += [(name, f"This work is licensed under the GNU {title}, version {v}."),
                (name, f"Licensed under the GNU {title} v{v}."), (name, f"Licensed under the GNU {short}, version {v}."),
                (name, f"Licensed under the GNU {short} v{v}.")]
    for name, title in (("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"),
                        ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "2-Clause BSD License"),
                        ("BSD-3-Clause", "3-Clause BSD License"), ("0BSD", "0BSD License"), ("Zlib", "zlib License"),
                        ("BSL-1.0", "Boost Software License, Version 1.0"), ("Unlicense", "Unlicense"),
                        ("MPL-1.1", "Mozilla Public License, Version 1.1"), ("EPL-1.0", "Eclipse Public License, v1.0"),
                        ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("EPL-2.0", "Eclipse Public License, v2.0"),
                        ("EPL-1.0", "Eclipse Public License, Version 1.0"), ("Artistic-2.0", "Artistic License 2.0"),
                        ("EPL-2.0", "Eclipse Public License, Version 2.0")):
        out.append((name, f"Licensed under the {title}."))
    kinds = {"BY": ["Attribution"], "BY-SA": ["Attribution-ShareAlike", "Attribution-Share Alike"],
             "BY-ND": ["Attribution-NoDerivatives", "Attribution-NoDerivs", "Attribution-No Derivative Works"],
             "BY-NC": ["Attribution-NonCommercial", "Attribution-Non-Commercial"],
             "BY-NC-SA": ["Attribution-NonCommercial-ShareAlike", "Attribution-Noncommercial-Share Alike",
                          "Attribution-Non-Commercial-Share Alike"],
             "BY-NC-ND": ["Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs",
                          "Attribution-Noncommercial-No Derivative Works"]}
    for kind, titles in kinds.items():
        for v, region in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            name = f"CC-{kind}-{v}"
            out += [(name, f"Licensed under CC {kind} {v}."), (name, f"creativecommons.org/licenses/{kind}/{v}")]
            out += [(name, f"This work is licensed under a Creative Commons {t} {v} {region} License.") for t in titles]
    spdx = {n for n, _ in out + TEMPLATES if n != "BSD"}
    return out + [(n, f"SPDX-License-Identifier: {n}") for n in sorted(spdx)]


def library() -> list[tuple[str, str]]:
    """The templates of the registered query: TEMPLATES, notices() and the full texts in the folder ``licenses``, each
    named by what precedes .txt or .holder.txt."""
    texts = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    known = {(n, t) for n, t in TEMPLATES}
    return (TEMPLATES + [x for x in notices() if x not in known]
            + [(f.name.removesuffix(".txt").removesuffix(".holder"), f.read_text("utf-8")) for f in texts])


def _hashes(words) -> np.ndarray:
    block = next(word_blocks(pa.array([" ".join(sorted(words))], pa.large_string()), ALNUM, True))
    return np.sort(block.hashes)


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the winnowed fingerprints of one text."""
    n = len(grams)
    if n <= WINNOW:
        return np.arange(n) if n else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], WINNOW)
    # the least in each window, the rightmost of equals: the first in the reversed text
    return np.unique(n - 1 - (np.argmin(views, axis=1) + np.arange(len(views))))


class Index:
    """Template words and the inverted index of their fingerprints."""

    def __init__(self, templates: list[tuple[str, str | None]]):
        self.names, self.words = [], []
        for b in word_blocks(pa.array([t for _, t in templates], pa.large_string()), ALNUM, True):
            for d in range(b.hi - b.lo):
                w = b.hashes[b.bounds[d]:b.bounds[d + 1]]
                if len(w):
                    self.names.append(templates[b.lo + d][0])
                    self.words.append(w)
        prints, self.sizes = [], sorted({min(GRAM, len(w)) for w in self.words})
        for t, w in enumerate(self.words):
            g = shingles(w, GRAM)
            # a document may start its window elsewhere, so all of a template's fingerprints are indexed
            prints += [(int(h), t, p) for p, h in enumerate(g.tolist())]
        prints.sort()
        self.hashes = np.array([p[0] for p in prints], np.uint64)
        self.template = np.array([p[1] for p in prints], np.int64)
        self.position = np.array([p[2] for p in prints], np.int64)
        deciding, self.foreign, self.numbers = _hashes(DECIDING | NUMBERS), _hashes(FOREIGN), _hashes(NUMBERS)
        self.deciding = [np.unique(w[np.isin(w, deciding)]) if len(w) <= NOTICE else None for w in self.words]

    def decided(self, t: int, words: np.ndarray, a: int, b: int) -> bool:
        """Whether the words at [a, b) have all deciding words of the template, and none of another license."""
        own, template = self.deciding[t], self.words[t]
        if own is None:
            return True
        # a word that stands where the template's first or last words are missing counts too
        lo, hi = max(0, min(a, b - len(template))), min(len(words), max(b, a + len(template)))
        if not np.isin(own, words[a:b]).all():
            return False
        if not len(own):
            return True
        other = words[lo:hi][~np.isin(words[lo:hi], template)]
        if np.isin(other, self.foreign).any():
            return False
        # a number next to one of the template's makes another version: 1.3 is not 3
        number = np.isin(words[lo:hi], self.numbers)
        mine = number & np.isin(words[lo:hi], own)
        beside = np.zeros(hi - lo, bool)
        beside[1:] |= mine[:-1]
        beside[:-1] |= mine[1:]
        return not (number & ~mine & beside).any()

    def possible(self, t: int, words: np.ndarray, place: int, least: float) -> bool:
        """False if too few of the template's words occur in the band around ``place`` for ``least`` to be reached."""
        template = self.words[t]
        n, need = len(template), least * len(template)
        if min(len(words), place + n + BAND) - max(0, place - BAND) < need:
            return False
        if n < NOTICE:
            return True
        near = np.zeros(n, bool)
        for shift in range(place - BAND, place + BAND + 1):
            lo, hi = max(0, -shift), min(n, len(words) - shift)
            if lo < hi:
                near[lo:hi] |= words[lo + shift:hi + shift] == template[lo:hi]
        return int(near.sum()) >= need

    def prints(self, words: np.ndarray) -> np.ndarray:
        """(template, place, position in the document) of each hit, sorted; the place is that of the first word."""
        parts = []
        for size in self.sizes:
            if len(words) < size:
                continue
            g = shingles(words, size)
            at = winnow(g) if size == GRAM else np.arange(len(g))
            lo, hi = np.searchsorted(self.hashes, g[at], "left"), np.searchsorted(self.hashes, g[at], "right")
            n = hi - lo
            held = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(at, n)
            parts.append(np.stack((self.template[held], p - self.position[held], p), axis=1))
        found = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        return found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, place), hits within BAND words taken as one place, for the templates of at most NOTICE words."""
        out = []
        for t, place, _ in self.prints(words).tolist():
            if len(self.words[t]) <= NOTICE and (not out or out[-1][0] != t or place - out[-1][1] > BAND):
                out.append((t, place))
        return out


def runs(found: np.ndarray) -> np.ndarray:
    """Hits (place, position) of one template, sorted, as runs (place, first position, last position, hits)."""
    new = (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) > RUN)
    begin = np.concatenate(([0], np.flatnonzero(new) + 1))
    end = np.concatenate((begin[1:], [len(found)]))
    out = np.stack((found[begin, 0], found[begin, 1], found[end - 1, 1], end - begin), axis=1)
    return out[np.lexsort((out[:, 0], out[:, 1]))]


def chain(found: np.ndarray) -> list[int]:
    """The best chain of runs: they follow each other in document and template; hits less changes of place."""
    place, first, last, hits_of = found.T
    score, before = hits_of.astype(float), np.full(len(found), -1)
    for k in range(1, len(found)):
        ok = (first[:k] < first[k]) & (last[:k] < last[k]) & (first[:k] - place[:k] < first[k] - place[k])
        if ok.any():
            # stray hits may lengthen a run past the next one's beginning: what overlaps does not count twice
            own = np.clip((last[k] - np.maximum(first[k] - 1, last[:k])) / (last[k] - first[k] + 1), 0, 1)
            gain = np.where(ok, score[:k] + own * hits_of[k] - 2 - np.abs(place[:k] - place[k]) / 4, -np.inf)
            j = int(np.argmax(gain))
            if gain[j] > score[k]:
                score[k], before[k] = gain[j], j
    k, out = int(np.argmax(score)), []
    while k >= 0:
        out.append(k)
        k = int(before[k])
    return out[::-1]


def align_chain(template: np.ndarray, words: np.ndarray, parts: np.ndarray, need: float) -> tuple[int, int, int, int]:
    """(matched words, words put in between, first word, end word) of a chain of runs; (0, 0, 0, 0) under ``need``."""
    n = len(template)
    places = parts[:, 0].tolist()
    begins, ends = [0], []
    for (d, first_1, last_1, _), (e, first_2, last_2, _) in zip(parts.tolist(), parts[1:].tolist()):
        # from one run's template part to the next one's: the cut with the most equal words on both sides
        lo = max(begins[-1] + 1, min(first_2 - e, last_1 - d) - RUN)
        hi = max(lo, min(n - 1, max(first_2 - e, last_1 - d) + RUN))
        at = np.arange(lo, hi + 1)
        gone = max(0, d - e)  # template words that the document leaves out

        def equal(place, q):
            p = q + place
            ok = (q < n) & (p >= 0) & (p < len(words))
            return ok & (template[np.minimum(q, n - 1)] == words[np.clip(p, 0, len(words) - 1)])

        before = np.concatenate(([0], np.cumsum(equal(d, at))[:-1]))
        after = np.cumsum(equal(e, at + gone)[::-1])[::-1]
        cut = lo + int(np.argmax(before + after))
        ends.append(cut)
        begins.append(min(n, cut + gone))
    ends.append(n)
    cuts, at = begins, [q + p for q, p in zip(begins, places)]
    limits = [*at[1:], len(words)]
    # at most as many words match as occur in their bands at all
    possible = 0
    for q, end, p in zip(cuts, ends, at):
        near = np.zeros(end - q, bool)
        for shift in range(p - BAND, p + BAND + 1):
            lo, hi = max(0, -shift), min(end - q, len(words) - shift)
            if lo < hi:
                near[lo:hi] |= words[shift + lo:shift + hi] == template[q + lo:q + hi]
        possible += int(near.sum())
    if possible < need:
        return 0, 0, 0, 0
    total, put_in, begin, done = 0, 0, None, 0
    for q, end, p, limit in zip(cuts, ends, at, limits):
        late = max(0, done - p)  # template words that would stand before the words that are left
        q, p = q + late, p + late
        got, a, b = align(template[q:min(end, q + limit - p)], words[done:limit], p - done)
        if got:
            a, b = a + done, b + done
            if begin is None:
                begin = a
            else:
                put_in += max(0, a - done)
            total, done = total + got, b
    return total, put_in, begin or 0, done


def align(template: np.ndarray, words: np.ndarray, place: int) -> tuple[int, int, int]:
    """(matched words, first word, end word) of the best alignment in the band around ``place``.

    Cell j of row i holds the best score of template[:i] against a document stretch that ends at word
    place + i + j - BAND, with the matches and the start of that alignment.
    """
    width = 2 * BAND + 1
    low = -(10 ** 6)
    score = [0 if 0 <= place + j - BAND <= len(words) else low for j in range(width)]
    matched = [0] * width
    start = [place + j - BAND for j in range(width)]
    for i in range(len(template)):
        new, got, began = [low] * width, [0] * width, [0] * width
        for j in range(width):
            at = place + i + j - BAND  # the document word beside template word i
            if 0 <= at < len(words):
                same = bool(words[at] == template[i])
                new[j], got[j], began[j] = score[j] + (1 if same else -1), matched[j] + same, start[j]
            if j + 1 < width and 0 <= at + 1 <= len(words) and score[j + 1] - 1 > new[j]:  # template word left out
                new[j], got[j], began[j] = score[j + 1] - 1, matched[j + 1], start[j + 1]
            if j and 0 <= at < len(words) and new[j - 1] - 1 > new[j]:  # document word left out
                new[j], got[j], began[j] = new[j - 1] - 1, got[j - 1], began[j - 1]
        score, matched, start = new, got, began
    best = max(range(width), key=lambda j: (score[j], matched[j], -j))
    if score[best] <= low // 2:
        return 0, place, place
    return matched[best], start[best], min(len(words), place + len(template) + best - BAND)


def hits(index: Index, words: np.ndarray, least: float) -> list[tuple[int, float, str, int, int]]:
    """(-matched, -coverage, name, first word, end word) of the notices in one text, overlapping ones too."""
    found = []
    for t, place in index.candidates(words):
        if not index.possible(t, words, place, least):
            continue
        got, a, b = align(index.words[t], words, place)
        if got >= least * len(index.words[t]) and b > a and index.decided(t, words, a, b):
            found.append((-got, -got / len(index.words[t]), index.names[t], a, b))
    prints = index.prints(words)
    for t in np.unique(prints[:, 0]).tolist():
        n = len(index.words[t])
        # fewer fingerprints than this cannot cover the words that are needed: each stands for GRAM + WINNOW words at most
        enough = least * n / (GRAM + WINNOW) / 2
        own = prints[prints[:, 0] == t][:, 1:]
        open_parts = [own] if n > NOTICE else []
        while open_parts:
            own = open_parts.pop()
            if len(own) < enough:
                continue
            parts = runs(own)
            parts = parts[chain(parts)]
            got, put_in, a, b = align_chain(index.words[t], words, parts, least * n)
            if got >= least * (n + put_in):
                found.append((-got, -got / n, index.names[t], a, b))
            lo, hi = (a, b) if got else (int(parts[0, 1]), int(parts[-1, 2]) + 1)
            open_parts += [own[own[:, 1] < lo], own[own[:, 1] >= hi]]
    return found


def resolve(found: list[tuple]) -> list[tuple]:
    """Of overlapping hits the one with more matched words, in the order of the text."""
    out: list[tuple] = []
    for x in sorted(found):
        if all(x[4] <= y[3] or x[3] >= y[4] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: x[3])


def find(index: Index, words: np.ndarray, least: float) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, matched, first word, end word) of the notices in one text."""
    return [(name, -coverage, -got, a, b) for got, coverage, name, a, b in resolve(hits(index, words, least))]


def scan(docs: DataFrame, templates: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
         name_col: str = "license", template_col: str = "template") -> DataFrame:
    """(id, license, coverage, matched, start_word, end_word, start, end): a row for each notice found; start and end
    are positions in the UTF-8 bytes of the text. Documents without a notice have no row."""
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    size = templates.agg(F.sum(F.octet_length(template_col))).first()[0] or 0
    n = size // (4 * MAX_WORDS) + 1  # a word and its gap take four bytes or more, as a rule
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["license", "coverage", "matched", "start_word", "end_word", "start", "end"]
    kinds = [pa.string(), pa.float64()] + [pa.int64()] * 5
    fields = "license string, coverage double, matched long, start_word long, end_word long, start long, `end` long"
    finds = "array<struct<negative: long, minus: double, license: string, a: long, b: long, start: long, end: long>>"
    if n > 1:  # rows of the same id and text have the same finds
        narrow = narrow.withColumn("same", F.md5("text"))
    out = None
    for k in range(n):
        rows = templates.where(F.pmod(F.xxhash64(name_col, template_col), F.lit(n)) == k)
        shared = share(spark, Index(sorted((str(a), b) for a, b in rows.select(name_col, template_col).collect()
                                           if b is not None)))

        def texts(column, own):
            """(row, [hit with its bytes]) of each text with a hit."""
            for b in word_blocks(column, ALNUM, True):
                # blocks without any indexed fingerprint are done at once
                if not len(b.hashes) or not any(np.isin(shingles(b.hashes, s), own.hashes).any() for s in own.sizes):
                    continue
                for d in range(b.hi - b.lo):
                    lo, hi = b.bounds[d], b.bounds[d + 1]
                    found = [(*x, int(b.starts[lo + x[3]] - b.offsets[d]), int(b.ends[lo + x[4] - 1] - b.offsets[d]))
                             for x in hits(own, b.hashes[lo:hi], least)]
                    if found:
                        yield b.lo + d, found

        def run(batches, shared=shared):
            index = shared_value(shared)
            for batch in batches:
                keys, found = [], []
                for row, own in texts(batch.column(1), index):
                    for x in resolve(own):
                        keys.append(row)
                        found.append(_row(x))
                yield _batch(batch.column(0), keys, found, names, kinds)

        def run_block(batches, shared=shared, k=k):
            kind_of = pa.list_(pa.struct(list(zip(("negative", "minus", "license", "a", "b", "start", "end"),
                                                  [pa.int64(), pa.float64(), pa.string()] + [pa.int64()] * 4))))
            index = shared_value(shared)
            for batch in batches:
                found = list(texts(batch.column(1), index))
                at = pa.array([row for row, _ in found], pa.int64())
                keys = ("negative", "minus", "license", "a", "b", "start", "end")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), pa.array([k] * len(found), pa.int64()),
                     pa.array([[dict(zip(keys, x)) for x in own] for _, own in found], kind_of)],
                    names=["id", "same", "block", "finds"])

        part = (narrow.mapInArrow(run, f"id {kind}, {fields}") if n == 1 else
                narrow.mapInArrow(run_block, f"id {kind}, same string, block long, finds {finds}"))
        out = part if out is None else out.union(part)
    if n > 1:
        def settle(batches):
            for batch in batches:
                keys, found = [], []
                for row, parts in enumerate(batch.column(1).to_pylist()):
                    blocks = {p["block"]: p["finds"] for p in parts}
                    own = [_row(x) for x in resolve([tuple(f.values()) for p in blocks.values() for f in p])]
                    for _ in range(len(parts) // len(blocks)):  # once for each of the equal rows
                        keys += [row] * len(own)
                        found += own
                yield _batch(batch.column(0), keys, found, names, kinds)

        out = (out.groupBy("id", "same").agg(F.collect_list(F.struct("block", "finds")).alias("parts"))
               .select("id", "parts").mapInArrow(settle, f"id {kind}, {fields}"))
    return out.withColumnRenamed("id", id_col)


def _row(x: tuple) -> tuple:
    got, coverage, name, a, b, start, end = x
    return name, round(-coverage, 6), -got, a, b, start, end


def _batch(ids: pa.Array, keys: list[int], found: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(keys, pa.int64())),
                                       *[pa.array(list(c), t) for c, t in zip(columns, kinds)]], names=["id", *names])
