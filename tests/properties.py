"""The two properties that define the duplicates of D5, checked on a similarity matrix.

``rows`` are normalized postings in (company, title, url) order, ``found`` maps each duplicate's url to its
canonical's url and score. Canonicals are the postings that are nobody's duplicate.
"""

from difflib import SequenceMatcher

from jobsight import rules


def in_order(rows):
    return sorted(rows, key=lambda r: (r["company"] or "", r["title"] or "", r["url"]))


def score(first, second, title=rules.TITLE_THRESHOLD, location=rules.LOCATION_THRESHOLD,
          combined=rules.COMBINED_THRESHOLD):
    """The combined score of two postings of one company if they are similar, else None."""
    def ratio(x, y, least):
        if not x or not y:
            return 0.0
        m = SequenceMatcher(None, x.lower(), y.lower())
        return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

    x, y = set(first["key_terms"]), set(second["key_terms"])
    terms = len(x & y) / len(x | y) if x and y else 0.0
    places = first["normalized_location"], second["normalized_location"]
    place = 1.0 if [p.lower() for p in places] == ["remote", "remote"] else ratio(*places, location)
    if place < location:
        return None
    names = first["normalized_title"], second["normalized_title"]
    best = max(terms, ratio(*names, title))
    total = rules.TITLE_WEIGHT * best + rules.LOCATION_WEIGHT * place
    if best < title or total < combined:
        return None
    # the score counts the exact title ratio, also where the terms alone made the pair similar
    return rules.TITLE_WEIGHT * max(terms, ratio(*names, 0.0)) + rules.LOCATION_WEIGHT * place


def check(rows, found, **thresholds):
    blocks = {}
    for r in in_order(rows):
        blocks.setdefault(r["company_key"], []).append(r)
    for block in blocks.values():
        canonicals = [r for r in block if r["url"] not in found]
        for k, late in enumerate(canonicals):
            assert all(score(early, late, **thresholds) is None for early in canonicals[:k]), late["url"]
        place = {r["url"]: k for k, r in enumerate(block)}
        for r in block:
            if r["url"] in found:
                owner, total = found[r["url"]]
                before = [(c["url"], score(c, r, **thresholds)) for c in canonicals if place[c["url"]] < place[r["url"]]]
                similar = [(u, s) for u, s in before if s is not None]
                assert similar and similar[0][0] == owner, r["url"]
                assert abs(similar[0][1] - total) < 1e-6, r["url"]
