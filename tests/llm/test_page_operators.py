"""HTML extraction, WARC derivatives, language ID, license scans and token rollups on small inputs."""

import base64
import gzip
import hashlib
import random
import tempfile

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import tiktoken

from jobsight.llm import html_extract, language_id, license_scan, token_rollups, warc
from jobsight.llm.bpe import read_ranks

# ---- HTML extraction ---------------------------------------------------------

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><div class="wrap sidebar-right">
<div id=menu><a href=x>Home</a></div><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article class="post"><header><h1>Title &amp; x</h1></header><p>First <b>pa</b>ra.</p><div class="ad">Buy</div>
<p>Short.</p><form>mail <input> me</form><p><b>Last&nbsp;one 3 < 4<br><p>End</p>
<section id="comments"><p>nice!</p></section></article><aside>related</aside></div><footer>f</footer>"""


def test_article_is_kept_whole():
    assert html_extract.extract(PAGE) == "Title & x First para. Short. Last one 3 < 4 End"


def test_pages_without_article():
    body = "<p>" + "long text here " * 20 + "</p><p>short</p><p>" + "more words go " * 15 + "</p>"
    page = "<nav><a href=a>Home</a></nav>" + body + "<ul>" + "<li><a href=b>link one</a></li>" * 9 + "</ul>"
    assert html_extract.extract(page) == " ".join(("long text here " * 20 + "short " + "more words go " * 15).split())


def test_stretches():
    assert html_extract.stretches([0, 0, 50, 60, 0, 0, 0, 0, 9, 0], 40) == [(2, 4)]
    assert html_extract.stretches([5, 5, 5], 1) == [(0, 3)]
    assert html_extract.stretches([], 1) == []


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("x", "x"), ("<p>", ""), ("<nav>open only<p>body text", "open only body text"),
    ("<!-- a", ""), ("a < b > c", "a < b > c"), ("<script>x", ""), ("a&#233;&amp;", "aé&"), ("<p>a</p><p>b</p>", "a b")])
def test_damaged_pages(page, text):
    assert html_extract.extract(page) == text


BODY = "<p>" + "long text here " * 20 + "</p><p>" + "more words go " * 15 + "</p>"
BODY_TEXT = ("long text here " * 20 + "more words go " * 15).strip()


@pytest.mark.parametrize("page, text", [
    ("<div class='wrap sidebar-right'>" + BODY + "</div>", BODY_TEXT),
    ("<div id=page class='has-sidebar'>" + BODY + "<div class='sidebar'>about us</div></div>", BODY_TEXT),
    ("<form action=x>" + BODY + "<form>mail me</form></form>", BODY_TEXT),
    ("<div class='has-sidebar'>" + BODY + "<div id=comments>" + "<p>" + "nice " * 300 + "</p></div></div>", BODY_TEXT),
    (f"<article><h2 id='related-work'>Related work</h2>{BODY}</article>", "Related work " + BODY_TEXT),
    (f"<article>{BODY}<section id='social-impact'><p>Impact</p></section></article>", BODY_TEXT + " Impact"),
    (f"<article>{BODY}<section id='search'><p>Search</p></section></article>", BODY_TEXT + " Search"),
    (f"<article><div class='entry-header'><h1>Head</h1></div>{BODY}</article>", "Head " + BODY_TEXT),
    (f"<article>{BODY}<div class='side-by-side'>both</div></article>", BODY_TEXT + " both"),
    (f"<article>{BODY}<div class='share-buttons'>Tweet</div><div id=related_posts>x</div></article>", BODY_TEXT),
    (f"<article>{BODY}</article><div id=comments><article class='comment-body'>{BODY}</article></div>", BODY_TEXT),
    ("<article><p class='ad'>Buy<p>one</p><p>two</p></article>", "one two"),
    ("<article><ul><li class='share'>Tweet<li>one<ul><li>in</li></ul></li><li>two</li></ul></article>", "one in two"),
    ("<article><table><tr><td class=ad>Buy<td>one<tr><td>two</table>end</article>", "one two end"),
    ("<article><div><p class='ad'>Buy</div>one</article>", "one"),
    ("<a name=top>" + BODY, BODY_TEXT)])
def test_hiding_leaves_the_main_text(page, text):
    assert html_extract.extract(page) == text


def _block(*texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


LONG = [("w%d " % i * 133).strip() for i in range(4)]  # four paragraphs of about 400 characters
ITEMS = ["list item number %d" % i for i in range(4)]
LINKS = "<ul>" + "".join(f"<li><a href={i}>see also this page {i}</a></li>" for i in range(5)) + "</ul>"
LINK_TEXT = " ".join(f"see also this page {i}" for i in range(5))


@pytest.mark.parametrize("page, text", [
    (_block(*LONG[:2]) + "<ul>" + _block(*ITEMS, tag="li") + "</ul>" + _block(*LONG[2:]),
     " ".join(LONG[:2] + ITEMS + LONG[2:])),
    (_block(*LONG[:2]) + _block(*["- Yes?", "- No."] * 20) + _block(*LONG[2:]),
     " ".join(LONG[:2] + ["- Yes?", "- No."] * 20 + LONG[2:])),
    (_block(LONG[0]) + "<p><a href=x>one link alone</a></p>" + _block(LONG[1]),
     LONG[0] + " one link alone " + LONG[1]),
    ("<section>" + _block(*LONG[:2], *ITEMS) + "</section><section>" + _block(*LONG[2:]) + "</section>",
     " ".join(LONG[:2] + ITEMS + LONG[2:])),
    ("<div>" + _block(*LONG[:2]) + LINKS + _block(*LONG[2:]) + "</div>", " ".join(LONG[:2] + [LINK_TEXT] + LONG[2:])),
    ("<div><div>" + _block(LONG[0]) + "</div>" + LINKS + "<div>" + _block(LONG[1]) + "</div></div>",
     " ".join([LONG[0], LINK_TEXT, LONG[1]])),
    ("<div>" + _block("Head", "by me", "today", "in town") + _block(*LONG) + _block(*ITEMS, tag="li") + "</div>"
     + "<div>Copyright</div>", " ".join(["Head", "by me", "today", "in town"] + LONG + ITEMS)),
    ("<article>Teaser</article>" + _block(*LONG), " ".join(["Teaser"] + LONG)),
    (_block(*LONG) + "<div>" + LINKS + "<article>Teaser</article></div>", " ".join(LONG)),
    ("<article>" + _block(*LONG[:2]) + "</article>" + LINKS + "<article>" + _block(*LONG[2:]) + "</article>",
     " ".join(LONG)),
    ("<div>" + _block(*LONG) + "</div><div>" + LINKS + "</div><div>" + _block("terms " * 30) + "</div>",
     " ".join(LONG))])
def test_unmarked_pages_are_kept_whole(page, text):
    assert html_extract.extract(page) == text


def test_hiding_by_long_names_ends():
    name = "ad_" + "1_" * 5000 + "x!"
    assert html_extract.extract(f"<div class='{name}'>" + BODY + "</div>") == BODY_TEXT
    assert html_extract.extract("<b>" * 50_000 + "<p>x" * 1000) == " ".join("x" * 1000)


def test_large_pages_of_many_stretches():
    page = ("<div>" * 3 + "<p>" + "x" * 200 + "</p>" + LINKS + "</div>" * 3) * 2000
    assert html_extract.extract("<div>" * 20_000 + page + "</div>" * 20_000).count("x" * 200) == 2000


def test_html_query(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "<p>" + "wört " * 50_000, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.main_text(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["n_chars"] for r in got if r["page_id"] is None] == [249_999]
    assert html_extract.main_text(df.limit(0)).count() == 0


# ---- WARC --------------------------------------------------------------------

def _sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=fr><title>T &amp;\n U</title><body><p>Hé <a href=x>b</a></p>"
                                    "<script>z</script><p>c</p>"), (2, "http://b/", None), (3, None, ""),
                                   (1, "http://b/", "x" * 200_000)], "page_id long, url string, html string")
    responses = warc.page_responses(pages, "2024-01-01T00:00:00Z")
    source = {r["headers"]["WARC-Record-ID"]: r for r in responses.collect()}
    records = warc.derive(responses).collect()
    assert len(records) == 8 and len({r["record_id"] for r in records}) == 8
    for r in records:
        h, s = r["headers"], source[r["refers_to"]]
        assert h["WARC-Refers-To"] == r["refers_to"] and h["WARC-Type"] == r["record_type"]
        assert h["WARC-Source-Payload-Digest"] == s["headers"]["WARC-Payload-Digest"]
        assert h["WARC-Block-Digest"] == _sha1(r["block"])
        assert int(h["Content-Length"]) == len(r["block"].encode())
        assert h.get("WARC-Target-URI", "") == (s["headers"]["WARC-Target-URI"] or "")
    first = {r["record_type"]: r for r in records if r["headers"].get("WARC-Target-URI") == "http://a/"}
    assert first["conversion"]["block"] == "Hé b\nc"
    assert first["metadata"]["block"].split("\r\n")[:3] == ["title: T & U", "language: fr", "links: 1"]
    again = {r["record_id"] for r in warc.derive(responses.repartition(3)).collect()}
    assert again == {r["record_id"] for r in records}
    folder = tempfile.mkdtemp(prefix="warc-") + "/out"
    warc.write_warc(warc.derive(responses), folder)
    back = warc.read_warc(spark, folder)
    assert sorted((r["headers"]["WARC-Record-ID"], r["block"]) for r in back.collect()) == sorted(
        (r["record_id"], r["block"]) for r in records)


def test_warc_without_fields(spark):
    df = spark.createDataFrame([(None, None, 1), ({"X-Own": "v", "WARC-Date": None}, "no http", 1),
                                ({}, "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n<b>kept</b>", 1)],
                               "headers map<string,string>, block string, record_id int")
    got = warc.derive(df).collect()
    assert len(got) == 6 and all(r["refers_to"].startswith("<urn:uuid:") for r in got)
    assert {r["block"] for r in got if r["record_type"] == "conversion"} == {"", "no http", "<b>kept</b>"}
    assert {r["headers"].get("WARC-Source-X-Own") for r in got} == {None, "v"}
    assert warc.derive(df.limit(0)).count() == 0
    assert warc.parse(gzip.decompress(gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"))) == [
        ([("Content-Length", "2")], "ab")]


# ---- language ID -------------------------------------------------------------

WORDS = {"en": "the of and with that from tion ing", "de": "der und nicht für ein zung schen keit",
         "fr": "le les une est pas que eaux ment"}


def _sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(1, 2))) for _ in range(n))


def test_language_fusion(spark):
    rnd = random.Random(1)
    texts = [(lang, _sentence(rnd, lang, 60)) for lang in WORDS for _ in range(30)] + [(None, "x"), ("en", None)]
    pages = []
    for i in range(240):
        lang = rnd.choice(list(WORDS))
        host = f"{lang}{i % 4}.{'hot' if i % 3 else 'cold'}.{'com' if i % 2 else lang}"
        text = _sentence(rnd, lang, 40) if i % 10 else ""  # every tenth page has no text: the other evidence decides
        pages.append((i, f"https://{host}/{lang}/{i}", f"<html lang='{lang}'><p>{text}</p>", lang, 1.0))
    odd = [(900, None, None, "x", 0.0), (901, "", "", "x", 0.0), (902, "::", "<html lang=>", "x", 0.0),
           (903, "https://en0.hot.com/en/1", "<html lang='en'>" + _sentence(rnd, "de", 3000), "x", 0.0)]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string, lang string, probability double")
    lab = spark.createDataFrame(texts, "lang string, text string")
    got = {r["page_id"]: r for r in language_id.identify(df, lab).collect()}
    assert len(got) == 244
    assert all(got[i]["lang"] == lang for i, _, _, lang, _ in pages)
    assert got[903]["text_lang"] == "de" and got[903]["declared"] == "en"
    assert all(r["lang"] in WORDS and 0 < r["probability"] <= 1 for r in got.values())
    assert language_id.identify(df.limit(0), lab).count() == 0
    nothing = language_id.identify(df, lab.limit(0)).collect()
    assert len(nothing) == 244 and {r["lang"] for r in nothing} == {None}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, logs = language_id.model(language_id.train(docs.where("doc_id % 2 = 0")))
    held = docs.where("doc_id % 2 = 1 and n_chars > 200").collect()
    right = sum(langs[language_id.log_likelihood(r["text"], logs).argmax()] == r["lang"] for r in held)
    assert right >= 0.97 * len(held)


# ---- license scans -----------------------------------------------------------

def test_license_scan(spark, monkeypatch):
    names = "license string, template string"
    templates = spark.createDataFrame(license_scan.TEMPLATES + [("none", None), ("none", ""), ("two", "zz yy")], names)
    mit = license_scan.TEMPLATES[3][1]
    changed = mit.replace("any person", "each and every person").replace("merge, ", "")
    docs = [(1, "Some words here.\nReleased under the MIT License.\nmore"), (2, "lorem ipsum " * 9000 + mit.upper() + " end"),
            (3, "intro " + changed), (4, None), (5, ""), (6, "the of and license released"), (7, "a zz yy b"),
            (8, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License"),
            (1, "Some words here.\nReleased under the MIT License.\nmore")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, start int, license string")
    for limit in (license_scan.MAX_WORDS, 40):  # one block of templates, and several
        monkeypatch.setattr(license_scan, "MAX_WORDS", limit)
        got = license_scan.scan(df, templates).collect()
        found = sorted((str(r["doc_id"]), r["license"], r["coverage"] == 1) for r in got)
        assert found == sorted([("1", "MIT", True)] * 2 + [("2", "MIT", True), ("3", "MIT", False), ("7", "two", True),
                                ("8", "Apache-2.0", True), ("8", "CC-BY-NC-4.0", True), ("None", "MIT", True)])
    two = next(r for r in got if r["doc_id"] == 2)
    text = dict(docs[1:3])[2].encode()
    assert text[two["start"]:two["end"]].decode().startswith("PERMISSION IS") and two["matched"] == two["end_word"] - two["start_word"]
    assert 0.9 < next(r for r in got if r["doc_id"] == 3)["coverage"] < 1
    assert license_scan.scan(df.limit(0), templates).count() == 0
    assert license_scan.scan(df, templates.limit(0)).count() == 0


CC = "This work is licensed under a Creative Commons Attribution"
NEAR_MISSES = [  # (notice, license by the whole library, by TEMPLATES alone)
    (CC + "-NonCommercial-NoDerivatives 4.0 International License", ["CC-BY-NC-ND-4.0"], []),
    (CC + "-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"], []),
    (CC + "-Share Alike 3.0 Unported License", ["CC-BY-SA-3.0"], []),
    (CC + " 4.0 International License", ["CC-BY-4.0"], ["CC-BY-4.0"]),
    (CC + " 9.0 International License", [], []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"], []),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], ["GPL-3.0"]),
    ("This work is licensed under the terms and conditions of the GNU General Public License, version 3.", ["GPL-3.0"],
     ["GPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"], []),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"], []),
    ("This work is licensed under the GNU Free Documentation License, version 1.3.", ["GFDL-1.3"], []),
    ("Licensed under CC BY 4.0", ["CC-BY-4.0"], []), ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"], ["CC-BY-NC-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"], []), ("Licensed under CC BY-NC-SA 8.0", [], []),
    ("Released under the BSD License", ["BSD"], []), ("Released under the ISC License", ["ISC"], []),
    ("Released under the XYZ License", [], []),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 2", ["Apache-2.0"], ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1.", [], []), ("Licensed under the Apache License, Version 2.1", [], []),
    ("SPDX-License-Identifier: LGPL-2.1", ["LGPL-2.1"], [])]


def _found(templates, texts):
    import pyarrow as pa
    index, out = license_scan.Index(templates), []
    for b in license_scan.word_blocks(pa.array(texts, pa.large_string()), license_scan.ALNUM, True):
        out += [license_scan.find(index, b.hashes[b.bounds[d]:b.bounds[d + 1]], 0.8) for d in range(b.hi - b.lo)]
    return out


def test_license_siblings():
    texts = [f"some words before. {t} And some after it." for t, _, _ in NEAR_MISSES]
    for templates, k in ((license_scan.library(), 1), (license_scan.TEMPLATES, 2)):
        got = [[x[0] for x in found] for found in _found(templates, texts)]
        assert got == [m[k] for m in NEAR_MISSES]


def test_full_license_texts():
    own = license_scan.library()
    full = [(n, t) for n, t in own if len(t) > 600]
    assert {n for n, _ in full} >= {"MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0",
                                    "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0"}
    for (name, _), found in zip(full, _found(own, ["Intro words. " + t for _, t in full])):
        assert [(x[0], x[1]) for x in found if x[2] > 80] == [(name, 1)], name
    assert [n for n, _ in own].count("AGPL-3.0") >= 5


def test_blocks_of_templates_do_not_show(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    templates = spark.createDataFrame([(f"{a}-{b}", " ".join(words[a:b])) for a, b in
                                       [(0, 10), (8, 20), (18, 40), (0, 40), (3, 12), (12, 21), (20, 30)]],
                                      "license string, template string")
    text = " ".join(words)
    docs = [(1, text), (1, text), (1, " ".join(words[:20])), (2, " ".join(words[3:24])), (None, "x " + " ".join(words[8:30])),
            (None, None), (3, text + " x " + text), (4, "nothing")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    results = []
    for limit in (license_scan.MAX_WORDS, 20, 5):  # 1, 6 and 21 blocks
        monkeypatch.setattr(license_scan, "MAX_WORDS", limit)
        results.append(sorted(map(str, license_scan.scan(df, templates).collect())))
    assert results[0] == results[1] == results[2]
    assert sum("doc_id=1," in x and "license='0-40'" in x for x in results[0]) == 2
    assert sum("doc_id=3," in x for x in results[0]) == 2


def test_winnowing_finds_every_long_enough_run():
    import numpy as np
    rng = np.random.default_rng(0)
    for _ in range(300):
        run = rng.integers(0, 50, license_scan.GRAM + license_scan.WINNOW - 1).astype(np.uint64)
        doc = np.concatenate((rng.integers(50, 99, 20).astype(np.uint64), run, rng.integers(50, 99, 9).astype(np.uint64)))
        grams = license_scan.shingles(doc, license_scan.GRAM)
        assert np.isin(grams[license_scan.winnow(grams)], license_scan.shingles(run, license_scan.GRAM)).any()


# ---- token rollups -----------------------------------------------------------

SCHEMA = "doc_id long, version string, source string, lang string, n_tokens long, kind string"


def test_rollups_follow_the_changes(spark):
    rnd = random.Random(2)
    store = token_rollups.RollupStore(spark, tempfile.mkdtemp(prefix="rollups-"))
    assert store.totals().count() == 0
    state = {}
    for batch in range(5):
        rows = {}
        for _ in range(40):
            key = (rnd.randrange(30), rnd.choice(["v1", "v2"]))
            kind = rnd.choice(["insert", "delete", "revise"]) if batch else "insert"
            rows[key] = (*key, rnd.choice(["s", None]), rnd.choice(["en", "de", None]),
                         rnd.choice([None, rnd.randrange(100)]), kind)
        for key, r in rows.items():
            state.pop(key, None)
            if r[5] != "delete":
                state[key] = (r[2], r[3], r[1], r[4] or 0)
        df = spark.createDataFrame(list(rows.values()), SCHEMA)
        assert store.commit(f"b{batch}", df)
        assert not store.commit(f"b{batch}", df)  # a batch that arrives again changes nothing
        want = {}
        for s, lang, v, n in state.values():
            a, b = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (a + 1, b + n)
        assert {tuple(r[:3]): tuple(r[3:]) for r in store.totals().collect()} == want


def test_rollups_survive_a_broken_commit(spark):
    store = token_rollups.RollupStore(spark, tempfile.mkdtemp(prefix="rollups-"))
    one = spark.createDataFrame([(1, "v", "s", "en", 5, "insert"), (1, "v", "s", "en", 9, "insert")], SCHEMA)
    store.signed().limit(0).write.parquet(store._path("batches", "b0"))  # written, but never logged
    assert store.totals().count() == 0
    store.commit("b0", one)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 9)]
    store.commit("b1", one.limit(0))
    with pytest.raises(Exception, match="a change needs"):
        store.commit("b2", spark.createDataFrame([(None, "v", "s", "en", 5, "insert")], SCHEMA))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 9)]
    with pytest.raises(ValueError):
        store.commit("../x", one)


def test_count_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(read_ranks(path))})
    rnd = random.Random(3)
    texts = [None, "", "  two  spaces\n\nand it's\tmore "] + ["".join(rnd.choice("ab c\n'sé ") for _ in range(50))
                                                            for _ in range(200)]
    df = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in enumerate(texts)],
                               "doc_id long, text string, source string, lang string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in token_rollups.count_tokens(df, {"v": path}, public_tokenizers.PATTERN).collect()}
    assert got == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}


# ---- edited full texts -------------------------------------------------------

def _found_in_library(text):
    index = license_scan.Index(license_scan.library())
    b = next(license_scan.word_blocks(pa.array([text], pa.large_string()), license_scan.ALNUM, True))
    return license_scan.find(index, b.hashes, 0.8)


@pytest.mark.parametrize("name", ["GPL-3.0", "Apache-2.0", "MPL-2.0", "BSD-3-Clause"])
def test_edited_full_texts_are_found_whole(name):
    """Twenty words out, twenty in, some everywhere, and the text twice: one find for each copy."""
    words = max((t for n, t in license_scan.library() if n == name), key=len).split()
    n, h = len(words), len(words) // 2
    new = [f"n{k}" for k in range(20)]
    edits = {"same": words, "in": words[:h] + new + words[h:], "out": words[:h] + words[h + 20:],
             "both": words[:h // 2] + new + words[h // 2:h] + words[h + 20:],
             "often": [x for k, w in enumerate(words) for x in ([w] if k % 150 else [*new[:9], w])]}
    for label, own in edits.items():
        got = _found_in_library(" ".join(["before"] * 30 + own + ["after"] * 30))
        assert [g[0] for g in got] == [name], label
        _, coverage, matched, a, b = got[0]
        lost = 20 if label in ("out", "both") else 0
        assert coverage >= (n - lost) / n - 0.005 and a >= 30 and b - a >= matched, label
    twice = _found_in_library(" ".join(edits["both"] + ["between"] * 40 + edits["in"]))
    assert [g[0] for g in twice] == [name, name] and twice[0][4] <= twice[1][3]


# ---- hostile pages, streamed WARC files, stored totals -------------------------

HOSTILE = ["<script>", "<title>", "<textarea>", '<a "', "<a '", '<a ">" ', "<html ", "<a ", "<!--", "<head><title ", "<p", "&", "<style>x</style "]


@pytest.mark.parametrize("unit", HOSTILE)
def test_hostile_megabyte_pages_take_linear_time(unit):
    import time
    page = unit * (1_000_000 // len(unit))
    begin = time.process_time()
    warc.plain_text(page)
    warc.head_fields(page)
    assert time.process_time() - begin < 2


def test_plain_text_by_small_cases():
    for page, text in (("a<script>b</script>c", "ac"), ("a<script>b", "ab"), ("<p>a<p title='>'>b", "a\nb"), ("1 < 2 <b>x</b>", "1 < 2 x"),
                       ("<head><title>t</title>rest</head>x", "restx"), ("a<!-- b --><!-- c", "a<!-- c"), ("<a 'x>y</a>", "y"), ("", "")):
        assert warc.plain_text(page) == text, page


def test_only_responses_have_derivatives(spark):
    heads = [{"WARC-Type": "request"}, {"WARC-Type": "warcinfo"}, {"WARC-Type": "Response"}, {}, None]
    rows = [(h, "HTTP/1.1 200 OK\r\n\r\n<p>x", "z") for h in heads]
    df = spark.createDataFrame(rows, "headers map<string,string>, block string, record_id string")
    assert warc.derive(df).count() == 6
    assert warc.derive(df.limit(0)).count() == 0


def test_warc_files_are_read_member_by_member(spark):
    def member(k, body):
        return gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nX: a\r\nX: b\r\nN: {k}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                             + body + b"\r\n\r\n")
    bodies = [b"", b"x" * 3_000_000, "é\r\n\r\nWARC/1.1 inside".encode()] + [b"b%d" % k for k in range(300)]
    data = b"".join(member(k, b) for k, b in enumerate(bodies))
    for step in (1000, 1 << 20):
        got = list(warc.records(warc.inflated(data, step)))
        assert [b.encode() for _, b in got] == bodies
    folder = tempfile.mkdtemp(prefix="warc-")
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(data)
    back = warc.read_warc(spark, folder, rows=7).collect()
    assert sorted(int(r["headers"]["N"]) for r in back) == list(range(len(bodies)))
    assert {r["headers"]["X"] for r in back} == {"a"}
    with open(f"{folder}/b.warc.gz", "wb") as f:
        f.write(gzip.compress(b""))
    assert warc.read_warc(spark, folder).count() == len(bodies)


def test_rollup_totals_are_stored_and_writers_collide(spark):
    import os
    folder = tempfile.mkdtemp(prefix="rollups-")
    store = token_rollups.RollupStore(spark, folder, buckets=256)
    load = spark.range(5000).select("id", F.lit("v").alias("version"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                    F.lit("en").alias("lang"), F.lit(2).alias("n_tokens"), F.lit("insert").alias("kind"))
    assert store.commit("load", load.withColumnRenamed("id", "doc_id"))
    sizes = lambda: {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs if "/state/" in d}
    before = sizes()
    few = spark.createDataFrame([(k, "v", "s9", "de", 7, "revise") for k in range(25)], SCHEMA)
    # another writer publishes the same version in between
    other, real = token_rollups.RollupStore(spark, folder, buckets=256), store._publish
    store._publish = lambda *a: (other.commit("other", few.limit(0)), real(*a))
    with pytest.raises(token_rollups.ConcurrentCommit):
        store.commit("few", few)
    store._publish = real
    assert store.committed() == ["load", "other"]
    middle = sizes()
    assert store.commit("few", few)
    new = sum(v for k, v in sizes().items() if k not in middle)
    assert 0 < new < 0.25 * sum(before.values())
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}
    assert got[("s9", "de")] == (25, 175) and sum(n for n, _ in got.values()) == 5000
    # the stored totals are those of the signed rows of all batches
    again = store.signed().groupBy("source", "lang").agg(F.sum("n_docs").alias("n"), F.sum("n_tokens").alias("t")).where("n <> 0")
    assert {(r["source"], r["lang"]): (r["n"], r["t"]) for r in again.collect()} == got


def test_main_text_of_an_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text int, n_chars string")
    assert html_extract.main_text(df).count() == 0
