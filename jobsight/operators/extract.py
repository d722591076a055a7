"""Extraction from raw pages.

E1 / E8 need a real (forgiving) HTML tree: they run the stdlib html.parser
inside ``mapInArrow``, over batches of bounded bytes, emitting N postings and
one outcome per page. Everything else (listing indicators, profiles, totals,
endpoints, patterns, page plans, validation) is regex and array columns that
stay in the JVM. Patterns are written so Java and RE2 read them alike.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight import rules
from jobsight.functions.text import company_from_url, host_of, job_id_from_url
from jobsight.session import limit_arrow_batches

# ---- a minimal DOM on top of html.parser --------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}


class _Node:
    # no link to the parent: a tree without cycles goes as soon as its page is done
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, attrs, []

    def iter(self):
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, _Node):
                yield n
                stack.extend(reversed(n.children))

    def find(self, pred):
        for n in self.iter():
            if n is not self and pred(n):
                return n
        return None

    def texts(self):
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return out

    def text(self, sep=""):
        return sep.join(t.strip() for t in self.texts() if t.strip())

    def markup(self):
        """The element as HTML: attributes in quotes, text escaped, void elements closed."""
        out, stack = [], [(self, False)]
        while stack:
            n, raw = stack.pop()
            if isinstance(n, str):
                out.append(n if raw else escape(n, quote=False))
                continue
            attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}/>" if n.tag in _VOID else f"<{n.tag}{attrs}>")
            if n.tag not in _VOID:
                raw = n.tag in ("script", "style")
                stack.append((f"</{n.tag}>", True))
                stack.extend((c, raw) for c in reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: (v or "") for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: (v or "") for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_html(html: str) -> tuple[_Node, str | None]:
    """(tree, error): malformed input gives what was read before the parser gave up, and why it did."""
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception as ex:  # the parser raises errors of several kinds; they become the page's outcome
        return b.root, f"{type(ex).__name__}: {ex}"
    return b.root, None


def _class_matches(node, rx):
    return bool(rx.search(node.attrs.get("class", "")))


def postings_from_html(html: str, site_url: str, page_url: str | None = None,
                       link_pattern: str | None = rules.JOB_LINK_PATTERN,
                       title_tag: str | None = None):
    """One page -> (list of posting dicts, parser error or None): the per-row helper of E1.

    With ``link_pattern`` (default): the first <a> of each <article> whose
    href matches (case-insensitive) gives title and URL; an article without
    one yields nothing. With ``link_pattern=None`` the first ``title_tag``
    element gives the title and the page URL is the posting URL.
    """
    root, error = parse_html(html)
    link_rx = re.compile(link_pattern, re.I) if link_pattern else None
    loc_rx = re.compile(rules.LOCATION_CLASS_PATTERN, re.I)
    out = []
    for art in [n for n in root.iter() if n.tag == "article"]:
        if link_rx is not None:
            link = art.find(lambda n: n.tag == "a" and "href" in n.attrs and link_rx.search(n.attrs["href"]))
            if link is None:
                continue
            title = link.text()
            href = link.attrs["href"]
            url = href if href.startswith("http") else urljoin(site_url or "", href)
        else:
            head = art.find(lambda n: n.tag == (title_tag or "h1"))
            if head is None:
                continue
            title, url = head.text(), page_url
        loc = art.find(lambda n: "class" in n.attrs and _class_matches(n, loc_rx))
        tm = art.find(lambda n: n.tag == "time")
        date = None
        if tm is not None:
            date = tm.attrs.get("datetime") or tm.text()
        out.append({"title": title, "url": url, "location": loc.text() if loc is not None else None,
                    "date_posted": date})
    return out, error


def description_from_html(html: str):
    """E8 helper: (description_text, description_html, description_tag) of a detail page."""
    root, _ = parse_html(html)
    rx = re.compile(rules.DESCRIPTION_CLASS_PATTERN, re.I)
    for tag in ("div", "section"):
        n = root.find(lambda x, t=tag: x.tag == t and "class" in x.attrs and _class_matches(x, rx))
        if n is not None:
            return n.text("\n"), n.markup(), tag
    n = root.find(lambda x: x.tag == "article")
    if n is not None:
        return n.text("\n"), n.markup(), "article"
    return None, None, None


_PARSED = ("page_url string, site_url string, title string, url string, location string, "
           "date_posted string, postings int, error string")


def parse_pages(pages: DataFrame, link_pattern: str | None = rules.JOB_LINK_PATTERN,
                title_tag: str | None = None) -> DataFrame:
    """One parse of pages(url, site_url, html): a row per posting, and a row per page with its outcome.

    A page's row has ``postings`` (how many it gave) and ``error`` (why the parser gave up, else null); in posting
    rows ``postings`` is null. Rows go out page by page, so a batch of pages never stands in memory as rows.
    """
    limit_arrow_batches(pages.sparkSession)
    names = [c.split()[0] for c in _PARSED.split(", ")]

    def parse(batches):
        for batch in batches:
            rows = []
            for page_url, site_url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found, error = postings_from_html(html, site_url, page_url, link_pattern, title_tag)
                rows += [(page_url, site_url, p["title"], p["url"], p["location"], p["date_posted"], None, None)
                         for p in found]
                rows.append((page_url, site_url, None, None, None, None, len(found), error))
                if len(rows) >= 10_000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

    return pages.select("url", "site_url", "html").mapInArrow(parse, _PARSED)


def _batch(rows, names):
    kinds = [pa.string()] * 6 + [pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def page_outcomes(parsed: DataFrame) -> DataFrame:
    """(page_url, site_url, postings, error) of each page, from ``parse_pages``."""
    return parsed.filter(F.col("postings").isNotNull()).select("page_url", "site_url", "postings", "error")


def site_outcomes(outcomes: DataFrame, run_id: str) -> DataFrame:
    """(run, company, success, error, stopped_early) of each site, from its pages: it fails if a page does."""
    per = outcomes.groupBy(company_from_url(F.col("site_url")).alias("company")).agg(F.max("error").alias("error"))
    return per.select(F.lit(run_id).alias("run"), "company", F.col("error").isNull().alias("success"), "error",
                      F.lit(False).alias("stopped_early"))


def postings_of(parsed: DataFrame, scraped_at=None) -> DataFrame:
    """The postings of ``parse_pages``, with the column ``seq`` if ``parsed`` has one."""
    raw = parsed.filter(F.col("postings").isNull())
    meta = F.when(F.col("date_posted").isNotNull(),
                  F.create_map(F.lit("date_posted"), F.col("date_posted"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    ts = F.current_timestamp() if scraped_at is None else F.lit(scraped_at).cast("timestamp")
    return raw.select(
        "title", "url", job_id_from_url(F.col("url")).alias("job_id"), "location",
        F.col("site_url").alias("company_url"), company_from_url(F.col("site_url")).alias("company"),
        ts.alias("scraped_at"), meta.alias("metadata"), F.lit(None).cast("string").alias("description"),
        "page_url", *[c for c in parsed.columns if c == "seq"])


def extract_postings(pages: DataFrame, link_pattern: str | None = rules.JOB_LINK_PATTERN,
                     title_tag: str | None = None, scraped_at=None) -> DataFrame:
    """pages(url, site_url, html) -> postings.

    Output: title, url, job_id, location, company_url, company, scraped_at,
    metadata map<string,string> (date_posted), description (null), page_url.
    """
    return postings_of(parse_pages(pages, link_pattern, title_tag), scraped_at)


def extract_descriptions(pages: DataFrame) -> DataFrame:
    """(url, description_text, description_html, description_tag) per detail page."""
    limit_arrow_batches(pages.sparkSession)
    names = ["url", "description_text", "description_html", "description_tag"]

    def parse(batches):
        for batch in batches:
            found = [description_from_html(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in range(3)]], names=names)

    return pages.select("url", "html").mapInArrow(parse, ", ".join(f"{n} string" for n in names))


def attach_descriptions(postings: DataFrame, descriptions: DataFrame) -> DataFrame:
    """E8 join: postings left-joined with their detail-page descriptions on url."""
    d = descriptions.select("url", F.col("description_text").alias("_d"), "description_html")
    out = postings.join(d, "url", "left")
    return out.withColumn("description", F.coalesce("_d", "description")).drop("_d")


# ---- regex-level page analysis (JVM) ----------------------------------------------

PAT = rules.PAGE_PATTERNS


def markup(html):
    """The page without comments and script bodies, where tags and attributes are looked for."""
    bare = F.regexp_replace(html, rules.COMMENT_PATTERN, "")
    return F.regexp_replace(bare, rules.SCRIPT_BODY_PATTERN, "$1$2")


def listing_indicators(pages: DataFrame, status_col: str | None = None) -> DataFrame:
    """The five listing flags and is_listing (status 200 and any flag)."""
    m = markup(F.col("html"))
    flags = {
        "has_article": m.rlike(PAT["article"]),
        "has_job_class": m.rlike(PAT["job_class"]),
        "has_job_link": m.rlike(PAT["job_link"]),
        "has_listing_text": F.col("html").rlike(PAT["listing_text"]),
        "has_search_class": m.rlike(PAT["search_class"]),
    }
    ok = (F.col(status_col) == 200) if status_col else F.lit(True)
    anyf = flags["has_article"] | flags["has_job_class"] | flags["has_job_link"] | \
        flags["has_listing_text"] | flags["has_search_class"]
    return pages.select(*[c for c in pages.columns if c != "html"],
                        *[v.alias(k) for k, v in flags.items()], (ok & anyf).alias("is_listing"))


def has_next_page(pages: DataFrame) -> DataFrame:
    """A next/pagination link or a page=N link exists."""
    h = F.col("html")
    return pages.select(*[c for c in pages.columns if c != "html"],
                        (h.rlike(PAT["next_link"]) | h.rlike(PAT["page_href"])).alias("has_next_page"))


PROFILE_COUNTS = ["article", "job_div", "job_li", "job_link", "pagination", "ext_script", "rel_script",
                  "data_job", "job_title_class", "job_list_class", "ajax", "link"]


def profile_pages(pages: DataFrame) -> DataFrame:
    """Element counts of a page (regexp_count of each pattern); calls are counted in scripts, too."""
    m = markup(F.col("html"))
    return pages.select(*[c for c in pages.columns if c != "html"],
                        *[F.regexp_count(F.col("html") if k == "ajax" else m, F.lit(PAT[k])).cast("bigint")
                          .alias("n_" + k) for k in PROFILE_COUNTS])


def declared_total(pages: DataFrame) -> DataFrame:
    """The job total a page announces (first pattern that hits), as text."""
    h = F.col("html")
    first = F.nullif(F.regexp_extract(h, "(?i)" + rules.TOTAL_PATTERNS[0], 1), F.lit(""))
    second = F.nullif(F.regexp_extract(h, "(?i)" + rules.TOTAL_PATTERNS[1], 1), F.lit(""))
    return pages.select(*[c for c in pages.columns if c != "html"],
                        F.coalesce(first, second).alias("declared_total"))


def extract_endpoints(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Distinct (key, kind, endpoint) found in inline scripts and meta contents; one pass over the pages."""
    h = F.col("html")

    def found(blocks, pattern, group, kind):
        hits = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(pattern), group)))
        return F.transform(hits, lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("endpoint")))

    scripts, blocks = F.col("scripts"), F.concat("scripts", "metas")
    all_found = F.concat(*[found(blocks, p, 0, f"url{i}") for i, p in enumerate(rules.ENDPOINT_PATTERNS)],
                         *[found(scripts, p, 1, f"call{i}") for i, p in enumerate(rules.API_CALL_PATTERNS)])
    parts = pages.select(key, F.regexp_extract_all(h, F.lit(PAT["script_body"]), 1).alias("scripts"),
                         F.regexp_extract_all(h, F.lit(PAT["meta_content"]), 1).alias("metas"))
    # array_distinct makes a page's rows distinct without a shuffle: the key is unique
    return parts.select(key, F.explode(F.array_distinct(all_found)).alias("e")).select(key, "e.kind", "e.endpoint")


def extract_json_ld(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """JSON-LD blocks, their top-level keys and whether they mention JobPosting."""
    h = F.col("html")
    b = pages.select(key, F.posexplode(F.regexp_extract_all(h, F.lit(PAT["ld_json"]), 1)).alias("n", "block"))
    return b.select(key, "n", F.json_object_keys("block").alias("keys"),
                    F.col("block").contains("JobPosting").alias("is_job_posting"))


# ---- URL patterns and page plans -------------------------------------------------

def pattern_priority(pattern_col, patterns=rules.LISTING_PATTERNS):
    """Priority of a listing pattern: its position in the list, unknown ones last."""
    expr = F.lit(len(patterns))
    for i, p in reversed(list(enumerate(patterns))):
        expr = F.when(pattern_col == F.lit(p), F.lit(i)).otherwise(expr)
    return expr


def choose_pattern(candidates: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Per site the first listing pattern in priority order.

    ``candidates`` holds (site, pattern, is_listing) for fetched candidate
    pages. A cached (site, pattern) that is still a listing wins. Min over
    (priority, pattern): a hash aggregate, not a sort of the site's pages.
    """
    c = candidates.filter(F.col("is_listing")).withColumn("prio", pattern_priority(F.col("pattern")))
    if cache is not None:
        valid = cache.select("site", "pattern").join(c.select("site", "pattern"), ["site", "pattern"], "left_semi")
        c = c.unionByName(valid.withColumn("is_listing", F.lit(True)).withColumn("prio", F.lit(-1)),
                          allowMissingColumns=True)
    return c.groupBy("site").agg(F.min_by("pattern", F.struct("prio", "pattern")).alias("pattern"))


def pattern_stats(patterns: DataFrame) -> DataFrame:
    """Sites per pattern ('' shown as '(base URL)') plus an '(all)' total row."""
    named = F.when(F.col("pattern") == "", F.lit("(base URL)")).otherwise(F.col("pattern"))
    per = patterns.groupBy(named.alias("pattern_name")).agg(F.count(F.lit(1)).alias("sites"))
    tot = patterns.agg(F.count(F.lit(1)).alias("sites")).select(F.lit("(all)").alias("pattern_name"), "sites")
    return per.unionByName(tot)


def invalidate_patterns(patterns: DataFrame, site: str | None = None) -> DataFrame:
    """Drop one site's cached pattern, or all of them."""
    if site is None:
        return patterns.limit(0)
    return patterns.filter(F.col("site") != F.lit(site))


def page_url(search_url, page):
    """Page 1 is the search URL; then &page=n or ?page=n."""
    return (F.when(page == 1, search_url)
            .when(search_url.contains("?"), F.concat(search_url, F.lit("&page="), page.cast("string")))
            .otherwise(F.concat(search_url, F.lit("?page="), page.cast("string"))))


def plan_page_urls(sites: DataFrame, max_pages: int = rules.MAX_PAGES) -> DataFrame:
    """(search_url, page, page_url) for pages 1..max_pages of every site."""
    p = sites.select("search_url", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"))
    return p.select("search_url", "page", page_url(F.col("search_url"), F.col("page")).alias("page_url"))


def validate_postings(postings: DataFrame) -> DataFrame:
    """First failing rule per posting ('ok' when none); location is optional."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    reason = (F.when(blank("title"), F.lit("missing_title"))
              .when(~F.coalesce(F.col("url").rlike(r"^https?://[^/\s]+"), F.lit(False)), F.lit("invalid_url"))
              .when(blank("company"), F.lit("missing_company"))
              .otherwise(F.lit("ok")))
    return postings.withColumn("reason", reason)


def site_of(url):
    """scheme://host of a URL."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.lit("://"), host_of(url))
