"""Main text of HTML pages by line-block distribution.

The markup is stripped to one line of text per block. Elements that never hold the article give no lines: scripts,
styles, menus, forms, page headers and footers, sidebars, and elements with a whole class, id or role that names an
advert, a notice, a menu, a sidebar or reader comments. A form, a page header or an element hidden by such a name other
than that of comments is kept if it holds more than half of the page's text outside links; headings are always kept,
and ids count on plain containers only, as elsewhere they mark places in the text. Where <article> and <main> hold
at least half of the text, they are the article, with every line in them. On other pages a line's weight is its length;
lines that are mostly links weigh nothing. Weights are summed over sliding windows of WINDOW lines. Where the sum rises
to the level of body text is a surge, where it falls below it a dive. These give the outer bounds only: a dive and the
next surge are joined where no line between them is mostly links, or where both sides lie in the same container (the
innermost element with more than half of a side's text), and of the joined stretches the heaviest is the article. It
goes on over the lines before and after it in its container, up to one that is mostly links, and every line within
these bounds is kept, short lines and links included.

Rules for damaged markup: an element of the kinds above that is never closed hides nothing, but p, li, dt, dd, option
and the parts of tables end at the next sibling or with their parent, as HTML has it; a link that is never closed is
none; end tags without a start are ignored; a text without markup is one line. Each page is handled alone, in one pass over its characters, so
nothing is shuffled and a task holds one Arrow batch.

Edge cases: a null or empty page gives an empty text; repeated rows are treated one by one; other columns are left
out by ``main_text``.
"""

from __future__ import annotations

import heapq
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: a window of body text holds at least this many characters, or a quarter of the page's heaviest window
BODY = 120
#: containers nested deeper than this count as part of the last one
DEPTH = 256

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_OPAQUE = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object",
           "select", "button")
_HIDDEN = {"nav", "footer", "aside", "form", "dialog", "menu", "head"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
           "time", "tt", "u", "var", "wbr", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: a class, id or role is matched as a whole, with these parts and nothing else
_NOISE = (r"(?:ads?|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|popup|modal"
          r"|sidebar|side|menu|nav|navigation|navbar|breadcrumbs?|footer|masthead|related|share|sharing|social|toolbar"
          r"|search|login|contentinfo|complementary)")
_FILLER = (r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|list|links?|buttons?|bar|box|block|wrap"
           r"|wrapper|container|inner|outer|area|widgets?|items?|group|posts|articles|stories|signup|form|icons?|tools?"
           r"|overlay|unit|slot|google|media|this|\d[^\W_]*)")
_NAMED = re.compile(rf"(?:{_FILLER}[_-]+)*{_NOISE}(?:[_-]+(?:{_NOISE}|{_FILLER}))*", re.I)
_HEADER = re.compile(r"(?:(?:site|global|top)[_-]+)?header", re.I)
_COMMENTS = re.compile(r"(?:(?:user|reader|post|article)[_-]+)?comments?(?:[_-]+(?:list|section|area|body|box|form|wrapper"
                       r"|container|thread|\d+))*|commentlist|disqus(?:[_-]+thread)?|replies", re.I)
#: the id of another element is the mark of a link to a place in the text
_ID_NAMES = {"div", "ul", "ol", "dl", "table", "center"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: end tags that may be left out: the element ends at the next sibling's start or at its parent's end
_OPTIONAL = {"p", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup"}
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
           "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li",
           "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ROWS = {"tbody", "thead", "tfoot"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"},
             **{t: _ROWS | {"tr"} for t in _ROWS}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
_CELLS = {"table", "td", "th"}
_CONTAINERS = {"article", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "form", "main", "ol",
               "section", "table", "tbody", "td", "th", "tr", "ul"}
_PARENTS = {"article", "aside", "blockquote", "dl", "fieldset", "footer", "form", "main", "menu", "nav", "ol", "section",
            "ul"} | _CELLS
_OPAQUE_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _OPAQUE}


def _hides(tag: str, attributes: str, in_article: bool) -> int:
    """0: not hidden; 1: hidden unless the element holds most of the page's text; 2: hidden."""
    if tag in _HIDDEN:
        return 1 if tag == "form" else 2
    if tag in _HEADINGS or tag in ("html", "body"):
        return 0
    own = 1 if tag == "header" and not in_article else 0
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            if tag not in _INLINE and _COMMENTS.fullmatch(name):
                return 2
            if tag in ("article", "main") or (m[1].lower() == "id" and tag not in _ID_NAMES):
                continue
            if _NAMED.fullmatch(name) or (not in_article and _HEADER.fullmatch(name)):
                own = 1
    return own


def _tokens(page: str) -> list[tuple[str, str, str]]:
    """Start tags as (<, tag, attributes), end tags as (/, tag, ..) and the texts between them."""
    tokens, at, missing = [], 0, set()  # end tags that were searched for and not found
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            tokens.append(("", page[at:], ""))
            return tokens
        if m.start() > at:
            tokens.append(("", page[at:m.start()], ""))
        at = m.end()
        tag = (m[2] or "").lower()
        if tag:
            tokens.append(("/" if m[1] else "<", tag, m[3]))
            if not m[1] and tag in _OPAQUE_END and not m[3].rstrip().endswith("/"):
                end = None if tag in missing else _OPAQUE_END[tag].search(page, at)
                if end is None:
                    missing.add(tag)
                at = end.end() if end else len(page) if tag in ("script", "style") else at


def _ends(tokens: list) -> list[int]:
    """For each start tag the token at which its element ends, 0 where it is never closed."""
    ends = [0] * len(tokens)
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}

    def pop(k: int, at: int):  # the k-th open element and those in it end before token ``at``
        for tag, i in stack[k:]:
            opened[tag] -= 1
            if tag in _OPTIONAL:
                ends[i] = at
        del stack[k:]

    def innermost(tags, stops) -> int:
        if any(opened.get(t) for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    return k
                if stops is None and stack[k][0] not in _INLINE or stops and stack[k][0] in stops:
                    break
        return -1

    for i, (kind, tag, _) in enumerate(tokens):
        if kind == "<":
            if tag in _ENDS_P and (k := innermost(("p",), None)) >= 0:
                pop(k, i)
            if tag in _SIBLINGS:
                stops = _PARENTS if tag in ("li", "dt", "dd") else {"table", "select"}
                while (k := innermost(_SIBLINGS[tag], stops)) >= 0:
                    pop(k, i)
            if tag not in _VOID and tag not in _OPAQUE_END:
                stack.append((tag, i))
                opened[tag] = opened.get(tag, 0) + 1
        elif kind == "/" and tag not in ("html", "body"):
            stops = (None if tag in _INLINE else {"table"} if tag in _SIBLINGS and tag not in ("li", "dt", "dd")
                     else _CELLS | {"ul", "ol", "menu"} if tag == "li" else _CELLS)
            k = innermost((tag,), stops)
            if k >= 0:
                start = stack[k][1]
                pop(k, i)
                ends[start] = i
    pop(0, len(tokens))
    return ends


def text_lines(page: str) -> tuple[list[tuple[str, int, bool, int]], list[int]]:
    """(text, characters of it in links, inside <article> or <main>, container) of each block that is not hidden, and
    the parent of each container; container 0 is the page."""
    tokens = _tokens(page)
    ends = _ends(tokens)
    articles = [0]  # starts of <article> and <main>, those of comments aside, before each token
    for kind, tag, rest in tokens:
        articles.append(articles[-1] + (kind == "<" and tag in ("article", "main") and not _hides(tag, rest, True)))

    # what each start tag's name says, and the characters before each token that are in no link and not surely hidden
    kinds, plain = [0] * len(tokens), [0]
    article = until = linked_until = 0
    for i, (kind, tag, rest) in enumerate(tokens):
        if kind == "<" and i >= until:
            if ends[i] and (article or articles[ends[i]] == articles[i + 1]):
                kinds[i] = _hides(tag, rest, article > 0)
            if kinds[i] == 2:
                until = ends[i] + (ends[i] < len(tokens) and tokens[ends[i]][:2] == ("/", tag))
            elif tag == "a":
                linked_until = ends[i]
        if kind and i >= until and tag in ("article", "main"):
            article = max(0, article + (1 if kind == "<" else -1))
        counted = not kind and i >= until and i >= linked_until
        plain.append(plain[-1] + (len(tag.strip()) if counted else 0))

    lines: list[tuple[str, int, bool, int]] = []
    parents, within = [0], [(0, len(tokens) + 1)]  # open containers, and where they end
    parts: list[str] = []
    links = article = until = linked_until = 0

    def close():
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            lines.append((text, links, article > 0, within[-1][0]))
        parts.clear()
        links = 0

    for i, (kind, tag, rest) in enumerate(tokens):
        if i < until:
            continue
        if not kind:
            parts.append(tag)
            links += len(tag) if i < linked_until else 0
            continue
        if tag not in _INLINE:
            close()
        while within[-1][1] <= i:
            within.pop()
        if kind == "<" and kinds[i] and (kinds[i] == 2 or 2 * (plain[ends[i]] - plain[i]) <= plain[-1]):
            # an end tag of its own belongs to the hidden element, a sibling's start does not
            until = ends[i] + (ends[i] < len(tokens) and tokens[ends[i]][:2] == ("/", tag))
            continue
        if kind == "<" and tag in _CONTAINERS and ends[i] and len(within) < DEPTH:
            parents.append(within[-1][0])
            within.append((len(parents) - 1, ends[i]))
        if tag == "a" and kind == "<":
            linked_until = ends[i]
        elif tag in ("article", "main"):
            article = max(0, article + (1 if kind == "<" else -1))
    close()
    return lines, parents


def stretches(weights: list[int], level: int) -> list[tuple[int, int]]:
    """[surge, dive) of the windows whose sum reaches ``level``, without weightless lines at either end."""
    sums = [sum(weights[i:i + WINDOW]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(sums):
        if sums[i] < level or not sums[i]:
            i += 1
            continue
        a = i
        while i < len(sums) and sums[i] >= level:
            i += 1
        b = min(len(weights), i + WINDOW - 1)
        while b > a and not weights[b - 1]:
            b -= 1
        while a < b and not weights[a]:
            a += 1
        out.append((a, b))
        i = max(i, b)
    return out


def _container(weights: list[int], own: list[int], parents: list[int]) -> int:
    """The innermost container that holds more than half of the weight."""
    held = dict.fromkeys(own, 0)
    for w, c in zip(weights, own):
        held[c] += w
    total = sum(weights)
    left = [-c for c in held]
    heapq.heapify(left)
    while left:  # a container's parent has a lesser number
        c = -heapq.heappop(left)
        if not c or 2 * held[c] > total:
            return c
        if parents[c] not in held:
            held[parents[c]] = 0
            heapq.heappush(left, -parents[c])
        held[parents[c]] += held[c]
    return 0


def _holds(outer: int, inner: int, parents: list[int]) -> bool:
    while inner > outer:
        inner = parents[inner]
    return inner == outer


def body_bounds(weights: list[int], own: list[int], parents: list[int]) -> tuple[int, int]:
    """[first, end) line of the main text, by the lines' weights and containers."""
    heaviest = max(sum(weights[i:i + WINDOW]) for i in range(len(weights)))
    count = [0] * len(parents)  # lines in each container; one that holds a single line is no container
    for c in own:
        count[c] += 1
    for c in range(len(parents) - 1, 0, -1):
        count[parents[c]] += count[c]
    inner = list(range(len(parents)))
    for c in range(1, len(parents)):
        if count[c] < 2:
            inner[c] = inner[parents[c]]
    own = [inner[c] for c in own]
    plain: list[tuple[int, int]] = []  # joined where no line between is mostly links
    for a, b in stretches(weights, min(BODY, heaviest // 4 + 1)):
        if plain and all(weights[plain[-1][1]:a]):
            plain[-1] = plain[-1][0], b
        else:
            plain.append((a, b))
    joined: list[tuple[int, int, int]] = []
    for a, b in plain:
        c = _container(weights[a:b], own[a:b], parents)
        if joined:
            first, _, other = joined[-1]
            outer, inside = min(c, other), max(c, other)
            if c == other or outer and _holds(outer, inside, parents):
                joined[-1] = first, b, outer
                continue
        joined.append((a, b, c))
    a, b, _ = max(joined, key=lambda s: (sum(weights[s[0]:s[1]]), -s[0]))
    c = _container(weights[a:b], own[a:b], parents)
    while a and weights[a - 1] and _holds(c, own[a - 1], parents):
        a -= 1
    while b < len(weights) and weights[b] and _holds(c, own[b], parents):
        b += 1
    return a, b


def extract(page: str | None) -> str:
    """The main text of one page."""
    lines, parents = text_lines(page or "")
    weights = [len(t) if 2 * linked <= len(t) else 0 for t, linked, _, _ in lines]
    marked = [t for t, _, inside, _ in lines if inside]
    if marked and 2 * sum(w for w, line in zip(weights, lines) if line[2]) >= sum(weights):
        return " ".join(marked)
    if not any(weights):
        return ""
    a, b = body_bounds(weights, [line[3] for line in lines], parents)
    return " ".join(line[0] for line in lines[a:b])


def main_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The id columns, ``text`` and ``n_chars`` of each page."""
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(id_cols)]
    narrow, n = pages.select(*own, F.col(html_col).alias("html")), len(own)

    def run(batches):
        for batch in batches:
            texts = [extract(p) for p in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.drop("html").schema)
    out = narrow.mapInArrow(run, f"{kinds}, text string, n_chars long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(id_cols)], "text", "n_chars")
