"""Main text of web pages by consensus host paths.

Each page is read into blocks with the path of generalised tag.class steps that
leads to them. A page's containers are scored by the prose in them: length, less
what is linked; a container whose tag, role, class or id names furniture (menus,
headers, footers, sidebars, notices, adverts, forms, comments) counts a tenth.
The best one votes for its path; where it is a part of an article, or of a
container that only adds headings, the whole votes. Spark counts the votes of
each host, and every page is read again with its host's winning path; a page
without that path, or with nothing in it, goes by its own best container.

The winning path decides what is text: what lies outside goes, whatever it is
called, and what lies inside stays, but for elements inside that name furniture
themselves and for paths whose blocks, over all pages of the host, are mostly
links. So a name alone drops no article: a container called so stays if the
host's pages vote for it. A class names furniture only if all of its words do
(ad-banner, site-footer; not social-science), and a header inside an article, or
one called so (entry-header), is the article's own.

Scale: votes are a few small rows per page, one for each path on it, combined
map-side, so a host with a third of all pages is as many rows per task as it
has paths; winners are joined back on the host by a plain join that AQE may
broadcast or split. Pages are parsed one by one, in linear time, without
recursion.

Nulls and odd cases: null and empty html give the empty text; html without any
tag is one block; unclosed and stray tags are mended as browsers do for the
common cases; a null or odd url is the host ''; ties between paths go to the
higher score, then to the lesser path; repeated rows each get a row; other
columns pass through inside `row`.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise, require, small_batches

TAG = re.compile(r"<(?:!--|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+", re.I)
HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A path counts as one of links if so many of its characters are, on so many pages of the host.
LINKED, LEAST_PAGES = 0.6, 3
#: What is nested deeper counts for its container at this depth, so that a path has a bounded length.
DEEP = 100
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object noembed noframes xmp select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: An opening tag on the left ends an open element on the right (up to the nearest container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt figcaption td th address".split())
BAD_TAG = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Furniture by name, and words that may stand beside such a name in one class without changing what it is.
BAD_WORD = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar sidebars rail aside notice notices cookie cookies consent gdpr banner banners ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion comment comments disqus reply replies respond share sharing social breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal overlay widget widgets related recommended recirc outbrain taboola pagination pager toolbar skip alert form search copyright adsbygoogle responses".split()
)
BESIDE = frozenset("site page main top bottom left right box wrap wrapper container block section area bar list item items inner outer col column row link links button buttons user reader global primary secondary panel module slot unit text message policy icon icons media sticky fixed mobile desktop post posts article entry content story body group holder thread articles stories entries news topics more sections pages first second third last one two three default inverse light dark expand collapse toggle toggler brand manager prompt layer privacy google dfp gpt info copy your our the new online".split())
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
GOOD_WORD = frozenset("article content post entry story body main text".split())
OWN_HEADER = frozenset("article post entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    """bad: the depth of the innermost element around it that names furniture, -1 if none; len(path) if it is the block itself."""

    __slots__ = ("path", "prose", "heading", "text", "linked", "bad")

    def __init__(self, path: tuple[str, ...], prose: bool, heading: bool, text: str, linked: int, bad: int):
        self.path, self.prose, self.heading, self.text, self.linked, self.bad = path, prose, heading, text, linked, bad


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if raw.strip(" /"):
        for name, a, b, c in ATTR.findall(raw):
            found.setdefault(name.lower(), a or b or c)
    return found


def _furniture(name: str, inside: bool) -> bool:
    """Whether a class or id names furniture; inside: of an article."""
    # one or two letters say nothing (js-, is-, 300x250) but for "ad"
    words = {x for w in HUMPS.findall(name) if len(x := w.lower()) > 2 or x in BAD_WORD}
    bad = words & BAD_WORD
    if not bad or not words <= BAD_WORD | BESIDE:
        return False
    return not (bad == {"header"} and (inside or words & OWN_HEADER))


def _hidden(at: dict[str, str]) -> bool:
    return "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()


def _step(tag: str, at: dict[str, str], inside: bool) -> tuple[str, bool]:
    """Generalised step of a path, and whether the element names furniture."""
    names = [*at.get("class", "").split(), *at.get("id", "").split()]
    bad = tag in BAD_TAG and not (tag == "header" and inside) or at.get("role", "").lower() in BAD_ROLE or any(_furniture(x, inside) for x in names)
    if tag in ("html", "body"):
        bad = False
    general = "-".join("#" if w.isdigit() else w.lower() for w in WORDS.findall(at.get("class", "")))
    return f"{tag}.{general}" if general else tag, bad


def blocks(html: str | None) -> list[Block]:
    """The page's blocks of text, furniture included, in page order; hidden elements, controls, scripts and styles have none."""
    out: list[Block] = []
    if not html:
        return out
    # open elements: (tag, path up to it, depth of the innermost furniture, inside an article, without text)
    stack: list[tuple[str, tuple[str, ...], int, bool, bool]] = [("", (), -1, False, False)]
    parts: list[str] = []
    linked = 0
    in_link = prose = heading = own_bad = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                path = stack[-1][1]
                out.append(Block(path, prose, heading, text, linked, len(path) if own_bad else stack[-1][2]))
            parts.clear()
        linked = 0

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1][4]:
            parts.append(html[at:lt])
            if in_link:
                linked += lt - at
        if lt == n:
            break
        m = TAG.match(html, lt) or LOOSE.match(html, lt)
        if not m:
            # a tag or comment that never ends, a bogus comment ("</" and no letter), or a bare "<"
            nxt, after = html[lt + 1 : lt + 2], html[lt + 2 : lt + 3]
            if nxt in ("!", "?") or nxt.isascii() and nxt.isalpha() or nxt == "/" and after:
                gt = html.find(">", lt + 2)
                if gt < 0:
                    break
                at = gt + 1
                continue
            if not stack[-1][4]:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1]:
                if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                    continue
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if not end:
                    at = n
                    continue
                gt = html.find(">", end.end())
                at = n if gt < 0 else gt + 1
            continue
        if tag == "a":
            in_link = not m[1]
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and parts:
                parts.append(" ")
            continue
        if tag in INLINE:
            # inline elements only matter when they are hidden or furniture of their own
            if not m[1]:
                raw = m[3]
                found = _attributes(raw) if raw and not raw.isspace() else None
                top = stack[-1]
                if top[4] or found and (_hidden(found) or _step(tag, found, top[3])[1]):
                    stack.append((tag, top[1], top[2], top[3], True))
            elif stack[-1][4] and stack[-1][0] == tag:
                stack.pop()
            continue
        flush()
        in_link = False
        if tag in VOID:
            continue
        if m[1]:
            prose = heading = own_bad = False
            if tag == "p":
                while len(stack) > 1 and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                    stack.pop()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES:
            stop = BARRIER[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
        # a hidden paragraph, or an inline element that was never closed, ends where a block begins
        while stack[-1][4] and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
            stack.pop()
        prose, heading, own_bad = tag in PROSE, tag in HEADINGS, False
        top = stack[-1]
        found = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        step, bad = _step(tag, found, top[3])
        gone = top[4] or tag == "button" or bool(found) and _hidden(found)
        if (tag == "p" or heading) and not gone:
            # prose leaves stay off the stack: their end is the next block's start
            own_bad = bad
            continue
        path = (*top[1], step) if len(top[1]) < DEEP else top[1]
        inside = top[3] or tag in ("article", "main") or bool({w.lower() for x in (found.get("class", ""), found.get("id", "")) for w in HUMPS.findall(x)} & OWN_HEADER)
        stack.append((tag, path, len(top[1]) if bad else top[2], inside, gone))
    flush()
    return out


def _worth(b: Block) -> float:
    """What a block says for its container."""
    n = len(b.text)
    share = min(1.0, b.linked / n) if n else 1.0
    return (n if b.prose else 0.6 * n) * (1 - share) * (0.1 if b.bad >= 0 else 1.0)


def _bonus(step: str) -> float:
    tag, _, name = step.partition(".")
    return (1.6 if tag in ("article", "main") else 1.0) * (1.3 if set(name.split("-")) & GOOD_WORD else 1.0)


#: Leaves of lists and tables count for what they are in.
_INNER = frozenset("li dd dt td th tr tbody thead tfoot ul ol dl table blockquote pre figure figcaption".split())


def best_path(found: list[Block]) -> tuple[tuple[str, ...] | None, float]:
    """The path of the container that scores best, widened to the article it is a part of, and its score."""
    score: dict[tuple[str, ...], float] = {}
    for b in found:
        path, worth = b.path, _worth(b)
        while path and path[-1].partition(".")[0] in _INNER:
            path = path[:-1]
        for up, part in enumerate((1.0, 0.6, 0.3)):
            if up > len(path):
                break
            key = path[: len(path) - up]
            score[key] = score.get(key, 0.0) + worth * part
    if not score:
        return None, 0.0
    best = min(score, key=lambda p: (-score[p] * (_bonus(p[-1]) if p else 1.0), p))
    worth = score[best] * (_bonus(best[-1]) if best else 1.0)
    while len(best) > 1 and (tag := best[-2].partition(".")[0]) not in ("html", "body"):
        up = best[:-1]
        more = [b for b in found if b.path[: len(up)] == up and b.path[: len(best)] != best and b.bad < len(up)]
        if not more or not (tag in ("article", "main") or all(b.heading for b in more)):
            break
        best = up
    return best, worth


def text_of(found: list[Block], path: tuple[str, ...], without: frozenset[str] | None = None) -> str:
    """Blocks at or below the path, in page order, but for furniture below it and the paths of `without`."""
    k = len(path)
    return " ".join(b.text for b in found if b.bad < k and b.path[:k] == path and not (without and ">".join(b.path) in without))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(row struct of pages' columns, host, path, text) for each row of pages."""
    require(pages, html_col, url_col)
    small_batches(pages.sparkSession)

    def vote(batches):
        for b in batches:
            hosts, paths, scores, chars, links = [], [], [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = blocks(html)
                best, score = best_path(found)
                if best is None:
                    continue
                here: dict[tuple[str, ...], list[int]] = {}
                for x in found:
                    size = here.setdefault(x.path, [0, 0])
                    size[0] += len(x.text)
                    size[1] += min(x.linked, len(x.text))
                here.setdefault(best, [0, 0])
                for path, (n, linked) in here.items():
                    hosts.append(host)
                    paths.append(">".join(path))
                    scores.append(score if path == best else None)
                    chars.append(n)
                    links.append(linked)
            columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64()), pa.array(chars, pa.int64()), pa.array(links, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "score", "chars", "links"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(vote, "host string, path string, score double, chars long, links long")
    # sums of whole numbers: the same whatever the order of rows
    counted = votes.groupBy("host", "path").agg(F.count("score").alias("n"), F.sum(F.round("score").cast("long")).alias("score"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    of_links = F.when((F.col("pages") >= LEAST_PAGES) & (F.col("links") > LINKED * F.col("chars")), F.col("path"))
    winners = counted.groupBy("host").agg(F.min_by("path", F.when(F.col("n") > 0, F.struct(-F.col("n"), -F.col("score"), F.col("path")))).alias("winner"), F.collect_set(of_links).alias("without"))
    winners = materialise(winners.select(F.col("host").alias("winner_host"), "winner", "without"), "host-paths")
    rows = pages.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(winners, F.col("host") == F.col("winner_host"), "left").select("row", "host", "winner", "without")

    def read(batches):
        for b in batches:
            paths, texts = [], []
            for winner, without, html in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(0).field(html_col).to_pylist(), strict=True):
                found = blocks(html)
                path = None if winner is None else tuple(winner.split(">")) if winner else ()
                text = "" if path is None else text_of(found, path, frozenset(without))
                if not text:
                    path, _ = best_path(found)
                    text = "" if path is None else text_of(found, path)
                paths.append(None if path is None else ">".join(path))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["row", "host", "path", "text"])

    return joined.mapInArrow(read, f"row {rows.schema['row'].dataType.simpleString()}, host string, path string, text string")


def op1(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
