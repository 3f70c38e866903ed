"""HTML extraction by nearest-URL page differencing.

Pages are cut into lines, one for each block of text. Within each host every page is
paired with the page next to it in order of URL path, the one of its two neighbours
that shares the longer start; all lines of both, menus and all, are aligned by longest
common subsequence, and lines that both hold are shared lines. Shared lines are
deleted, except inside the article element of a page that has one: articles repeat
each other and what menus and notices say elsewhere, and there it is the page's own
text. Structure that is never text (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, comments, hidden parts) is left out in any case; on a page
with an article element so is what stands outside of it. An element that is left out
and holds the page's only article loses its other text, not the article.

The order of URLs is made by range partitioning, and neighbours across partitions by
a row for each partition, so that a host with a third of all pages is no one task's.

Cases: null html is empty and gives an empty text; null or unreadable URLs are one
host with the whole URL as path; equal rows are one page for pairing, and each is
returned; of two neighbours that share equally long starts the one before counts;
cut-off and badly nested pages are read as far as they go; very long pages are aligned
whole, in memory that grows with the lines times the root of the lines that both share;
extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_hashes, written

# Elements and names by what they are for.
RAW = frozenset("script style noscript template textarea title iframe svg object select option button canvas audio video".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    "html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset hr center hgroup"
    " nav footer aside form menu dialog head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"html", "body"}
SMALL = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription social share sharing sharebar related recommended recommendations comment comments commentlist disqus respond replies widget widgets pagination pager toolbar login signup skip".split()
)
# the same, as whole names of more than one word
NAMES |= frozenset(
    "ad-slot ad-unit ad-container ad-banner adsbygoogle cookie-banner cookie-notice cookie-consent site-header site-footer page-footer main-nav main-menu main-navigation site-navigation nav-menu nav-links post-navigation skip-link"
    " share-buttons social-share social-links social-icons related-posts related-articles comment-list comments-area comment-respond newsletter-signup newsletter-form subscribe-form modal-dialog".split()
)
# names that inside an article can be what it is about
SUBJECTS = frozenset("menu banner promotion masthead cookie cookies consent gdpr notice notices overlay subscription comment replies widget widgets toolbar login signup sponsor".split())
# texts of others, often article elements themselves
OTHERS = frozenset("related recommended recommendations comment comments commentlist disqus respond replies related-posts related-articles comment-list comments-area comment-respond".split())
# blocks of text themselves: inside an article their names say how they look, not what they are
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre dt dd td th figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Why an element is left out; the numbers grow with how surely.
FORM, NAMED, STRUCTURE, OF_OTHERS = 1, 2, 3, 4
# What a block is: menus and the like, text outside of an article, text of the article.
LEFT_OUT, AROUND, ARTICLE = 0, 1, 2


def _flags(tag: str, attributes: str, in_main: bool) -> tuple[int, bool]:
    """Why the element is left out (0: it is not), and whether it is the article."""
    skip, main = 0, tag in ("article", "main")
    if tag == "form":
        skip = FORM
    elif tag in BOILERPLATE or (tag == "header" and not in_main):
        skip = STRUCTURE
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
            if key in ("class", "id") and tag not in ("html", "body", "main"):
                if in_main and (tag in PROSE or (tag == "section" and key == "id")):
                    continue  # a paragraph is the article's whatever it is called; ids are made of the words of a heading
                names = {x.lower().replace("_", "-") for x in value.split()} & NAMES
                if in_main:
                    names -= SUBJECTS
                if names:
                    skip = max(skip, OF_OTHERS if names & OTHERS else NAMED)
            elif key == "role":
                role = value.strip().lower()
                skip = max(skip, FORM if role == "form" else STRUCTURE if role in ROLES else 0)
                main |= role in ("main", "article")
            elif key == "itemprop":
                main |= value == "articleBody"
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                skip = max(skip, STRUCTURE)
            elif key == "style" and "display:none" in value.replace(" ", "").lower():
                skip = max(skip, STRUCTURE)
    return skip, main and not skip


def _chosen(blocks: list[tuple[str, bool, int, int]]) -> dict[int, bool]:
    """Of all blocks (text, inside an article, why left out outside of it and inside) the places of the page's, and whether they are the article's."""
    words = lambda x: sum(blocks[i][0].count(" ") + 1 for i, *_ in x)
    may = [(i, m, why, own) for i, (_, m, why, own) in enumerate(blocks) if (own <= FORM if m else why < STRUCTURE)]
    found = [(i, m, why) for i, m, why, own in may if not own]
    form = [(i,) for i, _, _, own in may if own == FORM]
    if form and words(form) > words([x for x in found if x[1]]):  # a form around the article's text
        found = [(i, m, why) for i, m, why, _ in may]
    free = {i: m for i, m, why in found if not why}
    if any(free.values()):
        return free
    inside = [(i, m) for i, m, why in found if m and why < OF_OTHERS]
    if inside:  # the only articles stand in what was left out
        main = words(inside) >= words([(i,) for i in free])
        return {i: m and main for i, m, why in found if not why or (m and why < OF_OTHERS)}
    form = [(i,) for i, _, why in found if why == FORM]
    if form and words(form) > words([(i,) for i in free]):  # a form around the page
        return {i: False for i, _, why in found if why <= FORM}
    return free or {i: m for i, m, why in found if why == NAMED or m}


def lines(page: str) -> list[tuple[str, bool]]:
    """The page's blocks of text in order, and whether each is inside the article."""
    return [(t, role == ARTICLE) for t, role in blocks(page) if role]


def blocks(page: str) -> list[tuple[str, int]]:
    """All blocks of text in order, white space made one space, with their roles: LEFT_OUT, AROUND or ARTICLE."""
    found: list[tuple[str, bool, int, int]] = []
    # open elements: tag, then why left out outside of the article, in the article, why left out in it
    stack: list[tuple[str, tuple[int, bool, int]]] = []
    held: list[str] = []
    top = state = (0, False, 0)
    at = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            found.append((text, state[1], state[0], state[2]))
        held.clear()

    def close(to: int) -> None:
        nonlocal state
        flush()
        del stack[to:]
        state = stack[-1][1] if stack else top

    while at < len(page):
        m = TOKEN.search(page, at)
        held.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS or any(t == tag for t, _ in stack):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if tag in SMALL and stack[i][0] not in SMALL and stack[i][0] in BLOCKS:
                        flush()
                        break
                else:
                    flush()
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, at)  # in page itself: lower-casing can change its length
            at = end.start() if end else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in ENDS_P:
            # a new block ends an open paragraph, a new item an open item
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (stack[i][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
                    close(i)
                    break
                if stack[i][0] not in SMALL and stack[i][0] in BLOCKS:
                    break
            flush()
        if tag in VOID:
            continue
        own_skip, own_main = _flags(tag, m[3], state[1])
        if tag in BLOCKS or own_skip or own_main:
            around, main, inside = state
            if main:
                inside = 0 if own_main and inside == FORM else max(inside, own_skip)
            elif own_main:
                # a form or a main element is no menu, whatever is around it
                around, main = 0 if around == FORM or tag == "main" else around, True
            else:
                around = max(around, own_skip)
            if (around, main, inside) != state:
                flush()
            state = (around, main, inside)
            stack.append((tag, state))
    flush()
    chosen = _chosen(found)
    return [(t, LEFT_OUT if i not in chosen else ARTICLE if chosen[i] else AROUND) for i, (t, *_) in enumerate(found)]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b, by bit rows.

    Only every so manieth row is held; those between are made again on the way back, so the
    memory follows the longer side times the root of the shorter.
    """
    both = set(a) & set(b)
    own, other = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    step = isqrt(len(own)) + 1

    def rows_from(v: int, start: int, end: int):
        """Rows start to end, of which the first is v."""
        yield v
        for i in own[start:end]:
            u = v & where[a[i]]
            v = ((v + u) | (v - u)) & full
            yield v

    held = [v for i, v in enumerate(rows_from(full, 0, len(own))) if i % step == 0]
    length = lambda i, j: j - (rows[i - low] & ((1 << j) - 1)).bit_count()  # noqa: E731  of the first i and j
    out, j, low, rows = [], len(other), len(own) + 1, []
    for i in range(len(own), 0, -1):
        if i - 1 < low:
            low = (i - 1) // step * step
            rows = list(rows_from(held[low // step], low, min(low + step, len(own))))
        here = length(i, j)
        if not here:
            break
        if length(i - 1, j) == here:
            continue
        while length(i, j - 1) == here:
            j -= 1
        out.append(own[i - 1])
        j -= 1
    return out[::-1]


def _url_parts(url) -> tuple:
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    path = F.when(host == "", u).otherwise(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1))
    return host, path


def neighbours(keys: DataFrame) -> DataFrame:
    """(k1, k2, n1, n2): each page's nearest of keys (k1, k2, host, path) by path within its host."""
    sort = ["host", "path", "k1", "k2"]
    placed = keys.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = written(placed.withColumn("pid", F.spark_partition_id()), "placed")
    row = F.struct(*sort)
    ends = placed.groupBy("pid").agg(F.min(row).alias("first"), F.max(row).alias("last"))  # a row for each partition
    w = Window.orderBy("pid")
    ends = ends.select(F.col("pid").alias("e_pid"), "first", "last", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("behind"))
    inside = Window.partitionBy("pid", "host").orderBy("path", "k1", "k2")
    near = placed.withColumn("prev", F.lag(row).over(inside)).withColumn("next", F.lead(row).over(inside))
    near = near.join(F.broadcast(ends), F.col("pid") == F.col("e_pid"))
    same = lambda x: F.when(x["host"] == F.col("host"), x)
    near = near.withColumn("prev", F.when(row == F.col("first"), same(F.col("before"))).otherwise(F.col("prev")))
    near = near.withColumn("next", F.when(row == F.col("last"), same(F.col("behind"))).otherwise(F.col("next")))

    def shared(x):
        """Characters that both paths begin with (one more for equal paths), in one pass."""
        same_at = F.zip_with(F.split("path", ""), F.split(F.coalesce(x["path"], F.lit("")), ""), lambda c, d: F.coalesce(c == d, F.lit(False)))
        return F.transform(F.array(same_at), lambda s: F.coalesce(F.nullif(F.array_position(s, False), F.lit(0)) - 1, F.size(s).cast("long")))[0]

    best = F.when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull(), F.col("prev")).when(shared(F.col("next")) > shared(F.col("prev")), F.col("next")).otherwise(F.col("prev"))
    return near.withColumn("best", best).where("best is not null").select("k1", "k2", F.col("best.k1").alias("n1"), F.col("best.k2").alias("n2"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_dropped, n_shared) per row of pages (page_id, url, html).

    n_dropped: lines that are not in the text; n_shared: those of them that only the neighbour's lines delete.
    """
    p = pages.select("page_id", "url", "html")
    content = [F.col("page_id").cast("string"), F.col("url"), F.col("html")]
    p = p.select("page_id", "url", "html", F.xxhash64(*content).alias("k1"), F.xxhash64(F.lit(1), *content).alias("k2"))
    host, path = _url_parts(F.col("url"))

    def hashed(batches):
        for b in batches:
            out = []
            for page in b["html"].to_pylist():
                own = [t.encode("utf-8", "surrogatepass") for t, _ in blocks(page or "")]
                ends = np.cumsum([len(t) for t in own], dtype=np.int64)
                starts = ends - np.array([len(t) for t in own], dtype=np.int64)
                out.append(range_hashes(np.frombuffer(b"".join(own), dtype=np.uint8), starts, ends).view(np.int64) if own else [])
            yield pa.RecordBatch.from_arrays([b["k1"], b["k2"], b["host"], b["path"], pa.array(out, pa.list_(pa.int64()))], names=["k1", "k2", "host", "path", "lines"])

    rows = p.select("k1", "k2", host.alias("host"), path.alias("path"), "html").mapInArrow(hashed, "k1 long, k2 long, host string, path string, lines array<long>")
    rows = written(rows, "lines")
    keys = rows.select("k1", "k2", "host", "path").distinct()
    pairs = written(neighbours(keys), "pairs")
    texts = rows.groupBy("k1", "k2").agg(F.first("lines").alias("lines"))
    texts = written(texts, "texts")
    both = pairs.join(texts, ["k1", "k2"]).join(texts.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("lines").alias("others")), ["n1", "n2"])

    def aligned(batches):
        for b in batches:
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "shared": [common_lines(list(x), list(y)) for x, y in zip(b["lines"], b["others"])]})

    shared = written(both.select("k1", "k2", "lines", "others").mapInPandas(aligned, "k1 long, k2 long, shared array<int>"), "shared")

    def differenced(batches):
        for b in batches:
            out, gone, by_neighbour = [], [], []
            for page, common in zip(b["html"].to_pylist(), b["shared"].to_pylist()):
                own, common = blocks(page or ""), set(common or ())
                least = ARTICLE if any(role == ARTICLE for _, role in own) else AROUND
                text = [(i, t) for i, (t, role) in enumerate(own) if role >= least]
                keep = [t for i, t in text if least == ARTICLE or i not in common]
                out.append("\n".join(keep))
                gone.append(len(own) - len(keep))
                by_neighbour.append(len(text) - len(keep))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(gone, pa.int64()), pa.array(by_neighbour, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_dropped", "n_shared"])

    result = p.join(shared.hint("merge"), ["k1", "k2"], "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "shared")
    return result.mapInArrow(differenced, "page_id long, url string, text string, n_chars long, n_dropped long, n_shared long")
