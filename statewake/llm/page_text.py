"""Main text of pages by nearest-URL page differencing.

A page's html becomes text lines (blocks), each with the place it stands in: an article, a main
element, page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments), or
neither. Pages are ordered by URL path within their host; each is paired with the neighbour whose
path shares the longer prefix (the earlier one on a tie), their lines are aligned by longest common
subsequence, and lines shared with the neighbour are deleted, as is furniture. A check follows:
lines that the markup declares as the article (or main, without one) are restored in their places,
since copies of a page share their whole article; a page whose lines would all go keeps those that
are not furniture. Where nothing is declared and most of the long lines are shared, the neighbour is
a near copy, which says nothing about the page's furniture, and shared lines are restored too.

Parts of class, id and role words mark furniture, and html and body never are. Inside an article whole
words do so, and of a class in parts (comment-list, newsletter-signup, text-ad) the first and last word;
a block named share, social or menu there is furniture only if it holds links or controls. That markup decides where it declares an article is a departure from the
method, since differencing can't give right results there: on the pages of sf0.1 92 % of the furniture
lines stand on none of the four nearest pages, and lines of copied articles do. A page on which that leaves no article and no main, but it has such elements
or nothing else, is read again with whole words alone (and those for comments, related pages and
adverts), so that a wrapper named has-sidebar does not take the article with it.

Only line hashes travel for the pairing. Neighbours are found by place in a global sort, so a host
with any share of the pages is spread over many tasks.

Defined results: null html counts as empty and gives an empty text; a null url has an empty host
and path; repeated rows are paired once and each give a row; a page alone in its host has no
neighbour, and nothing of it is shared; an empty table gives an empty result; only the three columns
named are read. Page ids are integers. Tags are read in time linear in the html, however broken.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.llm.common import Scratch

FURNITURE, OPEN, MAIN, ARTICLE = 0, 1, 2, 3
#: Inside an article: furniture if links or controls turn up within.
MAYBE = -1
#: Characters of a line that is taken for content and not for a menu's or footer's.
LONG_LINE = 40
# fixed values: element names and the words in class, id and role that mark page furniture
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "link", "mark", "meta", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ALWAYS_FURNITURE = {"nav", "footer", "aside", "form", "button", "dialog", "head", "menu"}
ALWAYS_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "comment", "comments", "disqus", "share", "sharing", "social", "related", "newsletter", "subscribe", "cookie", "cookies", "consent", "popup", "modal", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "complementary"}
#: Of ALWAYS_WORDS, those that mark furniture also as parts of a name where layout words (has-sidebar, nav-open) do not.
CONTENT_WORDS = {"advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "comment", "comments", "disqus", "related"}
#: First or last words of a class that mark furniture inside an article, and whole words that do so only with links or controls.
END_WORDS = {"advert", "adverts", "advertisement", "advertising", "ad", "ads", "sponsor", "sponsored", "promo", "comment", "comments", "disqus", "newsletter", "subscribe", "cookie", "cookies", "consent", "notice", "share", "sharing", "social"}
SOFT_WORDS = {"share", "sharing", "social", "menu", "nav", "navigation"}
CONTROLS = {"a", "button", "input", "select", "textarea", "form"}
OUTSIDE_WORDS = {"header", "masthead", "banner", "footer", "contentinfo", "notice", "alert", "widget", "toolbar", "search"}

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^>"'])*+>""")
DECLARES = re.compile(r"<(?:article|main)[\s>]|role\s*=\s*[\"']?main", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")


def _words(attributes: str) -> tuple[set[str], set[str], set[str], bool]:
    """The words of class, id and role, in parts and whole, the first and last parts of classes, and whether the element is hidden."""
    found, whole, ends, hidden = set(), set(), set(), False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            apart = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
            found |= set(re.findall(r"[a-z]+", apart))
            whole |= set(value.lower().split())
            if name == "class":
                ends |= {parts[k] for word in apart.split() if len(parts := re.findall(r"[a-z]+", word)) > 1 for k in (0, -1)}
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
    return found, whole, ends, hidden


#: Elements that, left open, do not keep an article in them from being one.
LOOSE = {"nav", "header", "ul", "li", "a", "head"}


def _place(name: str, attributes: str, now: int, firm: bool, strict: bool) -> int:
    """Where the inside of an element stands; firm: furniture around it that was surely meant to be."""
    words, whole, ends, hidden = _words(attributes) if attributes.strip() else (set(), set(), set(), False)
    if name in ("html", "body"):
        return MAIN if "main" in whole and "role" in attributes else now
    if now in (MAIN, ARTICLE) or name in ("article", "main") and not strict:
        words = whole
        if now in (MAIN, ARTICLE) and name not in ("article", "main"):
            words = whole | ends & END_WORDS
            if not hidden and name not in ALWAYS_FURNITURE and name not in INLINE and (hits := words & ALWAYS_WORDS) and hits <= SOFT_WORDS:
                return MAYBE
    elif name in ("article", "main") or not strict:
        words = whole | words & CONTENT_WORDS
    if hidden or name in ALWAYS_FURNITURE or words & ALWAYS_WORDS:
        return FURNITURE
    if now == FURNITURE:
        # menus and headers that were never closed do not swallow the article
        return {"article": ARTICLE, "main": MAIN}[name] if name in ("article", "main") and not firm else FURNITURE
    if name == "article":
        return ARTICLE
    if name == "main" or "main" in words and "role" in attributes:
        return max(now, MAIN)
    if now == OPEN and (name == "header" or words & OUTSIDE_WORDS):
        return FURNITURE
    return now


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order: text with character references decoded and white space folded, and place."""
    lines = _lines(html or "", True)
    best = max((p for _, p in lines), default=FURNITURE)
    if lines and (best == FURNITURE or best == OPEN and DECLARES.search(html)):
        lines = _lines(html, False)
    return lines


def _tags(html: str):
    """start, end, whether it closes, name and attributes of each tag (name empty: a comment or declaration), in time linear in the text: quotes that do not end are read as plain characters, from the first one on."""
    at, last, quotes = 0, html.rfind(">") + 1, True
    while 0 <= (start := html.find("<", at)) < last:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            yield start, at, False, "", ""
        elif html[start + 1] in "!?":
            at = html.find(">", start) + 1
            yield start, at, False, "", ""
        elif m := TAG.match(html, start):
            end = ATTRIBUTES.match(html, m.end()) if quotes else None
            quotes = end is not None
            at = end.end() if end else html.find(">", m.end()) + 1
            if not at:
                return
            # a raw element's end is for the caller to send
            skip = yield start, at, bool(m[1]), m[2].lower(), html[m.end() : at - 1]
            at = skip or at
        else:
            at = start + 1


def _lines(html: str, strict: bool) -> list[tuple[str, int]]:
    out, parts = [], []
    stack: list[tuple[str, int, tuple[int, int] | None]] = []
    opened: dict[str, int] = {}
    at, place, firm, skip, controls = 0, OPEN, 0, None, 0

    def end_block():
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((text, place))
            parts.clear()

    def solid(x: tuple) -> bool:
        return x[1] == FURNITURE and x[0] not in LOOSE

    def settle(ended: list[tuple]) -> None:
        """Blocks that may be furniture are, if controls turned up since they began."""
        for *_, mark in ended:
            if mark and controls > mark[1]:
                end_block()
                out[mark[0] :] = [(text, FURNITURE) for text, _ in out[mark[0] :]]

    tags = _tags(html)
    while True:
        try:
            start, end, closes, name, attributes = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            parts.append(html[at:start])
        at = end
        if not name:
            continue
        if name not in INLINE:
            end_block()
        controls += not closes and name in CONTROLS
        if closes:
            if opened.get(name):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                if stack[k - 1][1] != place if k else place != OPEN:
                    end_block()
                settle(stack[k:])
                for x in stack[k:]:
                    opened[x[0]] -= 1
                    firm -= solid(x)
                del stack[k:]
                place = stack[-1][1] if stack else OPEN
            elif name == "head":
                place = OPEN
        elif name in RAW:
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            at = skip = close.end() if close else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            if name == "body":
                if opened.get("head"):
                    stack = [x for x in stack if x[0] != "head"]
                    opened["head"] = 0
                place = OPEN
            inner, mark = _place(name, attributes, place, firm > 0, strict), None
            if inner != place:
                end_block()
            if inner == MAYBE:
                inner, mark = place, (len(out), controls)
            stack.append((name, inner, mark))
            opened[name] = opened.get(name, 0) + 1
            firm += solid(stack[-1])
            place = inner
    # a tag cut off at the end of the page is none of its text
    cut = re.compile(r"<[A-Za-z/!]").search(html, at)
    parts.append(html[at : cut.start()] if cut else html[at:])
    end_block()
    settle(stack)
    return out


def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel table of the longest common subsequence: bit j of row i is 0 where it grows at b[j]."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def shared_lines(a: list, b: list, most_bits: int = 1 << 28) -> list[int]:
    """Places in a of one longest common subsequence of a and b."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    middle: list[int] = []
    if x and y and len(x) * len(y) > most_bits and len(x) > 1:
        # halves of the first page, split where both parts together share the most
        h, n = len(x) // 2, len(y)
        before, after = _rows(x[:h], y)[-1], _rows(x[h:][::-1], y[::-1])[-1]

        def lengths(v: int) -> list[int]:
            out, bits = [0], bin(v | 1 << n)[:2:-1]
            for c in bits:
                out.append(out[-1] + (c == "0"))
            return out

        f, g = lengths(before), lengths(after)
        k = max(range(n + 1), key=lambda k: f[k] + g[n - k])
        middle = [*shared_lines(x[:h], y[:k], most_bits), *(h + i for i in shared_lines(x[h:], y[k:], most_bits))]
    elif x and y:
        rows, i, j = _rows(x, y), len(x), len(y)
        length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
        while i and j and (now := length(i, j)):
            if length(i - 1, j) == now:
                i -= 1
            elif length(i, j - 1) == now:
                j -= 1
            else:
                i, j = i - 1, j - 1
                middle.append(i)
        middle.reverse()
    return [*range(lead), *(lead + i for i in middle), *range(len(a) - tail, len(a))]


def main_text(lines: list[tuple[str, int]], shared: list[int]) -> str:
    """The text left after shared lines are deleted and declared content is restored."""
    best, gone = max((p for _, p in lines), default=FURNITURE), set(shared)
    declared = best if best in (MAIN, ARTICLE) else None
    if declared is None:
        # the long lines of pages of one site are their own, those of near copies are not
        long = [(len(t), i in gone) for i, (t, p) in enumerate(lines) if p == OPEN and len(t) >= LONG_LINE]
        if 2 * sum(n for n, both in long if both) > sum(n for n, _ in long):
            gone = set()
    left = [t for i, (t, p) in enumerate(lines) if p == declared or p != FURNITURE and i not in gone]
    return " ".join(left or [t for t, p in lines if p == OPEN])


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def shared_with_neighbour(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2 (hashes of the row) and shared (line places) of pages(page_id, url, html, k1, k2) that share lines with their neighbour."""

    def hashes(batches):
        import xxhash

        for b in batches:
            lines = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in page_lines(h)] for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "page_id", "host", "path")), pa.array(lines, pa.list_(pa.int64()))], names=["k1", "k2", "page_id", "host", "path", "lines"])

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "part", "at"])
            at += b.num_rows

    kind = "k1 long, k2 long, page_id long, host string, path string, lines array<long>"
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    rows = pages.withColumns({"host": host, "path": path}).mapInArrow(hashes, kind).dropDuplicates(["k1", "k2"])
    order = ["host", "path", "page_id", "k1", "k2"]
    placed = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{kind}, part int, at long"), "places")
    # for each task that sorted, the tasks with rows before and after it: as many rows as tasks
    by_part = Window.orderBy("part")
    ends = placed.groupBy("part").agg(F.max("at").alias("last")).select("part", "last", F.lag("part").over(by_part).alias("p_part"), F.lag("last").over(by_part).alias("p_last"), F.lead("part").over(by_part).alias("n_part"))
    first, last = F.col("at") == 0, F.col("at") == F.col("last")
    rows = placed.join(F.broadcast(ends), "part").select(
        "k1", "k2", "host", "path", "lines",
        F.when(first, F.col("p_part")).otherwise(F.col("part")).alias("b_part"), F.when(first, F.col("p_last")).otherwise(F.col("at") - 1).alias("b_at"),
        F.when(last, F.col("n_part")).otherwise(F.col("part")).alias("a_part"), F.when(last, F.lit(0)).otherwise(F.col("at") + 1).alias("a_at"),
    )
    other = lambda x: placed.select(F.col("part").alias(f"{x}_part"), F.col("at").alias(f"{x}_at"), F.col("host").alias(f"{x}_host"), F.col("path").alias(f"{x}_path"), F.col("lines").alias(f"{x}_lines"))
    rows = rows.join(other("b"), ["b_part", "b_at"], "left").join(other("a"), ["a_part", "a_at"], "left").select("k1", "k2", "host", "path", "lines", *(f"{x}_{c}" for x in "ba" for c in ("host", "path", "lines")))

    def align(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                near = [(-_common(r["path"], r[f"{x}_path"]), i, r[f"{x}_lines"]) for i, x in enumerate("ba") if r[f"{x}_host"] == r["host"]]
                if near and (shared := shared_lines(r["lines"], min(near)[2])):
                    out.append((r["k1"], r["k2"], shared))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["k1", "k2", "shared"])

    return rows.mapInArrow(align, "k1 long, k2 long, shared array<int>")


def extract_text(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text, n_chars, and n_shared (lines that the neighbour has too)."""
    cols = [F.col(c) for c in (id_col, url_col, html_col)]
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(1), *cols).alias("k2"))
    shared = shared_with_neighbour(keyed, Scratch(pages.sparkSession, "pages"))

    def run(batches):
        for b in batches:
            texts = [main_text(page_lines(h), s or []) for h, s in zip(b.column("html").to_pylist(), b.column("shared").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(s or []) for s in b.column("shared").to_pylist()], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_shared"])

    return keyed.join(shared, ["k1", "k2"], "left").select("page_id", "url", "html", "shared").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared long")
