"""HTML extraction by differencing each page with the page of nearest URL on its host.

1. A page is read tag by tag into lines, one for each block of text, with character references decoded and white space
   turned into single spaces.  A line has a *slot*: the elements it is in, with their classes, and whether all of it is links.  A line is
   *stated* by the page's own markup to be content (inside article or main), or to be none (inside nav, header, footer, aside, form, scripts and
   the like, or a container whose class or id names an advert, notice, menu, sidebar, comments ...), or is undecided.
2. Pages are paired within their host: a host's pages are sorted by path, over all its folders, and each is paired with
   the neighbour whose path has the longer common beginning (ties: the one before).
3. Lines of both are aligned by longest common subsequence, equal in slot and text; shared lines are page furniture and are deleted.
   So are lines that are nothing but links, in a slot of which a line is shared: entries of a menu that differ from page to page.

Deleting shared lines alone can't give right results where furniture differs on every page of a host, or an article's paragraphs
also stand on a near copy beside it; so a shared line is deleted unless the page's markup states it to be content, and what
the markup states to be furniture goes, shared or not.  Pages without such markup are judged by differencing alone, except that a page all of whose
undecided lines are shared keeps them, being a copy of its neighbour.

Defined cases: a null html is an empty page and has the empty text; a null URL has an empty host and path; markup cut off
anywhere ends there; unclosed elements end with their parents; repeated rows and ties in URL are neighbours in order of page id, as text;
the only page of a host loses no undecided line; an article that is named a comment is content where the page has no other; an empty table stays
empty; extra columns are kept (result columns replace theirs).

Scale: one pass over html; then lines, packed, not html, are shuffled once, in segments of the order by host and path, so that a host with a third
of all pages is many segments; their bounds come from a sample of at most `max_sample` URLs, the only thing broadcast.  A segment has 128 pages up to
8 million pages, and `max_segments` of them grow from there (76,000 pages each at 5 billion); they are streamed sorted, three pages at a time, so time grows, not memory; a segment's first and last page meet those of the segments beside it in a join.  The result depends neither on the
sample nor on partitions.  Reading a page takes time by its length, however deep its elements are.  Alignment takes time by lines times lines / 64, and memory by their square root times lines / 8.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.llm import common as C
from latticore.llm.url_trie import url_host, url_path

NONE, UNDECIDED, CONTENT, PERHAPS = 0, 1, 2, 3  # perhaps: content where there is no other
#: Elements that hold no running text of the page.
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "noscript", "iframe", "object", "svg", "template"}
RAW = {"script", "style", "textarea", "title", "noembed", "noframes"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: First or last words of a class or id that name furniture; those of LAYOUT say nothing of an article inside.
LAYOUT = {"menu", "nav", "navbar", "navigation", "sidebar", "side", "footer", "header", "masthead", "toolbar", "banner", "search", "share", "notice"}
NAMES = LAYOUT | {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "breadcrumb", "breadcrumbs", "widget", "comment", "comments", "reply", "replies", "disqus", "respond", "sharing", "social", "related", "recommended", "pagination", "pager", "login"}
#: Before a name: it says what the element has, not what it is.
HAS = {"with", "has", "no", "without", "is"}
#: Elements of running text, whose names say nothing inside an article.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "tbody", "thead", "tr", "td", "th", "caption"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*(?:>|$)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


def named(attributes: str) -> int:
    """What class, id and role say of an element: 0 nothing, 1 furniture by a word of layout, 2 furniture."""
    found = 0
    for group in _NAMED.findall(attributes):
        for token in "".join(group).lower().split():
            w = _WORD.findall(token)
            if w and w[0] not in HAS:
                own = {w[0], w[-1]} & NAMES
                found = max(found, 1 + bool(own - LAYOUT) if own else 0)
    return found


def page_lines(page: str | None) -> list[tuple[int, str, str]]:
    """The page's lines in order: what its markup says of it, its slot, its text."""
    if not page:
        return []
    lines: list[tuple[int, str, str]] = []
    held: list[str] = []
    #: (tag, furniture, main, place of the nearest block, sum of the blocks' names) of open elements, each with what it is in
    stack: list[tuple[str, int, int, int, int]] = []
    opened: Counter[str] = Counter()  # open elements by tag
    at, end = 0, len(page)
    furniture = main = 0  # furniture: 1 by a word of layout, 2 by another name or its tag; main: 1 perhaps, 2 inside article or main
    linked = True  # all text held is links

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            kind = NONE if furniture else (UNDECIDED, PERHAPS, CONTENT)[main]
            lines.append((kind, f"{stack[-1][4] if stack else 0:08x}{'a' if linked else '-'}", text))
        linked = True

    def hold(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if linked and not opened["a"] and not text.isspace():
                linked = False

    def close(k: int) -> None:
        nonlocal furniture, main
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
        furniture, main = stack[-1][1:3] if stack else (0, 0)

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            hold(page[at:])
            break
        hold(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:  # an end tag closes what is open down to its element
            if opened[name]:
                if name not in INLINE:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != name:  # all of these close
                    k -= 1
                if held and (stack[k - 1][1:3] if k else (0, 0)) != (furniture, main):
                    flush()
                close(k)
            elif name == "p":
                flush()
            continue
        if name in RAW:
            at = re.compile(rf"</{name}\s*>|$", re.I).search(page, at).end()
            continue
        attributes = m[3]
        if name not in INLINE:
            flush()
            block = stack[-1][3] if stack else -1
            if name in CLOSES_P and block >= 0 and stack[block][0] == "p":  # what stands open in a paragraph ends with it
                close(block)
        if name in VOID or attributes.endswith("/"):
            continue
        own, inside = 2 * (name in FURNITURE), main
        if not own and attributes and name not in ("html", "body"):
            own = named(attributes)
            if name in MAIN and not main:
                inside, own = (1 if own == 2 else 2), 0
            elif main and name in TEXT:
                own = 0
            if _HIDDEN.search(attributes):
                own = 2
        if name in MAIN and not main:
            inside = inside or 2
            closed = 0 if furniture == 1 else furniture  # a word of layout around an article says nothing of it
        else:
            closed = furniture
        closed = max(closed, own)
        if held and (closed, inside) != (furniture, main):
            flush()
        furniture, main = closed, inside
        block, slot = stack[-1][3:] if stack else (-1, 0)
        if name not in INLINE:
            own_name = name + ("".join(f".{x}" for g in _NAMED.findall(attributes) for x in "".join(g).split()) if attributes else "")
            block, slot = len(stack), zlib.crc32((own_name if block < 0 else f"/{own_name}").encode("utf-8", "replace"), slot)
        stack.append((name, furniture, main, block, slot))
        opened[name] += 1
    flush()
    return lines


def shared_lines(a: list, b: list) -> set[int]:
    """The lines of a on a longest common subsequence with b: bit by bit, a row of bits for each line, of which every so many are kept."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    at: dict = {}
    for j, k in enumerate(y):
        at.setdefault(b[k], []).append(j)
    where = {}
    for line, places in at.items():
        bits = bytearray(len(y) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        where[line] = int.from_bytes(bits, "little")
    whole = (1 << len(y)) - 1

    def after(row: int, i: int) -> int:  # a zero bit: the subsequence of what has been read grows there
        hit = row & where[a[x[i]]]
        return ((row + hit) | (row - hit)) & whole

    step = max(1, math.isqrt(len(x)))
    kept, row = [whole], whole
    for i in range(len(x)):
        row = after(row, i)
        if (i + 1) % step == 0:
            kept.append(row)
    i, j, rows, base = len(x), len(y), [], len(x) + 1
    while i and j:
        if i - 1 < base:  # the rows from the last one kept
            base = (i - 1) // step * step
            rows = [kept[base // step]]
            for k in range(base, i):
                rows.append(after(rows[-1], k))
        if rows[i - base] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1 - base] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            out.add(x[i])
        else:
            i -= 1
    return out


def main_text(lines: list[tuple[int, str, str]], partner: list[tuple[int, str, str]] | None) -> str:
    """The lines that differencing with the partner and the page's markup leave, joined by a space."""
    top = max((kind for kind, _, _ in lines if kind in (CONTENT, PERHAPS)), key=lambda k: k == CONTENT, default=UNDECIDED)
    if top != UNDECIDED:  # beside an article, what is not in it is no article; and shared or not, it is content
        return " ".join(t for kind, _, t in lines if kind == top)
    undecided = {i for i, (kind, _, _) in enumerate(lines) if kind == UNDECIDED}
    gone = shared_lines([x[1:] for x in lines], [x[1:] for x in partner]) if partner is not None and undecided else set()
    if gone >= undecided:
        gone = set()
    slots = {lines[i][1] for i in gone}
    return " ".join(lines[i][2] for i in sorted(undecided) if i not in gone and not (lines[i][1] in slots and lines[i][1].endswith("a")))


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def packed(lines: list[tuple[int, str, str]]) -> bytes:
    """Lines as compressed bytes, after the length of what they decompress to."""
    data = "\n".join(f"{kind}{slot}{text}" for kind, slot, text in lines).encode("utf-8", "replace")
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[tuple[int, str, str]]:
    size = int.from_bytes(data[:8], "little")
    lines = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True).decode() if size else ""
    return [(int(x[0]), x[1:10], x[10:]) for x in lines.split("\n")] if lines else []


#: Lines of a segment's first or last page, for the page beside it, and that page's place and text beside its neighbour within the segment.
EDGE = "_segment int, _place int, _host string, _path string, _near int, _packed binary"


def _parsed(names: list[str], html: str, bounds):
    """Pages as packed lines, with their segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [packed(page_lines(x.as_py())) for x in C.column(b, html)]
            keys = zip(*(C.column(b, c).to_pylist() for c in ("_host", "_path", "_tie")))
            segments = [bisect_right(bounds.value, tuple(x.encode() for x in k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*(C.column(b, n) for n in names), pa.array(segments, pa.int32()), pa.array(found, pa.binary())], [*names, "_segment", "_packed"])

    return run


def _differenced(names: list[str]):
    """Texts of the pages; first (_place -1) and last (1; 2 if it is the first, too) pages of a segment keep their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None  # (segment, host, path, lines, packed lines, the batch's columns, position)
        held: list = []

        def emit(page, left, right) -> None:
            first, last = left is None or left[0] != page[0], right is None or right[0] != page[0]
            sides = [s for s in (left, right) if s is not None and s[:2] == page[:2]]
            partner = max(sides, key=lambda s: _common(s[2], page[2])) if sides else None  # ties: the one before
            near = _common(partner[2], page[2]) if partner else -1
            place = 2 if first and last else -1 if first else 1 if last else 0
            edge = (page[0], place, page[1], page[2], near, page[4]) if place else (page[0], 0, None, None, None, None)
            held.append((page[5], page[6], (main_text(page[3], partner and partner[3]), *edge)))

        def batch(schema: pa.Schema) -> pa.RecordBatch:
            own = [pa.concat_arrays([cols[k].slice(i, 1) for cols, i, _ in held]) for k in range(len(names))]
            new = [pa.array(x, t) for x, t in zip(zip(*(row for _, _, row in held)), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()))]
            held.clear()
            return pa.RecordBatch.from_arrays([*own, *new], [*names, "text", *(f.split()[0] for f in EDGE.split(", "))])

        for b in batches:
            cols = [C.column(b, n) for n in names]
            for i, (segment, host, path, data) in enumerate(zip(*(C.column(b, c).to_pylist() for c in ("_segment", "_host", "_path", "_packed")))):
                after = (segment, host, path, unpacked(data), data, cols, i)
                if now is not None:
                    emit(now, before, after)
                before, now = now, after
            if held:
                yield batch(b.schema)
        if now is not None:
            emit(now, before, None)
            yield batch(None)

    return run


def _rejoined(names: list[str]):
    """Texts of edge pages that meet their neighbours in the segments beside theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, host, path, near, data, *sides in zip(*(C.column(b, c).to_pylist() for c in ("text", "_host", "_path", "_near", "_packed", "_host1", "_path1", "_packed1", "_host2", "_path2", "_packed2"))):
                for (h, p, other), tie in ((sides[:3], True), (sides[3:], False)):  # the one before goes first, and wins ties
                    if other is not None and h == host and (n := _common(p, path)) + tie > near:
                        near, text = n, main_text(unpacked(data), unpacked(other))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(C.column(b, n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return run


def _bounds(placed: DataFrame, segment_pages: int, max_segments: int, max_sample: int) -> list[tuple[bytes, ...]]:
    """Upper bounds of all segments but the last, from a sample of the keys."""
    keys = placed.select("_host", "_path", "_tie")
    pages = keys.count()
    segments = min(max_segments, -(-pages // segment_pages))
    if segments < 2:
        return []
    share = min(20 * segments, max_sample / 2) / pages  # half of what is allowed, so that chance does not exceed it
    draw = F.pmod(F.xxhash64("_host", "_path", "_tie"), F.lit(1 << 62)) < int((1 << 62) * min(1.0, share))
    rows = sorted(tuple(x.encode() for x in r) for r in keys.where(draw).limit(max_sample).toArrow().to_pandas().itertuples(index=False))
    return sorted({rows[len(rows) * k // segments] for k in range(1, segments)}) if rows else []


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", segment_pages: int = 128, max_segments: int = 65_536, max_sample: int = 400_000) -> DataFrame:
    """pages without html, with text: the main text of each."""
    C.need(pages, page_id, url, html)
    spark = pages.sparkSession
    C.short_batches(spark)
    kept = [f for f in pages.schema.fields if f.name not in (html, "text")]
    own = {f.name: f"_own{i}" for i, f in enumerate(kept)}  # names that clash with none of ours
    names = list(own.values())
    fields = [f"{own[f.name]} {f.dataType.simpleString()}" for f in kept]
    tie = F.coalesce(F.col(f"`{page_id}`").cast("string"), F.lit(""))
    placed = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), F.col(f"`{html}`").alias("_html"), url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"), tie.alias("_tie"))
    bounds = spark.sparkContext.broadcast(_bounds(placed, segment_pages, max_segments, max_sample))
    keyed = [*names, "_host", "_path", "_tie"]
    lined = placed.mapInArrow(_parsed(keyed, "_html", bounds), ", ".join([*fields, "_host string, _path string, _tie string, _segment int, _packed binary"]))
    lined = lined.repartition("_segment").sortWithinPartitions("_segment", "_host", "_path", "_tie")
    done = C.cut(lined.mapInArrow(_differenced(names), ", ".join([*fields, "text string", EDGE])), "pages", "zstd")
    inner = done.where("_place = 0").select(*names, "text")
    edges = done.where("_place <> 0")
    # segments that hold pages, in order: at most max_segments numbers
    order = sorted(r[0] for r in edges.select("_segment").distinct().collect())
    place = spark.createDataFrame([(s, i) for i, s in enumerate(order)], "_segment int, _order int")
    edges = edges.join(F.broadcast(place), "_segment")
    side = lambda k, where, n: edges.where(where).select((F.col("_order") + k).alias("_order"), *(F.col(c).alias(f"{c}{n}") for c in ("_host", "_path", "_packed")))
    first, last = F.col("_place") != 1, F.col("_place") != -1
    met = edges.join(side(1, last, 1), ["_order"], "left").join(side(-1, first, 2), ["_order"], "left")
    # only a first page meets the page before, only a last page the one after
    met = met.withColumns({"_packed1": F.when(first, F.col("_packed1")), "_packed2": F.when(last, F.col("_packed2"))})
    outer = met.mapInArrow(_rejoined(names), ", ".join([*fields, "text string"]))
    return inner.unionByName(outer).select(*(F.col(n).alias(c) for c, n in own.items()), "text")


def op1_page_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


OP1_SQL = r"""
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1) AS x FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(a|b|i|em|strong|span)>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM body),
decoded AS (SELECT page_id, url, replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM plain)
SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS n_chars FROM decoded
"""
