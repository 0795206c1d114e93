"""Main text of web pages by nearest-URL page differencing, guarded by page structure.

1. A page is read into lines, the texts of its block elements. Lines in navigation, footers, sidebars, notices, adverts,
   forms or reader comments are dropped; of the others those inside <article> (or, without one, <main>) count, or all of
   them where a page has neither.
2. Pages are sorted by (host, path). Each page is paired with the neighbour in that order, on its own host, whose
   path has the longer common beginning.
3. The pair's lines are aligned by a longest common subsequence, and shared lines are deleted.
4. Guards: inside <article> or <main> only lines that may be labels of a template are deleted, which are short, no
   sentences and no headings, list items, table cells, captions or code; articles that quote the same passage keep it.
   And a page whose neighbour is a copy of it (COPY of the characters shared) keeps all its lines.

The order is made by a range partitioning of small key rows, so a large host spreads over partitions; only the
first and last key of each partition pass through the driver, to pair across partition ends. Line hashes, not texts,
are joined; texts stay where they were parsed, but for pages that lose lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import arrow_limits, key_filter, maybe_in, staged, tidy, unstage
from .urlfilter import host_of, path_of

# HTML element names by what they mean for text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title template iframe svg object".split())
#: Skipped or dropped as well, but text inside an article or main.
LOOSE_RAW, LOOSE_DROPPED = {"noscript", "math"}, {"figcaption"}
DROPPED = set("head nav footer aside form button select dialog menu".split())
BLOCKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of class, id or role that mark furniture.
FURNITURE = set("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

#: Whole class tokens, and ids but of headings and sections, that mark furniture inside an article.
ARTICLE_FURNITURE = set("ad ads advert advertisement advertising comment comments disqus promo share sharing social sponsor sponsored".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 header section".split())
#: Block elements whose lines inside an article may be labels of a template.
PLAIN = set("address article div main p section".split())
SENTENCE_ENDS = tuple(".!?\u2026:;,\u3002\uff01\uff1f\u0964")

#: A line of at least so many words is no label.
LABEL_WORDS = 8
#: A pair that shares so much of a page's characters are copies.
COPY = 0.9
#: Bits of a table that the alignment may hold at once; longer pages are halved first.
TABLE_BITS = 1 << 26

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAMED = re.compile(r"""(?<![\w-])(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def _is_furniture(attributes: str) -> bool:
    return any(w in FURNITURE for m in _MARKED.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()))


def _is_article_furniture(name: str, attributes: str) -> bool:
    found = (m for m in _NAMED.finditer(attributes) if name not in HEADINGS or m[1].lower() == "class")
    return any(w in ARTICLE_FURNITURE for m in found for w in (m[2] or m[3] or m[4] or "").lower().split())


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of each block outside furniture, in page order; place: 2 in an article, 1 in main, 0 loose."""
    return [(text, place) for text, place, _ in lines_of(page)]


def lines_of(page: str) -> list[tuple[str, int, str]]:
    """The blocks with the name of the innermost block element that holds each."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, whether its text is dropped, place
    parts: list[str] = []
    at = 0

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][2] if stack else 0, next((e[0] for e in reversed(stack) if e[0] in BLOCKS), "")))
            parts.clear()

    while True:
        m = _TAG.search(page, at)
        if not stack or not stack[-1][1]:
            parts.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                if any(s[0] in BLOCKS or s[0] in DROPPED for s in stack[depth:]):
                    close_block()
                del stack[depth:]
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS or name in DROPPED:
            close_block()
        gone, place = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if name in RAW or (name in LOOSE_RAW and place == 0):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            gone = gone or name in DROPPED or (name in LOOSE_DROPPED or name == "header") and place == 0
            if not gone and name not in ("html", "body", "article", "main") and "=" in m[3]:
                gone = _is_article_furniture(name, m[3]) if place == 2 else _is_furniture(m[3])
            stack.append((name, gone, max(place, 2 if name == "article" else 1 if name == "main" else 0)))
    if not stack or not stack[-1][1]:
        close_block()
    return out


def _is_label(text: str, element: str) -> bool:
    return element in PLAIN and len(text.split()) < LABEL_WORDS and not text.rstrip("\"')]\u201d\u2019\u00bb").endswith(SENTENCE_ENDS)


def _rows(a: list, b: list) -> Iterator[int]:
    """For each line of a, a row of bits over b: bit k is 0 where the common length of a so far and b[:k + 1] is one
    more than with b[:k]."""
    full = (1 << len(b)) - 1
    where: dict = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Common lengths of a and b[:k] for k = 0 to len(b)."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: list, b: list, table_bits: int = TABLE_BITS) -> list[int]:
    """Places in a of a longest common subsequence of a and b: rows of bits and a walk back through them; tables of more
    than table_bits are halved first, where both halves' common lengths add up to the most."""
    both = set(a) & set(b)
    at, b = [k for k, x in enumerate(a) if x in both], [x for x in b if x in both]
    a = [a[k] for k in at]
    if len(a) * len(b) > table_bits and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return [at[k] for k in common_lines(a[:half], b[:cut], table_bits)] + [at[half + k] for k in common_lines(a[half:], b[cut:], table_bits)]
    rows = list(_rows(a, b))
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i > 0 and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(at[i])
            i, j = i - 1, j - 1
    return out[::-1]


_PARSED = "uid long, page_id long, url string, host string, path string, blocks array<string>, lines array<long>, sizes array<int>, open array<boolean>"


def _hashes(texts: list[str]) -> list[int]:
    raw, at = bv.column_bytes(pa.array(texts, pa.string()))
    return bv.span_hashes(raw, at[:-1], at[1:]).view(np.int64).tolist()


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, free = [], [], []
        for page in batch.column(5):
            found = lines_of(page.as_py() or "")
            top = max((p for _, p, _ in found), default=0)
            found = [line for line in found if line[1] == top]
            texts.append([t for t, _, _ in found])
            lines.append(_hashes(texts[-1]))
            free.append([not top or _is_label(t, element) for t, _, element in found])
        sizes = [[len(t) for t in own] for own in texts]
        made = [pa.array(texts, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(free, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *made], names=[c.split()[0] for c in _PARSED.split(", ")])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_NEXT = "uid long, host string, path string, page_id long, before long, before_path string, after long, after_path string, edge int"


def _neighbour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys in; each key with the uids next to it on its host. edge: 1 first, 2 last key of the partition."""
    names = [c.split()[0] for c in _NEXT.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32()]

    def rows(three):
        (prev, key, after), edge = three
        p = prev if prev and prev[0] == key[0] else None
        a = after if after and after[0] == key[0] else None
        return (key[3], key[0], key[1], key[2], p and p[3], p and p[1], a and a[3], a and a[1], edge)

    prev = key = None
    for batch in batches:
        out = []
        for nxt in zip(*(batch.column(k).to_pylist() for k in range(4))):  # host, path, page_id, uid
            if key is not None:
                out.append(rows(((prev, key, nxt), 1 if prev is None else 0)))
            prev, key = key, nxt
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
    if key is not None:
        out = [rows(((prev, key, None), 3 if prev is None else 2))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _partners(keys: DataFrame) -> DataFrame:
    """(uid, partner): the neighbour on the same host whose path has the longer common beginning; ties: the one before."""
    order = ["host", "path", "page_id", "uid"]
    near = staged(keys.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_neighbour_rows), _NEXT), "neighbours")
    ends = sorted(near.where("edge > 0").collect(), key=lambda r: (r.host, r.path, r.page_id is not None, r.page_id or 0, r.uid))  # two rows per partition
    patch = {}
    for left, right in zip(ends, ends[1:]):
        if left.edge & 2 and right.edge & 1 and left.host == right.host:
            patch.setdefault(left.uid, {})["after"] = (right.uid, right.path)
            patch.setdefault(right.uid, {})["before"] = (left.uid, left.path)
    if patch:
        rows = [(u, *p.get("before", (None, None)), *p.get("after", (None, None))) for u, p in patch.items()]
        fixed = near.sparkSession.createDataFrame(rows, "uid long, b long, bp string, a long, ap string")
        near = near.join(F.broadcast(fixed), "uid", "left").select("uid", "path", F.coalesce("before", "b").alias("before"), F.coalesce("before_path", "bp").alias("before_path"), F.coalesce("after", "a").alias("after"), F.coalesce("after_path", "ap").alias("after_path"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = []
            for path, b, bp, a, ap in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                after = a is not None and (b is None or _prefix(path, ap) > _prefix(path, bp))
                picked.append(a if after else b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.int64())], names=["uid", "partner"])

    return near.select("uid", "path", "before", "before_path", "after", "after_path").mapInArrow(tidy(choose), "uid long, partner long")


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, lines, sizes, open, other lines): the numbers of the lines that go, of pages that lose any."""
    for batch in batches:
        uids, gone = [], []
        for uid, lines, sizes, free, other in zip(*batch.columns):
            size = sizes.as_py()
            shared = common_lines(lines.as_py(), other.as_py())
            may = free.as_py()
            if sum(size[k] for k in shared) < COPY * sum(size) and (own := [k for k in shared if may[k]]):
                uids.append(uid.as_py())
                gone.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["uid", "gone"])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (blocks of the main text joined by blank lines; empty if none), n_chars.

    pages needs page_id, url and html; other columns are ignored. A null html is empty; a very long one is parsed
    whole. Pages with a null URL, or one without a host, are not paired with others. Equal rows are one page: they are
    not paired with each other and are answered alike. A page that is alone on its host, or whose neighbour is a copy
    of it, keeps its lines. An empty table gives an empty result.
    """
    arrow_limits(pages.sparkSession)
    url = F.col("url")
    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("uid"), "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    parsed = staged(rows.mapInArrow(tidy(_parse_rows), _PARSED), "parsed")
    partner = _partners(parsed.where("host <> ''").select("host", "path", "page_id", "uid")).where("partner IS NOT NULL")
    mine = parsed.where(F.exists("open", lambda x: x)).select("uid", "lines", "sizes", "open").dropDuplicates(["uid"])
    other = parsed.select(F.col("uid").alias("partner"), F.col("lines").alias("other")).dropDuplicates(["partner"])
    pairs = mine.join(partner, "uid").join(other, "partner").select("uid", "lines", "sizes", "open", "other")
    gone = staged(pairs.mapInArrow(tidy(_shared_rows), "uid long, gone array<int>"), "gone")
    if gone.n_rows:
        found = key_filter(gone, ["uid"])
        cut = maybe_in(parsed, ["uid"], found).join(gone, "uid", "left")
        left = F.filter("blocks", lambda x, k: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), k))
        done = maybe_in(parsed, ["uid"], found, outside=True).select("page_id", "url", "blocks").unionByName(cut.select("page_id", "url", left.alias("blocks")))
    else:
        unstage(gone)
        done = parsed
    return done.select("page_id", "url", F.array_join("blocks", "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
