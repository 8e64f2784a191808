"""Main text of web pages: nearest-URL page differencing, guarded by page structure (operator 10).

A page becomes lines, one a block, each marked by where it stands: in boilerplate (navigation, page
headers and footers, sidebars, forms, notices, adverts, reader comments, scripts and styles), in the main
part (``article``, else ``main``), or undecided.  A class, id or role marks boilerplate by whole names: ``share``, ``cookie-banner`` and
``site-footer-2`` do, ``share-price`` and ``lead-menu`` do not, as every part of a name must be a word of boilerplate or one that
stands beside such words.  Names never mark ``article`` or ``main`` themselves; an element around them that its name marks is kept for their
sake if the page has no other main part, unless it holds reader comments.  A page whose main parts keep no line counts as one without.

Every page with a URL is differenced.  Pages are put in order of host and URL path, and each is paired with the neighbour in that
order whose path shares the longest beginning (with both, if they share as much).  A longest common
subsequence aligns the lines of a pair, and shared lines are deleted.  Structure only guards and completes: a shared line
in the main part stays, because an article may rightly quote, or be, another one and the contract drops nothing
of it; lines that no neighbour shares go if they stand in boilerplate or beside a marked main part.
``n_shared`` and ``n_beside`` count the lines that went for the one and the other reason.

Null or empty html: empty text.  A page without a URL or without a neighbour on its host loses no line by
differencing.  A page that would lose all its undecided lines keeps them (its twin is a copy, not a frame).
Repeated rows, null ids and null URLs are rows of their own.  Other columns are ignored.  All work on a page is linear in its length, but for the
alignment, which takes time by the product of the two pages' lines over 64 and memory by their sum.
Lines of a pair are compared by 64-bit hashes; a page is known by a 128-bit digest of id, URL and html.

Pages are parsed twice: once for the hashes of their lines, which are put in order and aligned, and once for the lines themselves,
which meet the outcome in a single shuffle, deflated.  No copy of the pages is written.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.llm.shared import stage_table

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\x00-\x7f]+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_RAW_ENDS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split())
_AWAY = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "object", "audio", "video", "canvas"}
#: Words of class, id or role that mark boilerplate, and those that may stand beside them in one name (share-buttons, but not share-price).
_BESIDE_WORDS = set("area bar block body bottom box button buttons col column container content field form group header holder icon icons inner item items left link links list main mini mobile module outer page panel primary right row secondary section site slot small sticky text title top unit wrap wrapper zone".split())
_COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
_AWAY_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related recommended share sharing social comment comments commentlist disqus reply replies respond footer copyright skip search login masthead complementary contentinfo".split())

AWAY, OPEN, MAIN = 0, 1, 2


@lru_cache(4096)
def boilerplate_words(name: str) -> frozenset[str]:
    """The words of a class, id or role that mark boilerplate: none unless all its parts are such words, or stand beside them."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return frozenset(p for p in parts if p in _AWAY_WORDS) if all(p in _AWAY_WORDS or p in _BESIDE_WORDS or p.isdigit() for p in parts) else frozenset()


def page_lines(source: str) -> list[tuple[str, int]]:
    """(text, region) of every block with text, in page order."""
    # name; boilerplate: 0 not, 1 by names outside any main part, 2 surely; part: 0 none, 1 main, 2 article
    stack: list[tuple[str, int, int]] = []
    open_tags: Counter[str] = Counter()
    lines: list[tuple[str, int, int]] = []
    held: list[str] = []
    away = part = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append((text, away, part))

    def close(k: int) -> None:
        for gone in stack[k:]:
            open_tags[gone[0]] -= 1
        del stack[k:]

    at, n, last, shape = 0, len(source), source.rfind(">"), _TAG
    while at < n:
        start = source.find("<", at)
        if start < 0:
            held.append(source[at:])
            break
        held.append(source[at:start])
        after = source[start + 1 : start + 2]
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if start > last and (after.isalpha() or after in ("/", "!")):  # the page ends within a tag
            break
        if after in ("!", "?"):
            end = source.find(">", start)
            at = n if end < 0 else end + 1
            continue
        tag = shape.match(source, start)
        if tag is None and shape is _TAG and _LOOSE_TAG.match(source, start):
            shape = _LOOSE_TAG  # a quote that never closes: from here on tags end at the first >
            tag = shape.match(source, start)
        if tag is None:
            held.append("<")
            at = start + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if name == "br" or name in ("td", "th"):
            held.append(" ")
        if name in _BLOCKS or name in _AWAY or name in _RAW:
            flush()
        if tag[1]:
            if open_tags[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
        elif name in _RAW:
            end = _RAW_ENDS[name].search(source, at)
            at = n if end is None else end.start()
            beyond = source.find(">", at)
            at = n if beyond < 0 else beyond + 1
            continue
        elif name not in _VOID and not tag[3].endswith("/"):
            if name == "p" or name in _BLOCKS:  # an open paragraph ends here
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _BLOCKS:
                        break
            outer = stack[-1][1] if stack else 0
            inside = stack[-1][2] if stack else 0
            words: set[str] = set()
            hidden = is_main = False
            for attribute, *values in _ATTRIBUTE.findall(tag[3]):
                attribute, value = attribute.lower(), "".join(values)
                hidden |= attribute == "hidden" or (attribute == "style" and bool(_NO_DISPLAY.search(entities.unescape(value))))
                is_main |= attribute == "role" and value.strip().lower() == "main"
                if attribute in ("class", "id", "role"):
                    words.update(*map(boilerplate_words, entities.unescape(value).split()))
            gone = outer
            if hidden or name in _AWAY or (name == "header" and inside < 2):
                gone = 2
            elif words and not is_main and name not in ("html", "body", "article", "main"):
                gone = max(outer, 2 if inside or words & _COMMENT_WORDS else 1)
            stack.append((name, gone, max(inside, 2 if name == "article" else 1 if name == "main" or is_main else 0)))
            open_tags[name] += 1
        away, part = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
    flush()
    for limit in (0, 1):  # a main part inside an element that only its name marks counts where the page has no other
        best = max((p for _, gone, p in lines if gone <= limit), default=0)
        if best:
            return [(t, MAIN if gone <= limit and p == best else AWAY) for t, gone, p in lines]
    return [(t, AWAY if gone else OPEN) for t, gone, _ in lines]


def _prefix_lengths(mine: list[int], other: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``other`` with every beginning of ``mine``, from bits."""
    n = len(mine)
    places: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(mine):
        places[x].append(i)

    @lru_cache(64)
    def mask(x: int) -> int:
        bits = np.zeros(n, np.uint8)
        bits[places[x]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    full = state = (1 << n) - 1
    for y in other:
        if y in places:
            match = mask(y)
            state = ((state + (state & match)) | (state & ~match)) & full
    bits = np.unpackbits(np.frombuffer(state.to_bytes(-(-n // 8) or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(mine: list[int], other: list[int]) -> list[bool]:
    """Which of ``mine`` a longest common subsequence with ``other`` aligns: divide and conquer in linear memory."""
    marked, known = [False] * len(mine), set(mine) & set(other)
    places = [i for i, x in enumerate(mine) if x in known]
    a, b = [mine[i] for i in places], [x for x in other if x in known]
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            marked[places[i]] = True
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            marked[places[j]] = True
        if i == j or k == m:
            continue
        if m - k == 1:
            hit = next((x for x in range(i, j) if a[x] == b[k]), None)
            if hit is not None:
                marked[places[hit]] = True
            continue
        half = (k + m) // 2
        left, right = _prefix_lengths(a[i:j], b[k:half]), _prefix_lengths(a[i:j][::-1], b[half:m][::-1])[::-1]
        cut = i + int(np.argmax(left + right))
        todo += [(i, cut, k, half), (cut, j, half, m)]
    return marked


def _key(page_id: int | None, url: str | None, source: str | None) -> bytes:
    return hashlib.blake2b(repr((page_id, url)).encode() + b"\0" + (source or "").encode(), digest_size=16).digest()


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, page_id, url and line hashes of pages with a URL and a line."""
    for batch in batches:
        rows = []
        for page_id, url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            lines = page_lines(source.as_py() or "") if url is not None else []
            if lines:
                rows.append((_key(page_id, url, source.as_py()), page_id, url, [hash_line(t) for t, _ in lines]))
        cols = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["key", "page_id", "url", "hashes"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, page_id, url, and all lines with their regions, deflated (lines hold no line breaks)."""
    for batch in batches:
        keys, packed = [], []
        for page_id, url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            lines = page_lines(source.as_py() or "")
            keys.append(_key(page_id, url, source.as_py()))
            packed.append(zlib.compress("\n".join(f"{r}{t}" for t, r in lines).encode("utf-8", "surrogatepass"), 6))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["key", "page_id", "url", "packed"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, text, n_shared, n_beside from packed lines and the flags of shared ones."""
    for batch in batches:
        cols: list[list] = [[], [], []]
        for packed, gone in zip(batch.column(2), batch.column(3).to_pylist()):
            body = zlib.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
            lines = [(x[1:], int(x[0])) for x in body.split("\n")] if body else []
            gone = gone or [False] * len(lines)
            undecided = [g for (_, r), g in zip(lines, gone) if r == OPEN]
            twin = bool(undecided) and all(undecided)
            stays = [r == MAIN or r == OPEN and (twin or not g) for (_, r), g in zip(lines, gone)]
            away = [g for s, g in zip(stays, gone) if not s]
            for c, v in zip(cols, ("\n\n".join(t for (t, _), s in zip(lines, stays) if s), sum(away), len(away) - sum(away))):
                c.append(v)
        arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["page_id", "url", "text", "n_shared", "n_beside"])


def hash_line(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())], names=[*batch.schema.names, "part", "place"])
        place += n


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which lines the nearer neighbour (or either of two as near) shares."""

    def near(path: str, other: str | None) -> int:
        if other is None:
            return -1
        k = 0
        for a, b in zip(path.split("/"), other.split("/")):
            if a != b:
                break
            k += 1
        return k

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            before, after = near(r["path"], r["path_before"]), near(r["path"], r["path_after"])
            nearest = [r[name] for name, k in (("before", before), ("after", after)) if k == max(before, after) >= 0]
            marks = [shared_lines(r["hashes"], other) for other in nearest]
            out.append([any(m[i] for m in marks) for i in range(len(r["hashes"]))])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(out, pa.list_(pa.bool_()))], names=["key", "gone"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_beside of every page."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/$", "")
    light = pages.mapInArrow(_outline, "key binary, page_id long, url string, hashes array<long>").select("key", host.alias("host"), path.alias("path"), "page_id", "hashes")
    ordered = light.repartitionByRange("host", "path", "page_id", "key").sortWithinPartitions("host", "path", "page_id", "key")
    numbered = ordered.mapInArrow(_number, "key binary, host string, path string, page_id long, hashes array<bigint>, part int, place long")
    numbered = stage_table(numbered, "order")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))  # one row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = numbered.join(F.broadcast(bases), "part").withColumn("nth", F.col("base") + F.col("place"))
    asking = placed.select("nth", "key", "host", "path", "hashes")

    def neighbour(step: int, name: str) -> DataFrame:
        return placed.select((F.col("nth") - step).alias("nth"), F.col("host").alias(f"host_{name}"), F.col("path").alias(f"path_{name}"), F.col("hashes").alias(name))

    paired = asking.join(neighbour(-1, "before"), "nth", "left").join(neighbour(1, "after"), "nth", "left")
    same = lambda name: F.when(F.col("host") == F.col(f"host_{name}"), F.col(f"path_{name}"))
    paired = paired.select("key", "path", "hashes", same("before").alias("path_before"), "before", same("after").alias("path_after"), "after")
    # repeated rows have equal flags: each has a twin beside it
    shared = paired.mapInArrow(_difference, "key binary, gone array<boolean>").groupBy("key").agg(F.first("gone").alias("gone"))
    packed = pages.mapInArrow(_lines, "key binary, page_id long, url string, packed binary")
    out = packed.join(shared, "key", "left").select("page_id", "url", "packed", "gone").mapInArrow(_kept, "page_id long, url string, text string, n_shared long, n_beside long")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_beside")
