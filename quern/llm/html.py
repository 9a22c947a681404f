"""Main text of HTML pages: blocks by structure, boilerplate by a suffix array of each host.

A page is cut into text blocks. Where markup says what a block is, it decides: scripts, styles,
menus, headers, footers, sidebars, notices, adverts, forms and reader comments go, and if the page
has an article or main element, its blocks are what stands there. Every page is then settled by its
host: the token streams of the host's distinct pages are put end to end, and a suffix array sorted by
the first tokens of each suffix finds long substrings that stand on distinct pages. On pages without
an article (in an array of their own), blocks mostly covered by substrings of two pages go, unique ones
stay. An article protects its text, since articles quote and repeat each other: there only blocks go that
are mostly covered by substrings of nearly all of the host's articles, and only where these are the
lesser part of the article.

A large host is dealt into slices of bounded size, and slices change nothing. Of each window of pages
without an article the least and the greatest page of the whole host are found by aggregation. Distinct
articles are dealt by their text, so a substring of nearly all of them is one of nearly all in some
slice; those are counted again over the whole host. Copies of one page stay one page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Hashes, arrow_schema, by_batch, chained, small_batches, staged, trim_memory

#: Elements by what they do to the text.
RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext")
DROPPED = ("nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "menu", "dialog", "button", "select", "object", "audio", "video", "canvas")
HELD = ("article", "main")
CONTAINERS = ("div", "section", "header", "body", "html", "head", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "fieldset", "details", "figure", "blockquote", "center", "span")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "address", "figcaption", "summary", "caption", "hgroup", "option", "legend")
#: Words of a class, id or role that mark what isn't the article.
MARKS = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors banner promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs pagination header masthead footer "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended widget search form complementary contentinfo skip toolbar"
)

#: Of these words, those that mark other people's or paid text for certain, and those that
#: inside an article are its own heading.
CERTAIN = "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion comment comments commentlist disqus reply replies respond related recommended"
HEADINGS = "header masthead"
#: Words that may stand beside a mark in one class name; any other word makes it a subject
#: of its own, as in related-work or share-price.
BESIDE = (
    "article articles area bar block body bottom box button buttons card col column container content entry foot global group head home html icon icons id inner item items js "
    "label large layout left line link links list main mini mobile module outer page panel post posts primary region right row secondary section site slot small sticky story text title top unit "
    "wrap wrapper zone has no is with the and"
)

_CERTAIN, _HEADINGS = frozenset(CERTAIN.split()), frozenset(HEADINGS.split())
_RAW, _DROPPED, _HELD, _BLOCKS = frozenset(RAW), frozenset(DROPPED), frozenset(HELD), frozenset(BLOCKS)
_TRACKED = frozenset(DROPPED + HELD + CONTAINERS)
_BREAKS = _TRACKED - {"span"} | _BLOCKS
_MARKS = frozenset(MARKS.split())
_SAID = _MARKS | frozenset(BESIDE.split())
_TAG = re.compile(r"<!--(?:.*?-->|>|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"(?:\A|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:\A|\s)(?:hidden(?=\s|\Z|=)|aria-hidden\s*=\s*[\"']?true)", re.I)
_ATTR_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HASHES = Hashes()


@dataclass(frozen=True)
class Repeats:
    """min_tokens (a power of two): length of a repeated substring; a block covered to cover or more
    goes; slice_tokens: tokens of one suffix array, of articles slice_pages distinct ones if that is more;
    article_percent, article_pages: an article's substring is the host's if it stands on that percentage
    of the host's distinct articles, and on that many at least."""

    min_tokens: int = 8
    cover: float = 0.5
    slice_tokens: int = 2_000_000
    slice_pages: int = 16
    article_percent: int = 90
    article_pages: int = 10


def _marked(attributes: str, held: bool) -> int:
    """0: no mark; 1: a mark that an article inside outweighs, as on a frame around all; 2: a certain one."""
    found = 0
    for m in _NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for name in [value] if m[1].lower() == "aria-label" else value.split():
            words = {w.lower() for w in _ATTR_WORDS.findall(name)}
            if not words <= _SAID:
                continue
            if words & _CERTAIN:
                return 2
            if words & _MARKS and not (held and words & _MARKS <= _HEADINGS):
                found = 1
    return 2 if _HIDDEN.search(attributes) else found


def page_blocks(page: str | None) -> tuple[list[str], list[str] | None]:
    """(blocks outside marked parts, those of them inside an article or main element; None if the page has none)."""
    if not page:
        return [], None
    everywhere: list[str] = []
    inside: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, mark that drops what follows, inside an article
    dropped, held, found = 0, False, False
    parts: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        block = " ".join("".join(parts).split())
        parts.clear()
        if block:
            everywhere.append(block)
            if held:
                inside.append(block)

    def text(until: int) -> None:
        if not dropped and until > at:
            piece = page[at:until]
            parts.append(html.unescape(piece) if "&" in piece else piece)

    for m in iter(lambda: _TAG.search(page, at), None):
        text(m.start())
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name in _BREAKS and not dropped:
            flush()
        if closing:
            if name in _TRACKED and any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                dropped, held = stack[-1][1:] if stack else (0, False)
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if attributes.endswith("/") and name in ("svg", "math") or name in VOID:
            continue
        if name in _TRACKED:
            mark = _marked(attributes, held) if attributes and name not in ("html", "body") else 0
            if name in _HELD:
                # A layout word on an article or around it doesn't drop it.
                mark = mark if mark > 1 else 0
                if not mark and dropped < 2:
                    dropped, found, held = 0, True, True
            elif name in _DROPPED or name == "header" and not held:
                mark = 2
            dropped = max(dropped, mark)
            stack.append((name, dropped, held))
        elif not dropped and attributes and name in _BLOCKS and _marked(attributes, held):
            # A marked paragraph or item: to its end tag, or to the next block.
            stop = re.compile(rf"</{name}\s*>|<(?:{'|'.join(sorted(_BREAKS))})(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else size
    text(size)
    if not dropped:
        flush()
    return everywhere, inside if found else None


def _repeats(streams: list[np.ndarray], k: int, pages: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in the streams end to end of k-token substrings that stand on least distinct pages or
    more; of each such substring one position; its number of pages). By prefix doubling up to k
    tokens: suffixes with one rank then share k tokens."""
    lengths = np.array([len(s) for s in streams], np.int64)
    page = np.repeat(pages, lengths)
    n = int(lengths.sum())
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    _, rank = np.unique(np.concatenate(streams), return_inverse=True)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # tokens to the stream's end
    step = 1
    while step < k:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        ahead[left <= step] = 0
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
        step *= 2
    paged = rank * (int(page.max()) + 1) + page
    suffixes = np.argsort(paged, kind="stable")
    suffixes = suffixes[left[suffixes] >= k]
    if not len(suffixes):
        return none, none, none
    starts = np.flatnonzero(np.append(True, np.diff(rank[suffixes]) != 0))
    found = np.add.reduceat(np.append(True, np.diff(paged[suffixes]) != 0).astype(np.int64), starts)
    several = found >= least
    return suffixes[np.repeat(several, np.diff(np.append(starts, len(suffixes))))], suffixes[starts[several]], found[several]


def _covered(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n positions stand in a window of k that starts at one of first, as booleans."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, first, 1)
    np.add.at(marks, first + k, -1)
    return np.cumsum(marks[:-1]) > 0


def repeated_windows(streams: list[np.ndarray], pages: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the streams end to end) covered by k-token substrings that stand on distinct
    pages, as booleans, and each position's page."""
    page = np.repeat(pages, [len(s) for s in streams])
    return _covered(_repeats(streams, k, pages, 2)[0], len(page), k), page


def _stream(blocks: list[str]) -> np.ndarray:
    return _HASHES.of([w.encode("utf-8", "replace") for b in blocks for w in b.split(" ")])


def _page_name(stream: np.ndarray) -> int:
    """Pages with equal streams are one page: copies don't make each other boilerplate."""
    import xxhash

    return xxhash.xxh3_64_intdigest(stream.tobytes())


def _windows(stream: np.ndarray, k: int) -> np.ndarray:
    return chained(*(stream[d : len(stream) - k + 1 + d] for d in range(k))) if len(stream) >= k else np.zeros(0, np.uint64)


def _unique_blocks(blocks: list[list[str]], known: np.ndarray, repeats: Repeats) -> list[str]:
    """Text of each page from its blocks; known: hashes of windows that stand on distinct pages of all slices."""
    streams = [_stream(b) for b in blocks]
    _, pages = np.unique([_page_name(s) for s in streams], return_inverse=True)
    covered, _ = repeated_windows(streams, pages, repeats.min_tokens)
    out, at = [], 0
    for b, s in zip(blocks, streams):
        own = covered[at : at + len(s)].copy()
        for i in np.flatnonzero(np.isin(_windows(s, repeats.min_tokens), known)) if len(known) else ():
            own[i : i + repeats.min_tokens] = True
        ends = np.cumsum([len(x.split(" ")) for x in b])
        out.append("\n\n".join(x for x, start, end in zip(b, [0, *ends], ends) if own[start:end].mean() < repeats.cover))
        at += len(s)
    return out


def _host_windows(streams: list[np.ndarray], repeats: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of windows that stand on article_percent of these distinct articles or more, their articles)."""
    k = repeats.min_tokens
    _, first, found = _repeats(streams, k, np.arange(len(streams)), -(-repeats.article_percent * len(streams) // 100))
    if not len(first):
        return np.zeros(0, np.uint64), found
    tokens = np.concatenate(streams)
    return chained(*(tokens[first + d] for d in range(k))), found


def _own_blocks(text: str, known: np.ndarray, repeats: Repeats) -> str:
    """An article's text without the blocks that its host's windows cover, if they are its lesser part."""
    blocks, k = text.split("\n\n"), repeats.min_tokens
    stream = _stream(blocks)
    covered = _covered(np.flatnonzero(np.isin(_windows(stream, k), known)), len(stream), k)
    if not covered.any() or 2 * covered.sum() >= len(stream):
        return text
    ends = np.cumsum([len(b.split(" ")) for b in blocks])
    return "\n\n".join(b for b, start, end in zip(blocks, [0, *ends], ends) if covered[start:end].mean() < repeats.cover)


#: article: the page has an article or main element, or no text at all; then text holds its blocks. copy: of
#: its host's article of this name (a hash of the text) the task met one before.
PARSED = "page_id bigint, url string, host string, text string, blocks array<string>, tokens bigint, name bigint, copy boolean, article boolean"
#: Token streams of some distinct articles of a slice, packed; pages and slices of a large host, else null.
PACKED = "host string, slice int, pages bigint, slices int, names array<bigint>, size bigint, texts binary"
PACKED_CHARS = 8 << 20


def main_text(pages: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """(page_id, url, text): one row a page; blocks joined by two line ends, empty if there are none.

    Null and empty html give empty text; a null url is a host of its own; repeated rows are answered
    each; an article's own text stays even where some other pages repeat it.
    """
    import xxhash

    spark = pages.sparkSession
    small_batches(spark)
    arrow = arrow_schema(spark, PARSED)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, urls, hosts, pages_ = (c.to_pylist() for c in part.columns)
                rows = []
                for of, page in zip(hosts, pages_):
                    blocks, article = page_blocks(page)
                    if article is None and blocks:
                        rows.append((None, blocks, sum(b.count(" ") + 1 for b in blocks), None, None, False))
                        continue
                    # A name is of the tokens in order, like a stream: the blocks' borders don't count.
                    name = xxhash.xxh3_64_intdigest(" ".join(article or []).encode("utf-8", "replace"))
                    copy = (of, name) in met
                    met.add((of, name))
                    rows.append(("\n\n".join(article or []), None, sum(b.count(" ") + 1 for b in article or []), name - (name >> 63 << 64), copy, True))
                found = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, urls, hosts, *found), arrow)], schema=arrow)

    parsed = staged(source.mapInArrow(parse, PARSED), "pages", "article")
    articles = _own_text(parsed.filter("article"), repeats)
    return articles.unionByName(_by_host(parsed.filter("not article").select("page_id", "url", "host", "blocks", "tokens"), repeats))


def _own_text(pages: DataFrame, repeats: Repeats) -> DataFrame:
    """(page_id, url, text) of articles, without the blocks that nearly all articles of their host have."""
    out = "page_id bigint, url string, text string"
    known = _host_repeats(pages.filter("not copy and tokens > 0").select("host", "name", "tokens", "text"), repeats)
    plain = pages.join(known.select("host"), "host", "left_anti").select("page_id", "url", "text")

    def settle(rows: dict[str, list]) -> dict[str, list]:
        texts = [_own_blocks(t, np.array(w, np.int64).view(np.uint64), repeats) if t else t for t, w in zip(rows["text"], rows["windows"])]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts}

    return plain.unionByName(by_batch(pages.join(known, "host").select("page_id", "url", "text", "windows"), settle, out))


def _host_repeats(articles: DataFrame, repeats: Repeats) -> DataFrame:
    """(host, windows): hashes of the windows that stand on nearly all distinct articles of a host."""
    k = repeats.min_tokens
    hosts = articles.groupBy("host", "name").agg(F.max("tokens").alias("tokens")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("tokens").alias("tokens"))
    slices = F.least(F.ceil(F.col("tokens") / F.lit(repeats.slice_tokens)), F.ceil(F.col("pages") / F.lit(repeats.slice_pages))).cast("int")
    # Only large hosts are listed, at most one for each slice_tokens tokens; any other host is one slice.
    large = hosts.select("host", "pages", slices.alias("slices")).filter("slices > 1")
    dealt = articles.join(F.broadcast(large), "host", "left").select("host", F.coalesce(F.pmod(F.xxhash64("name"), F.col("slices")).cast("int"), F.lit(0)).alias("slice"), "pages", "slices", "name", "text")
    schema = "host string, pages bigint, slices int, w bigint, found bigint"
    packed, arrow = (arrow_schema(articles.sparkSession, s) for s in (PACKED, schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[list[int], list[str]]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            texts = ["\n".join(t).encode() for _, t in groups.values()]
            columns = [*zip(*groups), [n for n, _ in groups.values()], [len(t) for t in texts], [pa.compress(t, "zstd", asbytes=True) for t in texts]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, packed)], schema=packed)

        for batch in batches:
            for *of, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                names, texts = groups.setdefault(tuple(of), ([], []))
                names.append(name)
                texts.append(text.replace("\n\n", " "))
                size += len(text)
            if size >= PACKED_CHARS:
                yield rows()
                groups.clear()
                size = 0
        if groups:
            yield rows()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[int, np.ndarray] = {}
        for batch in batches:
            host, _, pages, slices = (batch.column(c)[0].as_py() for c in range(4))
            for names, size, texts in zip(*(c.to_pylist() for c in batch.columns[4:])):
                for name, text in zip(names, pa.decompress(texts, size, "zstd", asbytes=True).decode().split("\n")):
                    if name not in streams:
                        streams[name] = _stream([text])
        of = (host, pages or len(streams), slices or 1)
        w, found = _host_windows(list(streams.values()), repeats) if of[1] >= repeats.article_pages else (np.zeros(0, np.uint64), [])
        yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(w), f.type) for v, f in zip(of, arrow)), pa.array(w.view(np.int64)), pa.array(found, pa.int64())], schema=arrow)
        trim_memory()

    near = staged(dealt.mapInArrow(pack, PACKED).groupBy("host", "slice").applyInArrow(search, schema), "repeats")
    # The count of a host's only slice is the host's; the windows of others are counted over all its articles.
    asked = near.filter("slices > 1").groupBy("host", "pages").agg(F.collect_set("w").alias("windows"))

    def count(rows: dict[str, list]) -> dict[str, list]:
        kept = [np.intersect1d(_windows(_stream([t.replace("\n\n", " ")]), k), np.array(w, np.int64).view(np.uint64)) for t, w in zip(rows["text"], rows["windows"])]
        repeat = lambda name: [v for v, w in zip(rows[name], kept) for _ in w]
        return {"host": repeat("host"), "pages": repeat("pages"), "name": repeat("name"), "w": np.concatenate(kept).view(np.int64) if kept else []}

    met = by_batch(articles.join(asked, "host").select("host", "pages", "name", "text", "windows"), count, "host string, pages bigint, name bigint, w bigint")
    counted = met.groupBy("host", "pages", "w").agg(F.countDistinct("name").alias("found"))
    whole = near.filter("slices = 1").select("host", "pages", "w", "found").unionByName(counted)
    kept = whole.filter((F.col("found") >= repeats.article_pages) & (100 * F.col("found") >= repeats.article_percent * F.col("pages")))
    return staged(kept.groupBy("host").agg(F.collect_list("w").alias("windows")), "repeats")


def _by_host(pages: DataFrame, repeats: Repeats) -> DataFrame:
    k, out = repeats.min_tokens, "page_id bigint, url string, text string"
    slices = pages.groupBy("host").agg(F.ceil(F.sum("tokens") / F.lit(repeats.slice_tokens)).cast("int").alias("slices"))
    dealt = pages.join(slices, "host").withColumn("slice", F.pmod(F.xxhash64("page_id", "url"), F.col("slices")).cast("int"))

    def windows(rows: pd.DataFrame) -> pd.DataFrame:
        streams = [_stream(list(b)) for b in rows["blocks"]]
        found = [_windows(s, k) for s in streams]
        names = np.repeat(np.array([_page_name(s) for s in streams], np.uint64).view(np.int64), [len(w) for w in found])
        found = np.concatenate(found)
        order = np.argsort(found, kind="stable")
        w, starts = np.unique(found[order], return_index=True)
        least, greatest = (f.reduceat(names[order], starts) for f in (np.minimum, np.maximum))
        return pd.DataFrame({"host": rows["host"].iloc[0], "slice": rows["slice"].iloc[0], "w": w.view(np.int64), "least": least, "greatest": greatest})

    several = dealt.filter("slices > 1").groupBy("host", "slice").applyInPandas(windows, "host string, slice int, w bigint, least bigint, greatest bigint")
    distinct = several.groupBy("host", "w").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).filter("least <> greatest")
    shared = several.select("host", "slice", "w").join(distinct.select("host", "w"), ["host", "w"])

    def settle(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        texts = _unique_blocks([list(b) for b in rows["blocks"]], known["w"].to_numpy(np.int64).view(np.uint64), repeats) if len(rows) else []
        return pd.DataFrame({"page_id": rows["page_id"].astype("Int64"), "url": rows["url"], "text": texts})

    return dealt.groupBy("host", "slice").cogroup(shared.groupBy("host", "slice")).applyInPandas(settle, out)
