"""Main text of web pages, with boilerplate found by a suffix array of each host.

A page is read into blocks. What the mark-up names as boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, comments) never
is text. If the page marks its article, the article's other blocks are the
text. The blocks outside articles of all pages of a host, as token streams
laid end to end, get a suffix array: windows of tokens that several distinct
streams share are boilerplate of the host, and a page without a marked article
keeps the blocks that such windows do not cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Fixed values of HTML: elements without content, elements inside a line, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split()
)
NO_TEXT = frozenset("script style head title template noscript iframe svg canvas object audio video math".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select textarea dialog menu".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in the class or id of an element that mark it as boilerplate.
BOILERPLATE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs
    footer sidebar masthead cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login
    search social share sharing sharebar related recommended comment comments commentlist disqus respond reply replies pagination pager widget""".split()
)
BOILERPLATE_NAMES = frozenset("header site-header page-header global-header alert alerts toolbar".split())
_P_ENDS = frozenset("article main".split()) | BOILERPLATE_TAGS

#: Tokens of a window, distinct streams that make it boilerplate, and the share of a block that windows must cover.
WINDOW, STREAMS, COVERED = 6, 3, 0.6
#: Pages of a host that share a suffix array; larger hosts are split and their windows counted together.
HOST_PAGES = 256


def _named_boilerplate(attributes: list[tuple[str, str | None]]) -> bool:
    for name, value in attributes:
        if name == "role" and (value or "").strip().lower() in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id"):
            for one in (value or "").lower().split():
                if one in BOILERPLATE_NAMES or not BOILERPLATE_WORDS.isdisjoint(re.split(r"[-_:]+", one)):
                    return True
    return False


class _Blocks(HTMLParser):
    """The blocks of a page as (text, inside an article, named boilerplate)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, int, int, int]] = []  # tag, and how many articles, boilerplates and silent elements hold
        self.has_article = False

    def _state(self) -> tuple[int, int, int]:
        return self.open[-1][1:] if self.open else (0, 0, 0)

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            article, boilerplate, _ = self._state()
            self.blocks.append((text, article > 0, boilerplate > 0))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._end_block()
            for i in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph
                if self.open[i][0] == "p":
                    del self.open[i:]
                    break
                if self.open[i][0] not in INLINE:
                    break
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        article, boilerplate, silent = self._state()
        is_article = tag in ARTICLE_TAGS or any(n == "role" and (v or "").lower() in ("main", "article") for n, v in attrs)
        named = tag not in ("html", "body") and (tag in BOILERPLATE_TAGS or _named_boilerplate(attrs))
        if is_article and not (boilerplate or named):
            self.has_article = True
        if (named or tag in NO_TEXT) and tag in INLINE:
            self._end_block()
        self.open.append((tag, article + is_article, boilerplate + named, silent + (tag in NO_TEXT)))

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in INLINE or any(t not in INLINE for t, *_ in self.open[i + 1 :]) or self.open[i][2:] != (self.open[i - 1][2:] if i else (0, 0)):
                    self._end_block()
                del self.open[i:]
                return
            if self.open[i][0] in _P_ENDS and tag in ("p", *INLINE):
                return  # a stray end tag does not close what holds it

    def handle_data(self, data: str) -> None:
        if not self._state()[2]:
            self.parts.append(data)

    def result(self, html: str) -> list[tuple[str, bool, bool]]:
        self.feed(html)
        self.close()
        self._end_block()
        return self.blocks


def page_blocks(html: str | None) -> tuple[bool, str, list[tuple[str, bool]]]:
    """Whether the page marks an article, the article's text, and the blocks outside it (text, named boilerplate); without an article all blocks are."""
    parser = _Blocks()
    blocks = parser.result(html or "")
    if not parser.has_article:
        return False, "", [(t, b) for t, _, b in blocks]
    return True, "\n".join(t for t, a, b in blocks if a and not b), [(t, b) for t, a, b in blocks if not a]


def host_of(url: str | None) -> str:
    rest = (url or "").split("//", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the tokens, by prefix doubling, and the LCP of each suffix with the one before it."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.concatenate(([False], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            break
        ranks.append(rank)
        step *= 2
    lcp, a, b = np.zeros(n, np.int64), order[1:].copy(), order[:-1].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        lcp[1:] += same * (1 << level)
        a += same * (1 << level)
        b += same * (1 << level)
    return order, np.minimum(lcp, n - order)


def _streams(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """All streams' tokens in a row as 63-bit hashes, each page followed by a separator of its own, and the page of each."""
    import xxhash

    hashes, owner = [], []
    for i, tokens in enumerate(pages):
        hashes.append(np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) >> 1 for t in tokens] + [(1 << 63) + i], np.uint64))
        owner.append(np.full(len(tokens) + 1, i))
    return np.concatenate(hashes), np.concatenate(owner)


def _window_hashes(tokens: np.ndarray) -> np.ndarray:
    """Of each position, a hash of the WINDOW tokens from it (0 where fewer are left)."""
    n = len(tokens) - WINDOW + 1
    out = np.zeros(len(tokens), np.uint64)
    if n > 0:
        mixed = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            mixed = (mixed ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        out[:n] = mixed
    return out


def shared_windows(pages: list[list[str]], weights: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the streams' distinct windows, and on how many pages each lies, from their suffix array.

    ``weights`` are the numbers of pages that have each stream (1 without).
    """
    number: dict[tuple[str, ...], int] = {}
    for t, w in zip(map(tuple, pages), weights or [1] * len(pages), strict=True):
        number[t] = number.get(t, 0) + w if weights else 1  # copies of a page count once
    distinct = [list(t) for t in number]
    if not distinct:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens, owner = _streams(distinct)
    order, lcp = suffix_array(tokens)
    group = np.cumsum(lcp < WINDOW)  # suffixes whose first WINDOW tokens are equal
    ends = np.searchsorted(np.flatnonzero(tokens >> np.uint64(63)), order)
    room = np.flatnonzero(tokens >> np.uint64(63))[ends] - order
    full = room >= WINDOW
    pairs = np.unique(np.stack([group[full], owner[order[full]]]), axis=1)
    groups, at = np.unique(pairs[0], return_inverse=True)
    count = np.bincount(at, np.array(list(number.values()))[pairs[1].astype(np.int64)], len(groups)).astype(np.int64)
    first = np.full(int(group[-1]) + 1, -1, np.int64)
    first[group[full][::-1]] = order[full][::-1]
    return _window_hashes(tokens)[first[groups]], count


def covered_blocks(blocks: list[str], windows: set[int]) -> list[bool]:
    """Which blocks of a page have at least the share COVERED of their tokens in the given windows."""
    tokens = [b.split() for b in blocks]
    if not windows or not tokens:
        return [False] * len(blocks)
    stream, _ = _streams([[t for block in tokens for t in block]])
    hit = np.flatnonzero([int(h) in windows for h in _window_hashes(stream[:-1])])
    covered = np.zeros(len(stream), bool)
    for k in range(WINDOW):
        covered[hit + k] = True
    ends = np.cumsum([len(t) for t in tokens])
    return [bool(covered[e - len(t) : e].mean() >= COVERED) for t, e in zip(tokens, ends, strict=True)]


def _parsed(pages: DataFrame, with_text: bool) -> DataFrame:
    """host, page (a hash of the html), marked, and either page_id, url and text, or the blocks outside the article and a hash of its text."""
    kind = pages.schema["page_id"].dataType.simpleString()
    outside_type = pa.list_(pa.struct([("text", pa.string()), ("named", pa.bool_())]))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [page_blocks(h) for h in part.column("html").to_pylist()]
                columns = {
                    "host": pa.array([host_of(u) for u in part.column("url").to_pylist()], pa.string()), "page": part.column("page"),
                    "marked": pa.array([m for m, _, _ in found], pa.bool_()),
                }
                if with_text:
                    columns |= {"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array([t for _, t, _ in found], pa.string())}
                else:
                    columns["outside"] = pa.array([[{"text": t, "named": b} for t, b in o] for _, _, o in found], outside_type)
                    columns["article"] = pa.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) >> 1 for _, t, _ in found], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    more = f"page_id {kind}, url string, text string" if with_text else "outside array<struct<text string, named boolean>>, article long"
    keyed = pages.select("page_id", "url", "html", F.xxhash64("html").alias("page"))
    return keyed.mapInArrow(parsed, f"host string, page long, marked boolean, {more}")


def host_boilerplate(pages: DataFrame) -> DataFrame:
    """host, page, shared, kept: how many of a page's blocks outside its article windows of its host cover, and the text of the others.

    A window counts the distinct pages of the host that have it: pages of
    equal text are one, pages of one menu and different articles are several.
    Blocks that the mark-up names are not kept either. No host has to fit in
    one task: large ones are split, and their windows are counted over all
    parts.
    """
    read = stored(_parsed(pages, False), "blocks")
    keyed = read.withColumns({"stream": F.xxhash64(F.array_join("outside.text", " ")), "blocks": F.xxhash64("outside")})
    pages_of = stored(keyed.select("host", "page", "blocks").distinct(), "pages")
    # Of each stream: the pages that have it, its part of the host, and the blocks whose row carries the count.
    light = keyed.groupBy("host", "stream").agg(F.count_distinct("article").alias("count"), F.min("blocks").alias("first"))
    sizes = light.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).alias("shards"))
    parts = light.join(stored(sizes, "hosts"), "host").withColumn("shard", F.pmod(F.xxhash64("stream"), "shards").cast("int")).drop("shards")
    dealt = keyed.dropDuplicates(["host", "blocks"]).drop("article").join(parts, ["host", "stream"]).withColumn("weight", F.when(F.col("blocks") == F.col("first"), F.col("count")).otherwise(0))
    streams = stored(dealt.select("host", "blocks", "shard", "outside", "weight"), "streams")

    def windows_of(group: pd.DataFrame) -> pd.DataFrame:
        hashes, count = shared_windows([[t for b in blocks for t in b["text"].split()] for blocks in group["outside"]], group["weight"].tolist())
        return pd.DataFrame({"host": group["host"].iloc[0], "shard": group["shard"].iloc[0], "window": hashes.view(np.int64), "pages": count})

    counted = streams.groupBy("host", "shard").applyInPandas(windows_of, "host string, shard int, window long, pages long")
    hot = counted.groupBy("host", "window").agg(F.sum("pages").alias("pages"), F.collect_set("shard").alias("shards")).where(F.col("pages") >= STREAMS)
    by_shard = hot.select("host", "window", F.explode("shards").alias("shard"))

    def kept_of(page_rows: pd.DataFrame, window_rows: pd.DataFrame) -> pd.DataFrame:
        windows = set(window_rows["window"].to_numpy(np.int64).view(np.uint64).tolist())
        shared, texts = [], []
        for blocks in page_rows["outside"]:
            gone = covered_blocks([b["text"] for b in blocks], windows)
            shared.append(sum(gone))
            texts.append("\n".join(b["text"] for b, g in zip(blocks, gone, strict=True) if not g and not b["named"]))
        return pd.DataFrame({"host": page_rows["host"], "blocks": page_rows["blocks"], "shared": shared, "kept": texts})

    both = streams.groupBy("host", "shard").cogroup(by_shard.groupBy("host", "shard"))
    found = both.applyInPandas(kept_of, "host string, blocks long, shared long, kept string")
    return pages_of.join(found, ["host", "blocks"]).select("host", "page", "shared", "kept")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, shared_blocks of every page.

    The text is that of the marked article, or else of the blocks that the
    host's shared windows do not cover; shared_blocks counts those that they
    do, outside an article. Null and empty html give an empty text. Repeated
    rows give repeated rows (and count as one stream for boilerplate); pages
    without a url share the host ''; an empty table gives no rows. Pages are
    read twice, so that their texts need not be stored meanwhile.
    """
    found = stored(host_boilerplate(pages.select("page_id", "url", "html")), "boilerplate")
    read = _parsed(pages.select("page_id", "url", "html"), True).withColumn("page", F.coalesce("page", F.lit(0)))
    joined = read.join(found.withColumn("page", F.coalesce("page", F.lit(0))), ["host", "page"], "left")
    text = F.when(F.col("marked"), F.col("text")).otherwise(F.coalesce("kept", F.lit("")))
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.coalesce("shared", F.lit(0)).alias("shared_blocks"))
