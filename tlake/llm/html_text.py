"""Main text of web pages: page structure, and a suffix array over the pages of a host.

A page is read into blocks with their place: inside the article, open (nothing says what they are), or furniture by their
tags or class names. The token streams of a host's pages, outside articles, are concatenated; sorting all suffixes by
their first MIN_RUN tokens brings equal runs together, and runs that distinct pages share are covered. A page with an
article gives its blocks. Where no article is marked, the open blocks that are not mostly covered are kept: unique runs.

A large host is dealt into parts with an array each. Runs that pages of different parts share meet by their hashes, and
each part gets those that concern it, so what counts as repeated does not depend on the parts.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_RUN = 6  # tokens, block ends included
PART_CHARS = 8_000_000  # characters of pages whose streams one task sorts together
HELD_RUNS = 1_000_000  # runs that a task holds before it gives them out
MANY_HOSTS = 20_000  # rows of (host, number of parts) that may be broadcast

#: Elements whose content is never text of a page.
RAW = frozenset("script style noscript template svg math iframe object head title textarea select button canvas audio video".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class, id and role values that mark furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination popup promo related "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemtype|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ARTICLE, OPEN, OUTSIDE = 0, 1, 2


def hinted(rest: str) -> set[str]:
    """Words of the attributes that name an element's purpose."""
    if "=" not in rest:
        return set()
    return {w for m in ATTRIBUTE.finditer(rest) for w in re.split(r"[\W_]+", (m[2] or m[3] or m[4] or "").lower())} & HINTS


def place(tag: str, rest: str) -> int | None:
    """What an element says about the blocks inside it; None: nothing."""
    if tag in FURNITURE:
        return OUTSIDE
    words = hinted(rest) if tag not in ("html", "body") else set()
    if tag in MAIN or re.search(r"\brole\s*=\s*[\"']?main\b", rest):
        return OUTSIDE if words & {"comment", "comments", "related", "promo", "sponsored", "ad", "ads"} else ARTICLE
    return OUTSIDE if words else None


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(place, text) of the page's blocks in order, white space as one blank, character references decoded."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, and where their content is
    page = page or ""
    at = 0

    def now() -> int:
        return stack[-1][1] if stack else OPEN

    def flush() -> None:
        if text:
            if words := "".join(text).split():
                out.append((now(), " ".join(words)))
            text.clear()

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            text.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m["data"] is not None:
            text.append(m["data"])
        if not m["tag"]:
            continue
        tag, ending = m["tag"].lower(), bool(m["end"])
        if tag in BLOCKS:
            flush()
        if tag in VOID or (m["rest"].endswith("/") and tag not in BLOCKS):
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if text and stack[k][1] != (stack[k - 1][1] if k else OPEN):
                        flush()
                    del stack[k:]
                    break
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "head":  # its end tag may be left out
                body = re.compile(r"<body\b", re.I).search(page, at)
                if not close and body or close and body and body.start() < close.start():
                    at = body.start()
                    continue
            at = close.end() if close else len(page) if tag != "head" else at
        elif tag in BLOCKS or tag in MAIN or hinted(m["rest"]):
            said, inside = place(tag, m["rest"]), now()
            where = inside if said is None or inside == OUTSIDE else said
            if where != inside:
                flush()
            if tag == "p":  # a paragraph ends where the next begins
                while stack and stack[-1][0] == "p":
                    stack.pop()
            stack.append((tag, where))
    flush()
    return out


def covered(streams: list[list[str]], width: int = MIN_RUN) -> list[np.ndarray]:
    """For each page's tokens: whether a run of ``width`` tokens around it occurs in another, different page as well."""
    lengths = np.array([len(s) for s in streams], np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    if not total:
        return [np.zeros(0, bool) for _ in streams]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for s in streams for t in s), np.int64, total)
    alike: dict[bytes, int] = {}  # pages with the same stream are one
    page = np.repeat([alike.setdefault(ids[e - n : e].tobytes(), len(alike)) for e, n in zip(ends, lengths)], lengths)
    left = np.repeat(ends, lengths) - np.arange(total)  # tokens from here to the page's end
    rank, span = ids, 1
    while span < width:  # ranks of the suffixes by their first `span` tokens, doubled
        step = min(span, width - span)
        after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        after = np.where(left > step, after + 1, 0)
        rank = np.unique(rank * np.int64(total + 2) + after, return_inverse=True)[1]
        span += step
    whole = left >= width
    low, high = np.full(rank.max() + 1, len(alike), np.int64), np.full(rank.max() + 1, -1, np.int64)
    np.minimum.at(low, rank[whole], page[whole])
    np.maximum.at(high, rank[whole], page[whole])
    begins = np.flatnonzero(whole & (low[rank] < high[rank]))
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + width, -1)
    return np.split(np.cumsum(edge[:-1]) > 0, ends[:-1])


def stream(page: list[tuple[int, str]]) -> list[str]:
    """Tokens of the blocks outside the article, each block with an end."""
    return [t for where, text in page if where != ARTICLE for t in (*text.split(" "), "\n")]


def run_hashes(tokens: list[str], host: str, width: int = MIN_RUN) -> np.ndarray:
    """64-bit hashes of a host's runs that begin at each token; alike in all tasks."""
    if len(tokens) < width:
        return np.zeros(0, np.int64)
    of = pd.util.hash_array(np.array([host, *tokens], object))
    h = np.full(len(tokens) - width + 1, of[0])
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + of[1 + k : len(h) + 1 + k]
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def runs_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, host, group) to (h, group, lo, hi): each run of a part, with its least and largest digest of a page."""
    number: dict[str, int] = {}
    held: list[np.ndarray] = []  # rows of h, number of the group, lo, hi

    def merged() -> np.ndarray:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        low, high = np.minimum.reduceat(rows[:, 2], first), np.maximum.reduceat(rows[:, 3], first)
        return np.column_stack([rows[first, :2], low, high])

    def given(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(number), pa.string())
        for at in range(0, len(rows), 100_000):
            h, group, low, high = rows[at : at + 100_000].T
            arrays = [pa.array(h), names.take(pa.array(group)), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "group", "lo", "hi"])

    size = 0
    for batch in batches:
        for html, host_name, group in zip(*(batch.column(c) for c in range(3))):
            tokens = stream(blocks(html.as_py()))
            h = np.unique(run_hashes(tokens, host_name.as_py()))
            if not len(h):
                continue
            digest = hashlib.blake2b("\0".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            page = np.full(len(h), np.frombuffer(digest, np.int64)[0])
            held.append(np.column_stack([h, np.full(len(h), number.setdefault(group.as_py(), len(number))), page, page]))
            size += len(h)
            if size > HELD_RUNS:
                held = [merged()]
                size = len(held[0])
                if size > HELD_RUNS // 2:
                    yield from given(held[0])
                    held, size = [], 0
    if held:
        yield from given(merged())


def host_texts(group: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
    """Texts of the pages of one part of a host; ``elsewhere``: hashes (h) of its runs that pages of the host share."""
    pages = [blocks(h) for h in group["html"]]
    streams = [stream(b) for b in pages]
    marks = covered(streams)
    if len(elsewhere):
        shared = np.sort(elsewhere["h"].to_numpy())
        for tokens, mark, name in zip(streams, marks, group["host"]):
            h = run_hashes(tokens, name)
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            for k in np.flatnonzero(shared[at] == h):
                mark[k : k + MIN_RUN] = True
    texts, repeated = [], []
    for b, mark in zip(pages, marks):
        repeated.append(int(mark.sum()))
        if any(where == ARTICLE for where, _ in b):
            texts.append(" ".join(text for where, text in b if where == ARTICLE))
            continue
        kept, at = [], 0
        for where, text in b:
            if where == ARTICLE:
                continue
            n = text.count(" ") + 1
            if where == OPEN and 2 * mark[at : at + n].sum() <= n:
                kept.append(text)
            at += n + 1
        texts.append(" ".join(kept))
    return pd.DataFrame({"page_id": group["page_id"].to_numpy(), "url": group["url"].to_numpy(), "text": texts, "n_repeated_tokens": repeated})


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated_tokens (tokens outside the article that other pages of the host repeat).

    Null html: empty text. Null or odd url: the host ''. Repeated rows give repeated results and count as one page. A host
    whose pages have more than PART_CHARS characters is dealt by a hash of the url into parts that stay near that size,
    each with an array of its own; the runs that parts share are found by hash over the whole host, for which its pages
    are read twice. Other columns are not read.
    """
    p = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    size = F.sum(F.coalesce(F.length("html"), F.lit(0)))
    large = p.groupBy("host").agg(F.ceil(size / PART_CHARS).cast("long").alias("parts")).filter("parts > 1")
    # Few hosts are that large, and few enough of them are sent to all tasks; otherwise the join is Spark's to choose.
    few = large.limit(MANY_HOSTS + 1).collect()
    if len(few) <= MANY_HOSTS:
        large = F.broadcast(pages.sparkSession.createDataFrame(few, large.schema))
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    # One column names the group, or pages dealt by host alone would already count as grouped.
    dealt = p.join(large, "host", "left").withColumn("group", F.concat_ws("#", part.cast("string"), "host"))
    runs = dealt.filter("parts > 1").select("html", "host", "group").mapInArrow(runs_of_parts, "h long, group string, lo long, hi long")
    # A run comes once from each task and part, so one on all pages does not weigh a task down; its list of parts is as long
    # as the host has parts.
    shared = (
        runs.repartition("h")
        .groupBy("h", "group")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("h")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("group").alias("groups"))
        .filter("lo < hi")
        .select("h", F.explode("groups").alias("group"))
    )
    out = f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, text string, n_repeated_tokens long"
    return (
        dealt.select("page_id", "url", "html", "host", "group")
        .groupBy("group")
        .cogroup(shared.groupBy("group"))
        .applyInPandas(host_texts, out)
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated_tokens")
    )
