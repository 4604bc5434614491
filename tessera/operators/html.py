"""Extraction of titles and sections from HTML pages, and the check of urls; both in Arrow batches."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col
from .quality import block_signals

MIN_BLOCK = 40
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside"))
HEADINGS = frozenset(("h1", "h2", "h3"))
BLOCKS = HEADINGS | {"p", "li"}
# elements whose start ends an open paragraph
_ENDS_P = BLOCKS | {"div", "ul", "ol", "table", "section", "article", "main", "form", "blockquote", "pre", "h4", "h5", "h6", "hr", "dl", "figure"} | DROPPED
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Collects the text of every block element; a block within a block is heard in both."""

    def __init__(self, dropped: frozenset[str] = DROPPED):
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.stack: list[tuple[str, int]] = []  # open elements and their block's number or -1
        self.blocks: list[tuple[str, list[str]]] = []
        self.mute = 0
        self.title: list[str] | None = None

    def _close(self, at: int) -> None:
        for name, _ in self.stack[at:]:
            self.mute -= name in self.dropped
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._close(i)
                    break
        if tag == "li":
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ("ul", "ol"):
                    break
                if self.stack[i][0] == "li":
                    self._close(i)
                    break
        if tag in _VOID:
            return
        number = -1
        if tag in BLOCKS and not self.mute:
            number = len(self.blocks)
            self.blocks.append((tag, []))
        elif tag == "title" and not self.mute and self.title is None:
            self.title = []
        self.mute += tag in self.dropped
        self.stack.append((tag, number))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                return

    def handle_data(self, data):
        text = data.strip()
        if not text or self.mute:
            return
        for name, number in self.stack:
            if number >= 0:
                self.blocks[number][1].append(text)
            elif name == "title" and self.title is not None:
                self.title.append(text)


def parse(html: str, dropped: frozenset[str] = DROPPED) -> tuple[str, list[tuple[str, str]]]:
    """The page's title and its blocks ``(element, text)`` in document order."""
    page = _Page(dropped)
    page.feed(html)
    page.close()
    blocks = [(tag, " ".join(parts)) for tag, parts in page.blocks]
    title = next((text for tag, text in blocks if tag == "h1"), None)
    if title is None:
        title = " ".join(page.title) if page.title is not None else "Untitled Source"
    return title, blocks


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        who, title, pos, tag, text = [], [], [], [], []
        for row, html in enumerate(batch.column(1).to_pylist()):
            name, blocks = parse(html or "")
            for k, (element, body) in enumerate([("title", name), *blocks]):
                who.append(row)
                title.append(name)
                pos.append(k - 1)
                tag.append(element)
                text.append(body)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(who, pa.int64())), pa.array(title, pa.string()), pa.array(pos, pa.int32()), pa.array(tag, pa.string()), pa.array(text, pa.string())],
            names=["page_id", "title", "pos", "tag", "text"],
        )


def page_blocks(pages: DataFrame, id_col: str, html_col: str, *, max_bytes: int = 15 * 1024 * 1024) -> DataFrame:
    """``(page_id, title, pos, tag, text)``; each page has a row of tag 'title' at -1. Pages over ``max_bytes`` are left out; a null page has the default title."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).where(F.col("html").isNull() | (F.octet_length("html") <= max_bytes))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_parse, f"page_id {kind}, title string, pos int, tag string, text string")


def page_sections(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(page_id, title, sections array<struct<heading, text>>)``: prose blocks of over ``MIN_BLOCK`` characters under their nearest heading.

    Built from one page's blocks at a time, which a page's size bounds.
    """
    flagged = block_signals(page_blocks(pages, id_col, html_col), "text")
    keep = (F.length("text") > MIN_BLOCK) & (F.size("reasons") == 0)
    item = F.struct("pos", F.col("tag").isin(*HEADINGS).alias("head"), "text")
    used = F.col("tag").isin(*HEADINGS) | F.col("tag").isin("p", "li") & keep
    # the title's row gives every page one, so pages without prose come out too, and a page is parsed once
    per = flagged.groupBy("page_id").agg(F.max(F.when(F.col("tag") == "title", F.col("title"))).alias("title"), F.array_sort(F.collect_list(F.when(used, item))).alias("b"))
    none = F.array().cast("array<struct<heading:string,text:string>>")
    start = F.struct(F.lit("").alias("heading"), F.array().cast("array<string>").alias("open"), none.alias("done"))

    def shut(acc: Column) -> Column:
        section = F.array(F.struct(acc["heading"].alias("heading"), F.array_join(acc["open"], "\n").alias("text")))
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], section)).otherwise(acc["done"])

    def step(acc: Column, b: Column) -> Column:
        heading = F.struct(b["text"].alias("heading"), F.array().cast("array<string>").alias("open"), shut(acc).alias("done"))
        block = F.struct(acc["heading"].alias("heading"), F.concat(acc["open"], F.array(b["text"])).alias("open"), acc["done"].alias("done"))
        return F.when(b["head"], heading).otherwise(block)

    sections = F.aggregate("b", start, step, shut)
    return per.select("page_id", "title", F.coalesce(sections, none).alias("sections"))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        titles, texts = [], []
        for html in batch.column(1).to_pylist():
            _, blocks = parse(html or "", DROPPED - {"aside"})
            titles.append(next((text for tag, text in blocks if tag == "h1"), "No Title"))
            texts.append("\n".join(text for tag, text in blocks if tag != "h1" and len(text) > MIN_BLOCK))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=["page_id", "title", "raw_text"])


def page_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(page_id, title, raw_text)``: the plain profile, which keeps asides and headings and filters by length only."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_flat, f"page_id {rows.schema['page_id'].dataType.simpleString()}, title string, raw_text string")


def url_title(c: Column | str) -> Column:
    """The last segment of a document's url, else a fixed title."""
    last = F.substring_index(F.regexp_replace(col(c), "/+$", ""), "/", -1)
    return F.when(last != "", last).otherwise("PDF Document")


def _is_public(host: str | None) -> bool | None:
    """Whether a literal address is public; None for names, which only a resolver can judge."""
    if host is None:
        return None
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return None
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


@F.arrow_udf(T.BooleanType())
def _public_hosts(hosts: pa.Array) -> pa.Array:
    known: dict[str | None, bool | None] = {}
    values = hosts.to_pylist()
    return pa.array([known.setdefault(h, _is_public(h)) if h not in known else known[h] for h in values], pa.bool_())


def url_check(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with ``scheme, host, valid``: http or https with a host that isn't a non-public literal address.

    Names count as valid here; resolving them is outside the engine. Unreadable and null urls are invalid.
    """
    scheme, host = F.lower(F.try_parse_url(F.col(url_col), F.lit("PROTOCOL"))), F.try_parse_url(F.col(url_col), F.lit("HOST"))
    out = df.withColumn("scheme", scheme).withColumn("host", host)
    public = F.coalesce(_public_hosts("host"), F.lit(True))
    return out.withColumn("valid", F.coalesce(F.col("scheme").isin("http", "https") & F.col("host").isNotNull() & (F.col("host") != "") & public, F.lit(False)))
