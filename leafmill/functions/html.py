"""HTML pages: validity, title, and markdown of the main content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import strip

MAX_BYTES = 10 * 1024 * 1024
MIN_BYTES = 512
MIN_WORDS = 50
# Titles and markers of pages that block, and how much of a page is searched for them.
BLOCK_TITLES = (
    r"just a moment|attention required|access denied|403 forbidden|you are being redirected|please wait|"
    r"checking your browser|security check|bot verification|error \d{3}"
)
BLOCK_MARKERS = ("cf-browser-verification", "challenge-platform", "cf_chl_opt", "_cf_chl_tk", "enable JavaScript and cookies to continue")
TITLE_HEAD, MARKER_HEAD = 3000, 5000


def check_html(html: Column) -> Column:
    """Why a page is rejected, or null: too large, too small, or a block page by title or marker."""
    size = F.octet_length(html)
    title = F.regexp_extract(F.left(html, F.lit(TITLE_HEAD)), rf"(?i)<title[^>]*>\s*((?:{BLOCK_TITLES})(?:\s*\.{{1,3}})?)\s*</title>", 1)
    reason = F.when(size > MAX_BYTES, F.format_string("html too large (%dMB)", F.floor(size / (1024 * 1024)))).when(
        size < MIN_BYTES, F.format_string("html suspiciously small (%d bytes)", size)
    )
    reason = reason.when(title != "", F.concat(F.lit("block page (title: '"), title, F.lit("')")))
    for marker in BLOCK_MARKERS:
        reason = reason.when(F.left(html, F.lit(MARKER_HEAD)).contains(marker), f"block page (marker: '{marker}')")
    return reason


def title(html: Column) -> Column:
    """The first title's text, trimmed, entities as they are; null if blank or missing."""
    return F.nullif(strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def fix_html(html: Column) -> Column:
    """Without the data script whose strings may hold an end tag."""
    return F.regexp_replace(html, r"(?is)<script\s+id=[\"']__NEXT_DATA__[\"'][^>]*>.*?</script>(?=\s*<(?:script|/body|/html))", "")


def too_short(words: Column, least: int, size: Column, kind: str) -> Column:
    """Why a text of fewer than ``least`` words is rejected, or null; ``size`` is that of its source in bytes."""
    shown = F.when(size < 1024, F.format_string("%d B", size)).otherwise(F.format_string("%d KB", F.floor(size / 1024)))
    return F.when(words < least, F.concat(F.lit("too short ("), words.cast("string"), F.lit(f" words < {least}, from "), shown, F.lit(f" {kind})")))


def fetch_error(message: Column) -> Column:
    """A fetch error in short."""
    line = F.substring_index(message, "\n", 1)
    return (
        F.when(line.contains("net::ERR_NAME_NOT_RESOLVED"), "DNS resolution failed")
        .when(line.contains("net::ERR_CONNECTION_REFUSED"), "connection refused")
        .when(line.contains("Timeout"), "timeout")
        .otherwise(line)
    )


#: Elements that are left out with all that is in them; a parameter of the conversion.
DROPPED = frozenset({"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "svg", "iframe", "select", "head"})
_BLOCKS = {"p", "div", "section", "article", "main", "blockquote", "figure", "figcaption", "dd", "dt", "dl", "ul", "ol", "table", "body"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed", "track"}


class _Markdown(HTMLParser):
    """Markdown of a page's content: headings, paragraphs, lists, tables and, if wanted, code."""

    def __init__(self, code: bool, dropped: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.keep_code, self.dropped = code, dropped
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.prefix = ""
        self.skip: list[str] = []
        self.row: list[str] | None = None
        self.rows = 0
        self.verbatim = 0
        self.lists: list[list] = []

    def close_block(self) -> None:
        raw = "".join(self.text)
        self.text = []
        body = raw.strip("\n") if self.verbatim else " ".join(raw.split())
        if body and self.row is not None:
            self.row.append(body)
        elif body:
            self.blocks.append(f"```\n{body}\n```" if self.verbatim else self.prefix + body)
        self.prefix = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            if tag not in _VOID and tag == self.skip[-1]:
                self.skip.append(tag)
            return
        edit = tag == "span" and "mw-editsection" in (dict(attrs).get("class") or "")
        if tag in self.dropped or edit or (tag in ("pre", "code") and not self.keep_code):
            self.skip.append(tag)
        elif re.fullmatch(r"h[1-6]", tag):
            self.close_block()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.close_block()
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self.prefix = f"{self.lists[-1][1]}. "
            else:
                self.prefix = "- "
        elif tag == "tr":
            self.close_block()
            self.row = []
        elif tag in ("td", "th"):
            self.text = []
        elif tag == "pre":
            self.close_block()
            self.verbatim += 1
        elif tag == "br":
            self.text.append("\n" if self.verbatim else " ")
        elif tag in _BLOCKS:
            prefix = self.prefix
            self.close_block()
            if tag == "p" and prefix and not self.blocks[-1:] == [prefix]:
                self.prefix = prefix
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            if tag == "table":
                self.rows = 0

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("td", "th"):
            cell = " ".join("".join(self.text).split())
            self.text = []
            if self.row is not None:
                self.row.append(cell)
        elif tag == "tr" and self.row is not None:
            row, self.row = self.row, None
            if row:
                self.blocks.append("| " + " | ".join(row) + " |")
                self.rows += 1
                if self.rows == 1:
                    self.blocks.append("| " + " | ".join("---" for _ in row) + " |")
        elif tag == "pre" and self.verbatim:
            self.close_block()
            self.verbatim -= 1
        elif tag in _BLOCKS or tag == "li" or re.fullmatch(r"h[1-6]", tag):
            self.close_block()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def markdown_of(html: str, code: bool = False, dropped: frozenset[str] = DROPPED) -> str | None:
    """Markdown of the content of a page, or None if there is none. Links lose their targets;
    a block that occurs again in the page is dropped; the elements in ``dropped`` are left out."""
    parser = _Markdown(code, dropped)
    parser.feed(html)
    parser.close_block()
    seen: set[str] = set()
    out = []
    for block in parser.blocks:
        if block.startswith("|") or block not in seen:
            out.append(block)
        seen.add(block)
    text = ""
    for a, b in zip(["", *out], out):
        tight = (a.startswith("|") and b.startswith("|")) or (re.match(r"(?:-|\d+\.) ", a) and re.match(r"(?:-|\d+\.) ", b))
        text += ("\n" if tight else "\n\n") * bool(text) + b
    return text or None


def html_to_markdown(html: Column, dropped: frozenset[str] = DROPPED) -> Column:
    """A struct of the markdown without code blocks and, where that is short, with them; null pages and pages
    without content give null."""

    @F.pandas_udf(T.StructType([T.StructField("stripped", T.StringType()), T.StructField("whole", T.StringType())]))
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h in batch:
                stripped = markdown_of(h, dropped=dropped) if h else None
                short = h and len(re.findall(r"\w+", stripped or "")) < MIN_WORDS
                rows.append((stripped, markdown_of(h, True, dropped) if short else None))
            yield pd.DataFrame(rows, columns=["stripped", "whole"])

    return convert(html)
