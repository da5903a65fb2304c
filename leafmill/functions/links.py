"""Links of notes, as column expressions, and of pages, from their anchors."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A markdown link with balanced parentheses in its URL; a bare URL outside of one;
# and the place between two URLs that run together, unless the second is a query's value.
MARKDOWN_LINK = r"\[(?:[^\[\]]|\[[^\]]*\])*\]\((https?://(?:\([^\s\)]*\)|[^\s\)])+)\)"
BARE_URL = r"(?<!\]\()https?://[^\s<>\[\]\"]+"
RUN_TOGETHER = r"(?<=[^\s?=&])(?=https?://)"


def extract_urls(text: Column) -> Column:
    """All URLs of a note: those of its markdown links, then the bare ones, in order, repeats kept.

    A bare URL loses punctuation at its end, and closing parentheses there that
    have no opening one. URLs that run together are split. A null text has none.
    """
    unicode = "(?U)"
    linked = F.regexp_extract_all(text, F.lit(unicode + MARKDOWN_LINK), F.lit(1))
    bare = F.transform(F.regexp_extract_all(text, F.lit(unicode + BARE_URL), F.lit(0)), _trimmed)
    parts = F.flatten(F.transform(F.concat(linked, bare), lambda u: F.split(u, RUN_TOGETHER)))
    return F.coalesce(F.filter(parts, lambda u: u != ""), F.array().cast("array<string>"))


def _trimmed(url: Column) -> Column:
    plain = F.regexp_replace(url, r"[.,;:!?']+\z", "")
    run = F.length(F.regexp_extract(plain, r"(\)*)\z", 1))
    surplus = F.regexp_count(plain, F.lit(r"\)")) - F.regexp_count(plain, F.lit(r"\("))
    return F.left(plain, F.length(plain) - F.greatest(F.lit(0), F.least(run, surplus)))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.base = ""
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        href = dict(attrs).get("href")
        if tag == "base" and href and not self.base:
            self.base = href
        elif tag in ("a", "area") and href:
            self.found.append(href.strip())


def anchors(html: str, url: str) -> list[str]:
    """The web links of a page, absolute, in order, each once; broken markup gives what can be read."""
    parser = _Anchors()
    parser.feed(html)
    base = urljoin(url, parser.base)
    out: dict[str, None] = {}
    for href in parser.found:
        try:
            link = urljoin(base, href)
            if urlsplit(link).scheme in ("http", "https"):
                out[link] = None
        except ValueError:
            continue
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The links of HTML pages (html, url); a null page has none."""
    for html, url in batches:
        yield pd.Series([anchors(h, u or "") if h else [] for h, u in zip(html, url)])
