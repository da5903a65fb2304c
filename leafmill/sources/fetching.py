"""Fetching pages on the workers by a function that the caller gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.settings import Settings

#: (content_type, html, pdf text) of a url within so many milliseconds; it raises what went wrong.
Fetch = Callable[[str, int], tuple[str, str | None, str | None]]

# What marks an error as one that may pass.
TRANSIENT = ("timeout", "net::ERR_CONNECTION_RESET", "net::ERR_CONNECTION_TIMED_OUT")
#: Seconds between attempts grow by so many.
BACK_OFF = 2.0
SCHEMA = "url string, content_type string, html string, pdf string, error string, attempts int"


def transient(reason: Column) -> Column:
    """Whether a failure is worth another attempt; null is not."""
    return F.coalesce(F.greatest(*(reason.contains(marker) for marker in TRANSIENT)), F.lit(False))


def one_page(fetch: Fetch, url: str, settings: Settings, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """A row of ``SCHEMA``: the page, or why the last attempt failed. PDF addresses are not tried again."""
    attempts = 1 if url.lower().endswith(".pdf") else 1 + settings.retries
    for n in range(1, attempts + 1):
        try:
            return url, *fetch(url, settings.timeout_ms), None, n
        except Exception as problem:  # noqa: BLE001 - a page that fails must not fail the others
            reason = str(problem) or type(problem).__name__
        if n == attempts or not any(marker in reason for marker in TRANSIENT):
            return url, None, None, None, reason, n
        sleep(BACK_OFF * n)
    raise AssertionError("unreachable")


def fetched(urls: DataFrame, fetch: Fetch, settings: Settings | None = None, column: str = "url") -> DataFrame:
    """``SCHEMA`` of each distinct address in ``column``; null is left out.

    Addresses are dealt out by a hash, so that no task has a host to itself and none
    has all of a large one; in a task ``concurrency`` pages are fetched at once.
    """
    chosen = settings or Settings.of()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
        with ThreadPoolExecutor(chosen.concurrency) as pool:
            for batch in batches:
                for at in range(0, len(batch), 64):  # few pages are held at once
                    rows = pool.map(lambda url: one_page(fetch, url, chosen), batch["url"].iloc[at : at + 64])
                    yield pd.DataFrame(list(rows), columns=names)

    return urls.select(F.col(column).alias("url")).where("url is not null").distinct().mapInPandas(run, SCHEMA)
