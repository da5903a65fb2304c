"""Fetching on workers, settings of the environment, and tables that are thrown away."""

import os
import warnings

import pytest
from pyspark.sql import functions as F

from leafmill import session
from leafmill.settings import Settings
from leafmill.sources.fetching import fetched, one_page, transient


def test_settings():
    assert Settings.of({}) == Settings(8, 2, 30_000)
    assert Settings.of({"LEAFMILL_RETRIES": "0", "LEAFMILL_CONCURRENCY": "3"}) == Settings(3, 0, 30_000)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert Settings.of({"LEAFMILL_TIMEOUT_MS": "soon", "LEAFMILL_CONCURRENCY": "0"}) == Settings()
    assert len(told) == 2


def failing(times, reason):
    calls = []

    def fetch(url, timeout):
        calls.append(timeout)
        if len(calls) <= times:
            raise RuntimeError(reason)
        return "html", "<p>x</p>", None

    return fetch


@pytest.mark.parametrize(
    ("url", "times", "reason", "attempts", "waits"),
    [
        ("https://a.example/1", 0, "", 1, []),
        ("https://a.example/1", 2, "a timeout", 3, [2.0, 4.0]),
        ("https://a.example/1", 9, "net::ERR_CONNECTION_RESET", 3, [2.0, 4.0]),
        ("https://a.example/1", 1, "net::ERR_NAME_NOT_RESOLVED", 1, []),
        ("https://a.example/1.pdf", 1, "a timeout", 1, []),
    ],
)
def test_attempts(url, times, reason, attempts, waits):
    slept = []
    row = one_page(failing(times, reason), url, Settings(timeout_ms=5), slept.append)
    assert row[0] == url and row[5] == attempts and slept == waits
    assert (row[4] is None) == (times < attempts) and (row[2] is None) == (times >= attempts)


def test_fetched(spark):
    def fetch(url, _timeout):
        if "bad" in url:
            raise ValueError("odd")
        return "html", f"<p>{url}</p>", None

    urls = spark.createDataFrame([("https://x.example/1",), ("https://x.example/bad",), (None,), ("https://x.example/1",)], "url string")
    got = {r["url"]: (r["html"], r["error"], r["attempts"]) for r in fetched(urls, fetch, Settings()).collect()}
    assert got == {"https://x.example/1": ("<p>https://x.example/1</p>", None, 1), "https://x.example/bad": (None, "odd", 1)}
    assert fetched(urls.limit(0), fetch, Settings()).count() == 0
    told = spark.createDataFrame([("a timeout",), ("Timeout",), (None,)], "m string").select(transient(F.col("m"))).collect()
    assert [r[0] for r in told] == [True, False, False]


def test_discarded_tables_are_gone(spark):
    table = session.written(spark.range(5))
    path = table._leafmill_path.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    session.discard(table, spark.range(3))
    assert not os.path.exists(path)


def test_temporaries_are_gone_at_the_end(spark):
    with session.temporaries() as keep:
        first = session.written(spark.range(3))
        with session.temporaries() as keep_inner:
            inner = keep_inner(session.written(first))
            other = session.written(inner)
        assert inner.count() == 3 and not os.path.exists(other._leafmill_path.removeprefix("file:"))
        last = keep(session.written(inner.where("id > 0")))
    assert last.count() == 2 and not any(os.path.exists(t._leafmill_path.removeprefix("file:")) for t in (first, inner))
