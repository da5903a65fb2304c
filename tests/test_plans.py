"""Plans that must keep their shape."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.functions.markdown import clean_markdown
from leafmill.operators import catalog, verdicts
from leafmill.plans.rules import DEFAULT_RULES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))


def test_only_needed_columns_are_read(spark):
    q = entry.queries()
    assert scans(q["list_newest"](spark, FOLDER)) == ["url:string,fetched_at:string"]
    assert scans(q["fail_summary"](spark, FOLDER)) == ["url:string,domain:string,fail_reason:string"]
    assert scans(q["page_states"](spark, FOLDER)) == ["url:string,fail_reason:string,fetched_at:string,parsed_at:string"]


def test_filters_reach_the_scan(spark):
    q = entry.queries()
    assert "PushedFilters: [IsNotNull(fetched_at)]" in plan(q["list_newest"](spark, FOLDER))
    assert "IsNotNull(fail_reason)" in re.search(r"PushedFilters: \[([^\]]*)\]", plan(q["fail_summary"](spark, FOLDER)))[1]


def test_no_python_where_none_is_needed(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert "Python" not in plan(docs.select(clean_markdown(F.col("text"))))
    assert "Python" not in plan(entry.queries()["note_urls"](spark, FOLDER))


def test_limits_are_top_k_and_joins_are_not_products(spark):
    q = entry.queries()
    assert "TakeOrderedAndProject" in plan(q["list_newest"](spark, FOLDER))
    for name in ("links_after_prune", "exclusive_pages", "fetch_candidates", "index_changes", "crawl"):
        assert not re.search(r"Cartesian|NestedLoop", plan(q[name](spark, FOLDER))), name


def test_verdicts_shuffle_nothing(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert "Exchange" not in plan(verdicts.with_verdict(pages, "original_url", DEFAULT_RULES))
    assert plan(catalog.status_counts(pages)).count("Exchange") == 1
