"""Gold queries: what a search should find."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from leafmill.schema import GOLD


def read_gold(spark: SparkSession, path: str | Path) -> DataFrame:
    """(query, expected) of a JSON list of objects with query and source, a name or a list of names."""
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(r["query"], [r["source"]] if isinstance(r["source"], str) else list(r["source"])) for r in rows], GOLD)
