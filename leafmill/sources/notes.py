"""Note files: found on the driver, read by the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.links import extract_urls
from leafmill.functions.text import strip

SUFFIXES = (".md", ".txt", ".rst")
# Fixed value: front matter at the start of a note, its closing line ended.
FRONT_MATTER = r"(?Uds)\A---\s*\n.*?\n---\s*\n"


def find_notes(folder: str | Path, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Paths of all notes below ``folder``, hidden ones too, in order of their parts; ``folder`` may be one note."""
    if Path(folder).is_file():
        return [str(folder)] if Path(folder).suffix in suffixes else []
    return [str(p) for p in sorted(p for p in Path(folder).rglob("*") if p.suffix in suffixes and p.is_file())]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for ord_, path in zip(batch["ord"], batch["file_path"]):
            try:
                with open(path, "rb") as f:
                    rows.append((ord_, path, f.read(), None))
            except OSError as e:
                rows.append((ord_, path, None, str(e)))
        yield pd.DataFrame(rows, columns=["ord", "file_path", "content", "error"])


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, file_path, content, error) of files in a folder that all executors see.

    Explicit paths, so that names that start with a dot or underscore are read.
    """
    listed = spark.createDataFrame(pd.DataFrame({"ord": range(len(paths)), "file_path": paths}) if paths else [], "ord long, file_path string")
    return listed.repartition(max(1, min(200, len(paths) // 64))).mapInPandas(_read, "ord long, file_path string, content binary, error string")


def note_text(content: Column) -> Column:
    """Text of a note without front matter, trimmed; null of what is no UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), strip(F.regexp_replace(text, FRONT_MATTER, "")))


def read_notes(spark: SparkSession, folder: str | Path, source_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Notes (ord, file_path, text, source_name) of a folder, and the files that could not be read (file_path, error)."""
    files = read_files(spark, find_notes(folder))
    read = files.withColumn("text", note_text(F.col("content"))).withColumn("source_name", F.lit(source_name))
    bad = read.where(F.col("text").isNull()).select("file_path", F.coalesce("error", F.lit("not valid UTF-8")).alias("error"))
    return read.where(F.col("text").isNotNull()).select("ord", "file_path", "text", "source_name"), bad


def note_urls(notes: DataFrame) -> DataFrame:
    """(file_path, source_name, ord, pos, raw) of every URL in the notes."""
    rows = notes.select("file_path", "source_name", "ord", F.posexplode(extract_urls(F.col("text"))).alias("pos", "raw"))
    return rows
