"""Tables as Parquet snapshots behind an atomic pointer."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from leafmill.schema import TABLES

#: Tables with a snapshot for each value of a column, so that a change rewrites its part only.
PARTS = {"vectors": "collection"}
NAME = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9._-]{1,510}[a-zA-Z0-9]")


class Warehouse:
    """A folder of tables. A commit writes whole new snapshots of the tables that
    change and then swaps one pointer file, so a reader sees all changes or none.
    One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark = spark
        self.folder = Path(folder)
        self.pointer = self.folder / "CURRENT.json"

    def versions(self) -> dict[str, str | dict[str, str]]:
        try:
            return json.loads(self.pointer.read_text(encoding="utf-8"))
        except FileNotFoundError:
            return {}

    def table(self, name: str, part: str | None = None) -> DataFrame:
        """The current snapshot, or that of one ``part`` of a table in ``PARTS``; an empty table before the first commit."""
        version = self.versions().get(name)
        if isinstance(version, dict):
            version = [version[part]] if part in version else [] if part is not None else list(version.values())
        if not version:
            return self.spark.createDataFrame([], TABLES[name])
        paths = [str(self.folder / name / v) for v in ([version] if isinstance(version, str) else version)]
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def commit(self, **tables: DataFrame | dict[str, DataFrame]) -> None:
        """New snapshots of some tables, or of some parts of a table in ``PARTS``, given by part; what cannot be written changes nothing."""
        versions = self.versions()
        old = []
        for name, content in tables.items():
            columns = [f.name for f in TABLES[name].fields]
            parts = content if name in PARTS else {None: content}
            for part, df in parts.items():
                version = uuid.uuid4().hex
                df.select(*columns).write.parquet(str(self.folder / name / version))
                where, key = (versions, name) if part is None else (versions.setdefault(name, {}), part)
                old.append((name, where.get(key)))
                where[key] = version
        self.folder.mkdir(parents=True, exist_ok=True)
        new = self.pointer.with_suffix(f".{uuid.uuid4().hex}")
        new.write_text(json.dumps(versions), encoding="utf-8")
        os.replace(new, self.pointer)
        for name, version in old:
            if version:
                shutil.rmtree(self.folder / name / version, ignore_errors=True)

    def remove(self) -> None:
        """Deletes the warehouse's own files and nothing else in its folder."""
        for name in self.versions():
            shutil.rmtree(self.folder / name, ignore_errors=True)
        self.pointer.unlink(missing_ok=True)


def valid_collection(name: str) -> bool:
    """3 to 512 letters, digits, dots, underscores and hyphens, with a letter or digit at both ends."""
    return NAME.fullmatch(name) is not None
