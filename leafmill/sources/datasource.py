"""Notes as a Spark data source: ``spark.dataSource.register(Notes)``, then ``spark.read.format("notes").load(folder)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.sources.notes import find_notes

#: Files that one task reads.
FILES = 64
_FRONT_MATTER = re.compile(r"\A---\s*\n.*?\n---\s*\n", re.S)


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "file_path string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    """Files are listed on the driver; what is no UTF-8 or cannot be read comes with an error and no text."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.files = int(options.get("files", FILES))

    def partitions(self) -> list[_Files]:
        paths = find_notes(self.folder)
        return [_Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, encoding="utf-8", newline="") as f:
                    yield path, _FRONT_MATTER.sub("", f.read()).strip(), None
            except (OSError, UnicodeDecodeError) as e:
                yield path, None, str(e)
