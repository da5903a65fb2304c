"""Schemas of the archive's tables. Times are ISO 8601 strings: their order is the order of the text."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


PAGES = _struct(
    url=_S, original_url=_S, domain=_S, slug=_S, content_type=_S, title=_S, author=_S, word_count=_L, fail_reason=_S, added_at=_S, fetched_at=_S, parsed_at=_S
)
SOURCES = _struct(name=_S, path=_S, added_at=_S)
LINKS = _struct(url=_S, file_path=_S, source_name=_S, indexed_at=_S)
RAW_PAGES = _struct(slug=_S, content_type=_S, html=_S, pdf=T.BinaryType())
PARSED_PAGES = _struct(slug=_S, markdown=_S)
CHUNK = _struct(text=_S, source=_S, heading=_S, line=_I, index=_I)
VECTORS = _struct(collection=_S, id=_S, embedding=T.ArrayType(T.FloatType()), document=_S, source=_S, heading=_S, line=_I, index=_I)
ROOTS = _struct(collection=_S, root=_S)
GOLD = _struct(query=_S, expected=T.ArrayType(_S))

TABLES = {"pages": PAGES, "sources": SOURCES, "links": LINKS, "raw_pages": RAW_PAGES, "parsed_pages": PARSED_PAGES, "vectors": VECTORS, "roots": ROOTS}
