"""Problem 9: filling containers of fixed capacity with documents.

First-fit decreasing by a tournament tree: its leaves are the free space of the
containers, an inner node the greatest of its two, so the first container that
an item fits is found by one descent. Groups of documents, drawn at random by a
hash of doc_id, are packed independently; with thousands of items in a group the
last container of each is all that grouping wastes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tokens import token_counts

#: Tokens of a container.
CAPACITY = 2048
#: Documents of a group, about.
GROUP = 20_000


class Tournament:
    """Free space of up to ``n`` containers."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first container with room for ``size``, and its free space before."""
        best, leaves = self.best, self.leaves
        at = 1
        while at < leaves:
            at *= 2
            if best[at] < size:
                at += 1
        bin_, free = at - leaves, best[at]
        best[at] = free - size
        while at > 1:
            at //= 2
            a, b = best[2 * at], best[2 * at + 1]
            top = a if a > b else b
            if best[at] == top:
                break
            best[at] = top
        return bin_, free


def first_fit_decreasing(items: list[tuple[int, int, int, int]], capacity: int) -> Iterator[tuple[int, int]]:
    """Container and place of each of ``items`` (size first), which must be in falling order of size."""
    tree = Tournament(len(items), capacity)
    for size, *_ in items:
        bin_, free = tree.place(size)
        yield bin_, capacity - free


def _pack(capacity: int):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        items = []
        for doc, n in zip(docs["doc_id"].tolist(), docs["n_tokens"].tolist()):
            for part, start in enumerate(range(0, n, capacity), 1):
                items.append((min(capacity, n - start), doc, part, start))
        items.sort(key=lambda x: (-x[0], x[1], x[2]))
        group = int(key[0])
        rows = [(doc, part, start, size, (group << 32) + bin_, place) for (size, doc, part, start), (bin_, place) in zip(items, first_fit_decreasing(items, capacity))]
        return pd.DataFrame(rows, columns=["doc_id", "part_no", "from_token", "n_tokens", "container_id", "place"])

    return run


def pack(sizes: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_no, from_token, n_tokens, container_id, place) of every document of size 1 or more.

    A document longer than a container is cut into full ones and a rest; any other
    lies whole in one. ``place`` is the first token's position in the container.
    """
    grouped = sizes.where("n_tokens > 0").withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(groups)).cast("int"))
    schema = "doc_id long, part_no int, from_token int, n_tokens int, container_id long, place int"
    # a number that is asked for is kept, though the rows are narrow: packing takes time, not space
    return grouped.repartition(groups, "g").groupBy("g").applyInPandas(_pack(capacity), schema)


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, group: int = GROUP, **tokenizer: str) -> DataFrame:
    """``pack`` of the token counts of ``documents``; documents without tokens need no container."""
    groups = max(1, -(-documents.count() // group))
    return pack(token_counts(documents, **tokenizer), groups, capacity)
