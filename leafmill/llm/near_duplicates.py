"""Problem 5: results with nearly the same main text.

Each main text becomes a fingerprint of ``BITS`` bits, one of each minimum hash
of its shingles, so two texts differ in a share of bits that falls with their
similarity. The fingerprints are indexed in Gray order: sorted by Gray rank,
neighbours share long runs of bits; an upper node keeps the bits that all of its
fingerprints have in common (a pattern and a mask), and two nodes whose common
bits already differ in more places than a link may are pruned with everything
below. The index is cut into shards by bands of minimum hashes; near-duplicates
share a shard with a probability that ``BANDS`` and ``ROWS`` set (0.987 at a
similarity of 0.5, 0.9996 at 0.6), and every pair that the index lets through is
compared exactly, shingle by shingle.

Equal texts enter the index once. A shard of more than ``BLOCK`` fingerprints is
split into blocks, and pairs of blocks are searched in separate tasks.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.corpus import hash64
from leafmill.llm.main_text import main_lines, page_nodes
from leafmill.session import cut_lineage, discard, written

#: Successive words of a shingle, words of a text at least, and the similarity of a link.
SHINGLE = 3
MIN_WORDS = 80
SIMILARITY = 0.5
#: Bits of a fingerprint; bands and minimum hashes of each that cut the index into shards.
BITS = 128
BANDS = 32
ROWS = 3
#: Differing bits that a link may have: expected (1 - 0.5) / 2 of them, and three deviations more.
RADIUS = 47
#: Children of an index node, and fingerprints that are searched in one task.
FANOUT = 8
BLOCK = 4096
#: Shingles whose minima are found at once.
SLICE = 16_384

#: Texts that are cut into words and hashed at once, and about how many characters of them.
AT_ONCE = 200
CHARS = 500_000

#: Which bytes of a lower-case text are part of a word, once other signs beyond ASCII are blanks.
_IN_WORD = np.array([b > 127 or chr(b).isalnum() or b == ord("_") for b in range(256)])
_NO_WORD = re.compile(r"[^\x00-\x7f\w]+")
_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BITS, dtype=np.uint32)
_MIX = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U32, _U64 = np.uint64(32), np.uint64(64)


def _plain(text: str) -> bytes:
    """``text`` in lower case, with no sign beyond ASCII but those of words."""
    low = text.lower()
    return (low if low.isascii() else _NO_WORD.sub(" ", low)).encode()


class Shingles:
    """Hashed shingles of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray | None:
        """The distinct shingles, or None of a text of too few words."""
        return self.each([text])[0]

    def each(self, texts: list[str]) -> list[np.ndarray | None]:
        """The same of each text; words are cut and hashed over many texts at once."""
        out: list[np.ndarray | None] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(_plain(text))
            size += len(held[-1])
            if size >= CHARS or len(held) >= AT_ONCE:
                out += self._distinct(held)
                held, size = [], 0
        return out + self._distinct(held) if held else out

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of all texts, and the number of words before each text and at the end."""
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        in_word = _IN_WORD[data]
        edges = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
        starts = edges[0::2]
        ends = np.cumsum([1, *(len(t) + 1 for t in texts)])
        offsets = np.concatenate([[0], np.cumsum(edges[1::2] - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[in_word])]).dictionary_encode()
        known = self.known
        if len(known) > 300_000:
            known.clear()
        names = words.dictionary.to_pylist()
        for w in set(names).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, names), np.uint64, len(names))
        return hashes[words.indices.to_numpy()], np.searchsorted(starts, ends)

    def _distinct(self, texts: list[bytes]) -> list[np.ndarray | None]:
        h, bounds = self._words(texts)
        n = max(0, len(h) - SHINGLE + 1)
        s = sum((h[i : i + n] * _MIX[i] for i in range(1, SHINGLE)), h[:n] * _MIX[0])
        s ^= s >> _U32
        s *= np.uint64(0x9E3779B97F4A7C15)
        out: list[np.ndarray | None] = []
        for start, end in itertools.pairwise(bounds.tolist()):
            if end - start < MIN_WORDS:
                out.append(None)
                continue
            own = s[start : end - SHINGLE + 1]
            own.sort()
            first = np.empty(len(own), bool)
            first[0] = True
            np.not_equal(own[1:], own[:-1], out=first[1:])
            out.append(own[first])
        return out


def minima(shingles: list[np.ndarray]) -> np.ndarray:
    """For each text, a row: the least value of each of ``BITS`` hash functions over its shingles.

    32 bits are enough to find the least of a text's shingles, and much faster.
    """
    short = (np.concatenate(shingles) >> _U32).astype(np.uint32)
    sizes = np.fromiter(map(len, shingles), np.int64, len(shingles))
    least = np.empty((BITS, len(shingles)), np.uint32)
    # a few texts at a time, and long ones in slices, so that their values stay in the cache
    starts = np.cumsum(sizes) - sizes
    at = 0
    value = np.empty(0, np.uint32)
    while at < len(shingles):
        to = max(at + 1, int(np.searchsorted(starts + sizes, starts[at] + SLICE, "right")))
        part = short[starts[at] : starts[to - 1] + sizes[to - 1]]
        if len(value) < len(part):
            value = np.empty(len(part), np.uint32)
        v, first = value[: len(part)], starts[at:to] - starts[at]
        for i in range(BITS):
            np.multiply(part, _MULTIPLY[i], out=v)
            np.add(v, _ADD[i], out=v)
            np.minimum.reduceat(v, first, out=least[i, at:to])
        at = to
    return np.ascontiguousarray(least.T)


def fingerprints(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit of each minimum of each text, as two signed 64-bit halves."""
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    halves = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    return halves[:, 0], halves[:, 1]


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band's minima, a row for each text."""
    rows = least[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ rows[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> _U32
    return key.view(np.int64)


_SIGNED = pa.schema([("result_id", pa.int64()), ("text", pa.string()), ("same", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    texts = ((rid, "\n".join(lines)) for rid, lines, _domain in main_lines(batches))
    for held in itertools.batched(texts, 500):
        long_enough = [(rid, text, s) for (rid, text), s in zip(held, shingles.each([text for _, text in held])) if s is not None]
        if long_enough:
            yield _signed(*zip(*long_enough))


def _signed(rid: tuple[int, ...], texts: tuple[str, ...], shingles: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    least = minima(shingles)
    same = [hash64(s.tobytes()) for s in shingles]
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rid) + 1, BANDS, dtype=np.int32)), pa.array(band_keys(least).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(texts, pa.string()), pa.array(same, pa.int64()), *map(pa.array, fingerprints(least)), bands], schema=_SIGNED)


def signed_texts(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, text, same, high, low, bands) of each main text long enough, written once to
    the shared folder: the passes after it read columns of it."""
    schema = "result_id long, text string, same long, high long, low long, bands array<long>"
    return written(page_nodes(conversions, pages).mapInArrow(_sign, schema))


# ---- the index --------------------------------------------------------------


def gray_rank(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each 128-bit code word in the reflected Gray code."""
    ranks = []
    for half in (high, low):
        r = half.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            r ^= r >> np.uint64(shift)
        ranks.append(r)
    odd = (ranks[0] & np.uint64(1)).astype(bool)
    ranks[1][odd] = ~ranks[1][odd]
    return ranks[0], ranks[1]


class GrayIndex:
    """Fingerprints of one or more shards, sorted by shard and Gray rank, with upper nodes of
    ``FANOUT`` neighbours each. A node is a pattern, and a mask of the bits all below it share."""

    def __init__(self, shard: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        rank_high, rank_low = gray_rank(high, low)
        self.order = np.lexsort((rank_low, rank_high, shard))
        shard, high, low = shard[self.order], high[self.order], low[self.order]
        full = np.full(len(high), np.iinfo(np.uint64).max, np.uint64)
        self.levels = [(high, low, full, full, np.arange(len(high) + 1))]
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([first, [len(shard)]]))
        while len(sizes) and sizes.max() > 1:
            parents = -(-sizes // FANOUT)
            ends = np.cumsum(parents)
            within = np.arange(ends[-1]) - np.repeat(ends - parents, parents)
            starts = np.repeat(first, parents) + within * FANOUT
            self._add(starts)
            first, sizes = ends - parents, parents
        self.roots = first

    def _add(self, starts: np.ndarray) -> None:
        high, low, mask_high, mask_low, _ = self.levels[-1]
        out = []
        for pattern, mask in ((high, mask_high), (low, mask_low)):
            ones = np.bitwise_and.reduceat(pattern & mask, starts)
            some = np.bitwise_or.reduceat(pattern | ~mask, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ some)
            out.append((ones & shared, shared))
        (h, mh), (lo, ml) = out
        self.levels.append((h, lo, mh, ml, np.concatenate([starts, [len(high)]])))

    def distance(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits among those that both nodes fix."""
        high, low, mask_high, mask_low, _ = self.levels[level]
        return np.bitwise_count((high[a] ^ high[b]) & mask_high[a] & mask_high[b]).astype(np.int16) + np.bitwise_count((low[a] ^ low[b]) & mask_low[a] & mask_low[b])

    def close_pairs(self, radius: int, step: int = 200_000, across: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Original positions of all pairs of one shard within ``radius``, each once; with ``across`` of all pairs between two shards."""
        stack = [(len(self.levels) - 1, *((self.roots[:1], self.roots[1:2]) if across else (self.roots, self.roots)))]
        while stack:
            level, a, b = stack.pop()
            if len(a) != len(b):  # one of two shards is empty
                break
            near = self.distance(level, a, b) <= radius
            a, b = a[near], b[near]
            if level == 0:
                apart = a != b
                if apart.any():
                    yield self.order[a[apart]], self.order[b[apart]]
                continue
            for at in range(0, len(a), step // (FANOUT * FANOUT)):
                pairs = self._children(level, a[at : at + step // (FANOUT * FANOUT)], b[at : at + step // (FANOUT * FANOUT)])
                if len(pairs[0]):
                    stack.append((level - 1, *pairs))

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = self.levels[level][4]
        grid_a, grid_b = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
        i = bounds[a][:, None] + grid_a
        j = bounds[b][:, None] + grid_b
        real = (i < bounds[a + 1][:, None]) & (j < bounds[b + 1][:, None]) & (i <= j)
        return i[real], j[real]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _columns(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() if isinstance(table, pa.Table) else table.column(c).to_numpy(zero_copy_only=False) for c in names]


def _search(rows: pa.Table, across: bool) -> Iterator[pa.RecordBatch]:
    shard, rid, high, low = _columns(rows, "shard", "result_id", "high", "low")
    if across:
        shard = rows.column("side").to_numpy()
    for i, j in GrayIndex(shard, high.view(np.uint64), low.view(np.uint64)).close_pairs(RADIUS, across=across):
        a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_PAIR)


def _search_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shards of a partition; they come sorted, so a shard is searched when the next begins."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
        if size + last > 100_000 and (last or held):
            held.append(batch.slice(0, last))
            whole, rest = _whole_shards(pa.Table.from_batches(held), shard[-1])
            yield from _search(whole, False)
            held = [*rest.to_batches(), batch.slice(last)]
            size = sum(b.num_rows for b in held)
        else:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield from _search(pa.Table.from_batches(held), False)


def _whole_shards(rows: pa.Table, open_shard: int) -> tuple[pa.Table, pa.Table]:
    shard = rows.column("shard").to_numpy()
    n = int(np.searchsorted(shard, open_shard))
    return rows.slice(0, n), rows.slice(n)


def candidate_pairs(entries: DataFrame) -> DataFrame:
    """(a, b), a < b, of all fingerprints of one shard that differ in at most ``RADIUS`` bits.

    ``entries``: (shard, result_id, high, low). Crowded shards are found by counts
    over cells of shards, which are few; their fingerprints go to pairs of blocks.
    """
    cells = max(1 << 14, 1 << (entries.count() // 1024).bit_length())
    in_cell = entries.withColumn("cell", F.pmod("shard", F.lit(cells)))
    full = in_cell.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell")
    crowded = in_cell.join(full, "cell", "left_semi").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = cut_lineage(crowded)
    if crowded.isEmpty():
        return _in_shards(entries)
    split = entries.join(crowded, "shard")
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    placed = split.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("result_id", "shard"), F.col("blocks")).cast("int"))
    paired = placed.select("shard", "result_id", "high", "low", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "shard", "result_id", "high", "low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side")
    )
    across = paired.groupBy("shard", "i", "j").applyInArrow(_search_blocks, "a long, b long")
    return _in_shards(entries.join(crowded, "shard", "left_anti")).unionByName(across)


def _search_blocks(rows: pa.Table) -> pa.Table:
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    return pa.Table.from_batches(_search(rows, i != j), schema=_PAIR)


def _in_shards(entries: DataFrame) -> DataFrame:
    return entries.select("shard", "result_id", "high", "low").repartition("shard").sortWithinPartitions("shard").mapInArrow(_search_partition, "a long, b long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        a, b = _columns(batch, "a", "b")
        # each text of the batch once
        ids, first = np.unique(np.concatenate([a, b]), return_index=True)
        left, right = first[first < len(a)], first[first >= len(a)] - len(a)
        of_a, of_b = (batch.column(c).take(pa.array(at)).to_pylist() for c, at in (("text_a", left), ("text_b", right)))
        kept = dict(zip([*a[left].tolist(), *b[right].tolist()], shingles.each([*of_a, *of_b])))
        shares = np.empty(len(a))
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            s, t = kept[x], kept[y]
            common = len(np.intersect1d(s, t, assume_unique=True))
            shares[i] = common / (len(s) + len(t) - common)
        linked = shares >= SIMILARITY
        yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked]), pa.array(shares[linked])], ["a", "b", "similarity"])


def distinct_links(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of linked texts, one result for each distinct text, and
    (result_id, text_id): the result that stands for each result's text."""
    first = signed.groupBy("same").agg(F.min("result_id").alias("text_id"))
    members = signed.select("result_id", "same").join(first, "same").select("result_id", "text_id")
    stands = first.select(F.col("text_id").alias("result_id"))
    entries = signed.select("result_id", "high", "low", "bands").join(stands, "result_id", "left_semi").select(F.explode("bands").alias("shard"), "result_id", "high", "low")
    pairs = cut_lineage(candidate_pairs(entries).distinct())
    needed = pairs.select(F.col("a").alias("result_id")).unionByName(pairs.select(F.col("b").alias("result_id"))).distinct()
    texts = signed.select("result_id", "text").join(needed, "result_id", "left_semi")
    both = pairs.join(texts.select(F.col("result_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("result_id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return both.mapInArrow(_verify, "a long, b long, similarity double"), members


def linked_pairs(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id_a, result_id_b), a < b: all pairs of results with nearly the same main text.

    Results of equal text are pairs too, and share all links of their text. Null,
    empty and short texts have none; repeated rows count once.
    """
    links, members = distinct_links(signed_texts(conversions, pages))
    many = members.groupBy("text_id").agg(F.count("*").alias("n")).where("n > 1").select("text_id")
    equal = members.join(many, "text_id", "left_semi")
    left = members.select(F.col("text_id").alias("a"), F.col("result_id").alias("x"))
    right = members.select(F.col("text_id").alias("b"), F.col("result_id").alias("y"))
    near = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("result_id_a"), F.greatest("x", "y").alias("result_id_b")).where("result_id_a < result_id_b")
    same = equal.select("text_id", F.col("result_id").alias("result_id_a")).join(equal.select("text_id", F.col("result_id").alias("result_id_b")), "text_id").where("result_id_a < result_id_b")
    return near.unionByName(same.select("result_id_a", "result_id_b"))


def article_groups(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, group_id, links): the group of each result with a main text long enough, named by
    its least result_id, and the number of links of its text to different texts.

    Groups are connected components, found by alternating large-star and small-star
    steps; each round is one shuffle of the remaining edges, which are checkpointed.
    """
    links, members = distinct_links(signed_texts(conversions, pages))
    links = cut_lineage(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count("*").alias("links"))
    roots = components(links)
    return (
        members.join(roots, "text_id", "left")
        .join(degree, "text_id", "left")
        .select("result_id", F.coalesce("root", "text_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(text_id, root): each node of ``edges`` (a, b) with the least node of its component."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        discard(now)
        now = after
        if same:
            break
    return now.select(F.col("u").alias("text_id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("text_id"), F.col("v").alias("root")).distinct())
