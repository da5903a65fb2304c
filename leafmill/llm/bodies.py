"""Whether the pages that hold a line are copies of one text.

For announcements (problem 7) it is counted: the running text of a page is cut
into phrases where its words say so, and of each phrase the pages that have it
are counted, which gives the share of text in common, averaged over all pairs.

For messages (problem 3) it is counted, too, with shorter phrases. The sentences of
a copied article are all on the same pages, so phrases are counted once for each
set of pages, and those of the sentence itself are taken off afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import written

#: A phrase ends after a word whose hash is divisible by this, and where its line ends.
PHRASE = 16
#: The same for phrases of single sentences, which may differ in a word or two.
SHORT_PHRASE = 4
_POWERS = np.cumprod(np.full(1024, 0x9FB21C651E98DF25, np.uint64))


def phrases(keys: pa.Array, ends: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All phrases of ``keys``, one after another: the number of the key, a hash of the phrase and its words.

    Words alone decide where a phrase ends, so what two texts have in common is cut alike in both.
    """
    split = pc.split_pattern(keys, " ")
    coded = split.flatten().dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = coded.indices.to_numpy()
    sizes = np.diff(split.offsets.to_numpy())
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = (known % np.uint64(ends) == 0)[word]
    first = np.append(True, first[:-1])
    first[np.cumsum(sizes)[:-1]] = True
    starts = np.flatnonzero(first)
    words = np.diff(np.append(starts, len(word)))
    place = np.arange(len(word)) - np.repeat(starts, words)
    h = np.add.reduceat(known[word] * _POWERS[place % len(_POWERS)], starts)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.repeat(np.arange(len(keys)), sizes)[starts], (h ^ (h >> np.uint64(32))).view(np.int64), words


def page_phrases(keys: pa.Array, page: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page, hash and weight of each phrase of the pages, whose ``keys`` are given by pairs of ``page`` and ``code``.

    All running text counts: lines at least half as long as those that hold most of the page's characters, and no
    shorter ones, as of menus. A phrase weighs as its words by the length of its line.
    """
    length = pc.utf8_length(keys).to_numpy().astype(np.int64)
    order = np.lexsort((code, -length[code], page))
    page, code = page[order], code[order]
    starts = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    sizes = np.diff(np.append(starts, len(page)))
    before = np.cumsum(length[code]) - length[code]
    before -= np.repeat(before[starts], sizes)
    total = np.add.reduceat(length[code], starts)
    usual = np.minimum.reduceat(np.where(2 * before < np.repeat(total, sizes), length[code], np.iinfo(np.int64).max), starts)
    chosen = 2 * length[code] >= np.repeat(usual, sizes)
    page, code = page[chosen], code[chosen]
    of_key, hashes, words = phrases(keys)
    n = np.bincount(of_key, minlength=len(keys))
    begin = np.cumsum(n) - n
    n = n[code]
    at = np.arange(n.sum()) + np.repeat(begin[code] - np.cumsum(n) + n, n)
    return np.repeat(page, n), hashes[at], words[at] * np.repeat(length[code], n)


def _in_common(texts: DataFrame) -> DataFrame:
    """(group, common) of ``texts`` (group, left, phrase, size), a row for each phrase of each page of a group, of which ``left`` is the page's
    text: the sum over all pairs of pages of the share of one page's text that the other has."""
    of = texts.groupBy("group", "phrase").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.sum(1 / F.col("left")).alias("parts")).where("n > 1")
    return of.groupBy("group").agg(F.sum(F.col("size") * F.col("parts") * (F.col("n") - 1)).alias("common"))


def _alike(share: F.Column) -> F.Column:
    """Text of two pages that is in both, as a share of all their text, from the share of one page's text that the other has."""
    return F.round(share / (2 - share), 9)


def _exploded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, "sizes", F.posexplode("phrases").alias("at", "phrase")).select(*columns, "phrase", F.get("sizes", "at").alias("size"))


def sentence_resemblance(held: DataFrame, bodies: DataFrame) -> DataFrame:
    """(key, pages, alike) of ``held`` (key, page, whole, own), a row for each page of a sentence, for those on two pages or more: the share of
    the pages' text that two of them have in common, over all pairs, beside the phrases of the sentence, which are ``own`` of the page's ``whole`` words.

    ``bodies`` (page, phrases, sizes) has the phrases of each page, each once. All is counted, nothing estimated. Each page's text weighs
    the same, so no long page decides alone.
    """
    of_key = held.groupBy("key").agg(
        F.count("*").alias("pages"), F.bit_xor("page").alias("set"), F.bit_xor(F.xxhash64("page")).alias("check"), F.max("own").alias("own"), F.sum(1 / F.col("whole")).alias("parts")
    )
    # the least of the sentences with the same pages stands for all of them
    first = F.min("key").over(Window.partitionBy("pages", "set", "check"))
    sets = written(of_key.where("pages > 1").withColumn("group", first).drop("set", "check"))
    of_group = held.select(F.col("key").alias("group"), "page", F.col("whole").alias("left")).join(sets.where("key = group").select("group"), "group", "left_semi")
    common = _in_common(_exploded(of_group.join(bodies, "page"), "group", "left"))
    beside = F.col("pages") - F.col("own") * F.col("parts")
    share = (F.coalesce("common", F.lit(0.0)) - F.col("own") * F.col("parts") * (F.col("pages") - 1)) / ((F.col("pages") - 1) * beside)
    return sets.join(common, "group", "left").select("key", "pages", _alike(share).alias("alike"))


def template_resemblance(held: DataFrame, bodies: DataFrame) -> DataFrame:
    """(template, alike) of ``held`` (template, page, whole, phrases, sizes), a row for each sentence of a template on a page, as ``sentence_resemblance``."""
    own = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("phrases", "sizes"))))
    pages = held.groupBy("template", "page").agg(own.alias("own"), F.max("whole").alias("whole"))
    left = F.col("whole") - F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["sizes"])
    pages = pages.select(F.col("template").alias("group"), "page", left.alias("left"), F.col("own.phrases").alias("own")).where("left > 0")
    several = pages.groupBy("group").agg(F.count("*").alias("pages")).where("pages > 1")
    texts = _exploded(pages.join(several, "group", "left_semi").join(bodies, "page"), "group", "left", "own").where(~F.array_contains("own", F.col("phrase")))
    share = F.coalesce("common", F.lit(0.0)) / (F.col("pages") * (F.col("pages") - 1))
    return several.join(_in_common(texts), "group", "left").select(F.col("group").alias("template"), _alike(share).alias("alike"))


def host_resemblance(pages: DataFrame, sizes: DataFrame, texts: DataFrame, weight: int) -> DataFrame:
    """(key, alike) of ``pages`` (key, domain, pages, result_id), a row for each of a host's ``pages``: the share of a page's text in phrases that
    another page of the key has, on average over all pairs of its pages. The pages of a host weigh as much as ``weight`` pages at most, so that no
    host of many pages decides alone. ``texts`` (result_id, phrase, size) has each phrase of a page once, ``sizes`` (result_id, size) their sum. All is counted, nothing estimated."""
    own = F.least("pages", F.lit(weight))
    whole = pages.join(sizes, "result_id").groupBy("key").agg(F.sum(F.col("size") * own / F.col("pages")).alias("size"), F.sum(own / F.col("pages")).alias("pages"))
    # a phrase of one page is on no other page of any key
    again = texts.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase")
    met = pages.select("key", F.xxhash64("domain").alias("host"), "pages", "result_id").join(texts.join(again, "phrase", "left_semi"), "result_id")
    same = met.groupBy("key", "phrase", "host", "pages").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    share, text = F.col("n") * own / F.col("pages"), F.col("size") * own / F.col("pages")
    inside = F.col("size") * (F.col("n") - 1) * own * (own - 1) / F.greatest(F.lit(1), F.col("pages") * (F.col("pages") - 1))
    of_phrase = same.groupBy("key", "phrase").agg(F.sum(share).alias("all"), F.sum(text).alias("text"), F.sum(text * share).alias("self"), F.sum(inside).alias("inside"))
    common = of_phrase.groupBy("key").agg(F.sum(F.col("all") * F.col("text") - F.col("self") + F.col("inside")).alias("common"))
    pairs = F.greatest(F.lit(1e-9), (F.col("pages") - 1) * F.col("size"))
    return whole.join(common, "key", "left").select("key", F.round(F.coalesce("common", F.lit(0.0)) / pairs, 9).alias("alike"))
