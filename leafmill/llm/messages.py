"""Problem 3: residue in place of an article.

The sentences of all main texts (problem 7) are masked (tokens with digits are
slots) and parsed into a prefix tree of fixed depth: the number of tokens, then
the first tokens. A sentence takes part in the mining if it stands on two hosts
or says what messages usually say, and if it and sentences like it make half of
the body wherever it stands, in half of its pages at least. In each leaf, those
that agree in most tokens are one template, its other tokens slots.

A template is classified once, by what its pages have in common: on how many
hosts they are, what share of the body such sentences are, how long the body is,
how much two bodies resemble each other beside the template's own sentences (the
copies of one article do almost wholly, different articles not at all, pages that
draw on one stock of messages in part), and whether its sentences say something
that messages say. How much each of these tells is learned by
expectation-maximization over the counts of all patterns of these features.

The verdict goes back to all sentences of the template, to those that fit it but
stand on one page only, and to sentences that stand beside messages wherever they
occur. A result is residue if half of its words are in messages. Filler and
unresolved slots are looked for in every main text apart from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bodies import SHORT_PHRASE, phrases, sentence_resemblance, template_resemblance
from leafmill.llm.corpus import hash64, rows_to_batches, slices
from leafmill.session import small_side, temporaries, written

#: Tokens that lead to a leaf after their number, and share of tokens in which a template's sentences agree.
DEPTH = 2
AGREEMENT = 0.7
#: Sentences of a leaf that are compared with one another; the path to a leaf with more grows by further tokens.
LEAF = 2000
#: Tokens of a sentence for each slot, so that there is something to tell it by.
TOKENS_A_SLOT = 5
#: Share of the body in sentences that may be messages, and share of a sentence's pages that have so much.
BODY = 0.5
#: A sentence is a message if so much of its pages, two or more, have known ones, which hold so much of their words.
BESIDE = 0.8
BESIDE_WORDS = 0.25
#: Share of the words that makes a text residue.
RESIDUE = 0.5
#: Unresolved slots of a text that was never filled in: so many, and so many for each word; an article that quotes some has fewer.
MIN_SLOTS = 3
SLOT_RATE = 0.03

#: Some of what error, access and script notices and template texts say in English, German and Spanish: one feature among five.
PHRASES = tuple(
    "not found|no longer available|could not be found|could not be located|access denied|forbidden|do not have permission|bad gateway|server error|"
    "service unavailable|temporarily unavailable|too many requests|session expired|account suspended|under maintenance|try again|request was blocked|"
    "something went wrong|javascript|noscript|turn on scripts|needs scripts|script support|captcha|you are human|security check|checking your browser|"
    "just a moment|please wait|lorem ipsum|your text|text goes here|caption goes here|title goes here|title here|placeholder|click to edit|example page|"
    "sample heading|your own words|replace this|"
    "nicht gefunden|zugriff verweigert|nicht verfügbar|nicht erreichbar|keine berechtigung|interner serverfehler|wartungsarbeiten|bitte warten|beispieltext|platzhalter|"
    "existiert nicht|versuchen sie es|no encontrada|no encontrado|acceso denegado|no tiene permiso|no está disponible|error interno|en mantenimiento|inténtelo de nuevo|texto de ejemplo".split("|")
)

SLOT = "<*>"
_QUOTED = re.compile(r"[\"“„«][^\"”“»]{3,}")
_SENTENCE = re.compile(r"[.!?…][\"”’»)]*\s+")
_TOKENS = re.compile(r"\w+|[.!?…](?=[\"”’»)]*(?:\s|$))")
_STOP = re.compile(r"[.!?](?=[\")]*(?:\s|$))")
_MARK = "\x01"
_PLAIN = {i: "." if chr(i) == _MARK else " " for i in range(128) if not (chr(i).isalnum() or chr(i) in "_\n")}
_DIGIT = re.compile(r"\d")


# ---- the sentences of one main text ---------------------------------------------


def tokenised(lines: list[str]) -> list[list[str]]:
    """The words of each line in lower case, with a full stop for each end of a sentence."""
    text = "\n".join(lines)
    if text.isascii() and _MARK not in text:  # the same tokens by replacing what is no word
        return [line.split() for line in _STOP.sub(f" {_MARK} ", text.lower()).translate(_PLAIN).split("\n")]
    out = []
    for line in lines:
        tokens = _TOKENS.findall(line.lower()) if line else []
        if "!" in line or "?" in line or "…" in line:
            tokens = ["." if t in "!?…" else t for t in tokens]
        out.append(tokens)
    return out


def masked(sentence: str) -> str:
    """``sentence``, of which a token with a digit is a slot."""
    return " ".join([SLOT if _DIGIT.search(t) else t for t in sentence.split(" ")]) if _DIGIT.search(sentence) else sentence


def body_sentences(lines: list[str], tokens: list[list[str]]) -> dict[str, int]:
    """The masked sentences of a main text, each with its words; lines of a wrapped paragraph are joined.

    What is quoted is no message, and no sentence with a quotation is here.
    """
    out: dict[str, int] = {}
    paragraphs: list[tuple[list[str], list[str]]] = []  # lines and tokens
    last = 0  # length of the line before; none after a blank one
    for line, own in zip(lines, tokens):
        if not line:
            last = 0
            continue
        s = line.strip(" \t\r>*_#-•–—")
        if last > 50 and s[:1].islower():
            paragraphs[-1][0].append(s)
            paragraphs[-1] = paragraphs[-1][0], paragraphs[-1][1] + own
        elif own:
            paragraphs.append(([s], own))
        last = len(s)
    quoted = any(map("\n".join(lines).__contains__, '"“„«'))
    for text, own in paragraphs:
        whole = " ".join(own)
        parts = (" " + whole).split(" .")
        if quoted and any('"' in s or "“" in s or "„" in s or "«" in s for s in text):
            whole = " ".join(text).lower()
            parts = [" ".join(t for t in _TOKENS.findall(part) if len(t) > 1 or t not in ".!?…") for part in _SENTENCE.split(whole) if not _QUOTED.search(part)]
        slots = _DIGIT.search(whole) is not None
        for part in parts:
            if part := part.strip():
                key = masked(part) if slots else part
                out[key] = out.get(key, 0) + part.count(" ") + 1
    return out


def _beginning(sentence: str, tokens: int) -> str:
    end = -1
    for _ in range(min(DEPTH, tokens)):
        end = sentence.find(" ", end + 1)
    return sentence[:end] if end > 0 else sentence


def leaf_of(sentence: str, tokens: int) -> int:
    """The leaf of the prefix tree: the number of tokens and the first ``DEPTH`` of them."""
    return hash64(_beginning(sentence, tokens), tokens)


_made: list[ahocorasick.Automaton] = []


def _phrases() -> ahocorasick.Automaton:
    if not _made:
        found = ahocorasick.Automaton()
        for p in PHRASES:
            found.add_word(f" {p} ", 1)
        found.add_word(" \x00 ", 0)  # an automaton needs a word
        found.make_automaton()
        _made.append(found)
    return _made[0]


def saying(sentences: list[str]) -> list[bool]:
    """Whether each of ``sentences`` has one of ``PHRASES``; most texts have none at all, which one scan finds."""
    found = _phrases()
    if next(found.iter(" " + " | ".join(sentences) + " "), None) is None:
        return [False] * len(sentences)
    return [next(found.iter(f" {s} "), None) is not None for s in sentences]


#: The sentences of a main text in its row of facts: hash, words, leaf, text, and bits: says something, has enough to tell it by.
FIELDS = [("keys", pa.list_(pa.int64())), ("sentence_words", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int64())), ("flags", pa.list_(pa.int32())), ("sentences", pa.list_(pa.string()))]
FIELDS_SQL = "keys array<long>, sentence_words array<int>, leaves array<long>, flags array<int>, sentences array<string>"


def sentence_facts(found: dict[str, int]) -> tuple[list, ...]:
    """The values of ``FIELDS`` of a main text with these sentences."""
    texts = list(found)
    tokens = [text.count(" ") + 1 for text in texts]
    flags = [says | (SLOT not in text or text.count(SLOT) * TOKENS_A_SLOT <= n) << 1 for text, says, n in zip(texts, saying(texts), tokens)]
    keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
    leaves = np.fromiter(map(xxhash.xxh64_intdigest, map(_beginning, texts, tokens), tokens), np.uint64, len(texts))
    return keys.view(np.int64).tolist(), list(found.values()), leaves.view(np.int64).tolist(), flags, texts


# ---- templates -------------------------------------------------------------------


def merge_leaf(sentences: list[str]) -> list[str]:
    """The template of each of a leaf's sentences, which all have one number of tokens."""
    if len(sentences) == 1:
        return list(sentences)
    rows = [s.split(" ") for s in sentences]
    number = {SLOT: 0}
    ids = np.array([[number.setdefault(t, len(number)) for t in row] for row in rows])
    least = AGREEMENT * ids.shape[1]
    templates = np.empty_like(ids)
    n = 0
    place = []
    for row in ids:
        fits = np.flatnonzero((templates[:n] == row).sum(axis=1) >= least)
        if len(fits):
            at = int(fits[0])
            templates[at][templates[at] != row] = 0
        else:
            at, n = n, n + 1
            templates[at] = row
        place.append(at)
    words = list(number)
    return [" ".join(words[i] for i in templates[at]) for at in place]


_TEMPLATE = pa.schema([("key", pa.int64()), ("template", pa.string()), ("leaf", pa.int64())])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of the leaves of a partition, whose rows come sorted by path."""

    def rows() -> Iterator[tuple]:
        path, held = None, []
        for batch in batches:
            for own, key, text in zip(*(batch.column(c).to_pylist() for c in ("path", "key", "sentence"))):
                if own != path and held:
                    yield from merged(held)
                    held = []
                path = own
                held.append((key, text))
        if held:
            yield from merged(held)

    def merged(held: list[tuple[int, str]]) -> Iterator[tuple]:
        leaf = leaf_of(held[0][1], held[0][1].count(" ") + 1)
        for (key, _), template in zip(held, merge_leaf([t for _, t in held])):
            yield key, template, leaf

    return rows_to_batches(rows(), _TEMPLATE)


def mined(sentences: DataFrame) -> DataFrame:
    """(key, template, leaf) of ``sentences`` (key, sentence): the leaves of the tree and their templates.

    The path to a leaf with more than ``LEAF`` sentences grows by a token, until it is
    no larger; as sentences differ, it is when the path has all tokens, if not before.
    """
    tokens = F.split("sentence", " ")
    path = F.concat_ws(" ", F.size(tokens), F.slice(tokens, 1, F.col("depth")))
    now = sentences.withColumn("depth", F.lit(DEPTH)).withColumn("path", path)
    while True:
        crowded = written(now.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).select("path", F.lit(1).alias("more")))
        if crowded.isEmpty():
            break
        now = now.join(crowded, "path", "left").withColumn("depth", F.col("depth") + F.coalesce("more", F.lit(0))).drop("more", "path").withColumn("path", path)
    ordered = now.select("path", "key", "sentence").repartition("path").sortWithinPartitions("path", "sentence")
    return ordered.mapInArrow(_templates, "key long, template string, leaf long")


# ---- what the pages of a template have in common ----------------------------------

#: Text that two pages of a sentence have in common, on average, if they are copies of one text.
COPIED = 0.6
_STUDIED = pa.schema(
    [("page", pa.int64()), ("key", pa.int64()), ("sentence", pa.string()), ("host", pa.int64()), ("share", pa.float64()), ("words", pa.int64()), ("said", pa.int32())]
    + [("whole", pa.int64()), ("size", pa.int64()), ("phrases", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
)
_STUDIED_SQL = "page long, key long, sentence string, host long, share double, words long, said int, whole long, size long, phrases array<long>, sizes array<int>"


def _studied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate on a page, with its phrases; and a row without key for the page, with those of all its sentences, each once."""

    def rows() -> Iterator[tuple]:
        for batch in slices(batches, 500):
            column = batch.column("sentences")
            ends = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
            texts = column.flatten()
            of, hashes, sizes = phrases(texts, SHORT_PHRASE)
            begin = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
            hashes, sizes = hashes.tolist(), sizes.tolist()
            between = lambda i, j: dict(zip(hashes[begin[i] : begin[j]], sizes[begin[i] : begin[j]]))
            for i, (rid, host, words, keys, flags, own, share) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("result_id", "host", "words", "keys", "flags", "own", "share")))):
                at = {key: j for j, key in enumerate(keys, ends[i])}
                page = hash64(np.array(keys, np.int64).tobytes(), rid & 0xFFFFFFFFFFFFFFFF)  # a result may have two texts
                every = between(ends[i], ends[i + 1])
                whole = sum(every.values())
                yield page, None, None, host, share, words, 0, whole, whole, list(every), list(every.values())
                for key in at.keys() & own:
                    j = at[key]
                    found = between(j, j + 1)
                    yield page, key, texts[j].as_py(), host, share, words, flags[j - ends[i]] & 1, whole, sum(found.values()), list(found), list(found.values())

    return rows_to_batches(rows(), _STUDIED, 2000)


#: For each feature of a template: upper ends of all but the last of its classes, the probability of each
#: class if it is a message and if it is a passage of articles. Beliefs to begin with, that weigh as much as ``BELIEF`` templates.
FEATURES = {
    "hosts": ((1, 3, 9), (0.25, 0.25, 0.25, 0.25), (0.3, 0.6, 0.08, 0.02)),
    "share": ((0.6, 0.85), (0.1, 0.2, 0.7), (0.3, 0.3, 0.4)),
    "words": ((50, 120), (0.6, 0.25, 0.15), (0.15, 0.3, 0.55)),
    "alike": ((-0.5, 0.03, 0.45), (0.2, 0.21, 0.55, 0.04), (0.2, 0.3, 0.05, 0.45)),
    "said": ((0.499,), (0.5, 0.5), (0.98, 0.02)),
}
BELIEF = 2000
#: Share of the templates that are messages, to begin with.
PRIOR = 0.2


def learned(patterns: np.ndarray, counts: np.ndarray, rounds: int = 10) -> np.ndarray:
    """The posterior of being a message, of each pattern of classes of ``FEATURES``, from the patterns and their counts."""
    beliefs = [np.array([m, p]) for _, m, p in FEATURES.values()]
    tables, prior = beliefs, np.array([PRIOR, 1 - PRIOR])
    for _ in range(rounds):
        logs = np.log(prior) + sum(np.log(t[:, patterns[:, i]]).T for i, t in enumerate(tables))
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        prior = (weight.sum(axis=0) + BELIEF * np.array([PRIOR, 1 - PRIOR])) / (weight.sum() + BELIEF)
        tables = []
        for i, belief in enumerate(beliefs):
            seen = np.stack([np.bincount(patterns[:, i], weight[:, c], belief.shape[1]) for c in (0, 1)]) + BELIEF * belief
            tables.append(seen / seen.sum(axis=1, keepdims=True))
    return post[:, 0]


def classified(templates: DataFrame) -> DataFrame:
    """``templates`` (with a column for each of ``FEATURES``) and the posterior of being a message.

    The driver learns from the counts of the patterns, of which there are a few hundred whatever the corpus.
    """
    spark = templates.sparkSession
    names = [f"of_{name}" for name in FEATURES]
    steps = [sum((F.when(F.col(name) > end, 1).otherwise(0) for end in ends), F.lit(0)).cast("int") for name, (ends, _, _) in FEATURES.items()]
    sorted_ = written(templates.withColumns(dict(zip(names, steps))))
    patterns = sorted_.groupBy(*names).agg(F.count("*").alias("n")).toPandas()
    table = patterns[names].copy()
    table["posterior"] = learned(patterns[names].to_numpy(np.int64), patterns["n"].to_numpy(float)) if len(patterns) else pd.Series(dtype=float)
    verdicts = spark.createDataFrame(table if len(table) else [], ", ".join([*(f"{n} int" for n in names), "posterior double"]))
    return sorted_.join(F.broadcast(verdicts), names).drop(*names)


def message_templates(facts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(template, leaf, posterior and features) of each template, (key, template) of its sentences, and
    (key, n) of every sentence on two pages or more with the number of its pages, and of some on one."""
    seen = written(
        rows.groupBy("key").agg(F.count("*").alias("n"), F.min("host").alias("one"), F.max("host").alias("another"), F.max("flag").alias("flag"))
        .select("key", "n", (((F.col("one") != F.col("another")) | F.col("flag").bitwiseAND(1).cast("boolean")) & (F.col("flag") >= 2)).alias("may"))
        .where("n > 1 or may")
    )
    found = written(rows.join(small_side(seen.where("may").select("key"), 16), "key", "left_semi").select("result_id", "key", "n", "words"))
    pages = found.groupBy("result_id").agg((F.sum("n") / F.max("words")).alias("share"))
    shared = found.select("result_id", "key").join(pages, "result_id")
    kept = shared.groupBy("key").agg(F.avg((F.col("share") >= BODY).cast("int")).alias("most")).where(F.col("most") >= BODY).select("key")
    own = written(shared.join(kept, "key", "left_semi").groupBy("result_id").agg(F.collect_list("key").alias("own"), F.max("share").alias("share")))
    bodies = facts.select("result_id", F.xxhash64("domain").alias("host"), "words", "keys", "sentences", "flags").join(small_side(own, 400), "result_id")
    all_studied = written(bodies.mapInArrow(_studied, _STUDIED_SQL))
    texts = all_studied.where("key is null").select("page", "phrases", "sizes")
    studied = all_studied.where("key is not null")
    of_key = sentence_resemblance(studied.where("size < whole").select("key", "page", "whole", F.col("size").alias("own")), texts)
    sentences = studied.groupBy("key").agg(F.first("sentence").alias("sentence"), F.max("said").alias("said")).join(of_key, "key", "left")
    sentences = written(sentences.where((F.col("said") > 0) | F.col("alike").isNull() | (F.col("alike") < COPIED)))
    members = written(mined(sentences.select("key", "sentence")))
    of = studied.drop("sentence").join(members, "key")
    # pages of one sentence, where there are any, tell more than pages of its variants
    own = members.join(sentences.where("alike is not null"), "key").groupBy("template").agg((F.sum(F.col("alike") * F.col("pages")) / F.sum("pages")).alias("own"))
    alike = template_resemblance(of.join(own, "template", "left_anti").select("template", "page", "whole", "phrases", "sizes"), texts)
    seen_on = of.groupBy("template").agg(
        F.max("leaf").alias("leaf"), F.count_distinct("host").alias("hosts"), F.avg("share").alias("share"), F.avg("words").alias("words"), F.avg("said").alias("said")
    )
    templates = seen_on.join(own, "template", "left").join(alike, "template", "left").withColumn("alike", F.coalesce("own", "alike", F.lit(-1.0))).drop("own")
    return classified(templates), members.select("key", "template"), seen.select("key", "n")


def message_sentences(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """(key) of every sentence that is a message."""
    with temporaries() as keep:
        return keep(_message_sentences(facts, rows))


def _message_sentences(facts: DataFrame, rows: DataFrame) -> DataFrame:
    templates, members, seen = message_templates(facts, rows)
    messages = written(templates.where("posterior > 0.5").select("template", "leaf"))
    parts = facts.select("leaves", "sentences", F.posexplode("keys").alias("at", "key")).select("key", F.get("leaves", "at").alias("leaf"), F.get("sentences", "at").alias("sentence"))
    tokens = F.split("sentence", " ")
    same = F.size(F.filter(F.zip_with(tokens, F.split("template", " "), lambda a, b: a == b), lambda x: x))
    variants = parts.join(small_side(messages, 200), "leaf").where(same >= AGREEMENT * F.size(tokens)).select("key")
    told = members.join(messages.select("template"), "template", "left_semi").select("key")
    known = written(told.unionByName(variants).distinct())
    pages = rows.join(small_side(known, 16), "key", "left_semi").groupBy("result_id").agg(F.sum("n").alias("told"), F.max("words").alias("words"))
    pages = written(pages.where(F.col("told") >= BESIDE_WORDS * F.col("words")).select("result_id"))
    near = written(rows.join(small_side(pages, 16), "result_id", "left_semi").groupBy("key").agg(F.count("*").alias("with")))
    beside = seen.join(small_side(near, 32), "key").where((F.col("n") > 1) & (F.col("with") >= BESIDE * F.col("n"))).select("key")
    return written(known.unionByName(beside).distinct())


def sentence_rows(facts: DataFrame) -> DataFrame:
    """(result_id, host, words, key, n, flag): a narrow row for each sentence of each main text."""
    # values are taken by their place, as arrays_zip makes an object of every sentence
    placed = facts.select("result_id", F.xxhash64("domain").alias("host"), "words", "sentence_words", "flags", F.posexplode("keys").alias("at", "key"))
    return placed.select("result_id", "host", "words", "key", F.get("sentence_words", "at").alias("n"), F.get("flags", "at").alias("flag"))


def residue(facts: DataFrame) -> DataFrame:
    """(result_id) of the results whose main text is residue; ``facts`` has ``FIELDS``, words, filler and slots."""
    rows = sentence_rows(facts)
    found = message_sentences(facts, rows)
    told = rows.join(small_side(found, 16), "key", "left_semi").groupBy("result_id").agg(F.sum("n").alias("told"), F.max("words").alias("words"))
    messages = told.where(F.col("told") >= RESIDUE * F.col("words")).select("result_id")
    by_form = facts.where((F.col("words") > 0) & ((F.col("filler") >= RESIDUE) | ((F.col("slots") >= MIN_SLOTS) & (F.col("slots") >= SLOT_RATE * F.col("words"))))).select("result_id")
    return messages.unionByName(by_form).distinct()
