"""Problems 3 and 6: residue in place of an article, and text that is no prose.

Both judge the main text (problem 7). One pass over the pages makes a row of
facts for each result; what follows works on these.

Problem 3 is in ``messages``.

Problem 6. Statistics of a text, each against a threshold, vote for prose, list,
table or junk, or abstain. How far each is to be believed is learned by
expectation-maximization from how they agree, over the counts of all vote
patterns, and the kind of the greatest posterior is the text's. As lists and
tables are defined by an exact share of words, an exact check follows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import messages
from leafmill.llm.corpus import rows_to_batches, settled, unique
from leafmill.llm.main_text import main_lines, page_nodes
from leafmill.llm.messages import merge_leaf, residue  # noqa: F401
from leafmill.session import written

#: Share of the words that makes a text a list or a table.
MOST = 0.5

#: Words of the usual filler paragraph and its usual additions.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum vestibulum faucibus pulvinar viverra ornare porta tellus mauris vivamus "
    "pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas curabitur praesent".split()
)
#: Frequent function words of English, German and Spanish.
COMMON = frozenset(
    "the of and to in a is that it for was on are as with his they be at one have this from or had by but some what there we can out "
    "other were all your when up use how said an each she which do their if will about many then them would so these her has him no "
    "more into than who its my been before after only over most such because while until though although since our not "
    "der die das und ist in zu den mit von für auf nicht ein eine einer eines dem des als auch es an werden aus er hat dass sie nach "
    "wird bei noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei worden wenn weil obwohl bevor "
    "el la los las de que y en un una por con no su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando "
    "todo esta ser son dos también fue había era muy hasta desde se porque según aunque luego donde".split()
)
#: How template languages write a slot, and what a slot that failed leaves behind.
_SLOT = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|[#$]?\{\w[\w. ]{0,40}\}|\{%[^{}\n]{0,60}%\}|<%=?[^<>\n]{0,60}%>|\[\[[^\[\]\n]{0,60}\]\]|%%\w+%%|@@\w+@@|%[A-Z][A-Z_]+%|__\w+?__|"
    r"\[[A-Za-z_]{2,30}\](?![(\[:])|(?<![\w%])%[sd]\b|\[object Object\]|#(?:VALUE|REF|NAME|N/A|DIV/0)!?|\bundefined\b|\bNaN\b|\bnull\b|\bInvalid Date\b|\(not set\)"
)
_SLOT_SIGNS = ("{", "[", "%", "__", "@@", "#VALUE", "#REF", "#NAME", "#N/A", "#DIV", "undefined", "NaN", "null", "Invalid Date", "(not set)")
_WORD = re.compile(r"\w+")
_STOPS = ".!?…。！？"
_ENDS = frozenset(_STOPS + ":")
_CLOSERS = "\"”’»)*_"
_MARKED = re.compile(r"^\s*(?:[-*•–—‣+·]|\d{1,3}[.)]|[a-z]\))\s+\S")
_MARK_SIGNS = frozenset("-*•–—‣+·")
_RULE = re.compile(r"^[\s|:+=-]+$")
_END = re.compile(r"[.!?…。！？:][\"”’»)*_]*$")
_HEAD = re.compile(r"^\s*#{1,6}\s")
#: What separates the fields of a row, and what a line must have for that.
_FIELDS = tuple((re.compile(split), sign) for split, sign in ((r"\s*\t\s*", "\t"), (r"\s*;\s*", ";"), (r"\s*\|\s*", "|"), (r"\s{2,}", "  "), (r",(?=\S)", ",")))
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


# ---- facts of one main text ---------------------------------------------------


@dataclass
class Stats:
    """Statistics of a text; shares are of its words unless they say otherwise."""

    words: int = 0
    mean_word_length: float = 0.0
    symbol_ratio: float = 0.0
    ended_lines: float = 0.0
    common_words: float = 0.0
    in_list: float = 0.0
    in_table: float = 0.0
    in_sentences: float = 0.0
    filler: float = 0.0
    slots: int = 0
    longest_token: int = 0
    wide: float = 0.0
    line_words: float = 0.0
    delimited_lines: float = 0.0


def line_kinds(lines: list[str]) -> list[str]:
    """"list", "table", "code", "head" or "text" for each line, "" if blank; items and rows need no markup."""
    kinds = [""] * len(lines)
    block: list[int] = []
    fenced = False
    for i, line in enumerate([*lines, ""]):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
            if i < len(lines):
                kinds[i] = "code"
            s = ""
        elif fenced and s:
            kinds[i] = "code"
            continue
        if s:
            block.append(i)
        elif block:
            _block_kinds(lines, block, kinds)
            block = []
    return kinds


def _block_kinds(lines: list[str], block: list[int], kinds: list[str]) -> None:
    plain: list[int] = []
    for i in block:
        line = lines[i]
        first = line.lstrip()[0]
        if first == "#" and _HEAD.match(line):
            kinds[i] = "head"
        elif first == "|" or ("|" in line and _RULE.match(line)):
            kinds[i] = "table"
        elif (first in _MARK_SIGNS or first.isdigit() or ")" in line[:8]) and _MARKED.match(line):
            kinds[i] = "list"
        else:
            kinds[i] = "text"
            plain.append(i)
    if len(plain) < len(block):  # a wrapped item goes on in the next line
        for a, b in zip(block, block[1:]):
            if kinds[b] == "text" and kinds[a] == "list" and not _END.search(lines[a].rstrip()) and lines[b][:1].islower():
                kinds[b] = "list"
                plain.remove(b)
    if len(plain) >= 3:
        texts = [lines[i].strip() for i in plain]
        for split, sign in _FIELDS:
            if sum(sign in t or (sign == "  " and not t.isprintable()) for t in texts) < 0.8 * len(texts):
                continue
            n = [len(split.split(t)) for t in texts]
            usual, times = Counter(n).most_common(1)[0]
            if usual >= 3 and times >= 0.8 * len(n):
                for i in plain:
                    kinds[i] = "table"
                return
        ended = sum(bool(_END.search(t)) and not t.endswith(":") for t in texts)
        short = sum(len(t) <= 60 and len(t.split()) <= 12 for t in texts)
        wrapped = sum(a.split()[-1:] != [] and len(a) + len(b.split()[0]) > 58 for a, b in zip(texts, texts[1:]) if b.split())
        if short >= 0.9 * len(texts) and ended <= 0.3 * len(texts) and wrapped <= 0.5 * (len(texts) - 1) and all(any(c.isalpha() for c in t) for t in texts[:3]):
            for i in plain:
                kinds[i] = "list"


def statistics(lines: list[str], found: list[list[str]] | None = None) -> Stats:
    """The statistics of a text given by its lines, and by their tokens if these are known."""
    text = "\n".join(lines)
    sizes = list(map(len, text.split()))
    if not sizes:
        return Stats()
    found = messages.tokenised(lines) if found is None else found
    kinds = line_kinds(lines)
    words: list[str] = []
    of_kind = dict.fromkeys(("list", "table", "code", "head", "text", ""), 0)
    ended = filled = in_sentences = delimited = stops = 0
    pending = 0  # words of the paragraph after its last sentence end; wrapped lines are one paragraph
    for line, kind, own in zip(lines, kinds, found):
        if not kind:
            pending = 0
            continue
        marks = own.count(".")
        n = len(own) - marks
        words += own
        stops += marks
        of_kind[kind] += n
        filled += 1
        last = line.rstrip()[-6:].rstrip(_CLOSERS)[-1:]
        ended += last in _ENDS
        delimited += line.count("|") + line.count(";") + line.count("\t") + line.count("  ") + line.count(",") - line.count(", ") >= 2
        if kind == "text":
            if last in _ENDS and last != ":":
                in_sentences += pending + n
                pending = 0
            elif (stop := max(map(line.rfind, _STOPS))) < 0:
                pending += n
            else:
                left = len(_WORD.findall(line[stop:]))
                in_sentences += pending + n - left
                pending = left
        else:
            pending = 0
    n_words = len(words) - stops
    total = max(1, n_words)
    counted = max(1, sum(of_kind.values()) - of_kind["head"])
    visible = sum(sizes)
    letters = sum(map(len, words)) - stops
    common = sum(map(COMMON.__contains__, words)) / total
    return Stats(
        words=n_words,
        mean_word_length=letters / total,
        symbol_ratio=1 - letters / visible if visible else 0.0,
        ended_lines=ended / max(1, filled),
        common_words=common,
        in_list=of_kind["list"] / counted,
        in_table=of_kind["table"] / counted,
        in_sentences=in_sentences / total,
        filler=sum(map(FILLER.__contains__, words)) / total if common < 0.3 else 0.0,  # filler has hardly any common words
        slots=_slots(text, lines, kinds),
        longest_token=max(sizes),
        wide=0.0 if text.isascii() else len(_WIDE.findall(text)) / max(1, letters),
        line_words=n_words / max(1, filled),
        delimited_lines=delimited / max(1, filled),
    )


def _slots(text: str, lines: list[str], kinds: list[str] | None = None) -> int:
    """Unresolved slots outside code and lists."""
    if not any(map(text.__contains__, _SLOT_SIGNS)):
        return 0
    signed = [i for i, line in enumerate(lines) if any(map(line.__contains__, _SLOT_SIGNS))]  # no slot goes over a line's end
    kinds = kinds or line_kinds(lines)
    return sum(len(_SLOT.findall(lines[i])) for i in signed if kinds[i] not in ("code", "list"))


def all_facts(lines: list[str]) -> tuple:
    """All statistics, and the sentences."""
    found = messages.tokenised(lines)
    return *_VALUES(statistics(lines, found)), *messages.sentence_facts(messages.body_sentences(lines, found))


def residue_facts(lines: list[str]) -> tuple:
    """words, filler and slots of ``statistics``, which is all that residue needs, and the sentences."""
    found = messages.tokenised(lines)
    words = len([t for own in found for t in own if t != "."])
    of = lambda known: sum(sum(map(known.__contains__, own)) for own in found) / max(1, words)
    filler = of(FILLER) if of(COMMON) < 0.3 else 0.0
    return words, filler, _slots("\n".join(lines), lines), *messages.sentence_facts(messages.body_sentences(lines, found))


_VALUES = attrgetter(*(f.name for f in fields(Stats)))


def _schema(names: list[str]) -> tuple[pa.Schema, str]:
    """The facts of a text, of which statistics those in ``names``, for Arrow and for Spark."""
    own = [(f.name, f.type) for f in fields(Stats) if f.name in names]
    arrow = pa.schema([("result_id", pa.int64()), ("domain", pa.string()), *((n, pa.int64() if t == "int" else pa.float64()) for n, t in own), *messages.FIELDS])
    return arrow, "result_id long, domain string, " + ", ".join(f"{n} {'long' if t == 'int' else 'double'}" for n, t in own) + ", " + messages.FIELDS_SQL


_FACTS, _FACTS_SQL = _schema([f.name for f in fields(Stats)])
_RESIDUE, _RESIDUE_SQL = _schema(["words", "filler", "slots"])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return rows_to_batches(((rid, domain, *all_facts(lines)) for rid, lines, domain in main_lines(batches)), _FACTS, 500)


def _residue_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return rows_to_batches(((rid, domain, *residue_facts(lines)) for rid, lines, domain in main_lines(batches)), _RESIDUE, 500)


def text_facts(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of facts for each result with text: statistics of its main text, and its sentences."""
    return written(page_nodes(conversions, pages).mapInArrow(_facts, _FACTS_SQL))


# ---- problem 3 ------------------------------------------------------------------


def residue_results(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id) of every result whose body is template text, filler or a message.

    Null texts and texts without a body have no verdict; repeated rows count once;
    an empty table gives no rows.
    """
    return residue(written(page_nodes(conversions, pages).mapInArrow(_residue_facts, _RESIDUE_SQL)))


def articles_only(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """``conversions`` without the residue; rows without result_id stay."""
    return conversions.join(residue_results(conversions, pages), "result_id", "left_anti")


# ---- problem 6 ------------------------------------------------------------------

KINDS = ("prose", "list", "table", "junk")
ABSTAIN = len(KINDS)


def labelling_votes(columns: list[str]) -> list[F.Column]:
    """The vote of each labelling function on the statistics in ``columns``: the number of a kind, or ``ABSTAIN``.

    Every kind has several that look at different things: lists and tables their words, the words
    of a line, how lines end and what separates their parts; prose and junk common words,
    sentences, word lengths, symbols and line ends.
    """
    prose, lst, tab, junk = (F.lit(i) for i in range(4))
    none = F.lit(ABSTAIN)
    c = F.col
    wide = c("wide") > 0.3
    listed, tabled = c("in_list") > MOST, c("in_table") > MOST
    votes = {
        "in_list": F.when(listed, lst).otherwise(none),
        "in_table": F.when(tabled, tab).otherwise(none),
        "common_words": F.when(wide | listed | tabled, none).when(c("common_words") >= 0.15, prose).when(c("common_words") < 0.06, junk).otherwise(none),
        "in_sentences": F.when(c("in_sentences") + c("in_list") * c("common_words") >= 0.5, prose).when((c("in_sentences") < 0.15) & ~listed & ~tabled, junk).otherwise(none),
        "mean_word_length": F.when(wide, prose).when((c("mean_word_length") > 11) | (c("mean_word_length") < 1.8), junk).otherwise(none),
        "symbol_ratio": F.when(c("symbol_ratio") > 0.3, F.when(tabled, tab).otherwise(junk)).when((c("symbol_ratio") < 0.06) & (c("in_sentences") > 0.4), prose).otherwise(none),
        "longest_token": F.when(wide, none).when(c("longest_token") > 120, junk).otherwise(none),
        "ended_lines": F.when(c("ended_lines") >= 0.6, F.when(listed | tabled, none).otherwise(prose)).when((c("ended_lines") <= 0.2) & (c("in_sentences") < 0.2), F.when(listed, lst).when(tabled, tab).otherwise(none)).otherwise(none),
        "line_words": F.when((c("line_words") <= 9) & (c("in_list") > c("in_table")) & (c("in_sentences") < 0.4), lst).when((c("line_words") >= 25) & (c("in_sentences") >= 0.3), prose).otherwise(none),
        "delimited_lines": F.when((c("delimited_lines") > 0.5) & (c("in_sentences") < 0.5), tab).otherwise(none),
    }
    return [vote for name, vote in votes.items() if name in columns]


def learn_accuracies(votes: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of each kind for each vote pattern (Dawid and Skene), from patterns and their counts."""
    k = len(KINDS)
    n, m = votes.shape
    onehot = np.eye(k + 1)[votes]  # pattern, function, vote
    confusion = np.full((m, k, k + 1), 0.05)
    for i in range(k):
        confusion[:, i, i] = 0.6
    confusion[:, :, k] = 0.3
    confusion /= confusion.sum(axis=2, keepdims=True)
    prior = np.array([0.7, 0.1, 0.1, 0.1])
    for _ in range(rounds):
        logs = np.log(prior) + np.einsum("nmv,mkv->nk", onehot, np.log(confusion))
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        prior = (weight.sum(axis=0) + 1) / (weight.sum() + k)
        seen = np.einsum("nk,nmv->mkv", weight, onehot)
        start = np.full((k, k + 1), 0.5)
        start[np.arange(k), np.arange(k)] = 6.0
        start[:, k] = 2.0
        confusion = seen + start
        confusion /= confusion.sum(axis=2, keepdims=True)
    return post


def text_types(facts: DataFrame) -> DataFrame:
    """``facts`` with the kind guessed by the posterior, body_kind and its posterior.

    body_kind is the guess, but for texts whose share of words in items or rows says otherwise. The vote patterns, at most a few thousand whatever the corpus, are what the
    driver learns from.
    """
    votes = labelling_votes(facts.columns)
    names = [f"v{i}" for i in range(len(votes))]
    voted = facts.where("words > 0").withColumns(dict(zip(names, (v.cast("int") for v in votes))))
    patterns = voted.groupBy(*names).agg(F.count("*").alias("n")).toPandas()
    if patterns.empty:
        return facts.where("words > 0").select("*", F.lit("prose").alias("guess"), F.lit("prose").alias("body_kind"), F.lit(1.0).alias("posterior"))
    post = learn_accuracies(patterns[names].to_numpy(), patterns["n"].to_numpy())
    table = patterns[names].copy()
    for i, name in enumerate(KINDS):
        table[f"of_{name}"] = post[:, i]
    of = [f"of_{name}" for name in KINDS]
    learned = facts.sparkSession.createDataFrame(table, ", ".join([*(f"{n} int" for n in names), *(f"{n} double" for n in of)]))
    judged = voted.join(F.broadcast(learned), names)
    most = F.greatest(*of)
    guess = F.coalesce(*(F.when(F.col(f"of_{name}") == most, name) for name in KINDS))
    # the definition of lists and tables is exact, so an exact check follows
    kind = (
        F.when((F.col("in_list") > MOST) & (F.col("in_list") >= F.col("in_table")), "list")
        .when(F.col("in_table") > MOST, "table")
        .when(F.col("guess").isin("prose", "junk"), F.col("guess"))
        .otherwise(F.when(F.col("of_junk") > F.col("of_prose"), "junk").otherwise("prose"))
    )
    posterior = F.coalesce(*(F.when(F.col("body_kind") == name, F.col(f"of_{name}")) for name in KINDS))
    return judged.withColumn("guess", guess).withColumn("body_kind", kind).withColumn("posterior", posterior).drop(*names, *of)


def not_prose(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, body_kind) of each result whose main text is a list, a table or junk, residue apart.

    A result without a main text, as of a null text, is no case; repeated rows count once.
    """
    facts = text_facts(conversions, pages)
    kinds = text_types(facts).where("body_kind <> 'prose'").select("result_id", "body_kind")
    return kinds.join(residue(facts), "result_id", "left_anti")


_STATS = ("words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for rid, md, stored in unique(batches, "result_id", "md_content", "word_count"):
            s = statistics(md.split("\n"))
            yield rid, stored, *(getattr(s, n) for n in _STATS)

    return rows_to_batches(rows(), pa.schema([("result_id", pa.int64()), ("stored_word_count", pa.int64()), ("word_count", pa.int64()), *((n, pa.float64()) for n in _STATS[1:])]))


def text_statistics(conversions: DataFrame) -> DataFrame:
    """(result_id, stored_word_count, word_count, mean_word_length, symbol_ratio, ended_lines,
    common_words) of each result with text; an empty text has zeros."""
    rows = settled(conversions.select("result_id", "md_content", "word_count"), "result_id").where("result_id is not null and md_content is not null").repartition("result_id")
    schema = "result_id long, stored_word_count long, word_count long, " + ", ".join(f"{n} double" for n in _STATS[1:])
    return rows.mapInArrow(_statistics, schema)
