"""Problem 7: the furniture of a page against its article.

Wrapper induction over all pages of a host. A page is a tree of depth three:
the page, its blocks (runs of lines that are not blank) and their lines. Two
nodes match if their keys are equal (letters only, lower case), so the constant
nodes of a host are the keys that a share of its pages have; they are counted
over all pages at once, as matching trees pair by pair grows with the square of
the host. The block that holds a constant node belongs to the template, and its
other lines are slots: short lines there (titles of other pages, names) are
furniture, running text is not. What recurs on many hosts above or below an
article without belonging to any host's template (announcements) is found the
same way over the whole collection, if the pages that have it differ in their
text; a line of an article that is copied to many hosts has one text beside it
everywhere. Slots that hold a different text on each
page (bylines, trails, tags, pagers, page numbers) are told by their form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bodies import host_resemblance, page_phrases
from leafmill.llm.corpus import beside_text, distinct_rows, hash64, line_key, places, rows_to_batches, settled
from leafmill.session import cut_lineage, written

#: A node is constant if at least one of so many pages of the host has it ...
ONE_OF = 8
#: ... and at least so many pages.
MIN_PAGES = 4
#: An announcement stands on pages of at least so many hosts, ...
MIN_HOSTS = 4
#: ... nearly always beside an article (so many sentences or more), ...
ARTICLE_SENTENCES = 8
BESIDE_ARTICLE = 0.7
#: ... and is hardly ever marked as a heading.
AS_HEADING = 0.03
#: Text that two of its pages have in common, on average, is less than this: four different articles, copied or not.
ALIKE = 0.25
#: All its pages are compared; those of one host weigh as much as so many at most.
HOST_WEIGHT = 4
#: A slot line has no more words than this, and fewer characters.
SLOT_WORDS = 16
LONG = 160

#: Lines of a host that fewer than one in so many of its pages have are kept beside the pages, not beside the host.
WIDE = 256

# the patterns of the first pass run over whole columns of lines, so they are written for that engine
_LETTERS = r"[^\p{L}]+"
_ANNOUNCE = r"^[\s\p{Z}>*_]*\p{L}[^\p{Nd}|;{}()=<\[\]\t]{8,90}$"
_HEADED = r"^[ >*_]*#"
_SENTENCE = r"[.!?][\"”’]?(?:\s|$)"
_FIRST = re.compile(r"[^\W\d_]+")
_NODE = pa.schema(
    [("domain", pa.string()), ("key", pa.int64()), ("first", pa.int32()), ("n_domain", pa.int64()), ("result_id", pa.int64()), ("n", pa.int64()), ("apart", pa.int64())]
    + [("beside", pa.int64()), ("headed", pa.int64()), ("size", pa.int64())]
)
_NODE_SQL = "domain string, key long, first int, n_domain long, result_id long, n long, apart long, beside long, headed long, size long"
#: Pages whose lines are counted before the counts are handed on.
AT_ONCE = 4000


def _count_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each node over the pages of a task: pages, as a line apart, beside an article, as a heading; and for
    each line apart and page a row with result_id and without counts, and for each phrase of such a page a row with
    its hash as key, result_id and size, and without domain; the row of such a page without key has the sum of the sizes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in distinct_rows(batches):
        held.append(batch)
        size += batch.num_rows
        if size >= AT_ONCE:
            yield from _nodes(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield from _nodes(pa.Table.from_batches(held))


def _nodes(pages: pa.Table) -> Iterator[pa.RecordBatch]:
    pages = pages.combine_chunks()
    texts = pages.column("md_content").combine_chunks()
    rid = pages.column("result_id").to_numpy()
    domains = pages.column("domain").combine_chunks().dictionary_encode()
    domain = domains.indices.to_numpy()
    n_domain = pages.column("n_domain").to_numpy()
    article = pc.count_substring_regex(texts, _SENTENCE).to_numpy() >= ARTICLE_SENTENCES
    split = pc.split_pattern(texts, "\n")
    page = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    lines = split.flatten()
    keys = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(lines), _LETTERS, " "), " ")
    some = pc.greater(pc.binary_length(keys), 0)
    lines, keys, page = lines.filter(some), keys.filter(some), page[some.to_numpy(zero_copy_only=False)]
    if not len(keys):
        return
    coded = keys.dictionary_encode()
    code, unique_keys = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    # of each line: 1 stands apart, 2 is a heading
    headed = pc.match_substring_regex(lines, _HEADED).to_numpy(zero_copy_only=False)
    blanks = pc.count_substring(unique_keys, " ").to_numpy()[code]
    apart = (pc.utf8_length(lines).to_numpy() < 120) & (blanks >= 2) & (blanks <= 13)
    apart[apart] = pc.match_substring_regex(pc.utf8_rtrim_whitespace(lines.filter(pa.array(apart))), _ANNOUNCE).to_numpy(zero_copy_only=False)
    flags = (apart | headed) + 2 * headed
    # a node counts once for each page
    node = page * len(unique_keys) + code
    order = np.argsort(node, kind="stable")
    starts = _starts(node[order])
    flags = np.bitwise_or.reduceat(flags[order], starts)
    page, code = page[order][starts], code[order][starts]
    # over the pages of a host
    own = domain[page].astype(np.int64) * len(unique_keys) + code
    order = np.lexsort((rid[page], own))
    page, code, flags, own = page[order], code[order], flags[order], own[order]
    starts = _starts(own)
    hashes = np.fromiter(map(hash64, unique_keys.to_pylist()), np.int64, len(unique_keys))
    firsts = _first_words(unique_keys)
    beside = article[page] & (flags > 0)
    columns = [domain[page[starts]], hashes[code[starts]], firsts[code[starts]], n_domain[page[starts]], np.diff(np.append(starts, len(own)))]
    columns += [np.add.reduceat(x.astype(np.int64), starts) for x in (flags > 0, beside, flags > 1)]
    rows = [domains.dictionary.take(pa.array(columns[0])), *map(pa.array, columns[1:4]), pa.nulls(len(starts), pa.int64()), *map(pa.array, columns[4:]), pa.nulls(len(starts), pa.int64())]
    yield pa.RecordBatch.from_arrays(rows, schema=_NODE)
    plain = flags == 1
    if not plain.any():
        return
    p, c = page[plain], code[plain]
    none = pa.array(np.zeros(len(p), np.int64))
    rows = [domains.dictionary.take(pa.array(domain[p])), pa.array(hashes[c]), pa.array(firsts[c]), pa.array(n_domain[p]), pa.array(rid[p]), none, none, none, none]
    yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(p), pa.int64())], schema=_NODE)
    told = np.zeros(len(rid), bool)
    told[p] = True
    told = told[page]
    p, of_phrase, size = page_phrases(unique_keys, page[told], code[told])
    of, at = np.unique(p, return_inverse=True)
    whole = np.bincount(at, size).astype(np.int64)
    of_phrase = pa.array(np.append(of_phrase, np.zeros(len(of), np.int64)), mask=np.arange(len(p) + len(of)) >= len(p))
    p, size = np.append(p, of), np.append(size, whole)
    zeros = pa.array(np.zeros(len(p), np.int64))
    rows = [pa.nulls(len(p), pa.string()), of_phrase, pa.array(np.zeros(len(p), np.int32)), zeros, pa.array(rid[p]), zeros, zeros, zeros, zeros]
    yield pa.RecordBatch.from_arrays([*rows, pa.array(size)], schema=_NODE)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def first_word(key: str) -> int:
    """A hash of the first word of ``key``."""
    return xxhash.xxh32_intdigest(key.split(" ", 1)[0]) >> 1


def _first_words(keys: pa.Array) -> np.ndarray:
    words = pc.list_element(pc.split_pattern(keys, " ", max_splits=1), 0).dictionary_encode()
    return np.array([xxhash.xxh32_intdigest(w) >> 1 for w in words.dictionary.to_pylist()], np.int32)[words.indices.to_numpy()]


def _templates(conversions: DataFrame, where: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, constant, shared, firsts) for each host and (result_id, rare, rare_firsts) for pages of large hosts."""
    texts = beside_text(conversions, where.select("result_id", "domain", "n_domain"))
    parts = texts.mapInArrow(_count_nodes, _NODE_SQL)
    counted = parts.groupBy("key", "domain", "result_id").agg(
        F.max("first").alias("first"), F.max("n_domain").alias("of"), *(F.sum(c).alias(c) for c in ("n", "apart", "beside", "headed")), F.sum("size").alias("size")
    )
    # an article's own headings return, too; a heading of the page is on most pages
    heading = (F.col("headed") * 2 > F.col("n")) & (F.col("n") * 2 < F.col("of"))
    constant = (F.col("domain") != "") & (F.col("n") >= MIN_PAGES) & (F.col("n") * ONE_OF >= F.col("of")) & ~heading
    # four uses follow; what they need is little, and counted once
    nodes = cut_lineage(counted.where(constant | (F.col("apart") > 0) | F.col("result_id").isNotNull()))
    apart = nodes.where("apart > 0")
    hosts = apart.groupBy("key").agg(F.count("*").alias("hosts"), *(F.sum(c).alias(f"all_{c}") for c in ("apart", "beside", "headed")))
    shared = hosts.where(
        (F.col("hosts") >= MIN_HOSTS) & (F.col("all_beside") >= BESIDE_ARTICLE * F.col("all_apart")) & (F.col("all_headed") <= AS_HEADING * F.col("all_apart"))
    )
    lines = nodes.where("result_id is not null and size is null")
    phrases = nodes.where("size is not null and key is not null").select("result_id", F.col("key").alias("phrase"), "size")
    sizes = nodes.where("size is not null and key is null").select("result_id", "size")
    plain = apart.select("key", "domain", (F.col("apart") - F.col("headed")).alias("pages")).where("pages > 0").join(shared.select("key"), "key", "left_semi")
    pages = lines.select("key", "domain", "result_id").join(plain, ["key", "domain"])
    alike = host_resemblance(pages, sizes, phrases, HOST_WEIGHT)
    shared = written(alike.where(F.col("alike") < ALIKE).select("key"))
    own = nodes.where(constant & F.col("result_id").isNull()).select("domain", "key", "first", F.lit(1).alias("kind"))
    common = apart.join(shared, "key", "left_semi").select("domain", "key", "first", (F.col("n") * WIDE >= F.col("of")).alias("often"))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("key")))
    frequent = common.where("often").select("domain", "key", "first", F.lit(2).alias("kind"))
    by_domain = own.unionByName(frequent).groupBy("domain").agg(of(1).alias("constant"), of(2).alias("shared"), F.collect_set("first").alias("firsts"))
    seldom = lines.join(common.where("not often").select("domain", "key"), ["domain", "key"], "left_semi")
    by_page = seldom.groupBy("result_id").agg(F.collect_set("key").alias("rare"), F.collect_set("first").alias("rare_firsts"))
    return by_domain, by_page


def template_nodes(conversions: DataFrame, where: DataFrame) -> DataFrame:
    """(domain, constant, shared, firsts): for each host the keys of its constant nodes and of the
    announcements on it, and the first words of all these, by which most lines are told apart.

    Both are bounded by the lines of a few pages: a constant node is on one in ``ONE_OF`` of them at least, an
    announcement on one in ``WIDE``. Those that fewer pages of a large host have are kept by page.
    """
    return _templates(conversions, where)[0]


# ---- the page as a tree ----------------------------------------------------

#: Names of months in English, German and Spanish, as bylines write them.
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz mai juni juli oktober dezember "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
_DATE = re.compile(r"\b(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|(?:%s)\b\.?,? (?:\d{1,2},? )?\d{1,4}|\d{1,2}\.? (?:de )?(?:%s))\b" % ("|".join(MONTHS), "|".join(MONTHS)), re.I)
_LETTER = re.compile(r"[^\W\d_]")
_END = re.compile(r"[.!?…。][\"”’»)]*$")
_MARK = re.compile(r"^(?:[-*•–—‣+]|\d{1,3}[.)])\s+")
_PAGE_NO = re.compile(r"^(?:[-–—·|\[(]\s*)?(?:\w{1,8}\.?\s+)?\d{1,4}(?:\s*(?:of|von|de|/)\s*\d{1,4})?(?:\s*[-–—·|\])])?$", re.I)
_TRAIL = re.compile(r"\S\s+[>›»→/]\s+\S.*\S\s+[>›»→/]\s+\S|^\S+\s+[›»]\s+\S")
_TAGS = re.compile(r"^(?:#+\s*)?(?:\w+:\s*|\w+ \w+:?\s+)?([^\W\d_]+(?:, [^\W\d_]+){2,})$")
_SHORT_TAGS = re.compile(r"^(?:\w+:|\w+ \w+:) ([^\W\d_]+(?:, [^\W\d_]+)*)$")
_FOLIO = re.compile(r"^(.{8,}?)\s+\d{1,4}$")
_PAGER = re.compile(r"^(?:←|«|‹|<<|⟵)|(?:→|»|›|>>|⟶)$")
_ARROWS = ("", "←", "«", "‹", "<", "⟵")
_MENU = re.compile(r"\s[|·•/]\s")


def bare(line: str) -> str:
    """``line`` without quote marks, bold marks and blanks around it, inner blanks single."""
    s = line.strip()
    while s[:1] == ">" or s.startswith("**"):
        s = s[1 if s[0] == ">" else 2 :].lstrip()
    while s.endswith("**"):
        s = s[:-2].rstrip()
    return " ".join(s.split()) if len(s) < LONG else s


def _ended(text: str) -> bool:
    return _END.search(text[-6:]) is not None


def _slot(text: str) -> bool:
    """A line that may fill a slot of the template: short, and no running text."""
    if len(text) >= LONG:
        return False
    text = _MARK.sub("", text)
    words = len(text.split())
    return words <= SLOT_WORDS and not text.startswith("|") and not (words > 4 and _ended(text))


def _by_form(text: str) -> bool:
    """A single line that is furniture by its form alone."""
    if text[0] == "|" or len(text) > 2 * LONG or (words := len(text.split())) > 34:
        return False
    if _PAGER.search(text) and words <= 20:
        return True
    if _TRAIL.search(text) and not _ended(text) and "|" not in text:
        return True
    if words <= 14 and not _ended(text) and _DATE.search(text) and not _MARK.match(text) and text[0] != "#":
        return True
    return False


def furniture(lines: list[str], constant: dict[int, int], kind: str) -> list[bool]:
    """For each line, whether it belongs to the page and not to its article.

    ``constant``: kind of the template node by line number from 1 (1 of the host,
    2 an announcement). Blank lines are never furniture.
    """
    n = len(lines)
    out = [False] * n
    blocks: list[list[int]] = []
    now: list[int] = []
    fenced = False
    inside = [False] * n
    for i, line in enumerate(lines):
        s = line.strip()
        if s.startswith("```"):
            inside[i] = True
            fenced = not fenced
        else:
            inside[i] = fenced
        if s:
            now.append(i)
        elif now:
            blocks.append(now)
            now = []
    if now:
        blocks.append(now)
    if fenced:  # a fence that is never closed fences nothing
        inside = [line.strip().startswith("```") for line in lines]
    pdf = kind == "pdf"
    heads: Counter = Counter()
    if pdf:
        heads.update(k for i in range(n) if lines[i].strip() and len(lines[i]) < 120 and (k := line_key(lines[i])))
    seen_title = False
    title = ""
    for block in blocks:
        i = block[0]
        if len(block) == 1 and not pdf and not inside[i] and (i + 1) not in constant:
            s = lines[i].strip()
            # no form of furniture ends as a sentence does, unless it begins with an arrow
            if s[-1] in ".!?…" and s.lstrip(">* ")[:1] not in _ARROWS:
                seen_title = True
                continue
        texts_ = [bare(lines[i]) or lines[i].strip() for i in block]
        fixed = [(i + 1) in constant and not inside[i] for i in block]
        if pdf:
            numbers = [bool(_PAGE_NO.match(t)) for t in texts_]
            near = any(numbers)
            title = title or line_key(lines[block[0]])
            for j, i in enumerate(block):
                t = texts_[j]
                if seen_title and (folio := _FOLIO.match(t)) and len(block) <= 3 and title.startswith(line_key(folio[1])):
                    out[i] = True
                elif numbers[j] and (len(block) <= 3 or j in (0, len(block) - 1)):
                    out[i] = True
                elif fixed[j] or (heads[line_key(lines[i])] >= 2 and not _ended(t) and not t.startswith(("|", "#")) and len(block) <= 3):
                    out[i] = True
                elif near and len(block) <= 3 and _slot(t) and not _ended(t) and seen_title:
                    out[i] = True
            if not all(out[i] for i in block):
                seen_title = True
            continue
        if any(fixed):
            # the template's block: from its first constant node on, slots are furniture
            open_ = False
            plain = [not _slot(t) for t in texts_]
            for j, i in enumerate(block):
                if fixed[j]:
                    out[i] = open_ = True
                elif plain[j]:
                    open_ = False
                elif open_ or (not any(plain) and texts_[j][0] != "#"):
                    out[i] = True
            continue
        if any(inside[i] for i in block):
            continue
        if len(block) <= 2 and all(_by_form(t) or (_slot(t) and _PAGER.search(t)) for t in texts_):
            for i in block:
                out[i] = True
            continue
        if len(block) == 1:
            t = texts_[0]
            tags = _TAGS.match(t) or _SHORT_TAGS.match(t)
            if tags and (seen_title or t[0] == "#") and (tags[1].islower() or tags[1].isupper()):
                out[block[0]] = True
                continue
            if t[0] != "|" and not _ended(t) and len(items := _MENU.split(t)) > 2 and all(x.strip() and len(x.split()) <= 3 for x in items):
                out[block[0]] = True
                continue
        if not all(out[i] for i in block):
            seen_title = True
    return out


# ---- the operator ----------------------------------------------------------


def page_nodes(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, md_content, domain, content_type, constant, shared, firsts, rare, rare_firsts): each text with its
    host's template, and the announcements of the page that few pages of its host have."""
    conversions = settled(conversions.select("result_id", "url", "md_content"), "result_id")
    where = written(places(conversions, pages))
    by_domain, by_page = _templates(conversions, where)
    narrow = where.select("result_id", "domain", "content_type").join(by_domain, "domain", "left").join(by_page, "result_id", "left")
    return beside_text(conversions, narrow)


#: Hosts whose templates a task holds as sets.
HELD_HOSTS = 2000


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[bool], str]]:
    """result_id, lines, furniture flags and domain of each row of ``page_nodes``."""
    firsts_of: dict[str, int] = {}
    hashes: dict[str, int | None] = {}  # of the keys of lines, which return from page to page
    templates: dict[str, tuple[set, set, set]] = {}
    for batch in distinct_rows(batches):
        lists = [(c.offsets.to_numpy(), c.flatten().to_numpy(zero_copy_only=False)) for c in map(batch.column, ("constant", "shared", "firsts"))]
        rows = zip(*(batch.column(c).to_pylist() for c in ("result_id", "md_content", "domain", "content_type", "rare", "rare_firsts")))
        for i, (rid, md, domain, kind, rare, rare_firsts) in enumerate(rows):
            template = templates.get(domain)
            if template is None:
                if len(templates) >= HELD_HOSTS:
                    templates.clear()
                template = templates[domain] = tuple(set(flat[of[i] - of[0] : of[i + 1] - of[0]].tolist()) for of, flat in lists)
            constant, shared, firsts = template
            if rare:
                shared, firsts = shared.union(rare), firsts.union(rare_firsts)
            lines = md.split("\n")
            nodes = {}
            if firsts:
                for at, line in enumerate(lines, 1):
                    # exact: a line of the template has the first word of its node
                    if (word := _FIRST.search(line)) and (not word[0].isalpha() or _known(word[0], firsts_of) in firsts):
                        h = _key_hash(line, hashes)
                        if h in constant:
                            nodes[at] = 1
                        elif h in shared and not line.lstrip(" >*_").startswith("#"):
                            nodes[at] = 2
            yield rid, lines, furniture(lines, nodes, kind), domain


def _key_hash(line: str, seen: dict[str, int | None]) -> int | None:
    """The hash of the key of ``line``, None without letters."""
    if len(line) >= LONG:
        return hash64(key) if (key := line_key(line)) else None
    if line in seen:
        return seen[line]
    if len(seen) > 100_000:
        seen.clear()
    h = seen[line] = hash64(key) if (key := line_key(line)) else None
    return h


def _known(word: str, seen: dict[str, int]) -> int:
    h = seen.get(word)
    if h is None:
        if len(seen) > 100_000:
            seen.clear()
        h = seen[word] = first_word(line_key(word))
    return h


def _furniture_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((rid, i) for rid, _lines, flags, _domain in marked(batches) for i, flag in enumerate(flags, 1) if flag)
    return rows_to_batches(rows, pa.schema([("result_id", pa.int64()), ("line_no", pa.int32())]))


def furniture_lines(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, line_no) of every line that is furniture.

    A null text has none, nor has an empty one; a host with few pages is judged by
    form and announcements alone; an empty table gives no rows.
    """
    return page_nodes(conversions, pages).mapInArrow(_furniture_rows, "result_id long, line_no int")


def main_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], str]]:
    """result_id, the lines of the main text, and domain of each row of ``page_nodes``."""
    for rid, lines, flags, domain in marked(batches):
        yield rid, [line for line, flag in zip(lines, flags) if not flag], domain


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((rid, "\n".join(lines)) for rid, lines, _domain in main_lines(batches))
    return rows_to_batches(rows, pa.schema([("result_id", pa.int64()), ("main_text", pa.string())]), 500)


def main_texts(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, main_text): each text without its furniture lines."""
    return page_nodes(conversions, pages).mapInArrow(_bodies, "result_id long, main_text string")
