"""Announcements are told by all pages that have them, not by a few of each host."""

import random

from pyspark.sql import functions as F

from leafmill.llm import main_text, near_duplicates, quality

HOSTS, PAGES = 4, 140
PROMPTS = ["Please tell your friends about these pages", "Our readers may write to us here", "Kindly support the work of this house"]


def text(rng, sentences=10, words=9):
    return " ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(words)) + "." for _ in range(sentences))


def large_hosts(spark, first, second, bodies=()):
    """Results of ``HOSTS`` hosts. On each, the pages that come first by a hash of their result_id have the prompts: ``first``
    and ``second``, numbers of pages with one article ("copied") or different ones ("own"), and a page for each of ``bodies``."""
    rng = random.Random(4)
    one, rows, at = text(rng), [], {}
    plan = [kind for kind, n in (first, second) for _ in range(n)] + list(range(len(bodies)))
    for n, (i,) in enumerate(spark.range(HOSTS * PAGES).orderBy(F.xxhash64("id")).collect()):
        place, host = divmod(n, HOSTS)
        kind = plan[place] if place < len(plan) else None
        title = f"# {text(rng, 1, 3)[:-1]}\n\n"
        md = {"copied": title + one, "own": title + text(rng), None: title + text(rng, 1)}.get(kind) or bodies[kind]
        if kind is not None:
            md += "\n\n" + "\n\n".join(PROMPTS)
        if isinstance(kind, int):
            at[i] = kind
        rows.append((i, f"https://h{host}.com/{i}", md, f"h{host}.com"))
    c = spark.createDataFrame([r[:3] for r in rows], "result_id long, url string, md_content string")
    p = spark.createDataFrame([(u, d, "html") for _, u, _, d in rows], "url string, domain string, content_type string")
    return c, p, at


def prompts_found(c, p):
    lines = {(i, n): x for i, md in c.select("result_id", "md_content").collect() for n, x in enumerate(md.split("\n"), 1)}
    found = {(r["result_id"], r["line_no"]) for r in main_text.furniture_lines(c, p).collect()}
    assert all(lines[k] in PROMPTS for k in found)
    return found == {k for k, x in lines.items() if x in PROMPTS}, len(found)


def test_announcements_are_told_by_all_pages(spark):
    """Beside different articles they are furniture though four pages of each host are copies; beside copies of one article
    they are not though four pages of each host differ."""
    assert prompts_found(*large_hosts(spark, ("copied", 4), ("own", 9))[:2]) == (True, HOSTS * 13 * len(PROMPTS))
    assert prompts_found(*large_hosts(spark, ("own", 4), ("copied", 12))[:2]) == (False, 0)


def test_residue_under_announcements(spark):
    """p3: filler is the whole body, whatever announcements stand under it."""
    filler = "# Vorel\n\nLorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut."
    c, p, at = large_hosts(spark, ("copied", 4), ("own", 9), [filler])
    found = {r["result_id"] for r in quality.residue_results(c, p).collect()}
    assert len(at) == HOSTS and set(at) == found


def test_pairs_without_announcements(spark):
    """p5: texts that have 80 words only with the announcements under them are too short for a link."""
    c, p, at = large_hosts(spark, ("copied", 4), ("own", 9), [text(random.Random(6), 7, 10)])
    pairs = [tuple(r) for r in near_duplicates.linked_pairs(c, p).collect()]
    assert pairs and len(at) == HOSTS and not any(a in at or b in at for a, b in pairs)


def test_a_list_under_announcements(spark):
    """p6: a list is the whole body, whatever announcements stand under it."""
    c, p, at = large_hosts(spark, ("copied", 4), ("own", 9), ["\n".join(f"- {text(random.Random(i), 1, 3)[:-1]}" for i in range(6))])
    kinds = {r["result_id"]: r["body_kind"] for r in quality.not_prose(c, p).collect()}
    assert len(at) == HOSTS and {kinds.get(i) for i in at} == {"list"}
