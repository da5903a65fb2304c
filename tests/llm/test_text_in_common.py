"""What pages have in common is counted over all their text, not estimated from a few drawn values of it."""

import random

import pytest
from leafmill.llm import main_text, near_duplicates, quality

HOSTS, PAGES = 8, 2
PROMPTS = ["Please tell your friends about these pages", "Our readers may write to us here"]


def paragraphs(rng, n):
    return [" ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(10)) + "." for _ in range(2)) for _ in range(n)]


def pages_with(spark, seed, passage, own, extra=()):
    """Pages of ``passage`` paragraphs that all have and ``own`` ones, and a page for each of ``extra``, with the prompts under them."""
    rng = random.Random(seed)
    one = paragraphs(rng, passage)
    bodies = [[*one, *paragraphs(rng, own)] for _ in range(HOSTS * PAGES)] + list(extra)
    rows = [(i, f"https://h{i % HOSTS}.com/{i}", "\n\n".join(["# Vorel", *body, *PROMPTS]), f"h{i % HOSTS}.com") for i, body in enumerate(bodies)]
    c = spark.createDataFrame([r[:3] for r in rows], "result_id long, url string, md_content string")
    p = spark.createDataFrame([(u, d, "html") for _, u, _, d in rows], "url string, domain string, content_type string")
    return c, p


def prompts_found(c, p):
    lines = {(i, n): x for i, md in c.select("result_id", "md_content").collect() for n, x in enumerate(md.split("\n"), 1)}
    return {lines[tuple(r)] for r in main_text.furniture_lines(c, p).collect()}


@pytest.mark.parametrize("passage, own, seed, found", [(9, 6, 65, False), (2, 13, 37, True)])
def test_pages_that_have_part_of_their_text_in_common(spark, passage, own, seed, found):
    """p7: prompts under pages of which 9 paragraphs of 15 are the same are none of the page's, those under pages that have 2 of 15 in common are."""
    assert prompts_found(*pages_with(spark, seed, passage, own)) == (set(PROMPTS) if found else set())


def different(spark, extra):
    """Pages with the prompts that have 2 paragraphs of 15 in common, and ``extra`` ones; result_ids of these."""
    c, p = pages_with(spark, 37, 2, 13, extra)
    return c, p, set(range(HOSTS * PAGES, HOSTS * PAGES + len(extra)))


def test_short_texts_over_prompts(spark):
    """p5: texts of 75 words have 80 only with the prompts under them, and no link."""
    text = " ".join("".join(random.Random(i).choice("abcdefgh") for _ in range(7)) for i in range(75))
    c, p, ids = different(spark, [[text], [text]])
    pairs = {tuple(r) for r in near_duplicates.linked_pairs(c, p).collect()}
    assert not any(ids & set(pair) for pair in pairs)


def test_a_list_over_prompts(spark):
    """p6: a list is the whole body."""
    c, p, ids = different(spark, [[f"- {'abcdefg'[i:]} word{'abcdefg'[:i]} name" for i in range(4)]])
    assert {r["body_kind"] for r in quality.not_prose(c, p).collect() if r["result_id"] in ids} == {"list"}


def test_filler_over_prompts(spark):
    """p3: filler is the whole body."""
    c, p, ids = different(spark, [["Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod."]])
    assert ids <= {r["result_id"] for r in quality.residue_results(c, p).collect()}
