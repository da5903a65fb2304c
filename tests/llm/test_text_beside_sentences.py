"""What the pages of a message have in common beside it is counted over all their text, not estimated from a few drawn values of it."""

import random

import pytest
from leafmill.llm import bodies, quality

HOSTS = 12


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))


def notices(spark, line, extra=()):
    """Pages of twelve hosts, each of a notice that all have, a sentence that all have, and one of its own: beside the notice
    half of a page's text is on the others, a third of the text of both. ``line`` makes a page of these."""
    rng = random.Random(1166)
    notice, again = sentence(rng, 16), sentence(rng, 8)
    rows = [(i, f"https://h{i}.com/a", line([notice, again, sentence(rng, 8)])) for i in range(HOSTS)]
    c = spark.createDataFrame([*rows, *extra], "result_id long, url string, md_content string")
    p = spark.createDataFrame([(u, u.split("/")[2], "html") for _, u, _ in rows], "url string, domain string, content_type string")
    return c, p


def prose(sentences):
    return " ".join(s.capitalize() + "." for s in sentences)


def test_notices_with_part_of_their_text_in_common(spark):
    """p3: the pages of a notice that have part of their text in common are no copies of an article."""
    found = {r["result_id"] for r in quality.residue_results(*notices(spark, prose)).collect()}
    assert found == set(range(HOSTS))


def test_a_result_with_two_texts(spark):
    """p3: a result whose other text has no notice is judged, too."""
    rng = random.Random(1)
    c, p = notices(spark, prose, [(0, "https://h0.com/a", prose(sentence(rng, 12) for _ in range(3)))])
    assert set(range(1, HOSTS)) <= {r["result_id"] for r in quality.residue_results(c, p).collect()}


def test_lists_of_notices_with_part_of_their_text_in_common(spark):
    """p6: a list whose items are a notice, with part of their text in common, is residue, and so none of the lists."""
    rng = random.Random(2)
    names = "\n".join(f"- {sentence(rng, 4).capitalize()}" for _ in range(5))
    c, p = notices(spark, lambda sentences: "\n".join(f"- {s.capitalize()}" for s in sentences), [(HOSTS, "https://h0.com/b", names)])
    assert [tuple(r) for r in quality.not_prose(c, p).collect()] == [(HOSTS, "list")]


def share_in_common(pages):
    """Text of two of ``pages`` (phrases and their words) that is in both, as a share of all their text, each page weighing by the last value of it."""
    common = weight = 0
    for i, (one, size) in enumerate(pages):
        for j, (other, _) in enumerate(pages):
            if i != j:
                common += sum(one[x] for x in one.keys() & other.keys()) / size
                weight += sum(one.values()) / size
    return common / (2 * weight - common)


@pytest.mark.parametrize("seed", [1, 2])
def test_share_of_text_in_common(spark, seed):
    """Counting phrases for each set of pages gives what comparing all pairs of pages gives."""
    rng = random.Random(seed)
    words = {i: rng.randint(1, 5) for i in range(60)}
    own = {k: range(3 * k, 3 * k + 3) for k in range(4)}  # phrases of four sentences
    on = {0: range(9), 1: range(9), 2: range(5), 3: range(4, 9)}
    texts = {p: {x for k in on if p in on[k] for x in own[k]} | set(rng.sample(range(12, 60), rng.randint(4, 20))) for p in range(9)}
    sizes = {p: sum(words[x] for x in t) for p, t in texts.items()}
    whole = spark.createDataFrame([(p, sorted(t), [words[x] for x in sorted(t)]) for p, t in texts.items()], "page long, phrases array<long>, sizes array<int>")
    held = spark.createDataFrame([(k, p, sizes[p], sum(words[x] for x in own[k])) for k in on for p in on[k]], "key long, page long, whole long, own long")
    found = {r["key"]: r["alike"] for r in bodies.sentence_resemblance(held, whole).collect()}
    beside = lambda p, without: {x: words[x] for x in texts[p] if x not in without}
    assert found == pytest.approx({k: share_in_common([(beside(p, own[k]), sizes[p]) for p in on[k]]) for k in on}, abs=1e-8)
    parts = spark.createDataFrame([(f"t{k // 2}", p, sizes[p], list(own[k]), [words[x] for x in own[k]]) for k in on for p in on[k]], "template string, page long, whole long, phrases array<long>, sizes array<int>")
    found = {r["template"]: r["alike"] for r in bodies.template_resemblance(parts, whole).collect()}
    without = {t: {p: {x for k in on if k // 2 == t and p in on[k] for x in own[k]} for k in on if k // 2 == t for p in on[k]} for t in (0, 1)}
    rest = {t: [beside(p, x) for p, x in of.items()] for t, of in without.items()}
    assert found == pytest.approx({f"t{t}": share_in_common([(r, sum(r.values())) for r in of]) for t, of in rest.items()}, abs=1e-8)
