"""Problems 1, 2, 7: lines, pieces and main text."""

import random

import pytest

from leafmill.llm import corpus, main_text, pieces, repeated_lines
from leafmill.llm.corpus import line_key, places

CONV = "result_id long, url string, md_content string, word_count long, domain string"
PAGE = "url string, domain string, content_type string, md_content string"


def tables(spark, rows, extra=()):
    """Conversions with a column that clashes with one of pages, and the other way round; every row twice."""
    c = spark.createDataFrame([(i, u, t, 0, "clash") for i, (u, _d, t) in enumerate(rows)] * 2 + [(None, "u", "x", 0, "c"), (9999, None, None, None, None), *extra], CONV)
    p = spark.createDataFrame([*{(u, d, "html", "clash") for u, d, _t in rows if d}], PAGE)
    return c, p


def brute_lines(rows, one_of=5, least=5):
    by = {}
    for i, (_u, d, t) in enumerate(rows):
        if t is not None and d:
            by.setdefault(d, {})[i] = t.split("\n")
    out = set()
    for docs in by.values():
        seen = {}
        for i, lines in docs.items():
            for key in {line_key(x) for x in lines} - {""}:
                seen.setdefault(key, set()).add(i)
        for i, lines in docs.items():
            out |= {(i, n) for n, x in enumerate(lines, 1) if len(seen.get(line_key(x), ())) >= least and len(seen[line_key(x)]) * one_of >= len(docs)}
    return out


def site(n_hot=40, n_cold=12):
    rng = random.Random(1)
    rows = []
    for i in range(n_hot + n_cold):
        domain = "hot.com" if i < n_hot else f"s{i % 2}.org"
        lines = [f"Own {rng.random()} words a{i}", "SHARE this: now!" if i % 3 else "- share  this now", "", "12 34", f"{i} comments", "Nur ²³ Zeichen" if i % 4 == 0 else "x²y"]
        rng.shuffle(lines)
        rows.append((f"https://{domain}/{i}", domain, "\n".join(lines * (1 + i % 2))))
    return [*rows, ("https://hot.com/null", "hot.com", None), ("https://hot.com/empty", "hot.com", ""), ("https://hot.com/long", "hot.com", "word " * 200_000 + "\nshare this now")]


def test_line_key():
    assert line_key("  Ünï-code 12 x_y ²z") == "ünï code x y z" and line_key("12 – ²") == ""


def test_excessive_lines_equal_brute_force(spark):
    rows = site()
    c, p = tables(spark, rows)
    found = [tuple(r) for r in repeated_lines.excessive_lines(c, p).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_lines(rows)
    kept = {r["result_id"]: r["md_content"] for r in repeated_lines.without_lines(c, repeated_lines.excessive_lines(c, p)).collect()}
    gone = brute_lines(rows)
    for i, (_u, _d, t) in enumerate(rows):
        assert kept[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone))


def test_templates_merge_across_tasks(spark):
    rows = [(f"https://a.com/{i}", "a.com", f"posted by name{'abcdefghij'[i % 10]} here\nfixed words stay") for i in range(30)]
    c, p = tables(spark, rows)
    trees = repeated_lines.token_trees(c.repartition(5), repeated_lines.places(c, p))
    merged = {r["template"]: r["covered"] for r in repeated_lines.merged_templates(trees).collect()}
    assert merged == {"posted by <*> here": 30, "fixed words stay": 30}


@pytest.mark.parametrize("operator", [repeated_lines.excessive_lines, main_text.furniture_lines, main_text.main_texts])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], CONV), spark.createDataFrame([], PAGE)).count() == 0


def test_pieces_keep_the_text_and_the_limits():
    rng = random.Random(2)
    for n in (0, 1, 1200, 1201, 5000, 30_000):
        for alphabet in ("word. another\n\nline\n ", "x", "日本語。"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            cut, _ = pieces.split_text(text)
            assert "".join(text[new:end] for _a, new, end in cut) == text
            assert all(end - a <= 1200 and (new - a == 200 or new == 0) for a, new, end in cut)


def test_cuts_are_natural_and_local():
    rng = random.Random(4)
    text = "\n\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(10, 60))) + "." for _ in range(60))
    cuts = pieces.cuts(text)
    assert all(text[:c].endswith("\n\n") for c in cuts)
    edited = text[:3000] + "inserted words " + text[3000:]
    same = {c for c in cuts if c > 8000} & {c - 15 for c in pieces.cuts(edited)}
    assert len(same) >= 0.9 * sum(c > 8000 for c in cuts)


def test_oversized_blocks(spark):
    big = "y" * 1201
    c = spark.createDataFrame([(1, f"a\n \n{big}\n\xa0\n" + "z" * 1200), (1, f"a\n \n{big}\n\xa0\n" + "z" * 1200), (2, "x" * 600 + "\n" + "x" * 600), (3, None), (4, ""), (None, big), (5, "é" * 1200)], "result_id long, md_content string")
    assert {tuple(r) for r in pieces.oversized_blocks(c).collect()} == {(1, 2), (2, 1)}
    rows = pieces.pieces(c).collect()
    assert {r["result_id"] for r in rows} == {1, 2, 5} and len([r for r in rows if r["result_id"] == 5]) == 1
    assert pieces.pieces(c.limit(0)).count() == 0


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(7))


def page_of(i, body):
    a, b, c = (word(random.Random(1000 * i + k)) for k in range(3))
    return f"Home | About | Jobs | Shop\n\n# Title {a} of its own\n\nBy Ann Lee{i}, {1 + i % 28} May 2020\n\n{body}\n\nRead also\nThe other title {b}\n- And one more {c}\n\n{i} comments\n\n(c) Site 2020"


def prose(i):
    rng = random.Random(i)
    nouns = [word(rng) for _ in range(8)]
    return "\n\n".join(" ".join(f"The {n} number went to the place and saw the thing there." for n in nouns[k : k + 3]) for k in (0, 3, 5))


def test_furniture(spark):
    rows = [(f"https://a.com/{i}", "a.com", page_of(i, prose(i))) for i in range(40)]
    c, p = tables(spark, rows)
    flagged = {}
    for r in main_text.furniture_lines(c, p).collect():
        flagged.setdefault(r["result_id"], set()).add(r["line_no"])
    for i, (_u, _d, t) in enumerate(rows):
        lines = t.split("\n")
        expected = {n for n, x in enumerate(lines, 1) if x and (x.startswith("The other title") or not x.startswith(("# Title", "The ")))}
        assert flagged[i] == expected
    bodies = {r["result_id"]: r["main_text"] for r in main_text.main_texts(c, p).collect()}
    assert all(len(b.split("\n")) < 25 for b in bodies.values()) and 9999 not in bodies


def test_furniture_of_pdfs():
    lines = ["# Title words here", "", "Running text that goes on", "and on in lines.", "", "SITE", "- 1 -", "", "More running text.", "", "SITE", "- 2 -", "", "Page 3 of 7", "", "Title words he 4", "", "Ends here."]
    flags = main_text.furniture(lines, {}, "pdf")
    assert [i for i, f in enumerate(flags) if f] == [5, 6, 10, 11, 13, 15]


def test_forms():
    for line in ("Home > News > A title", "← Older page title", "By Ann Lee, 3 May 2020", "2020-01-02 Staff", "Words: A B. March 2021", "Filed  under one, two, three"):
        assert main_text.furniture(["# T", "", line], {}, "html") == [False, False, True], line
    for line in ("The visit of 3 May 2020 was long and it went well.", "| a | b | c |", "## From May to June", "1. item of May 2020", "```\na, b, c\n```", "One word"):
        assert not any(main_text.furniture(["# T", "", *line.split("\n")], {}, "html")), line


def test_places(spark):
    c = spark.createDataFrame([(1, "https://www.a.com/x", "t"), (2, "https://b.org/y", "t"), (3, None, "t"), (4, "https://a.com/z", None), (5, "https://c.net/1", "t"), (5, "https://c.net/1", "t")], "result_id long, url string, md_content string")
    p = spark.createDataFrame([("https://b.org/y", "known.org", "pdf"), ("https://c.net/1", None, None), (None, "x", "html"), ("https://b.org/y", "known.org", "pdf")], "url string, domain string, content_type string")
    got = {r["result_id"]: (r["domain"], r["content_type"], r["n_domain"]) for r in places(c, p).collect()}
    assert got == {1: ("a.com", "html", 1), 2: ("known.org", "pdf", 1), 3: ("", "html", 1), 5: ("c.net", "html", 1)}


def test_a_row_delivered_over_and_over(spark, monkeypatch):
    monkeypatch.setattr(corpus, "REPEATS", 5)
    rows = site()
    c, p = tables(spark, rows)
    hot = c.where("result_id = 3")
    for _ in range(4):
        hot = hot.unionByName(hot)
    many = c.unionByName(hot)
    assert corpus.settled(c, "result_id").count() == c.count()
    assert corpus.settled(many, "result_id").where("result_id = 3").count() == 1
    assert sorted(map(tuple, repeated_lines.excessive_lines(many, p).collect())) == sorted(brute_lines(rows))


def tree_of(text):
    """A page as its blocks of line keys."""
    blocks = [[]]
    for line in text.split("\n"):
        if line.strip():
            blocks[-1].append(line_key(line))
        elif blocks[-1]:
            blocks.append([])
    return [b for b in blocks if b]


def common(a, b, weight):
    """Greatest total weight of an alignment of two sequences that keeps their order, and its pairs."""
    best = [[(0, ()) for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            w = weight(x, y)
            taken = (best[i - 1][j - 1][0] + w, (*best[i - 1][j - 1][1], (i - 1, j - 1))) if w else (0, ())
            best[i][j] = max(best[i - 1][j], best[i][j - 1], taken, key=lambda t: t[0])
    return best[-1][-1]


def simple_tree_match(a, b):
    """Keys of the nodes that simple tree matching pairs in two pages."""
    same = lambda x, y: int(x == y and x != "")
    lines = lambda x, y: common(x, y, same)
    _, pairs = common(a, b, lambda x, y: (n + 1 if (n := lines(x, y)[0]) else 0))
    return {a[i][k] for i, j in pairs for k, _ in lines(a[i], b[j])[1]}


def test_counting_finds_what_tree_matching_finds(spark):
    rows = [(f"https://a.com/{i}", "a.com", page_of(i, prose(i))) for i in range(12)]
    trees = [tree_of(t) for _u, _d, t in rows]
    matched = set().union(*(simple_tree_match(trees[i], trees[j]) for i in range(12) for j in range(i)))
    c, p = tables(spark, rows)
    where = corpus.places(c, p)
    counted = main_text.template_nodes(c, where).where("domain = 'a.com'").first()["constant"]
    assert {corpus.hash64(k) for k in matched} == set(counted)


def test_copies_of_an_article_are_no_announcement(spark):
    """Lines of one article on 50 hosts stay, with small differences too; a prompt beside different articles goes."""
    line, prompt = "The quiet river kept its own slow counsel", "Please tell your friends about these pages"
    rng = random.Random(8)
    text = lambda: " ".join(" ".join(word(rng) for _ in range(9)) + "." for _ in range(10))
    rows, article = [], text()
    for i in range(50):
        words = article.split(" ")
        for k in range(len(words)):
            if rng.random() < 0.03:
                words[k] = word(rng)
        rows.append((f"https://copy{i}.com/a", f"copy{i}.com", f"# Title\n\n{line}\n\n" + " ".join(words)))
        rows.append((f"https://own{i}.com/a", f"own{i}.com", f"# Title {word(rng)}\n\n{text()}\n\n{prompt}"))
    c, p = tables(spark, rows)
    found = {(r["result_id"], r["line_no"]) for r in main_text.furniture_lines(c, p).collect()}
    lines = {(i, n): x for i, (_u, _d, t) in enumerate(rows) for n, x in enumerate(t.split("\n"), 1)}
    assert {k for k, x in lines.items() if x == prompt} == found


def test_rows_of_one_key_that_differ(spark, monkeypatch):
    """Exact repeats drop, however many there are; different texts under one key all count."""
    from leafmill.llm import tokens

    rows = [(1, "one text"), (1, "one text"), (1, "another text"), (2, "one text")]
    items = spark.createDataFrame(rows, "result_id long, md_content string")
    docs = items.toDF("doc_id", "text")
    for repeats in (1000, 1):
        monkeypatch.setattr(corpus, "REPEATS", repeats)
        assert sorted((r["result_id"], r["piece"]) for r in pieces.pieces(items).collect()) == [(1, "another text"), (1, "one text"), (2, "one text")]
        assert sorted(r["doc_id"] for r in tokens.token_ids(docs).collect()) == [1, 1, 2]
        assert corpus.settled(items, "result_id").where("result_id = 1").count() == (3 if repeats == 1000 else 2)


def test_announcements_of_few_pages_of_a_large_host(spark, monkeypatch):
    """They are kept by page instead of by host, and found as well."""
    prompt, rng = "Please tell your friends about these pages", random.Random(1)
    rows = [(f"https://h{i % 6}.com/{i}", f"h{i % 6}.com", f"# {word(rng)} {word(rng)} {word(rng)}\n\n{prose(i)}" + (f"\n\n{prompt}" if i % 5 == 0 else "")) for i in range(60)]
    c, p = tables(spark, rows)
    found = sorted(map(tuple, main_text.furniture_lines(c, p).collect()))
    monkeypatch.setattr(main_text, "WIDE", 2)
    assert sorted(map(tuple, main_text.furniture_lines(c, p).collect())) == found
    assert {r for r, _ in found} == {i for i in range(60) if i % 5 == 0}
