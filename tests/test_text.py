import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import html, markdown
from leafmill.functions.chunks import chunk_markdown, chunked, located, strip_breadcrumb
from leafmill.functions.links import anchors, extract_urls
from leafmill.functions.text import replace_first, strip, word_count
from leafmill.operators.parse import parsed, recorded
from leafmill.schema import PAGES


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1).orderBy("i")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_small_expressions(spark):
    assert one(spark, word_count, "café naïve über x_1", "", None, "①2") == [4, 0, 0, 1]
    assert one(spark, strip, "  a b \n", "") == ["a b", ""]
    assert one(spark, lambda c: replace_first(c, "(a)(b)", "$2$1"), "xababx", "none", None) == ["xbaabx", "none", None]


def test_links_of_notes(spark):
    cases = {
        "[a](https://e.com/x)seasonal": ["https://e.com/x"],
        "[a [b]](https://e.com/L_(m))": ["https://e.com/L_(m)"],
        "see https://e.com/a. And (https://e.com/b).": ["https://e.com/a", "https://e.com/b"],
        "https://e.com/L_(m))": ["https://e.com/L_(m)"],
        "https://a.com/1https://b.com/2": ["https://a.com/1", "https://b.com/2"],
        "https://a.com/?u=https://b.com/2": ["https://a.com/?u=https://b.com/2"],
        "https://b.com [x](https://a.com)": ["https://a.com", "https://b.com"],
        '[t](https://x.com "title")': [],
        "": [],
    }
    assert one(spark, extract_urls, *cases, None) == [*cases.values(), []]


def test_anchors():
    page = '<a href="/a">x</a><a href="b">y</a><a href="mailto:x@y.z">m</a><a href="javascript:0">j</a><a href="/a">x</a><a href="https://o.org/p.pdf">p</a><a href="https://[">'
    assert anchors(page, "https://e.com/d/") == ["https://e.com/a", "https://e.com/d/b", "https://o.org/p.pdf"]


def python_clean(text):
    for _step, pattern, by in markdown.REWRITES:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    return text


def test_clean_markdown(spark):
    cases = ["`a` **b** *c* __d__ _e_ ***f*** **_g_**", "2 * 3 * 4", "data:If U.S.A Node.JS", "- \n1. \n* x\n-  : y\n1. 2. 3. z", "a () [ ] )x\n)y", "(())", "*a\nb*", "é*a*é *ü*", "", "x y**z**"]
    assert one(spark, markdown.clean_markdown, *cases) == [python_clean(c) for c in cases]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="*_`ab .:A\n-1()[]é", max_size=40), min_size=20, max_size=20))
def test_clean_markdown_random(spark, texts):
    assert one(spark, markdown.clean_markdown, *texts) == [python_clean(t) for t in texts]


def page(title, body="x" * 600):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def test_validity_and_title(spark):
    got = one(spark, html.check_html, page("Article"), page(" Just a moment... "), "x" * 511, "x" * 512, page("a", "cf_chl_opt" + "x" * 600), page("a", "x" * 5000 + "cf_chl_opt"), None)
    assert got == [None, "block page (title: 'Just a moment...')", "html suspiciously small (511 bytes)", None, "block page (marker: 'cf_chl_opt')", None, None]
    assert one(spark, html.title, page(" A &amp; B\n"), page(" "), "<p>") == ["A &amp; B", None, None]
    assert one(spark, html.fetch_error, "net::ERR_NAME_NOT_RESOLVED at x\ny", "Timeout 30", "odd\nmore") == ["DNS resolution failed", "timeout", "odd"]


def test_html_to_markdown():
    md = html.markdown_of(
        "<head><title>t</title></head><nav>menu</nav><h1>Top</h1><p>One <a href='x'>two</a> &amp; three.</p><p>One <a href='y'>two</a> &amp; three.</p>"
        "<h2>Sub <span class='mw-editsection'>[edit]</span></h2><ul><li>a</li><li>b</li></ul><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><pre>code()</pre><script>if (a<b) x</script>"
    )
    assert md == "# Top\n\nOne two & three.\n\n## Sub\n\n- a\n- b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |"
    assert "code()" in html.markdown_of("<pre>code()</pre>", code=True) and html.markdown_of("<nav>x</nav>") is None


def test_parse_stage(spark):
    body = "".join(f"<p>Paragraph {i} has words of its own kind.</p>" for i in range(40))
    raw = spark.createDataFrame([("a", "html", page("A", body)), ("b", "html", page("Access denied")), ("c", "html", "plain **text**"), ("d", "html", page("D", "<p>few words</p>" + " " * 600))], "slug string, content_type string, html string")
    blank = {f: None for f in PAGES.names}
    pages = spark.createDataFrame([blank | {"url": f"https://e.com/{s}{'.md' if s == 'c' else ''}", "slug": s, "content_type": "html", "fetched_at": "2026"} for s in "abcde"], PAGES)
    rows = {r["slug"]: r for r in parsed(pages, raw).collect()}
    assert rows["a"]["word_count"] == 320 and rows["a"]["title"] == "A" and rows["a"]["fail_reason"] is None
    assert rows["b"]["fail_reason"] == "block page (title: 'Access denied')" and rows["b"]["markdown"] is None
    assert rows["c"]["markdown"] == "plain **text**"
    assert rows["d"]["fail_reason"].startswith("too short (2 words < 50, from ") and rows["e"]["fail_reason"] == "raw file missing on disk (html)"
    after = {r["slug"]: r for r in recorded(pages, parsed(pages, raw), "2027").collect()}
    assert after["a"]["parsed_at"] == "2027" and after["b"]["parsed_at"] is None and after["b"]["fail_reason"].startswith("block page")


def test_chunks():
    chunks = chunk_markdown("intro\n\n# Top\nbody\n\n## Sub\n```\n# no heading\n```\n| a |\n| - |\n\n![alt](i.png)\n![](j.png)\n", "notes/Doc.md")
    assert [(c["heading"], c["text"].split("\n\n", 1)[1], c["line"]) for c in chunks] == [
        ("Doc", "intro", 1), ("Doc > Top", "body", 4), ("Doc > Top > Sub", "# no heading", 8), ("Doc > Top > Sub", "| a |\n| - |", 10), ("Doc > Top > Sub", "alt", 13)]
    assert chunk_markdown("# doc\nx", "doc.md")[0]["heading"] == "doc" and chunk_markdown("", "a.md") == []
    long = chunk_markdown("\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(30)), "l.md")
    assert len(long) > 1 and [c["line"] for c in long] == sorted({c["line"] for c in long})
    own = [c["text"].removeprefix("l\n\n") for c in long]
    assert max(map(len, own)) <= 1400 and all(b.startswith(a[-150:].strip()[:20]) or a[-200:].strip()[:20] in b for a, b in zip(own, own[1:]))


def test_chunked_and_display(spark):
    docs = spark.createDataFrame([("# A\nx", "a.md"), (None, "b.md"), (" ", "c.md")], "text string, file_path string")
    rows = chunked(docs).collect()
    assert len(rows) == 1 and len(rows[0]["id"]) == 64
    df = spark.createDataFrame([("h\n\nt", "h", "p", 3), ("t", "", "p", None)], "t string, h string, p string, l int")
    assert [tuple(r) for r in df.select(strip_breadcrumb(F.col("t"), F.col("h")), located(F.col("p"), F.col("l"))).collect()] == [("t", "p:3"), ("t", "p")]
