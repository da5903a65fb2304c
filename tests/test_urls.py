import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import urls, urlspec
from leafmill.operators.verdicts import registered, with_verdict
from leafmill.sources.rules import Rule, Action, java_replacement, load_rules, parse_rules


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(f(F.col("u"))).collect()]


CANONICAL = {
    "https://www.example.com/post/": "https://example.com/post",
    "https://example.com": "https://example.com/",
    "https://example.com/": "https://example.com/",
    "https://example.com//": "https://example.com/",
    "https://example.com:443/a": "https://example.com/a",
    "https://example.com:8443/a": "https://example.com:8443/a",
    "https://example.com/x?b=2&a=1": "https://example.com/x?a=1&b=2",
    "https://example.com/x?id=42&utm_campaign=x&FBCLID=abc": "https://example.com/x?id=42",
    "https://example.com/x?a=&b": "https://example.com/x?a=&b=",
    "https://user:pw@example.com/a": "https://example.com/a",
    "https://example.com/x?q=a+b~*": "https://example.com/x?q=a+b~%2A",
    "https://example.com/x?a=b&a=a": "https://example.com/x?a=a&a=b",
    "https://example.com:port/a": "https://example.com:port/a",
    "https://example.com/x?ref=1#top": "https://example.com/x?ref=1",
    "https://example.com/caf%c3%a9": "https://example.com/caf%C3%A9",
    "https://example.com/café": "https://example.com/caf%C3%A9",
    "https://www.www.example.com/": "https://www.example.com/",
}


def test_canonical_expression_and_spec_agree(spark):
    df = spark.createDataFrame([(u,) for u in CANONICAL], "u string")
    got = {r["u"]: r["c"] for r in urls.with_canonical(df, "u", "c").collect()}
    assert got == CANONICAL
    for u, c in CANONICAL.items():
        assert urlspec.canonical(u) == c


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/?=&#%:.@[]é 1", max_size=30))
def test_canonical_never_raises_and_is_stable(rest):
    once = urlspec.canonical("https://example.com/" + rest)
    assert urlspec.canonical(once) == urlspec.canonical(once)


def test_random_plain_urls_agree_with_the_spec(spark):
    import random

    rng = random.Random(3)
    made = ["https://" + rng.choice(["", "www.", "m."]) + "example.org" + rng.choice(["", ":443", ":81"]) + "".join("/" + rng.choice(["a", "b-c", "x.html", ""]) for _ in range(rng.randint(0, 4)))
            + rng.choice(["", "?" + "&".join(rng.choice(["a", "b", "utm_x", "gclid", "z~"]) + rng.choice(["", "=", "=1", "=a*b", "=x y".replace(" ", "+")]) for _ in range(rng.randint(0, 4)))]) for _ in range(300)]
    df = spark.createDataFrame([(u,) for u in made], "u string")
    for r in urls.with_canonical(df, "u", "c").collect():
        assert r["c"] == urlspec.canonical(r["u"]), r["u"]


def test_domains_and_slugs(spark):
    cases = {
        "https://api.example.com/x": "example.com",
        "https://a.b.example.co.uk/": "example.co.uk",
        "https://co.uk/": "co.uk",
        "https://192.168.2.13/a": "192.168.2.13",
        "https://localhost:8080/a": "localhost:8080",
        "https://www.Example.com": "example.com",
        "nothing": "",
    }
    assert column(spark, cases, urls.domain_for_url) == list(cases.values())
    slug = column(spark, ["https://example.com/a", "nothing"], urls.slug_for_url)
    assert re.fullmatch(r"example\.com-[0-9a-f]{16}", slug[0]) and slug[1].startswith("unknown-")


def test_routes(spark):
    u = ["https://x.org/a.PDF", "https://x.org/pdf/1", "https://x.org/pdf/", "https://x.org/a/pdf/b", "https://x.org/a.md?x=.pdf", None]
    assert column(spark, u, urls.is_pdf_url) == [True, True, False, False, False, None]
    assert column(spark, u, urls.is_raw_text_url) == [False, False, False, False, True, None]


RULES = parse_rules(
    r"""
[[rule]]
name = "first"
type = "regex"
match = '^https://code\.example/[^/]+/[^/]+/blob/(?!.*\.md$)'
  [[rule.action]]
  type = "regex_replace"
  pattern = '^https://code\.example/(?P<a>[^/]+)/([^/]+)/.*'
  replacement = "https://code.example/$1/${2}"
[[rule]]
name = "mirror"
type = "domain"
match = "paywall.com"
  [[rule.action]]
  type = "prepend"
  text = "https://mirror.net/"
[[rule]]
name = "skip"
type = "host"
match = "tube.com"
  [[rule.action]]
  type = "skip"
[[rule]]
name = "no actions"
type = "host"
match = "x.com"
[[rule]]
name = "broken"
type = "regex"
match = "("
  [[rule.action]]
  type = "skip"
[[rule]]
name = "literal"
type = "starts_with"
match = "https://lit.com/a"
  [[rule.action]]
  type = "replace"
  old = "a"
  new = "b"
  [[rule.action]]
  type = "regex_replace"
  pattern = "("
  replacement = "x"
"""
)


def verdicts(spark, *given):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string")
    return [tuple(r)[2:] for r in with_verdict(df, "u", RULES).orderBy("i").collect()]


def test_verdicts(spark):
    assert [r.name for r in RULES] == ["first", "mirror", "skip", "broken", "literal"]
    got = verdicts(
        spark,
        "http://example.com", None, "https://", "https://[", "https://Example.com/photo.PNG", "https://a.com/_next/image?u=1", "https://10.0.0.1:8/x",
        "https://localhost:8080/", "https://example.com/a#b", "https://code.example/o/r/blob/main/x.py", "https://code.example/o/r/blob/main/x.md",
        "https://blog.paywall.com/p", "https://tube.com/v", "https://www.tube.com/v", "https://lit.com/aa", "https://www.example.com/x/?utm_source=a",
    )
    skip = lambda reason, rule=None: (None, "skipped", reason, rule)
    assert got == [
        skip("URL does not begin with HTTPS"), skip("URL does not begin with HTTPS"), skip("URL has no host"), skip("URL could not be parsed"),
        skip("non-content file extension"), skip("image proxy endpoint"), skip("IP-address host"), skip("local address"),
        ("https://example.com/a", "passthrough", None, None),
        ("https://code.example/o/r", "rewritten", None, "first"),
        ("https://code.example/o/r/blob/main/x.md", "passthrough", None, None),
        ("https://mirror.net/https://blog.paywall.com/p", "rewritten", None, "mirror"),
        skip("skipped (not content)", "skip"),
        ("https://tube.com/v", "passthrough", None, None),
        ("https://lit.com/bb", "rewritten", None, "literal"),
        ("https://example.com/x", "passthrough", None, None),
    ]


def test_rules_from_files(tmp_path):
    broken = tmp_path / "rules.toml"
    broken.write_text("[[rule", encoding="utf-8")
    default = [Rule("d", "host", "x", (Action("skip"),))]
    assert load_rules(default, broken) == default == load_rules(default, tmp_path / "none.toml")
    broken.write_text('[[rule]]\nname="mine"\ntype="host"\nmatch="y"\n[[rule.action]]\ntype="skip"\nreason="no"\n', encoding="utf-8")
    assert [r.name for r in load_rules(default, broken)] == ["mine", "d"]
    assert java_replacement(r"a\b$1${2}$$") == r"a\\b$1$2\$"


def test_registered_keeps_the_first_original(spark):
    df = spark.createDataFrame([("https://a.com/x/", 2), ("https://www.a.com/x", 1), ("http://a.com/y", 0), ("https://a.com/x#z", 1)], "u string, o int")
    rows = registered(df, "u", "o", []).collect()
    assert [(r["url"], r["original_url"], r["domain"]) for r in rows] == [("https://a.com/x", "https://a.com/x#z", "a.com")]


@pytest.mark.parametrize("plan", ["registered"])
def test_plan_stays_small(spark, plan):
    df = spark.createDataFrame([("https://a.com/x/", 2)], "u string, o int")
    text = registered(df, "u", "o", RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert len(text) < 60_000


def test_public_suffixes_of_a_file(spark, tmp_path):
    from leafmill.sources.suffixes import read_suffixes

    path = tmp_path / "suffixes.dat"
    path.write_text("// a remark\ncom\nco.uk\ngithub.io\n*.ck\n!www.ck\npvt.k12.ma.us\n\nde // another\n", encoding="utf-8")
    known = read_suffixes(path)
    hosts = {"a.b.co.uk": "b.co.uk", "me.github.io": "me.github.io", "github.io": "", "x.y.ck": "x.y.ck", "y.ck": "", "a.www.ck": "www.ck", "www.ck": "www.ck", "s.pvt.k12.ma.us": "s.pvt.k12.ma.us", "a.ma.us": "ma.us", "a.b.de": "b.de", "1.2.3.4": "", "de": ""}
    rows = spark.createDataFrame([(f"https://{h}/x",) for h in hosts], "u string")
    assert [r[0] for r in rows.select(urls.registered_domain(F.col("u"), known)).collect()] == list(hosts.values())
