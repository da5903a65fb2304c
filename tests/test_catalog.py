import pytest
from pyspark.sql import functions as F

from leafmill.operators import catalog as C
from leafmill.operators.crawl import crawl, saved_page_links
from leafmill.schema import LINKS, PAGES, SOURCES
from leafmill.session import small_side
from leafmill.sources.notes import find_notes, note_urls, read_notes
from leafmill.sources.warehouse import Warehouse, valid_collection
from leafmill.streaming import events


def pages(spark, *rows):
    blank = {f: None for f in PAGES.names}
    return spark.createDataFrame([blank | {"domain": "e.com", "slug": r["url"], "original_url": r["url"], "added_at": "1", "word_count": 0} | r for r in rows], PAGES)


FIVE = ({"url": "a"}, {"url": "b", "fail_reason": "x"}, {"url": "c", "fetched_at": "2"}, {"url": "d", "fetched_at": "3", "fail_reason": "y"}, {"url": "e", "fetched_at": "4", "parsed_at": "5"})


def values(df):
    return sorted(r[0] for r in df.collect())


def test_states(spark):
    assert C.status_counts(pages(spark, *FIVE)).first().asDict() == {"total": 5} | {s: 1 for s in C.STATES}
    assert set(C.status_counts(pages(spark)).first()) == {0}
    assert [(r["url"]) for r in C.list_fetched(pages(spark, *FIVE), limit=2).collect()] == ["e", "d"]
    assert [(r["url"]) for r in C.list_fetched(pages(spark, *FIVE), newest=False).collect()] == ["c", "d", "e"]
    assert values(pages(spark, *FIVE).where(C.unparsed()).select("url")) == ["c"]


def test_prune_and_sources(spark):
    p = pages(spark, *FIVE)
    links = spark.createDataFrame([("b", "f", "s", "1"), ("d", "g", None, "1"), ("e", "f", "s", "1"), ("e", "h", "t", "1")], LINKS)
    assert values(C.prune_victims(p, links, "failed")) == ["b", "d"] and values(C.prune_victims(p, links.where("url <> 'b'"), "missing")) == ["b"]
    assert C.prune_victims(p, links, "all").count() == 5
    with pytest.raises(ValueError):
        C.prune_victims(p, links, "some")
    kept = C.without(p, links, C.prune_victims(p, links, "failed"))
    assert values(kept[0]) == ["a", "c", "e"] and values(kept[1]) == ["e", "e"]
    assert values(C.exclusive_pages(p, links, "s")) == ["b"]
    sources = spark.createDataFrame([("s", "p", "1")], SOURCES)
    left, nulled = C.remove_source(sources, links, "s")
    assert left.count() == 0 and nulled.where("source_name is null").count() == 3
    assert {(r["url"], r["missing"]) for r in C.dangling_links(links, p.where("url <> 'b'"), sources).collect()} == {("b", "page"), ("e", "source")}


def test_mutations(spark):
    old = pages(spark, {"url": "a", "title": "old", "fail_reason": "x"}, {"url": "b"})
    new = pages(spark, {"url": "a", "added_at": "9"}, {"url": "c", "added_at": "9"})
    got = {r["url"]: (r["title"], r["fail_reason"], r["added_at"]) for r in C.upsert(old, new).collect()}
    assert got == {"a": (None, None, "1"), "b": (None, None, "1"), "c": (None, None, "9")}
    assert {(r["url"], r["added_at"]) for r in C.insert_absent(old, new).collect()} == {("a", "1"), ("b", "1"), ("c", "9")}
    links = spark.createDataFrame([("a", "f", "s", "1"), ("a", "f", "t", "2"), ("b", "g", "s", "1")], LINKS)
    again = spark.createDataFrame([("c", "g", None, "3")], LINKS)
    assert {tuple(r) for r in C.replace_links(links, again, again).collect()} == {("a", "f", "t", "2"), ("c", "g", None, "3")}
    urls = spark.createDataFrame([("a", "A"), ("b", "B"), ("z", "Z")], "url string, original_url string")
    assert {tuple(r) for r in C.candidates(urls, old).collect()} == {("b", "b"), ("z", "Z")}
    assert C.candidates(urls, old, refetch=True).count() == 3
    told = spark.createDataFrame([("a", None, "r"), ("b", "c", None)], "url string, target string, reason string")
    assert {r["url"]: r["fail_reason"] for r in C.mark_diverted(old, told).collect()} == {"a": "x", "b": "rewritten to c"}
    assert tuple(C.pipeline_summary(old, old, new, new.limit(0)).first()) == (2, 2, 2, 0)
    assert [tuple(r) for r in C.latest(links, "url", "indexed_at").orderBy("url").collect()] == [("a", "f", "t", "2"), ("b", "g", "s", "1")]


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, tmp_path / "w")
    assert w.table("pages").count() == 0
    w.commit(pages=pages(spark, *FIVE))
    w.commit(pages=w.table("pages").where("url <> 'a'"), links=spark.createDataFrame([("b", "f", None, "1")], LINKS))
    assert w.table("pages").count() == 4 and w.table("links").count() == 1
    (tmp_path / "w" / "other.txt").write_text("kept")
    w.remove()
    assert w.table("pages").count() == 0 and (tmp_path / "w" / "other.txt").exists()
    assert valid_collection("my-notes") and not valid_collection("-x") and not valid_collection("ab")


def test_notes(spark, tmp_path):
    for name, text in {"b/a.md": b"---\nt: 1\n---\n see https://e.com/a \n", "b-a.txt": "ü [x](https://e.com/b)".encode(), ".hidden/_c.rst": b"x", "d.pdf": b"", "bad.md": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    assert [p[len(str(tmp_path)) + 1 :] for p in find_notes(tmp_path)] == [".hidden/_c.rst", "b/a.md", "b-a.txt", "bad.md"]
    notes, bad = read_notes(spark, tmp_path, "s")
    assert {r["text"] for r in notes.collect()} == {"x", "see https://e.com/a", "ü [x](https://e.com/b)"}
    assert [r["error"] for r in bad.collect()] == ["not valid UTF-8"]
    assert {r["raw"] for r in note_urls(notes).collect()} == {"https://e.com/a", "https://e.com/b"}
    assert read_notes(spark, tmp_path / "none")[0].count() == 0


def test_crawl(spark):
    html = {"": "<a href=/b>b</a><a href=https://other.com/x>o</a>", "b": "<a href=/c#y>c</a><a href=/>home</a>", "c": "<a href=/d>d</a>", "d": ""}
    p = pages(spark, *({"url": f"https://e.com/{k}", "slug": k or "root", "content_type": "html", "fetched_at": "1"} for k in html))
    raw = spark.createDataFrame([(k or "root", v) for k, v in html.items()], "slug string, html string")
    seeds = spark.createDataFrame([("https://e.com/",)], "url string")
    for depth, expected in ((0, 1), (1, 2), (2, 3), (9, 4)):
        got = crawl(seeds, saved_page_links(p, raw), depth)
        assert {r["url"].rsplit("/", 1)[1]: r["level"] for r in got.collect()} == {k: i for i, k in enumerate(["", "b", "c", "d"][:expected])}


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 10:0{i % 10}:00", i % 4, "view" if i % 2 else "click", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    batch = {tuple(r) for r in events.windowed(df).collect()}
    assert {tuple(r) for r in events.streamed_table(events.windowed(events.read_stream(spark, str(tmp_path), "events"))).collect()} == batch
    assert events.sessions(df).count() == len({(r[2], r[1][:10]) for r in rows})
    seen = []
    state = str(tmp_path / "state")
    for _ in range(2):  # a restart finds nothing new
        events.run_available(events.read_stream(spark, str(tmp_path), "events"), lambda b, _n: seen.append(b.count()), state=state)
    assert sum(seen) == 60


def test_small_side_is_checked(spark):
    few, many = spark.range(10), spark.range(1000)
    assert "broadcast" in small_side(few, 8, 800)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in small_side(many, 8, 800)._jdf.queryExecution().logical().toString()
