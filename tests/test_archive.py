import json

from pyspark.sql import functions as F

from leafmill.api import Archive
from leafmill.cli import main
from leafmill.sources.gold import read_gold


def test_archive_end_to_end(spark, tmp_path, capsys):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("[x](https://www.e.com/one/) and http://plain.com https://youtube.com/v\n", encoding="utf-8")
    (notes / "b.md").write_text("https://e.com/one https://e.com/two?utm_source=x\n", encoding="utf-8")
    home = ["--home", str(tmp_path / "home")]

    def run(*args):
        code = main([*home, *args], spark)
        return code, capsys.readouterr().out.splitlines()

    assert run("source-add", str(notes), "n") == (0, []) and run("source-add", str(notes), "n")[0] == 64
    assert run("source-add", str(tmp_path / "none"), "m")[0] == 66
    assert run("index", "--all") == (0, ["2"]) and run("index", "zz")[0] == 66 and run("index")[0] == 64
    assert json.loads(run("--json", "status")[1][0])["pending"] == 2
    archive = Archive(spark, tmp_path / "home")
    body = "".join(f"<p>Paragraph number {i} of a long page.</p>" for i in range(40))
    snapshot = spark.createDataFrame([("https://e.com/one", "html", f"<html><head><title>One</title></head><body>{body}<a href=/two>t</a></body></html>", None, None)], "url string, content_type string, html string, pdf binary, error string")
    archive.fetch(snapshot)
    assert run("parse") == (0, ["1"])
    assert {tuple(r) for r in archive.store.table("pages").select("url", "title", "fail_reason").collect()} == {("https://e.com/one", "One", None), ("https://e.com/two", None, "not in the snapshot")}
    assert run("path", "https://www.e.com/one/#x")[1][0].startswith("Paragraph number 0") and run("path", "https://e.com/two")[0] == 66
    assert run("list", "--source", "n")[1][0].endswith("e.com\thttps://e.com/one") and run("list", "--source", "q")[0] == 66
    assert [r["url"] for r in archive.crawl(spark.createDataFrame([("https://e.com/one",)], "url string"), 1).orderBy("level").collect()] == ["https://e.com/one", "https://e.com/two"]
    assert run("prune", "missing") == (0, [])
    assert len(run("prune", "failed")[1]) == 1 and archive.store.table("pages").count() == 2
    assert len(run("prune", "failed", "--force")[1]) == 1 and archive.store.table("pages").count() == 1
    assert run("--json", "extract", str(notes / "b.md"), str(notes / "no.md")) == (66, ['{"url": "https://e.com/one"}', '{"url": "https://e.com/two?utm_source=x"}'])
    (tmp_path / "list").write_text(f"{notes / 'b.md'}\n\n", encoding="utf-8")
    assert run("extract", "-f", str(tmp_path / "list"))[1] == ["https://e.com/one", "https://e.com/two?utm_source=x"] and run("extract")[0] == 64
    assert run("search-evaluate", "none.json")[0] == 66
    assert json.loads(run("--json", "rules-test", "https://youtube.com/v")[1][0])["verdict"] == "skipped"
    assert run("source-remove", "n", "--remove-pages") == (0, []) and archive.store.table("pages").count() == 0
    assert run("db-remove")[0] == 64 and run("db-remove", "--force") == (0, [])


def test_search_index(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "cats.md").write_text("# Cats\ncats purr and sleep\n", encoding="utf-8")
    (docs / "dogs.md").write_text("# Dogs\ndogs bark and run\n", encoding="utf-8")
    archive = Archive(spark, tmp_path / "home")
    assert archive.index_documents(docs, "pets") == (2, 2, 0)
    assert archive.query("dogs bark", 1).first()["source"] == "dogs.md"
    assert archive.refresh() == {"pets": (2, 0, 0)}
    gold = tmp_path / "gold.json"
    gold.write_text(json.dumps([{"query": "dogs bark and run", "source": "dogs.md"}, {"query": "cats purr", "source": ["cats.md", "x.md"]}, {"query": "cats", "source": "none.md"}]), encoding="utf-8")
    metrics, ranks = archive.evaluate(read_gold(spark, gold))
    assert tuple(metrics.first()) == (3, 0.667, 0.667, 0.667, 0.667) and {r["query"]: r["rank"] for r in ranks.collect()}["cats"] is None
    assert archive.evaluate(read_gold(spark, gold).limit(0))[0].first()["queries"] == 0
    (docs / "dogs.md").write_text("# Dogs\ndogs bark\n", encoding="utf-8")
    (docs / "cats.md").unlink()
    assert archive.index_documents(docs, "pets") == (1, 1, 1)
    assert [(r["source"], r["line"]) for r in archive.store.table("vectors").select("source", "line").collect()] == [("dogs.md", 2)]
    (docs / "dogs.md").unlink()
    assert archive.index_documents(docs, "pets") == (0, 0, 0) and archive.store.table("vectors").where(F.col("collection") == "pets").count() == 1
    for wrong in ((tmp_path, "pets"), (docs, "-")):
        try:
            archive.index_documents(*wrong)
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_one_note_and_all_sources(spark, tmp_path):
    for name, text in (("one", "https://e.com/a https://e.com/b"), ("two", "https://e.com/b?utm_source=x https://e.com/c")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "n.md").write_text(text, encoding="utf-8")
    archive = Archive(spark, tmp_path / "home")
    assert archive.index(tmp_path / "one" / "n.md") == 2 and archive.index(tmp_path / "one" / "n.png") == 0
    assert archive.index_all() == 0
    for name in ("two", "one"):
        archive.add_source(name, str(tmp_path / name))
    assert archive.index_all() == 3
    assert {r["original_url"] for r in archive.store.table("pages").collect()} == {"https://e.com/a", "https://e.com/b", "https://e.com/c"}


def test_a_collection_is_a_part_of_its_own(spark, tmp_path):
    archive = Archive(spark, tmp_path / "home")
    for name in ("cats", "dogs"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "n.md").write_text(f"# {name}\n{name} sleep\n", encoding="utf-8")
        assert archive.index_documents(tmp_path / name, name) == (1, 1, 0)
    before = archive.store.versions()["vectors"]
    (tmp_path / "dogs" / "n.md").write_text("# dogs\ndogs run\n", encoding="utf-8")
    assert archive.index_documents(tmp_path / "dogs", "dogs") == (1, 1, 0) and archive.index_documents(tmp_path / "cats", "cats") == (1, 0, 0)
    after = archive.store.versions()["vectors"]
    assert before["cats"] == after["cats"] and before["dogs"] != after["dogs"]
    assert {r["collection"] for r in archive.query("cats", 5).collect()} == {"cats", "dogs"} and archive.query("cats", 5, "dogs").count() == 1
    assert archive.store.table("vectors", "none").count() == 0
