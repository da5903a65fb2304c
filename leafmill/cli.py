"""Command line: ``python -m leafmill.cli --home DIR COMMAND``.

Results go to standard output, one record a line, or as JSON with --json. Exit
codes: 0 done, 64 wrong use, 65 bad data, 66 no such input.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.api import Archive
from leafmill.operators import catalog, search
from leafmill.operators.verdicts import with_verdict
from leafmill.plans.rules import DEFAULT_RULES
from leafmill.session import build_session
from leafmill.sources.gold import read_gold
from leafmill.sources.rules import load_rules

USAGE, DATA, NO_INPUT = 64, 65, 66


class Fail(Exception):
    def __init__(self, code: int, text: str) -> None:
        super().__init__(text)
        self.code = code


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill")
    p.add_argument("--home", default=".leafmill", help="folder of the warehouse")
    p.add_argument("--json", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        c = commands.add_parser(name)
        for flags, settings in options:
            c.add_argument(*flags, **settings)

    text, flag = {}, {"action": "store_true"}
    add("source-add", (["path"], text), (["name"], text))
    add("source-list")
    add("source-remove", (["name"], text), (["--remove-pages"], flag))
    add("index", (["name"], {"nargs": "?"}), (["--all"], flag))
    add("index-path", (["path"], text))
    add("get", (["urls"], {"nargs": "+", "help": "- reads them from standard input"}))
    add("extract", (["files"], {"nargs": "*"}), (["-f", "--files-from"], {"help": "file of paths, - for standard input"}))
    add("parse", (["--reparse"], flag))
    add("status")
    add("list", (["-n"], {"type": int, "default": 20}), (["--reverse"], flag), (["--domain"], text), (["--source"], text))
    add("prune", (["mode"], {"choices": sorted(catalog.PRUNE_MODES)}), (["--force"], flag))
    add("path", (["url"], text))
    add("rules-list")
    add("rules-test", (["url"], text))
    add("search-index", (["folder"], text), (["collection"], text), (["--no-prune"], flag))
    add("search-query", (["text"], text), (["-k"], {"type": int, "default": 5}), (["--collection"], text))
    add("search-collections")
    add("search-refresh")
    add("search-evaluate", (["gold"], text))
    add("db-remove", (["--force"], flag))
    return p


def _lines(source) -> list[str]:
    """Lines with something in them, trimmed, in order."""
    return [t for line in source if (t := line.strip())]


def show(df: DataFrame, as_json: bool) -> None:
    for row in df.toLocalIterator():
        record = row.asDict(recursive=True)
        print(json.dumps(record, ensure_ascii=False) if as_json else "\t".join("" if v is None else str(v) for v in record.values()))


def run(a: argparse.Namespace, archive: Archive) -> None:
    spark, store = archive.spark, archive.store
    sources = {r["name"]: r["path"] for r in store.table("sources").collect()} if a.command in ("source-remove", "index", "list") else {}
    wanted = getattr(a, "source", None) or (a.name if a.command in ("source-remove", "index") else None)
    if wanted and wanted not in sources:
        raise Fail(NO_INPUT, f"no such source: {wanted}")
    if a.command == "source-add":
        if not Path(a.path).is_dir():
            raise Fail(NO_INPUT, f"no such folder: {a.path}")
        if not archive.add_source(a.name, a.path):
            raise Fail(USAGE, f"the name is taken: {a.name}")
    elif a.command == "source-list":
        show(store.table("sources").orderBy("name").select("name", "path"), a.json)
    elif a.command == "source-remove":
        archive.remove_source(a.name, a.remove_pages)
    elif a.command == "index":
        if bool(a.name) == a.all:
            raise Fail(USAGE, "give a source or --all")
        print(archive.index(sources[a.name], a.name) if a.name else archive.index_all())
    elif a.command == "index-path":
        if not Path(a.path).exists():
            raise Fail(NO_INPUT, f"no such note or folder: {a.path}")
        print(archive.index(a.path))
    elif a.command == "get":
        print(archive.register(_lines(sys.stdin) if a.urls == ["-"] else a.urls))
    elif a.command == "extract":
        files = list(a.files)
        if a.files_from:
            files += _lines(sys.stdin) if a.files_from == "-" else _lines(Path(a.files_from).read_text(encoding="utf-8").splitlines())
        if not files:
            raise Fail(USAGE, "give files or --files-from")
        missing = [f for f in files if not Path(f).is_file()]
        show(archive.extract([f for f in files if f not in missing]), a.json)
        if missing:
            raise Fail(NO_INPUT, f"cannot read: {', '.join(missing)}")
    elif a.command == "parse":
        print(archive.parse(a.reparse))
    elif a.command == "status":
        counts, failures = archive.status()
        if a.json:
            print(json.dumps(counts.first().asDict() | {"failures": [r.asDict() for r in failures.collect()]}))
        else:
            for name, n in counts.first().asDict().items():
                print(f"{name}\t{n}")
            show(failures.limit(10), False)
    elif a.command == "list":
        rows = archive.list(limit=a.n or None, newest=not a.reverse, domain=a.domain, source=a.source)
        show(rows.select(F.left("fetched_at", F.lit(19)).alias("fetched_at"), "domain", "url"), a.json)
    elif a.command == "prune":
        show(archive.prune(a.mode, dry_run=not a.force), a.json)
    elif a.command == "path":
        try:
            page = archive.page(a.url)
        except LookupError as e:
            raise Fail(NO_INPUT, str(e)) from e
        print(json.dumps({"url": page["url"], "markdown": page["markdown"]}, ensure_ascii=False) if a.json else page["markdown"])
    elif a.command == "rules-list":
        for r in archive.rules:
            print(json.dumps({"name": r.name, "type": r.match_type, "match": r.pattern, "actions": [x.type for x in r.actions]}) if a.json else f"{r.name}\t{r.match_type}\t{r.pattern}")
    elif a.command == "rules-test":
        show(with_verdict(spark.createDataFrame([(a.url,)], "url string"), "url", archive.rules).drop("url"), a.json)
    elif a.command == "search-index":
        try:
            print("\t".join(map(str, archive.index_documents(a.folder, a.collection, prune=not a.no_prune))))
        except ValueError as e:
            raise Fail(USAGE, str(e)) from e
    elif a.command == "search-query":
        if a.k < 1:
            raise Fail(USAGE, "-k must be at least 1")
        if store.table("vectors").isEmpty():
            raise Fail(NO_INPUT, "nothing is indexed")
        show(archive.query(a.text, a.k, a.collection), a.json)
    elif a.command == "search-collections":
        show(search.collections(store.table("vectors"), store.table("roots")).orderBy("collection"), a.json)
    elif a.command == "search-refresh":
        for name, counts in archive.refresh().items():
            print(name, *(counts or ["folder missing"]), sep="\t")
    elif a.command == "search-evaluate":
        try:
            gold = read_gold(spark, a.gold)
        except OSError as e:
            raise Fail(NO_INPUT, str(e)) from e
        except (ValueError, KeyError, TypeError) as e:
            raise Fail(DATA, f"no gold queries: {a.gold}") from e
        metrics, ranks = archive.evaluate(gold)
        show(metrics, a.json)
        show(search.imperfect(ranks), a.json)
    elif a.command == "db-remove":
        if not a.force:
            raise Fail(USAGE, "this deletes the warehouse: repeat with --force")
        store.remove()


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else 0
    spark = spark or build_session("leafmill", "local[*]", **{"spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    archive = Archive(spark, a.home, load_rules(DEFAULT_RULES, Path(a.home) / "rules.toml"))
    try:
        run(a, archive)
        return 0
    except Fail as e:
        print(e, file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
