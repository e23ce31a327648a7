"""python -m mergeloom.cli: merge, diff, dedup, query, delta, merkle and verify over files."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import dedup, delta, governance, laws, merkle
from .operators import merge as m
from .plans.language import MergeLanguage
from .session import session
from .sources.files import read_table, write_table


def _rules(given: Sequence[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in given)


def _out(df: DataFrame, to: str | None) -> None:
    if to:
        write_table(df, to)
    else:
        for line in df.toJSON().toLocalIterator():
            print(line)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mergeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *files: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for f in files:
            c.add_argument(f)
        c.add_argument("--out", help="file to write; else JSON lines on standard output")
        return c

    c = add("merge", "merge two files", "left", "right")
    c.add_argument("--key", nargs="+", required=True)
    c.add_argument("--timestamp")
    c.add_argument("--prefer", default="latest", choices=("latest", "a", "b"))
    c.add_argument("--strategy", nargs="*", default=[], metavar="COLUMN=NAME")
    c = add("provenance", "how each cell of a merge is decided", "left", "right")
    c.add_argument("--key", nargs="+", required=True)
    c.add_argument("--strategy", nargs="*", default=[], metavar="COLUMN=NAME")
    for name, about in (("diff", "changes from one file to another"), ("delta", "what turns one file into another"), ("merkle", "keys that differ, by hash trees")):
        c = add(name, about, "left", "right")
        c.add_argument("--key", nargs="+", required=True)
    c = add("apply", "a file after a delta", "table", "changes")
    c.add_argument("--key", nargs="+", required=True)
    c = add("dedup", "rows without repetition", "table")
    c.add_argument("--order", required=True)
    c.add_argument("--columns", nargs="*")
    c.add_argument("--threshold", type=float)
    c = add("query", "a statement of the merge language", "statement")
    c.add_argument("--source", nargs="+", required=True, metavar="NAME=FILE")
    c = add("verify", "whether a merge of three versions keeps the laws", "one", "two", "three")
    c.add_argument("--key", nargs="+", required=True)
    c.add_argument("--strategy", nargs="*", default=[], metavar="COLUMN=NAME")
    add("scan", "personal data in a file's text fields", "table")
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or session()
    load = lambda name: read_table(spark, getattr(a, name))
    if a.command == "merge":
        _out(m.merge(load("left"), load("right"), a.key, a.timestamp, a.prefer, _rules(a.strategy) or None), a.out)
    elif a.command == "provenance":
        _out(m.provenance(load("left"), load("right"), a.key, _rules(a.strategy)), a.out)
    elif a.command == "diff":
        _out(m.diff(load("left"), load("right"), a.key), a.out)
    elif a.command == "delta":
        _out(delta.compute_delta(load("left"), load("right"), a.key), a.out)
    elif a.command == "apply":
        _out(delta.apply_delta(load("table"), load("changes"), a.key), a.out)
    elif a.command == "merkle":
        _out(merkle.diff(load("left"), load("right"), a.key), a.out)
    elif a.command == "dedup":
        _out(dedup.records(load("table"), a.order, a.columns, a.threshold), a.out)
    elif a.command == "query":
        ql = MergeLanguage(spark)
        for name, path in _rules(a.source).items():
            ql.register(name, read_table(spark, path))
        _out(ql.execute(a.statement), a.out)
    elif a.command == "verify":
        found = laws.verify(lambda x, y: m.merge(x, y, a.key, schema=_rules(a.strategy) or {}), load("one"), load("two"), load("three"))
        for law in found:
            print(f"{law.name}: {'holds' if law.holds else f'fails, {law.differing} rows differ'}")
        return int(not all(law.holds for law in found))
    elif a.command == "scan":
        _out(governance.personal_data(load("table")), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
