"""Command line: list, run or explain the named queries, search documents, show table counts."""

from __future__ import annotations

import argparse

from tessellar import queries
from tessellar.bindings import BINDINGS, bind
from tessellar.operators.text import search
from tessellar.plans.lifecycle import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessellar", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("tables", help="folder of Parquet tables")
        if name == "run":
            p.add_argument("--out", help="folder to write Parquet to; shows rows otherwise")
    p = sub.add_parser("search", help="BM25 over documents")
    p.add_argument("tables")
    p.add_argument("words", nargs="+")
    p = sub.add_parser("status", help="rows of the bound tables")
    p.add_argument("tables")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    spark = session()
    if a.command in ("run", "explain"):
        if a.query not in queries.QUERIES:
            print(f"no such query: {a.query}")
            return 2
        df = queries.QUERIES[a.query](spark, a.tables)
        if a.command == "explain":
            df.explain("formatted")
        elif a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(50, truncate=False)
    elif a.command == "search":
        search(bind(spark, a.tables, "documents"), a.words).show(truncate=False)
    else:
        for name in ("documents", *BINDINGS):
            print(f"{name}: {bind(spark, a.tables, name).count()}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
