"""python -m flowschema: format, lower or trace SQL, or list end points of files."""

from __future__ import annotations

import argparse
import glob
import sys

from .lineage import endpoints, lineage, to_dot
from .sql import SqlError, parse, to_sql
from .sql.lower import SparkPrinter


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="flowschema")
    p.add_argument("command", choices=["format", "spark", "dot", "endpoints"])
    p.add_argument("files", nargs="*", help="SQL files or patterns; standard input if there are none")
    p.add_argument("--sql", help="the text itself")
    p.add_argument("--dialect", default="spark", choices=["spark", "hive", "clickhouse"])
    p.add_argument("--detail", type=int, default=10)
    a = p.parse_args(args)
    texts = [("", a.sql)] if a.sql else [(f, open(f).read()) for x in a.files for f in sorted(glob.glob(x, recursive=True))] or [("", sys.stdin.read())]
    failed = False
    for name, text in texts:
        try:
            if a.command == "dot":
                print(to_dot(lineage(text, a.dialect), a.detail), end="")
            elif a.command == "endpoints":
                e = endpoints(text, a.dialect)
                print("\n".join([f"{name}\tI\t{t}" for t in e.inputs] + [f"{name}\tO\t{t}" for t in e.outputs]))
            else:
                make = to_sql if a.command == "format" else SparkPrinter("clickhouse" if a.dialect == "clickhouse" else "spark")
                print(";\n".join(make(s) for s in parse(text, a.dialect)))
        except SqlError as x:
            failed = True
            print(f"{name or 'input'}: {x}", file=sys.stderr)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
