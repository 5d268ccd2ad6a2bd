"""python -m basalt -c "SQL; SQL" [--timing] [--table NAME=PATH ...]: statements from the command line."""

from __future__ import annotations

import argparse
import sys
import time

from .plans.dialect import tokenize
from .plans.engine import Engine
from .session import session


def statements(text: str) -> list[str]:
    out: list[list[str]] = [[]]
    for _, x in tokenize(text):
        if x == ";":
            out.append([])
        else:
            out[-1].append(x)
    return [" ".join(words) for words in out if words]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="basalt")
    parser.add_argument("-c", "--command", required=True, help="statements, with ; between them")
    parser.add_argument("--timing", action="store_true", help="print the time that each statement takes")
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet path to query as a table")
    given = parser.parse_args(args)
    spark = session()
    engine = Engine(spark)
    try:
        for name, _, path in (x.partition("=") for x in given.table):
            engine.register(name, spark.read.parquet(path))
        for text in statements(given.command):
            began = time.time()
            result = engine.execute(text)
            rows = result.rows()
            if result.df is not None:
                print(" | ".join(result.df.columns))
                for row in rows:
                    print(" | ".join("" if v is None else str(v) for v in row))
            print(result.tag if result.df is None else f"({len(rows)} rows)")
            if given.timing:
                print(f"Time: {1000 * (time.time() - began):.3f} ms")
    except Exception as x:
        print(f"ERROR: {str(x).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
