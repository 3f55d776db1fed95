"""python -m sparkloom INPUT [--format F] [--safe] [--pretty] [--query SELECTOR] [--errors] [--output PATH]: INPUT is a file, a folder or - for standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import functions as X
from . import sources
from .api import HtmlFrame
from .html.errors import SelectorError


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("input")
    p.add_argument("-f", "--format", choices=("html", "markdown", "text", "tree"), default="html")
    p.add_argument("--safe", action="store_true")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("-q", "--query")
    p.add_argument("-e", "--errors", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("--profile", choices=("observed", "spec"), default="observed")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    df = sources.from_string(spark, sys.stdin.read()) if a.input == "-" else sources.read_files(spark, a.input)
    page = HtmlFrame(df, profile=a.profile)
    if a.errors:
        shown = page.errors().orderBy("doc_id", "err_ord").select(X.error_display("code", "message", "line", "col"))
        print(*(r[0] for r in shown.collect()), sep="\n", file=sys.stderr)
    fmt = "pretty" if a.format == "html" and a.pretty and not a.safe else a.format
    if a.query is not None:
        try:
            safe = page.sanitize() if a.safe and a.format == "html" else page
            out = safe.query_all(a.query, fmt).orderBy("doc_id", "ord").select(F.col("content").alias("out"))
        except SelectorError as e:
            print(e, file=sys.stderr)
            return 1
    else:
        out = (page.sanitize() if a.safe else page)._render(fmt).orderBy("doc_id").select(F.col(fmt).alias("out"))
    if a.output:
        sources.write_text(out, a.output, "out")
    else:
        sys.stdout.write(sources.show_text(out, "out"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
