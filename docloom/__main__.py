"""spark-submit docloom/__main__.py FOLDER OUT [--recursive] [--text]: a folder of office files as Markdown or text, in Parquet.

spark-submit docloom/__main__.py --filter FILE|- [--output FILE]: the plain text of one file, or of what comes in, whatever its type.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from docloom.sources.files import convert, filter_bytes


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__)
    p.add_argument("folder", nargs="?")
    p.add_argument("out", nargs="?")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--text", action="store_true", help="plain text instead of Markdown")
    p.add_argument("--filter", metavar="FILE", help="one file, or - for what comes in")
    p.add_argument("--output", help="where the text of --filter goes instead of out")
    p.add_argument("-v", "--verbose", action="store_true", help="log what Spark does")
    a = p.parse_args(argv)
    if not a.filter and not (a.folder and a.out):
        p.error("FOLDER and OUT, or --filter FILE")
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    if a.filter:
        content = sys.stdin.buffer.read() if a.filter == "-" else Path(a.filter).read_bytes()
        try:
            text = filter_bytes(spark, content, "stdin" if a.filter == "-" else a.filter)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        Path(a.output).write_text(text, encoding="utf-8") if a.output else sys.stdout.write(text)
        return 0
    counts = convert(spark, a.folder, a.out, a.recursive, a.text).first()
    print(f"success {counts.success}, failed {counts.failed}")
    return int(counts.failed > 0)


if __name__ == "__main__":
    sys.exit(main())
