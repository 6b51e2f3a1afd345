"""Command line: load draw files into a table and report on it. python -m drawforge.cli FILE... --table DIR"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException

from .plans import pipeline
from .session import session
from .sources import draw_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="drawforge")
    p.add_argument("files", nargs="+")
    p.add_argument("--table", required=True, help="folder of the table the draws are kept in")
    p.add_argument("--output-dir", default=".")
    p.add_argument("--validate", action="store_true", help="write the validation report only; its result is the exit code")
    p.add_argument("--reset", action="store_true", help="empty the table first")
    a = p.parse_args(argv)
    spark = session()
    lines = draw_files.read_lines(spark, a.files)
    try:
        held = None if a.reset else spark.read.parquet(a.table)
    except AnalysisException:  # no table yet
        held = None
    rows, counters = draw_files.load(lines, held)
    counters.show()
    draw_files.store(rows, a.table, a.reset)
    table = spark.read.parquet(a.table)
    os.makedirs(a.output_dir, exist_ok=True)
    draws = draw_files.draws_of(table)
    failed = pipeline.write_validation(pipeline.validation(draws, lines), a.output_dir)
    if a.validate or table.isEmpty():
        return failed
    pipeline.write_report(pipeline.bundle(draws), a.output_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
