"""Delimited draw files: reading, the loader's cleaning rules, and loading into a table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, chomp, split_delimited, strip, without_last_empty
from ..operators.rejects import parse_headers, with_headers
from ..schema import BALLS, LAYOUT, MAX_BALL, NUM_CHANCE_MAX
from ..session import cut

LINES = "file_no int, row_no long, line string"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, row_no, line) of text files, in the given order; files that are missing are passed over.

    row_no 0 is the first line; later numbers rise with the lines but leave gaps where a file is read in splits.
    """
    found = spark.createDataFrame([], LINES)
    for no, path in enumerate(paths, 1):
        if "://" in path or os.path.exists(path):
            lines = spark.read.text(path).select(F.lit(no).alias("file_no"), F.monotonically_increasing_id().alias("row_no"), F.col("value").alias("line"))
            found = found.unionByName(lines)
    return found


def count_lines(lines: DataFrame) -> DataFrame:
    """(file_no, n): lines of each file less the header; blank lines count."""
    return lines.groupBy("file_no").agg((F.count("*") - 1).alias("n"))


def number(c: Column) -> tuple[Column, Column]:
    """(value as double, is it infinite) of a written number as the loader reads it: comma or point, exponent,
    underscores between digits; null value where it is none, or not a number."""
    x = F.regexp_replace(strip(F.replace(c, F.lit(","), F.lit("."))), "(?<=[0-9])_(?=[0-9])", "")
    value = F.when(x.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double"))
    infinite = x.rlike("(?i)^[+-]?inf(inity)?$") | F.coalesce(F.abs(value) > 1.7e308, F.lit(False))
    return value, F.coalesce(infinite, F.lit(False))


def _as_int(value: Column, infinite: Column) -> Column:
    return F.when(~infinite & (F.abs(value) < 9.2e18), value.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _as_float(value: Column, infinite: Column, text: Column) -> Column:
    return F.when(infinite, F.when(text.contains("-"), float("-inf")).otherwise(float("inf"))).otherwise(F.coalesce(value, F.lit(0.0)))


def parse_int_safe(c: Column) -> Column:
    """Whole part of a written number, 0 where there is none; out of the range of 64 bits counts as none."""
    return _as_int(*number(c))


def parse_float_safe(c: Column) -> Column:
    """A written number, 0 where there is none."""
    return _as_float(*number(c), c)


def clean_rows(lines: DataFrame) -> DataFrame:
    """Every row of the files in the layout of `tirages`, by the loader's rules, with file_no, row_no and `why`.

    Columns are found by name; a number that cannot be read, or whose column is absent, is 0. `why` is null for a
    row that can be stored, else the reason for skipping it: no_key, short_row, infinite, out_of_range.
    """
    rows = lines.filter((F.col("row_no") > 0) & ~blank(F.col("line"))).select("file_no", "row_no", chomp(F.col("line")).alias("line"))
    cells = F.coalesce(split_delimited(F.col("line")), F.split("line", ";", -1))
    rows = with_headers(rows.withColumn("cells", without_last_empty(F.col("line"), cells)), cut(parse_headers(lines)), lines).filter("n_names is not null")

    def cell(name: str) -> Column:
        return F.get("cells", F.nullif(F.array_position("names", F.lit(name)), F.lit(0)).cast("int") - 1)

    texts = [F.coalesce(cell(n), cell("nombre_codes_gagnants")) if n == "nombre_de_codes_gagnants" else cell(n) for n in LAYOUT]
    raw = rows.select("file_no", "row_no", (F.size("cells") < F.col("n_names")).alias("_short"), F.array(*texts).alias("_texts"))
    # numbers are read in the array, so that the rule stands in the plan once and not for every column
    read = lambda v: F.struct(v.alias("text"), number(v)[0].alias("value"), number(v)[1].alias("infinite"))
    raw = raw.select("file_no", "row_no", "_short", F.transform("_texts", read).alias("_n"))
    out, whole = [], []
    for i, (col, kind) in enumerate(LAYOUT.values()):
        c = F.get("_n", F.lit(i))
        if kind == "string":
            v = c["text"]
            value = strip(v) if col in ("annee_numero", "jour_tirage") else v
            out.append(F.coalesce(value, F.lit("EUR" if col == "devise" else "")).alias(col))
        elif kind == "double":
            out.append(_as_float(c["value"], c["infinite"], c["text"]).alias(col))
        else:
            whole.append(i)
            out.append(_as_int(c["value"], c["infinite"]).alias(col))
    bad = F.exists(F.transform(F.array(*[F.lit(i) for i in whole]), lambda i: F.get("_n", i)["infinite"]), lambda x: x)
    clean = raw.select("file_no", "row_no", "_short", bad.alias("_bad"), *out)
    inside = F.col("numero_chance").between(1, NUM_CHANCE_MAX)
    for b in BALLS:
        inside = inside & F.col(b).between(1, MAX_BALL)
    why = (
        F.when(F.col("annee_numero") == "", "no_key")
        .when(F.col("_short"), "short_row")
        .when(F.col("_bad"), "infinite")
        .when(~inside, "out_of_range")
    )
    return clean.withColumn("why", why).drop("_short", "_bad")


def load(lines: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new rows for the table, counters per file: read, inserted, skipped).

    Rows that cannot be stored go first, then the first row of each key wins; keys of `existing` are left out.
    """
    rows = cut(clean_rows(lines))  # read for the rows and for the counters
    order = W.partitionBy("annee_numero").orderBy("file_no", "row_no")
    first = rows.filter("why is null").withColumn("_i", F.row_number().over(order)).filter("_i = 1").drop("_i", "why")
    if existing is not None:
        first = first.join(existing.select("annee_numero"), "annee_numero", "left_anti")
    read = rows.groupBy("file_no").agg(F.count("*").alias("read"))
    new = first.groupBy("file_no").agg(F.count("*").alias("inserted"))
    counters = read.join(new, "file_no", "left").select(
        "file_no", "read", F.coalesce("inserted", F.lit(0)).alias("inserted"), (F.col("read") - F.coalesce("inserted", F.lit(0))).alias("skipped")
    )
    return first.select(*[c for c, _ in LAYOUT.values()]), counters


def store(rows: DataFrame, path: str, reset: bool = False) -> None:
    """Appends rows to the table at `path`; `reset` empties it first."""
    rows.write.mode("overwrite" if reset else "append").parquet(path)


def draws_of(tirages: DataFrame) -> DataFrame:
    """The columns of the draw operators, from loaded rows: draw_idx as any distinct number (keys are unique already), draw_date from the text."""
    return tirages.select(
        F.xxhash64("annee_numero").alias("draw_idx"),
        "annee_numero",
        F.try_to_date("date_tirage", "dd/MM/yyyy").alias("draw_date"),
        "date_tirage",
        "jour_tirage",
        *[F.col(b).cast("int").alias(b) for b in BALLS],
        F.col("numero_chance").cast("int").alias("numero_chance"),
        "combinaison_croissante",
    )
