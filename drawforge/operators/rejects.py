"""Rows that fail to parse: reject them with the first reason that applies, load the others.

Lines are split into cells; cells of columns that have a rule are exploded into (row, column, value), joined to a
rule table and judged; the errors of a row are aggregated; the clean rows are what an anti-join leaves. What concerns
the line as a whole is a cell of its own, so that one pass over the lines finds all errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import cell_keys, clean_name, field_of
from ..functions.ordering import spread, spread_join
from ..functions.text import blank, chomp, real_date, split_delimited, strip, without_last_empty
from ..schema import BALLS, MAX_BALL, NUM_CHANCE_MAX
from ..session import cut

ROW = ["file_no", "row_no"]
#: Reasons in the order in which they apply.
REASONS = ["quoting", "column_count", "bad_key", "bad_value"]
#: Pseudo columns: the numbers of all balls of a row, and the number of cells of a line that differs from its header
#: (null where its quoting is broken).
ALL_BALLS, WHOLE = "boules", "ligne"
#: Row numbers that differ in the last bits only are compared with their file's rejects in one place.
BLOCK_BITS = 10
#: Most headers that are sent to all executors, about 5 KB each; more are joined by shuffle.
BROADCAST_HEADERS = 10_000

#: column, check, reason, lowest, highest, must the file have the column
RULES: list[tuple[str, str, str, int | None, int | None, bool]] = [
    ("annee_numero_de_tirage", "key", "bad_key", 1976, 2025, True),
    ("nombre_de_gagnant_au_rang1", "count", "bad_value", None, None, False),
    ("rapport_du_rang1", "amount", "bad_value", None, None, False),
    *[(b, "number", "bad_value", 1, MAX_BALL, False) for b in BALLS],
    ("numero_chance", "number", "bad_value", 1, NUM_CHANCE_MAX, False),
    ("date_de_tirage", "date", "bad_value", None, None, False),
    (ALL_BALLS, "distinct", "bad_value", None, None, False),
    (WHOLE, "quoting", "quoting", None, None, False),
    (WHOLE, "columns", "column_count", None, None, False),
]
RULE_SCHEMA = "column string, check string, reason string, low int, high int, required boolean"

_GROUPED = "([0-9]+|[0-9]{1,3}([ \u00a0\u202f][0-9]{3})+)"


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table; its size is fixed by the layout."""
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def fails(value: Column, check: Column, low: Column, high: Column) -> Column:
    """Does a trimmed value break its rule? A null value (missing cell) breaks any rule but an empty-able one."""
    v = F.coalesce(value, F.lit(""))
    number = F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint"))
    year = F.when(v.rlike("^[0-9]{11}$"), F.substring(v, 1, 4).cast("int"))
    parts = F.split(v, "-")
    return (
        F.when(check == "number", ~F.coalesce(number.between(low, high), F.lit(False)))
        .when(check == "count", ~v.rlike(f"^({_GROUPED})?$"))
        .when(check == "amount", ~v.rlike(f"^({_GROUPED}([,.][0-9]+)?)?$"))
        .when(check == "key", ~F.coalesce(year.between(low, high), F.lit(False)))
        .when(check == "date", real_date(v).isNull())
        .when(check == "distinct", F.size(F.array_distinct(parts)) < F.size(parts))
        .when(check == "quoting", value.isNull())
        .when(check == "columns", value.isNotNull())
        .otherwise(F.lit(False))
    )


def parse_headers(lines: DataFrame) -> DataFrame:
    """One row per file that has lines: file_no, names (cleaned), meant (the fields they stand for), n_names, keys
    (the names made unique) and ruled: (column, place) of the columns that have a rule, place null for a required
    one that the file lacks. Worked out once a file and not once a row.

    The header is the line with row_no 0; where it comes more than once the smallest text counts. A header whose
    quoting is broken is split at every separator. Of two columns with one meaning the first has the rule.
    """
    plain = F.regexp_replace(chomp(F.col("line")), "^\ufeff", "")
    one = lines.filter("row_no = 0 and file_no is not null").groupBy("file_no").agg(F.min(plain).alias("header"))
    cut_up = F.coalesce(split_delimited(F.col("header")), F.split("header", ";", -1))
    one = spread(one, "file_no").withColumn("_cut", cut_up)
    one = one.withColumn("names", F.transform(without_last_empty(F.col("header"), F.col("_cut")), clean_name))
    one = one.withColumn("meant", F.transform("names", lambda n: field_of(n)))
    places = [
        F.struct(F.lit(r[0]).alias("column"), F.nullif(F.array_position("meant", F.lit(r[0])), F.lit(0)).cast("int").alias("place"), F.lit(r[5]).alias("must"))
        for r in RULES
        if r[0] not in (ALL_BALLS, WHOLE)
    ]
    ruled = F.filter(F.array(*places), lambda p: p["place"].isNotNull() | p["must"])
    return one.select("file_no", "names", "meant", F.size("names").alias("n_names"), ruled.alias("ruled"), cell_keys(F.col("names")).alias("keys"))


def row_lines(lines: DataFrame) -> DataFrame:
    """(file_no, row_no, line) of the lines that are rows: row_no > 0, of a file, not blank; without line ends."""
    rows = lines.filter((F.col("row_no") > 0) & F.col("file_no").isNotNull() & ~blank(F.col("line")))
    return rows.select("file_no", "row_no", chomp(F.col("line")).alias("line"))


def _split(rows: DataFrame) -> DataFrame:
    """`rows`(..., line) with `cells`, as they are written; null where quoting is broken."""
    cells = rows.withColumn("_cells", split_delimited(F.col("line")))
    return cells.withColumn("cells", without_last_empty(F.col("line"), F.col("_cells"))).drop("_cells", "line")


def with_headers(rows: DataFrame, headers: DataFrame, lines: DataFrame, broadcast_headers: int = BROADCAST_HEADERS) -> DataFrame:
    """Rows of `lines` with the columns of their file's header; null where the file has none. A file of any size is
    spread."""
    return spread_join(rows, headers, "file_no", broadcast_headers, keys=lines.select("file_no"))


def ruled_cells(rows: DataFrame) -> DataFrame:
    """(file_no, row_no, column, value) of the cells that have a rule, and of required columns a file lacks; of a line
    that differs from its header, or whose quoting is broken, the one cell that tells so. Rows of a file without a
    header differ from it in their number of cells."""
    pairs = F.transform("ruled", lambda r: F.struct(r["column"].alias("column"), strip(F.get("cells", r["place"] - 1)).alias("value")))
    count = F.when(F.col("cells").isNotNull(), F.size("cells"))
    odd = F.array(F.struct(F.lit(WHOLE).alias("column"), count.cast("string").alias("value")))
    fits = count == F.coalesce("n_names", F.lit(-1))
    rows = rows.select(*ROW, F.when(fits, pairs).alias("_pairs"), odd.alias("_odd"))
    numbers = F.transform(
        F.filter("_pairs", lambda p: p["column"].isin(*BALLS) & p["value"].rlike("^[0-9]+$")),
        lambda p: F.ltrim(p["value"], F.lit("0")),
    )
    together = F.struct(F.lit(ALL_BALLS).alias("column"), F.array_join(numbers, "-").alias("value"))
    # an outer explode, as an inner one would first filter by the arrays and so make them twice
    cells = rows.select(*ROW, F.explode_outer(F.coalesce(F.array_append("_pairs", together), "_odd")).alias("_c"))
    return cells.select(*ROW, "_c.column", "_c.value")


def rejects_of(rows: DataFrame) -> DataFrame:
    """(file_no, row_no, reason, columns) of every row with headers that cannot be loaded, one row each: the first
    reason that applies, and the columns at fault (none where the line as a whole is)."""
    rules = rule_table(rows.sparkSession)
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    # the rule table has one row per rule of the layout: its size is fixed
    judged = ruled_cells(rows).join(F.broadcast(rules), "column")
    bad = judged.filter(fails(F.col("value"), F.col("check"), F.col("low"), F.col("high")))
    column = F.when(F.col("column") != WHOLE, F.col("column"))
    per_row = bad.groupBy(*ROW).agg(F.min(rank).alias("_r"), F.sort_array(F.collect_set(column)).alias("columns"))
    return per_row.select(*ROW, F.get(F.array(*[F.lit(r) for r in REASONS]), (F.col("_r") - 1).cast("int")).alias("reason"), "columns")


def separate(lines: DataFrame, headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects) of `lines`(file_no, row_no, line).

    `clean` has file_no, row_no, cells (trimmed) and the columns of parse_headers, `rejects` file_no, row_no, reason
    and the columns at fault. Null or blank lines are no rows, nor are lines without file_no or row_no; an empty table
    gives two empty ones; other columns of `lines` are left out, whatever their names. (file_no, row_no) names a line:
    lines under one name are all rejected where one of them is. `headers` may give the headers, checkpointed and with
    further columns, which `clean` then has too: what depends on the header alone is worked out once a file.
    """
    headers = cut(parse_headers(lines)) if headers is None else headers
    rows = row_lines(lines)
    rejects = rejects_of(with_headers(_split(rows), headers, lines))
    block = F.shiftright("row_no", BLOCK_BITS).alias("block")
    bad = rejects.groupBy(F.col("file_no").alias("_f"), block.alias("_b")).agg(F.collect_set("row_no").alias("_rows"))
    # lines are shuffled as they are written, which is less than their cells, and split behind the anti-join; by blocks of
    # a file's rows, so that what is counted for each file afterwards is counted before it is shuffled
    kept = rows.select("*", block).join(bad, F.expr("file_no = _f and block = _b and array_contains(_rows, row_no)"), "left_anti")
    clean = _split(kept.drop("block"))
    clean = clean.select(*ROW, F.transform("cells", strip).alias("cells"))
    return with_headers(clean, headers, lines), rejects
