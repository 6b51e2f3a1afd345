"""Column-level quality profile of every load of a table, and the loads that break limits or depart from the last.

Columns are unpivoted into (load, field, value) and counted exactly; everything else - null rates, distinct counts,
ranges, pattern violations, class shares, chi-square and population stability index - is an aggregate of those
counts, so the rows themselves are read and shuffled once, pre-aggregated. What is read more than once are the
counts by class, which are checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import previous_by_blocks
from ..functions.text import real_date, strip
from ..session import cut

NULL_RATE, BAD_SHARE, SHIFT, FEWER = 0.05, 0.01, 0.2, 0.5
OTHER = "other"


@dataclass(frozen=True)
class Limits:
    """What is expected of a field: how to read a value, its range, its classes; `form` marks a pattern check."""

    kind: str  # "number", "date" or "time" (no range, no classes of its own)
    low: float | None = None
    high: float | None = None
    #: (upper bound, name) of classes in rising order; values below `low` or above the last bound are OTHER.
    bins: tuple[tuple[float, str], ...] | None = None
    form: str | None = None


#: Limits of the fields of `tirages`.
TIRAGES_LIMITS: dict[str, Limits] = {
    "boule_1": Limits("number", 1, 49, ((10, "1-10"), (20, "11-20"), (30, "21-30"), (40, "31-40"), (49, "41-49"))),
    "numero_chance": Limits("number", 1, 10),
    "date_tirage": Limits("date", form="dd/MM/yyyy"),
    "rapport_rang1": Limits(
        "number", 0, 500_000_000, ((0, "0"), (2_999_999.999999999, "<3M"), (7_999_999.999999999, "<8M"), (500_000_000, "<=500M"))
    ),
}
FIRST_DAY, LAST_DAY = date(1976, 1, 1), date(2025, 12, 31)


def value_counts(table: DataFrame, load: str, fields: list[str]) -> DataFrame:
    """(load, field, value, n): exact counts of every value as text; null values are counted under null."""
    cols = [F.col(f"`{f}`").cast("string").alias(f) for f in fields]
    long = table.select(F.col(f"`{load}`").alias("_load"), *cols).unpivot("_load", fields, "field", "value")
    return long.groupBy(F.col("_load").alias("load"), "field", "value").agg(F.count(F.lit(1)).alias("n"))


def shape(value: Column) -> Column:
    """Coarse form of a whole text: runs of digits, letters and blanks as one sign each."""
    signs = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "\\p{L}+", "a")
    return F.regexp_replace(signs, "\\s+", " ")


def magnitude(number: Column) -> Column:
    """Class of a number without limits: its sign and power of ten."""
    size = F.floor(F.log10(F.abs(number))).cast("string")
    return F.when(number == 0, "0").when(number < 0, F.concat(F.lit("-e"), size)).otherwise(F.concat(F.lit("e"), size))


def _read(fields: dict[str, Limits]) -> tuple[Column, Column]:
    """(day, number) of a value that is not blank: the real date of a date field, else the number that it writes (seconds
    since 1970 for a time)."""
    v, field = F.col("value"), F.col("field")
    day, number = F.lit(None).cast("date"), v.try_cast("double")
    for name, limits in fields.items():
        if limits.kind == "date":
            day = F.when(field == name, real_date(v, limits.form)).otherwise(day)
            number = F.when(field != name, number)
        elif limits.kind == "time":
            number = F.when(field == name, F.unix_micros(v.try_cast("timestamp")) / 1e6).otherwise(number)
    return day, number


def _judge(limits: Limits | None) -> dict[str, Column]:
    """class, bad (pattern) and outside (range) of a value that is not blank, from `_day` and `_number`."""
    v, day, number, no = F.col("value"), F.col("_day"), F.col("_number"), F.lit(False)
    if limits is None:
        return {"class": F.when(number.isNotNull(), magnitude(number)).otherwise(shape(v)), "bad": no, "outside": no}
    if limits.kind == "time":
        return {"class": shape(v), "bad": no, "outside": no}
    if limits.kind == "date":
        outside = F.coalesce((day < F.lit(FIRST_DAY)) | (day > F.lit(LAST_DAY)), no)
        return {"class": F.weekday(day).cast("string"), "bad": day.isNull(), "outside": outside}
    outside = F.coalesce((number < limits.low) | (number > limits.high), F.lit(True))
    if limits.bins is None:
        kind = F.coalesce(F.regexp_replace(v, "[.]0$", ""), F.lit(OTHER))
    else:
        kind = F.when(outside, OTHER)
        for bound, name in limits.bins:
            kind = kind.when(number <= bound, name)
        kind = kind.otherwise(OTHER)
    return {"class": kind, "bad": no, "outside": outside}


def judged_counts(counts: DataFrame, limits: dict[str, Limits]) -> DataFrame:
    """`counts` with number, class, bad (pattern), outside (range) of each value that is not null or blank.

    Values are read in one step and judged in the next, so that each is read once, and the generated code of a step
    stays small enough to be compiled.
    """
    out = counts.withColumn("blank", F.col("value").isNull() | (strip(F.col("value")) == ""))
    day, number = _read(limits)
    out = out.withColumns({"_day": F.when(~F.col("blank"), day), "_number": F.when(~F.col("blank"), number)})
    judged = {}
    for key in ("class", "bad", "outside"):
        chosen = None
        for field, lim in limits.items():
            here = _judge(lim)[key]
            chosen = F.when(F.col("field") == field, here) if chosen is None else chosen.when(F.col("field") == field, here)
        rest = _judge(None)[key]
        judged[key] = F.when(~F.col("blank"), rest if chosen is None else chosen.otherwise(rest))
    number = F.coalesce("_number", F.unix_date("_day").cast("double"))
    return out.withColumns({"number": number, **judged}).drop("_day", "_number")


def class_counts(judged: DataFrame) -> DataFrame:
    """(load, field, class, n, nulls, n_distinct, low, high, bad, outside): sums of the judged counts by class."""
    return judged.groupBy("load", "field", "class").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(~F.col("blank")).alias("n_distinct"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(F.col("outside"), F.col("n"))), F.lit(0)).alias("outside"),
    )


def load_chain(counts: DataFrame) -> DataFrame:
    """(load, before): each load and the next smaller one; null for the first."""
    return previous_by_blocks(counts.select("load").distinct(), [], "load", "before")


def field_profile(classes: DataFrame) -> DataFrame:
    """One row per (load, field): rows, nulls, distinct values, smallest and largest number, pattern and range faults."""
    return classes.groupBy("load", "field").agg(
        F.sum("n").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.sum("n_distinct").alias("n_distinct"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("bad").alias("bad"),
        F.sum("outside").alias("outside"),
    )


def class_changes(counted: DataFrame, profile: DataFrame, chain: DataFrame) -> DataFrame:
    """(load, field, moved, psi, chi2) of each load that has a predecessor.

    `moved` is the largest difference of a class's share of the values, rounded to 6 decimals; `psi` the population
    stability index over the classes (shares of 0 as half a value); `chi2` the two-sample chi-square statistic.
    Values of a load: those that are not null or blank. A load or predecessor without values has null measures.
    """
    classes = counted.filter(F.col("class").isNotNull()).select("load", "field", "class", "n")
    sizes = profile.select("load", "field", (F.col("rows") - F.col("nulls")).alias("total"))
    pairs = chain.filter("before is not null")
    now = classes.join(pairs.select("load"), "load").select("load", "field", "class", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    then = classes.withColumnRenamed("load", "before").join(pairs, "before").select(
        "load", "field", "class", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")
    )
    both = now.unionByName(then).groupBy("load", "field", "class").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    here = sizes.join(pairs, "load").select("load", "field", "before", F.col("total").alias("na"))
    prev = sizes.select(F.col("load").alias("before"), "field", F.col("total").alias("nb"))
    sized = both.join(here.join(prev, ["before", "field"]), ["load", "field"]).filter("na > 0 and nb > 0")
    p, q = F.col("a") / F.col("na"), F.col("b") / F.col("nb")
    pp = F.greatest(p, 0.5 / F.col("na"))
    qq = F.greatest(q, 0.5 / F.col("nb"))
    cross = F.pow(F.sqrt(F.col("nb") / F.col("na")) * F.col("a") - F.sqrt(F.col("na") / F.col("nb")) * F.col("b"), 2)
    return sized.groupBy("load", "field").agg(
        F.round(F.max(F.abs(p - q)), 6).alias("moved"),
        F.sum((pp - qq) * F.ln(pp / qq)).alias("psi"),
        F.sum(cross / (F.col("a") + F.col("b"))).alias("chi2"),
    )


def profile_loads(table: DataFrame, load: str, fields: list[str], limits: dict[str, Limits] | None = None) -> DataFrame:
    """The profile of every field in every load, with its comparison to the preceding load.

    Columns: load, field, rows, nulls, n_distinct, low, high, bad, outside, before, distinct_before, moved, psi, chi2.
    `load` is an integer column; rows with a null load form a load of their own without predecessor. An empty table
    has no rows; a load of nulls only has nulls = rows and null measures. `low` and `high` of dates with limits are
    days, of other date and timestamp columns seconds since 1970.
    """
    limits = TIRAGES_LIMITS if limits is None else limits
    times = {f: Limits("time") for f, kind in table.dtypes if kind in ("date", "timestamp", "timestamp_ntz")}
    judged = judged_counts(value_counts(table, load, fields), {f: x for f, x in (times | limits).items() if f in fields})
    classes = cut(class_counts(judged))
    profile = field_profile(classes)
    chain = load_chain(classes.filter("load is not null"))
    moved = class_changes(classes, profile, chain)
    before = profile.select(F.col("load").alias("before"), "field", F.col("n_distinct").alias("distinct_before"))
    return (
        profile.join(chain, "load", "left")
        .join(before, ["before", "field"], "left")
        .join(moved, ["load", "field"], "left")
        .select(
            "load", "field", "rows", "nulls", "n_distinct", "low", "high", "bad", "outside", "before", "distinct_before", "moved", "psi", "chi2"
        )
    )


def issues(profile: DataFrame, limits: dict[str, Limits] | None = None) -> DataFrame:
    """(load, field, issue) of a profile: null_rate, pattern, range, distinct, shift."""
    limits = TIRAGES_LIMITS if limits is None else limits
    dates = [f for f, x in limits.items() if x.kind == "date"]
    values = F.col("rows") - F.col("nulls")
    found = F.array_compact(
        F.array(
            F.when(F.col("nulls") >= NULL_RATE * F.col("rows"), "null_rate"),
            F.when((F.col("bad") > 0) & (F.col("bad") >= BAD_SHARE * values), "pattern"),
            F.when((F.col("outside") > 0) & (F.col("outside") >= BAD_SHARE * values), "range"),
            F.when(~F.col("field").isin(*dates) & (F.col("n_distinct") < FEWER * F.col("distinct_before")), "distinct"),
            F.when(F.col("moved") >= SHIFT, "shift"),
        )
    )
    return profile.select("load", "field", F.explode(found).alias("issue"))
