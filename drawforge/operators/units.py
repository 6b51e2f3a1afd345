"""Quantities recorded in different units: one value in euro cents for every figure.

Distinct unit spellings are mapped to units once, through an inverted index of the character n-grams of the known
spellings and a weighted edit distance for the candidates it gives; the dictionary that results is joined to all
rows. Units come with the figure, in a column of their own, or in words in the note of the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import spread_join
from ..functions.text import let, strip
from ..session import cut

#: Unit -> (numerator, denominator) of its value in euro cents. 1 euro = 6.55957 francs.
UNITS: dict[str, tuple[int, int]] = {
    "cEUR": (1, 1),
    "EUR": (100, 1),
    "kEUR": (10**5, 1),
    "MEUR": (10**8, 1),
    "AF": (10**5, 655957),
    "FRF": (10**7, 655957),
    "kFRF": (10**10, 655957),
    "MFRF": (10**13, 655957),
}
PLAIN = "EUR"

#: Known spellings, in the form `plain_spelling` gives.
SPELLINGS: dict[str, list[str]] = {
    "EUR": ["eur", "euro"],
    "cEUR": ["ct", "cent", "ceur", "centime", "centime eur", "centime euro"],
    "kEUR": ["keur", "millier eur", "millier euro"],
    "MEUR": ["meur", "million eur", "million euro"],
    "FRF": ["f", "ff", "frf", "franc", "franc francais"],
    "kFRF": ["kf", "kff", "kfrf", "millier franc"],
    "MFRF": ["mf", "mff", "mfrf", "million franc"],
    "AF": ["af", "ancien franc"],
}

#: Largest dictionary that is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Share of a spelling's length that its edits may weigh; spellings up to EXACT_UP_TO characters must be exact.
MAX_EDITS, EXACT_UP_TO = 0.2, 4
#: Figures below this are held in millionths as 64-bit integers, larger ones as decimals of DIGITS digits before the point.
LARGE, DIGITS = 10**12, 31


def plain_spelling(c: Column) -> Column:
    """Lower case without accents, punctuation, plural s and small words; the euro sign as "eur"."""
    plain = F.translate(F.lower(c), "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")
    plain = F.replace(plain, F.lit("(s)"), F.lit(""))
    plain = F.replace(plain, F.lit("€"), F.lit("eur"))
    words = F.regexp_extract_all(plain, F.lit("([a-z]+)"), F.lit(1))
    words = F.filter(words, lambda w: ~w.isin("d", "de", "des", "en", "l", "les", "le", "la"))
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) > 2, F.rtrim(w, F.lit("s"))).otherwise(w)), " ")


def _known(spark: SparkSession) -> DataFrame:
    # "cts" keeps its s in `plain_spelling` only if it has two letters; it ends up as "ct"
    return spark.createDataFrame([(s, u) for u, all_ in SPELLINGS.items() for s in all_], "alias string, unit string")


def grams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams of `c` with a mark at both ends."""
    marked = F.concat(F.lit("^"), c, F.lit("$"))
    at = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(marked, i, F.lit(n))))


def weighted_edits(a: str, b: str) -> float:
    """Edit distance in which a repeated letter, a vowel for a vowel and a final letter count half."""
    vowels = set("aeiouy")
    row = [0.0]
    for j, y in enumerate(b):
        row.append(row[-1] + (0.5 if j and y == b[j - 1] else 1.0))
    for i, x in enumerate(a):
        gone = 0.5 if (i and x == a[i - 1]) or i == len(a) - 1 else 1.0
        new = [row[0] + gone]
        for j, y in enumerate(b):
            come = 0.5 if (j and y == b[j - 1]) or j == len(b) - 1 else 1.0
            swap = 0.0 if x == y else 0.5 if x in vowels and y in vowels else 1.0
            new.append(min(row[j] + swap, row[j + 1] + gone, new[j] + come))
        row = new
    return row[-1]


@F.pandas_udf(T.DoubleType())
def _edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([weighted_edits(x, y) for x, y in zip(a, b)], dtype="float64")


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """(spelling, unit) for every distinct non-null `spelling` that means a unit.

    Spellings of the same plain form are decided once. Candidates share at least half of the n-grams of the shorter
    form; among them the smallest weighted edit distance wins, ties by the known spelling. Spellings that are too far
    from any known one are left out.
    """
    known = _known(spellings.sparkSession)
    named = spellings.select("spelling").filter("spelling is not null").distinct()
    named = named.withColumn("form", plain_spelling(F.col("spelling"))).filter("form <> ''")
    forms = named.select("form").distinct()
    index = known.select("alias", "unit", F.explode(grams(F.col("alias"))).alias("gram"), F.size(grams(F.col("alias"))).alias("na"))
    probe = forms.select("form", F.explode(grams(F.col("form"))).alias("gram"), F.size(grams(F.col("form"))).alias("nf"))
    # the index has a few rows for each known spelling: its size is fixed
    shared = probe.join(F.broadcast(index), "gram").groupBy("form", "alias", "unit", "na", "nf").agg(F.count("*").alias("n"))
    likely = shared.filter(F.col("n") * 2 >= F.least("na", "nf"))
    same = F.col("form") == F.col("alias")
    near = F.when(same, 0.0).when((F.length("form") > EXACT_UP_TO) & (F.length("alias") > EXACT_UP_TO), _edits("form", "alias"))
    verified = likely.withColumn("d", near).filter(F.col("d") <= MAX_EDITS * F.length("alias"))
    best = verified.groupBy("form").agg(F.min(F.struct("d", "alias", "unit")).alias("b"))
    return named.join(best, "form").select("spelling", F.col("b.unit").alias("unit"))


def _joined(rows: DataFrame, dictionary: DataFrame, spelling: str, unit: str) -> DataFrame:
    """Left join of the dictionary on column `spelling`; hot spellings never meet in one task."""
    return spread_join(rows, dictionary.select(F.col("spelling").alias(spelling), F.col("unit").alias(unit)), spelling, BROADCAST_ROWS)


def unit_text(c: Column) -> Column:
    """What a written figure has beside its one number; null where that is nothing."""
    rest = strip(F.regexp_replace(c, _RUN, " "))
    return F.when(rest != "", rest)


#: Digits, and what may stand between them in one number.
_RUN = "[0-9](?:[0-9 .,\\u00a0\\u202f]*[0-9])?"


def plain_number(c: Column) -> Column:
    """The number of a written figure ("12 345,6 kF", "€9.5", "1.234.567") as digits with at most one point.

    Null where no figure, or more than one, is written. Thousands may be parted by blanks or points (commas where a
    point or a second group follows); what remains of commas is the decimal mark.
    """
    run = F.regexp_extract(c, _RUN, 0)
    one = F.length(F.regexp_replace(c, _RUN, "")) == F.length(c) - F.length(run)
    digits = F.when((run != "") & one, F.regexp_replace(run, "[ \\u00a0\\u202f]", ""))
    by_points = digits.rlike("^[0-9]{1,3}([.][0-9]{3})+(,[0-9]+)?$")
    by_commas = digits.rlike("^[0-9]{1,3}(,[0-9]{3})+[.][0-9]+$|^[0-9]{1,3}(,[0-9]{3}){2,}$")
    plain = (
        F.when(by_points, F.translate(F.replace(digits, F.lit("."), F.lit("")), ",", "."))
        .when(by_commas, F.replace(digits, F.lit(","), F.lit("")))
        .otherwise(F.translate(digits, ",", "."))
    )
    # most figures are plain digits
    return F.when(c.rlike("^[0-9]+$"), c).otherwise(let(plain, lambda t: F.when(t.rlike("^[0-9]+([.][0-9]+)?$"), t)))


def written_amount(plain: Column) -> tuple[Column, Column]:
    """(millionths as a 64-bit integer, the amount as decimal(38,6)) of a plain number; one of them is null, the first
    from LARGE on. More than DIGITS digits before the point count as so many nines: in no unit do their cents fit."""
    whole = F.ltrim(F.substring_index(plain, ".", 1), F.lit("0"))
    small = F.length(whole) < len(str(LARGE))
    fits = F.when(F.length(whole) > DIGITS, F.lit("9" * DIGITS)).otherwise(plain)
    micro = F.when(plain.contains("."), (plain.try_cast("decimal(18,6)") * F.lit(10**6)).cast("bigint")).otherwise(plain.try_cast("bigint") * 10**6)
    return F.when(small, micro), F.when(~small, fits.try_cast("decimal(38,6)"))


def double_amount(v: Column) -> tuple[Column, Column]:
    """`written_amount` of a double; null for null, NaN and negative ones."""
    known, small = ~F.isnan(v) & (v >= 0), v < LARGE
    micro = F.when(v == F.floor(v), v.cast("bigint") * 10**6).otherwise((v.cast("decimal(18,6)") * F.lit(10**6)).cast("bigint"))
    fits = F.when(v >= 10.0**DIGITS, F.lit("9" * DIGITS).cast("decimal(38,6)")).otherwise(v.try_cast("decimal(38,6)"))
    return F.when(known & small, micro), F.when(known & ~small, fits)


def _ratio(unit: Column, which: int) -> Column:
    """2 a or b of the reduced ratio a / b of cents to millionths of a unit, as a bigint."""
    ratios = {}
    for name, (num, den) in UNITS.items():
        common = gcd(num, den * 10**6)
        ratios[name] = (2 * num // common, den * 10**6 // common)[which]
    return F.create_map(*[F.lit(x) for name, n in ratios.items() for x in (name, n)])[unit].cast("bigint")


def with_cents(figures: DataFrame) -> DataFrame:
    """`figures`(..., micro, large, unit) with `cents`: the amount in euro cents, rounded half up, in exact arithmetic; null
    where 64 bits do not hold it.

    The amount is `micro` millionths, or `large` where that is null. Products that fit 64 bits are worked out so, others
    as decimals of 38 digits. The unit's ratio is looked up in a step of its own, so that the arithmetic stands in the
    generated code once and not for every unit.
    """
    figures = figures.withColumns({"_a": _ratio(F.col("unit"), 0), "_b": _ratio(F.col("unit"), 1)})
    micro, large, a, b = (F.col(c) for c in ("micro", "large", "_a", "_b"))
    n = F.coalesce(micro.cast("decimal(38,0)"), F.when(large < F.lit(Decimal(10**24)), (large * F.lit(10**6)).cast("decimal(38,0)")))
    top, wide = n * a.cast("decimal(8,0)") + b.cast("decimal(14,0)"), b.cast("decimal(14,0)") * 2
    by_decimals = F.when(top < wide * F.lit(Decimal(2**63)), ((top - top % wide) / wide).cast("bigint"))
    by_integers = F.call_function("div", micro * a + b, b * 2)
    fits = micro <= F.call_function("div", F.lit(2**63 - 1) - b, a)
    return figures.withColumn("cents", F.when(fits, by_integers).otherwise(by_decimals)).drop("_a", "_b")


def note_units(sources: DataFrame) -> DataFrame:
    """(source_code, first_year, last_year, spelling): unit phrases of the notes with the years they hold for.

    A note is cut into clauses; words up to four long are phrases. "avant Y", "jusqu'au ../../Y", "depuis le ../../Y"
    set the note's turn of years; a clause with avant, jusqu'à or auparavant speaks of the years before, one with
    depuis or ensuite of those after, any other of all. A clause without a unit belongs to the next one.
    """
    note = F.translate(F.lower("note"), "’", "'")
    turn = F.coalesce(
        F.regexp_extract(note, "avant(?: le [0-9]{2}/[0-9]{2}/| )([0-9]{4})", 1).try_cast("int"),
        F.regexp_extract(note, "jusqu'(?:au|en|à)(?: fin)? (?:[0-9]{2}/[0-9]{2}/)?([0-9]{4})", 1).try_cast("int") + 1,
        F.regexp_extract(note, "(?:depuis|à partir)(?: le| du)? (?:[0-9]{2}/[0-9]{2}/)?([0-9]{4})", 1).try_cast("int"),
    )
    clauses = F.split(note, "[;,:=]|[.](?: |$)")
    clause = sources.filter("note is not null").select("source_code", turn.alias("turn"), F.posexplode(clauses).alias("at", "clause"))
    words = F.regexp_extract_all("clause", F.lit("([^ ']+)"), F.lit(1))
    starts = F.sequence(F.lit(0), F.size("w") - 1)
    phrases = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(4), F.size("w") - i)), lambda n: F.array_join(F.slice("w", i + 1, n), " ")
            ),
        )
    )
    clause = clause.withColumn("w", words).filter(F.size("w") > 0)
    return clause.select("source_code", "turn", "at", "clause", F.explode(phrases).alias("spelling"))


def note_dictionary(sources: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(source_code, first_year, last_year, note_unit), at most one for each source and year."""
    found = _joined(note_units(sources), dictionary, "spelling", "unit")
    longest = F.max(F.when(F.col("unit").isNotNull(), F.struct(F.length("spelling"), "unit")))
    clause = found.groupBy("source_code", "turn", "at", "clause").agg(longest.alias("u"))
    by_source = W.partitionBy("source_code").orderBy("at")
    clause = clause.withColumn("unit", F.col("u.unit"))
    # a clause without a unit is put before the next one that has one
    clause = clause.withColumn("group", F.coalesce(F.count("unit").over(by_source.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    told = clause.groupBy("source_code", "turn", "group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "clause"))), lambda x: x["clause"]), " ").alias("said"),
        F.max("unit").alias("note_unit"),
    )
    before, after = F.col("said").rlike("avant|jusqu|auparavant"), F.col("said").rlike("depuis|ensuite|partir|après")
    auparavant = F.col("said").rlike("auparavant|avant [0-9l]|jusqu")
    first = F.when(F.col("turn").isNotNull() & after & ~auparavant, F.col("turn")).otherwise(F.lit(0))
    last = F.when(F.col("turn").isNotNull() & before, F.col("turn") - 1).otherwise(F.lit(9999))
    spans = told.filter("note_unit is not null").select("source_code", first.alias("first_year"), last.alias("last_year"), "note_unit")
    return spans.groupBy("source_code", "first_year", "last_year").agg(F.min("note_unit").alias("note_unit"))


def report_lines(reports: DataFrame) -> DataFrame:
    """(row_id, year, source_code, devise, rang, t, written): the figures of `payout_reports` as they are written, and the
    unit text beside each."""
    long = reports.select(
        F.col("rec_id").alias("row_id"),
        F.substring(strip(F.col("annee_numero")), 1, 4).try_cast("int").alias("year"),
        "source_code",
        F.when(strip(F.col("devise")) != "", strip(F.col("devise"))).alias("devise"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rang"), strip(F.col(f"rapport_du_rang{r}")).alias("t")) for r in (1, 2)])).alias("f"),
    ).select("row_id", "year", "source_code", "devise", "f.rang", "f.t")
    return long.withColumn("written", unit_text(F.col("t")))


def unit_dictionary(reports: DataFrame | None = None, sources: DataFrame | None = None, tirages: DataFrame | None = None) -> DataFrame:
    """The alias dictionary of all spellings of the given tables, made once and checkpointed.

    Spellings need no number: what is beside a figure that cannot be read is no unit, or does no harm.
    """
    spellings = []
    if reports is not None:
        spellings.append(report_lines(reports).select(F.explode(F.array("written", "devise")).alias("spelling")))
    if sources is not None:
        spellings.append(note_units(sources).select("spelling"))
    if tirages is not None:
        spellings.append(tirages.select(strip(F.col("devise")).alias("spelling")).filter("spelling <> ''"))
    # each table's spellings are made distinct before they meet
    return cut(alias_dictionary(reduce(DataFrame.unionByName, [s.distinct() for s in spellings])))


def payout_figures(reports: DataFrame, sources: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(row_id, rang, positive, number, unit, cents) of every figure of `payout_reports` that can be read.

    The unit is the one written with the figure, else that of `devise`, else that of the source's note for the year
    of the draw, else euro. A unit text or `devise` that no known spelling is near to counts as none.
    """
    long = report_lines(reports)
    dictionary = unit_dictionary(reports, sources) if dictionary is None else dictionary
    micro, large = written_amount(F.col("plain"))
    long = long.withColumn("plain", plain_number(F.col("t"))).filter("plain is not null")
    long = long.select("row_id", "year", "source_code", "devise", "rang", "written", micro.alias("micro"), large.alias("large"))
    notes = cut(note_dictionary(sources, dictionary))
    small = notes.count() <= BROADCAST_ROWS
    spans = notes.select(F.col("source_code").alias("_s"), "first_year", "last_year", "note_unit")
    known = _joined(_joined(long, dictionary, "written", "unit_1"), dictionary, "devise", "unit_2")
    year_fits = F.col("year").between(F.col("first_year"), F.col("last_year"))
    told = known.join(F.broadcast(spans) if small else spans, (F.col("source_code") == F.col("_s")) & year_fits, "left")
    return _converted(told, F.coalesce("unit_1", "unit_2", "note_unit", F.lit(PLAIN)))


def _converted(figures: DataFrame, unit: Column) -> DataFrame:
    """(row_id, rang, positive, number, unit, cents) of figures with micro, large."""
    number = F.coalesce("large", F.col("micro").cast("decimal(38,6)") / F.lit(10**6)).cast("decimal(38,6)")
    figures = with_cents(figures.select("row_id", "rang", "micro", "large", unit.alias("unit")))
    positive = F.coalesce(F.col("micro") > 0, F.lit(True))
    return figures.select("row_id", "rang", positive.alias("positive"), number.alias("number"), "unit", "cents")


def draw_figures(tirages: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """The same of the payouts of ranks 1 and 2 of `tirages`; null, NaN and negative ones are left out."""
    long = tirages.select(
        F.col("id").alias("row_id"),
        F.when(strip(F.col("devise")) != "", strip(F.col("devise"))).alias("devise"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rang"), F.col(f"rapport_rang{r}").alias("v")) for r in (1, 2)])).alias("f"),
    ).select("row_id", "devise", "f.rang", "f.v")
    micro, large = double_amount(F.col("v"))
    long = long.select("row_id", "devise", "rang", micro.alias("micro"), large.alias("large")).filter("micro is not null or large is not null")
    dictionary = unit_dictionary(tirages=tirages) if dictionary is None else dictionary
    return _converted(_joined(long, dictionary, "devise", "unit"), F.coalesce("unit", F.lit(PLAIN)))


def in_cents(reports: DataFrame, sources: DataFrame, tirages: DataFrame) -> DataFrame:
    """(src_table, row_id, rang, positive, number, unit, cents) of all payouts of both tables. Figures that 64 bits do not
    hold in cents come out with null cents."""
    dictionary = unit_dictionary(reports, sources, tirages)
    a = payout_figures(reports, sources, dictionary).select(F.lit("payout_reports").alias("src_table"), "*")
    b = draw_figures(tirages, dictionary).select(F.lit("tirages").alias("src_table"), "*")
    return a.unionByName(b)
