"""Checks of loaded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BALLS, MAX_BALL


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """(annee_numero, cnt) of trimmed keys that come more than once."""
    return rows.groupBy(F.trim("annee_numero").alias("annee_numero")).agg(F.count("*").alias("cnt")).filter("cnt > 1")


def zero_balls(mode: str = "observed") -> Column:
    """Observed: ball 1 or 5 is 0. Intended: any ball is missing or outside 1..49."""
    if mode == "observed":
        return (F.col("boule_1") == 0) | (F.col("boule_5") == 0)
    return ~F.coalesce(F.forall(F.array(*BALLS), lambda b: b.between(1, MAX_BALL)), F.lit(False))


def missing_date() -> Column:
    return F.col("date_tirage").isNull() | (F.col("date_tirage") == "")


def unsorted_combination(mode: str = "observed") -> Column:
    """Are the numbers of the combination out of order? Observed: parts between "-" that are all digits, so that
    "41+3" is passed over; intended: the balls before "+"."""
    c = F.col("combinaison_croissante")
    text = c if mode == "observed" else F.regexp_replace(c, "[+].*$", "")
    parts = F.filter(F.transform(F.split(text, "-"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))
    numbers = F.transform(parts, lambda x: x.cast("long"))
    return F.coalesce((c != "") & (numbers != F.array_sort(numbers)), F.lit(False))


def errors(rows: DataFrame, mode: str = "observed") -> DataFrame:
    """(error): one text for every fault of the loaded rows, one for each repeated key; an empty table is one fault."""
    one = summary(rows, mode)
    texts = F.array_compact(
        F.array(
            F.when(F.col("rows") == 0, "Aucun tirage en base — chargez les CSV d'abord."),
            F.when(F.col("zero_balls") > 0, "Boules a zero detectees"),
            F.when(F.col("missing_dates") > 0, "Dates manquantes detectees"),
            F.when(F.col("unsorted") > 0, F.format_string("%d combinaison(s) non triee(s)", F.col("unsorted"))),
        )
    )
    twice = duplicate_keys(rows).select(F.format_string("Doublon: %s", F.coalesce("annee_numero", F.lit("None"))).alias("error"))
    return one.select(F.explode(texts).alias("error")).unionByName(twice)


def summary(rows: DataFrame, mode: str = "observed") -> DataFrame:
    """One row: rows, duplicates, zero_balls, missing_dates, unsorted, status (SUCCES or ECHEC)."""
    one = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(zero_balls(mode)).alias("zero_balls"),
        F.count_if(missing_date()).alias("missing_dates"),
        F.count_if(unsorted_combination(mode)).alias("unsorted"),
    )
    twice = duplicate_keys(rows).agg(F.count("*").alias("duplicates"))
    all_ = one.join(F.broadcast(twice))  # one row each
    clean = (F.col("rows") > 0) & (F.col("duplicates") + F.col("zero_balls") + F.col("missing_dates") + F.col("unsorted") == 0)
    return all_.select("rows", "duplicates", "zero_balls", "missing_dates", "unsorted", F.when(clean, "SUCCES").otherwise("ECHEC").alias("status"))
