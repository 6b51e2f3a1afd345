from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from drawforge.functions.text import strip
from drawforge.operators import profile, units
from drawforge.plans import quality_queries


def cents_slowly(v, unit):
    num, den = units.UNITS[unit]
    return int(Fraction(v) * num / den + Fraction(1, 2))


def test_written_figures(spark):
    cases = {
        "1 234,5 kF": ("1234.5", "kF"), "€9.5": ("9.5", "€"), "1.234.567": ("1234567", None), "EUR 12": ("12", "EUR"), " 7 ": ("7", None),
        "1 000,25 cts": ("1000.25", "cts"), "2,5 million(s) €": ("2.5", "million(s) €"), "1.234,5": ("1234.5", None), "1,234,567.8": ("1234567.8", None),
        "-": (None, None), "NC": (None, None), "": (None, None), "12 34x56": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    t = strip(F.col("t"))
    got = {r.t: (r.n, r.u) for r in df.select("t", units.plain_number(t).alias("n"), units.unit_text(t).alias("u")).collect()}
    for k, (number, unit) in cases.items():
        assert got[k][0] == number, k
        assert number is None or got[k][1] == unit, k
    assert got[None] == (None, None)


def test_cents_are_exact(spark):
    values = ["0.005", "1", "6.55957", "123456.78", "15349393800", "0.69", "999999999999", "0", "00012.5"]
    values += ["1000000000000", "123456789012345.67", "92233720368547758.07", "92233720368547758.08", "9" * 24, "1" + "0" * 40]
    rows = [(v, u) for v in values for u in units.UNITS]
    micro, large = units.written_amount(F.col("v"))
    df = spark.createDataFrame(rows, "v string, u string").withColumns({"m": micro, "l": large})
    got = units.with_cents(df.withColumnsRenamed({"m": "micro", "l": "large", "u": "unit"})).selectExpr("v", "unit as u", "cents as c").collect()
    for r in got:
        want = cents_slowly(r.v, r.u)
        assert r.c == (want if want < 2**63 else None), r


def test_figures_of_any_size_come_out(spark):
    """What no 64 bits hold in cents has null cents; NaN and negative figures are none."""
    t = spark.createDataFrame([(1, 1e12, 5e14, "AF"), (2, 1e30, float("inf"), "EUR"), (3, float("nan"), -1.0, "EUR"), (4, None, 0.0, "kF")], "id long, rapport_rang1 double, rapport_rang2 double, devise string")
    got = {(r.row_id, r.rang): (r.positive, r.cents) for r in units.draw_figures(t).collect()}
    assert got == {(1, 1): (True, cents_slowly("1000000000000", "AF")), (1, 2): (True, cents_slowly("500000000000000", "AF")), (2, 1): (True, None), (2, 2): (True, None), (4, 2): (False, 0)}
    reports = spark.createDataFrame([(1, "20010000001", "x", "1 234 567 890 123 456 789 012 345", "2 000 000 000 000", None)], "rec_id long, annee_numero string, source_code string, rapport_du_rang1 string, rapport_du_rang2 string, devise string")
    sources = spark.createDataFrame([], "source_code string, note string")
    assert {(r.rang, r.cents) for r in units.payout_figures(reports, sources).collect()} == {(1, None), (2, 2 * 10**14)}


@pytest.mark.parametrize(
    "spelling,unit",
    [("Euros", "EUR"), ("k€", "kEUR"), ("KFRF", "kFRF"), ("milliers d'euros", "kEUR"), ("anciens francs", "AF"), ("ancien francs", "AF"), ("cts", "cEUR"), ("Centimmes", "cEUR"), ("milions d’euros", "MEUR"), ("F", "FRF"), ("dollars", None), ("x", None), ("", None)],
)
def test_alias_dictionary(spark, spelling, unit):
    got = units.alias_dictionary(spark.createDataFrame([(spelling,), (None,), (spelling,)], "spelling string")).collect()
    assert [tuple(r) for r in got] == ([] if unit is None else [(spelling, unit)])


def test_unit_order_and_notes(spark):
    sources = spark.createDataFrame(
        [("a", "Avant 2002 en francs ; depuis, en euros."), ("b", "Tout en centimes d'euro."), ("c", None), ("d", "Sans particularité.")], "source_code string, note string"
    )
    reports = spark.createDataFrame(
        [(1, "20010000001", "a", "10", "10 €", None), (2, "20020000001", "a", "10", None, None), (3, " 20010000001", "b", "5", "5", "kF"), (4, "20010000001", "zz", "5", None, "??"), (5, None, None, "1", None, None)],
        "rec_id long, annee_numero string, source_code string, rapport_du_rang1 string, rapport_du_rang2 string, devise string",
    )
    got = sorted((r.row_id, r.rang, r.unit, r.cents) for r in units.payout_figures(reports, sources).collect())
    assert got == [(1, 1, "FRF", 152), (1, 2, "EUR", 1000), (2, 1, "EUR", 1000), (3, 1, "kFRF", 76225), (3, 2, "kFRF", 76225), (4, 1, "EUR", 500), (5, 1, "EUR", 100)]
    assert units.payout_figures(reports.limit(0), sources).count() == 0


def rows_of(spark, loads):
    rows = [(n, b, c, d, float(r) if r is not None else None) for n, rs in loads.items() for b, c, d, r in rs]
    return spark.createDataFrame(rows, "load_no int, boule_1 int, numero_chance int, date_tirage string, rapport_rang1 double")


def issues(spark, loads):
    p = profile.profile_loads(rows_of(spark, loads), "load_no", list(profile.TIRAGES_LIMITS))
    return sorted((r.load, r.field, r.issue) for r in profile.issues(p).collect())


def test_issues(spark):
    normal = [(1 + i % 49, 1 + i % 10, "12/06/1999", 100.0 * i) for i in range(40)]
    odd = [(None if i < 2 else 7, 1 + i % 10, "31/02/1999" if i == 5 else "1976-01-01" if i == 6 else "01/01/1970" if i == 7 else "12/06/1999", -1.0 if i == 9 else 100.0 * i) for i in range(40)]
    got = issues(spark, {3: normal, 10: odd, 11: normal})
    assert got == [
        (10, "boule_1", "distinct"), (10, "boule_1", "null_rate"), (10, "boule_1", "shift"), (10, "date_tirage", "pattern"), (10, "date_tirage", "range"), (10, "rapport_rang1", "range"), (11, "boule_1", "shift"),
    ]
    assert issues(spark, {}) == []
    assert ("boule_1", "null_rate") in {(f, i) for _, f, i in issues(spark, {1: [(None, None, None, None)] * 3})}


def test_profile_matches_counts(spark):
    t = rows_of(spark, {1: [(1, 1, " ", 5.0), (1, None, "12/06/1999", 5.0)], 2: [(2, 2, "12/06/1999", 7.0)]})
    got = {(r.load, r.field): r for r in profile.profile_loads(t, "load_no", ["boule_1", "date_tirage", "numero_chance"]).collect()}
    assert (got[1, "boule_1"].rows, got[1, "boule_1"].nulls, got[1, "boule_1"].n_distinct) == (2, 0, 1)
    assert got[1, "date_tirage"].nulls == 1 and got[1, "numero_chance"].nulls == 1
    assert got[2, "boule_1"].before == 1 and got[2, "boule_1"].moved == 0 and got[1, "boule_1"].before is None


def test_class_of_a_text_is_its_whole_shape(spark):
    codes = ["P 2124 2283", "F 3637 1035", "Y 5565 2290", "A 1111 2222", "B 3333 4444"]
    loads = {1: [",".join(codes[:3])] * 4, 2: [",".join(codes)] * 4, 3: [",".join(codes)] * 2 + [",".join(codes)[:-1] + "?"] * 2}
    t = spark.createDataFrame([(n, v) for n, vs in loads.items() for v in vs], "load_no int, codes_gagnants string")
    got = {r.load: r for r in profile.profile_loads(t, "load_no", ["codes_gagnants"]).collect()}
    assert got[2].moved == 1 and got[2].psi > 0 and got[2].chi2 == 8
    assert got[3].moved == 0.5 and got[3].psi > 0


def test_profile_query_has_every_column_and_measure(spark, tmp_path):
    rows = [(1, 1, "1999-01-01 00:00:00", 1), (2, 1, "1999-01-01 00:00:10", 1), (2, 1, None, 30), (None, 2, "1970-01-01 00:00:05.5", 30)]
    t = spark.createDataFrame(rows, "id long, load_no int, at string, boule_1 int")
    t.withColumn("loaded_at", F.col("at").cast("timestamp")).drop("at").write.parquet(str(tmp_path / "tirages.parquet"))
    got = {(r.load_no, r.field_name): r for r in quality_queries.p5_profile(spark, str(tmp_path)).collect()}
    assert set(got) == {(n, f) for n in (1, 2) for f in ("id", "loaded_at", "boule_1")}
    one, two = got[1, "id"], got[2, "id"]
    assert (one.rows, one.nulls, one.n_distinct, one.low, one.high) == (3, 0, 2, 1, 2) and (two.nulls, two.distinct_before) == (1, 2)
    assert (got[1, "loaded_at"].low, got[1, "loaded_at"].high) == (915148800, 915148810) and got[2, "loaded_at"].low == 5.5
    ball = got[2, "boule_1"]
    assert (ball.low, ball.high, ball.moved) == (30, 30, 0.666667) and ball.psi > 0
    assert ball.chi2 == round((3**0.5 * 1 - 1 / 3**0.5) ** 2 / 2 + (2 / 3**0.5) ** 2 / 2, 6)


def test_clashing_and_repeated_columns(spark):
    t = rows_of(spark, {1: [(1, 1, "12/06/1999", 5.0)] * 2, 2: [(50, 1, "12/06/1999", 5.0)]})
    t = t.selectExpr("*", "1 as load", "'x' as value", "2 as n", "'y' as field", "3 as `class`", "4 as before")
    p = profile.profile_loads(t, "load_no", ["boule_1", "value", "n"])
    got = {(r.load, r.field): (r.rows, r.n_distinct, r.outside) for r in p.collect()}
    assert got[2, "boule_1"] == (1, 1, 1) and got[1, "value"] == (2, 1, 0) and got[1, "n"] == (2, 1, 0)
    draws = spark.createDataFrame([(1, 100.0, None, "ct", "z", 1), (2, float("nan"), 6.55957, "FRF", "z", 1), (3, None, -1.0, None, "z", 1)], "id long, rapport_rang1 double, rapport_rang2 double, devise string, unit string, rang int")
    assert sorted((r.row_id, r.rang, r.unit, r.cents) for r in units.draw_figures(draws).collect()) == [(1, 1, "cEUR", 100), (2, 2, "FRF", 100)]
    assert units.draw_figures(draws.limit(0)).count() == 0
