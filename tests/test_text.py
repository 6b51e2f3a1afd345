from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawforge.functions import text
from drawforge.functions.names import clean_name, field_of, word_key


def split_slowly(line):
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j, got = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                got += line[j:k]
                if line[k + 1 : k + 2] == '"':
                    got += '"'
                    j = k + 2
                    continue
                break
            if line[k + 1 : k + 2] not in ("", ";"):
                return None
            out.append(got)
            i = k + 1
        else:
            k = line.find(";", i)
            k = len(line) if k < 0 else k
            out.append(line[i:k])
            i = k
        if i >= len(line):
            return out
        i += 1
        if i == len(line):
            return out + [""]


LINES = [
    "", ";", "a;b", "a;b;", ';"x;y";z', '"a""b";c', '"a"b;c', '"open;c', '"";""', '""";x', '"a""";x', 'a"b;c', ';;"q";', '"a";"b', 'x;"a;b"";c";d',
]


def test_split_matches_slow_split(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string")
    got = rows.select("line", text.split_delimited(F.col("line")).alias("f"), text._fold_quoted(F.col("line"), ";").alias("g")).collect()
    for r in got:
        assert r.f == split_slowly(r.line), r.line
        assert r.g == split_slowly(r.line), r.line


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='a;" ', max_size=14), min_size=1, max_size=40))
def test_split_on_any_text(spark, lines):
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in rows.select("line", text.split_delimited(F.col("line")).alias("f"), text._fold_quoted(F.col("line"), ";").alias("g")).collect():
        assert r.f == r.g == split_slowly(r.line), r.line


def test_long_quoted_line_and_null(spark):
    long = '"' + 'x""' * 5000 + '";end'
    rows = spark.createDataFrame([(long,), (None,)], "line string")
    a, b = rows.select(text.split_delimited(F.col("line")).alias("f")).collect()
    assert a.f == ['x"' * 5000, "end"] and b.f is None


def test_real_dates(spark):
    values = ["29/02/2020", "29/02/2021", "2020-12-31", "20201231", "20201331", "1/2/2020", "", None, "12/06/1976\n"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.real_date(F.col("v")).cast("string")).collect()]
    assert got == ["2020-02-29", None, "2020-12-31", "2020-12-31", None, None, None, None, None]


def test_names(spark):
    raw = ["﻿Annee_Numero_De_Tirage", '"devise" ', "NB_codes", "nbre_codes_gagnants", "gagnants_rang5", "promotion", "rapport_du_rang5"]
    df = spark.createDataFrame([(v,) for v in raw], "v string")
    got = [r[0] for r in df.select(field_of(clean_name(F.col("v")))).collect()]
    assert got == ["annee_numero_de_tirage", "devise", "nombre_de_codes_gagnants", "nombre_de_codes_gagnants", "nombre_de_gagnant_au_rang5", "promotion", "rapport_du_rang5"]
    assert word_key("Nb_gagnants_rang_5") == word_key("nombre_de_gagnant_au_rang5")
