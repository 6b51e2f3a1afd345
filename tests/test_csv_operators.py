import json

from drawforge.operators import drift, rejects
from drawforge.schema import LAYOUT

NAMES = ["annee_numero_de_tirage", "date_de_tirage", *[f"boule_{i}" for i in range(1, 6)], "numero_chance", "nombre_de_gagnant_au_rang1", "rapport_du_rang1"]
GOOD = ["19990000012", "12/06/1999", "1", "2", "3", "4", "5", "7", "0", "1 200 000,5"]


def line(**changes):
    row = dict(zip(NAMES, GOOD)) | changes
    return ";".join(row[n] for n in NAMES) + ";"


def lines_of(spark, files):
    rows = [(no, k, text) for no, texts in files.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "file_no int, row_no long, line string")


HEAD = ";".join(NAMES) + ";"


def test_reasons(spark):
    cases = [
        (line(), None),
        (line(boule_1='"1"'), None),
        (line(rapport_du_rang1=""), None),
        (line(rapport_du_rang1="1 200 000"), None),
        (line(date_de_tirage="1999-06-12"), None),
        (line(date_de_tirage="19990612"), None),
        (line().rstrip(";"), None),
        ("   ", None),
        (line(boule_2='"2'), "quoting"),
        (line(boule_2='"2"x'), "quoting"),
        (line() + "more;", "column_count"),
        ("# export partiel", "column_count"),
        (line(annee_numero_de_tirage="1999000012"), "bad_key"),
        (line(annee_numero_de_tirage="19750000012"), "bad_key"),
        (line(annee_numero_de_tirage="", boule_1="99"), "bad_key"),
        (HEAD, "bad_key"),
        (line(boule_3="50"), "bad_value"),
        (line(boule_3="5"), "bad_value"),
        (line(boule_3="05"), "bad_value"),
        (line(boule_3=""), "bad_value"),
        (line(numero_chance="11"), "bad_value"),
        (line(numero_chance="１"), "bad_value"),
        (line(date_de_tirage="31/02/1999"), "bad_value"),
        (line(nombre_de_gagnant_au_rang1="1,5"), "bad_value"),
        (line(nombre_de_gagnant_au_rang1="12 00"), "bad_value"),
        (line(rapport_du_rang1="1e5"), "bad_value"),
    ]
    lines = lines_of(spark, {1: [HEAD] + [c[0] for c in cases]})
    clean, bad = rejects.separate(lines)
    got = {r.row_no: r.reason for r in bad.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases, 1) if want}
    assert {r.row_no for r in clean.collect()} == {i for i, (t, want) in enumerate(cases, 1) if not want and t.strip()}


def test_empty_null_and_headless(spark):
    empty = spark.createDataFrame([], "file_no int, row_no long, line string")
    assert [d.count() for d in rejects.separate(empty)] == [0, 0]
    odd = spark.createDataFrame([(1, 0, HEAD, "x"), (1, 1, None, "x"), (2, 3, line(), "x")], "file_no int, row_no long, line string, names string")
    clean, bad = rejects.separate(odd)
    assert clean.count() == 0 and [(r.file_no, r.reason) for r in bad.collect()] == [(2, "column_count")]


def test_other_header_spellings(spark):
    head = '﻿"ANNEE_NUMERO_DE_TIRAGE"; Date_De_Tirage ;boule_1;boule_2;boule_3;boule_4;boule_5;no_chance'
    lines = lines_of(spark, {1: [head, "19990000012;12/06/1999;1;2;3;4;5;10", "19990000013;12/06/1999;1;2;3;4;5;12"]})
    _, bad = rejects.separate(lines)
    assert [(r.row_no, r.reason, r.columns) for r in bad.collect()] == [(2, "bad_value", ["numero_chance"])]


def test_rescue_and_promotion(spark):
    head = "annee_numero_de_tirage;boule_1;nb_codes;promotion;nombre_de_gagnant_au_rang2;boule_1"
    lines = lines_of(spark, {1: [head, "19990000012;7;4 codes;oui;n.c.;8", "19990000013;7;5;;12;7"]})
    clean, _ = rejects.separate(lines, drift.planned_headers(lines))
    raw = {r.row_no: r for r in drift.enforce(clean).collect()}
    assert raw[1].nombre_codes is None and raw[1].boule_1 == 7
    assert json.loads(raw[1]._rescued) == {"nb_codes": "4 codes", "promotion": "oui", "nombre_de_gagnant_au_rang2": "n.c.", "boule_1#6": "8"}
    table = {r.row_no: r for r in drift.promote(drift.enforce(clean)).collect()}
    assert table[1].nombre_codes == 4 and table[2].nombre_codes == 5 and table[2].gagnants_rang2 == 12
    assert json.loads(table[1]._rescued) == {"promotion": "oui", "nombre_de_gagnant_au_rang2": "n.c.", "boule_1#6": "8"}
    assert {r.row_no: r for r in drift.ingest(lines).collect()} == table
    assert set(table[1].asDict()) == {c for c, _ in LAYOUT.values()} | {"file_no", "row_no", "_rescued"}


def test_changes(spark):
    key = "19990000012;1"
    files = {
        1: ["annee_numero_de_tirage;boule_1;nb_codes;x;", key + ";4;a;"],
        2: ["boule_1;annee_numero_de_tirage;nombre_codes;x", "1;19990000012;4;a"],
        5: ["annee_numero_de_tirage;boule_1;nombre_codes;y", key + ";4 codes;2,5"],
        7: ["annee_numero_de_tirage;boule_1;nombre_codes;y"],
        9: ["annee_numero_de_tirage;boule_1;nb_codes;y", key + ";4;2020-01-01"],
        4: ["annee_numero_de_tirage;boule_1;other", key + ";1"],
    }
    known = spark.createDataFrame([(n, "B" if n == 4 else "A") for n in (1, 2, 3, 4, 5, 7, 9)], "file_no int, famille string")
    got = sorted(tuple(r) for r in drift.changes(lines_of(spark, files), known).collect())
    assert got == [
        (2, "nombre_codes", "renamed"),
        (5, "nombre_codes", "retyped"),
        (5, "x", "removed"),
        (5, "y", "added"),
        (9, "nb_codes", "renamed"),
    ]


def test_names_of_same_words_and_with_marks(spark):
    head = "annee_numero_de_tirage;boule_1;Nbre_Codes_Gagnants;a;a;a#2;gagnants_rang;gagnants_rang"
    lines = lines_of(spark, {1: [head, "19990000012;7;4;x;y;z;1;2"], 2: [head, "19990000013;7;;;;;;;"]})
    headers = drift.planned_headers(lines)
    clean, _ = rejects.separate(lines, headers)
    raw = {r.file_no: r for r in drift.enforce(clean).collect()}
    assert set(json.loads(raw[1]._rescued)) == {"nbre_codes_gagnants", "a", "a#5", "a#2#6", "gagnants_rang", "gagnants_rang#8"}
    assert raw[2]._rescued is None
    table = {r.file_no: r for r in drift.ingest(lines).collect()}
    assert table[1].nombre_codes == 4 and table[2].nombre_codes is None
    assert json.loads(table[1]._rescued) == {"a": "x", "a#5": "y", "a#2#6": "z", "gagnants_rang": "1", "gagnants_rang#8": "2"}
    fields = {(r.name, r.field, r.kind) for r in drift.file_fields(lines, headers).filter("file_no = 1").collect()}
    assert fields == {
        ("annee_numero_de_tirage", "annee_numero_de_tirage", "integer"),
        ("boule_1", "boule_1", "integer"),
        ("nbre_codes_gagnants", "nombre_de_codes_gagnants", "integer"),
        ("a", "a", "text"),
        ("a#2", "a#2", "text"),
        ("gagnants_rang", "gagnants_rang", "integer"),
    }


def test_replay_takes_the_first_value_that_can_be_cast(spark):
    head = "annee_numero_de_tirage;nb_codes;nombre_de_codes_gagnants;nombre_codes;rapport_du_rang2;nombre_de_gagnant_au_rang2"
    rows = [
        ("12;x;n.c.;7;1 234,50;1 234", (7, 1234.5, 1234), {"nb_codes": "x", "nombre_de_codes_gagnants": "n.c."}),
        ("13;5;;7;2,5 EUR;12,0", (5, 2.5, 12), {"nombre_codes": "7"}),
        ("14;5;6 codes;;;99999999999999999999", (6, None, None), {"nb_codes": "5", "nombre_de_gagnant_au_rang2": "99999999999999999999"}),
        ("15;;;;-1;+3", (None, -1.0, 3), None),
    ]
    lines = lines_of(spark, {1: [head] + ["199900000" + r[0] for r in rows]})
    clean, _ = rejects.separate(lines, drift.planned_headers(lines))
    for table in (drift.ingest(lines), drift.promote(drift.enforce(clean))):
        for got, (_, want, left) in zip(table.orderBy("row_no").collect(), rows):
            assert (got.nombre_codes, got.rapport_rang2, got.gagnants_rang2) == want
            assert (got._rescued and json.loads(got._rescued)) == left


def test_headers_too_many_to_send_and_hot_files(spark):
    from drawforge.functions.ordering import spread_join

    rows = spark.createDataFrame([(k % 3 if k % 4 else None, k, "a") for k in range(60)], "file_no int, row_no long, x string")
    side = spark.createDataFrame([(0, "p"), (1, "q"), (5, "r")], "file_no int, name string")
    sent = spread_join(rows, side, "file_no", 10).collect()
    split = spread_join(rows, side, "file_no", 0, rows_per_key=4).collect()
    key = lambda r: r.row_no
    assert len(sent) == 60 and sorted(sent, key=key) == sorted(split, key=key)


def test_separation_beyond_the_broadcast_of_headers(spark, monkeypatch):
    lines = lines_of(spark, {k: [HEAD, line(), line(boule_1="50"), line(boule_1='"1')] for k in range(1, 6)})
    want = [sorted(map(str, d.select("file_no", "row_no", d.columns[2]).collect())) for d in rejects.separate(lines)]
    monkeypatch.setattr(rejects.with_headers, "__defaults__", (2,))
    monkeypatch.setattr(rejects.spread_join, "__defaults__", (1, None))
    assert [sorted(map(str, d.select("file_no", "row_no", d.columns[2]).collect())) for d in rejects.separate(lines)] == want
    assert [len(w) for w in want] == [5, 10]


def test_masked_split_equals_matching(spark):
    from drawforge.functions import text
    from pyspark.sql import functions as F

    lines = ['"a;b";c', 'a;"b;c"', '"a""b";c', '"a";"b"', '"a"', '""', '"";', 'a"b;"c;d"', '"a;b', '"a"b;c', 'a;"b;c";', '"a;\x01b";c\x01', ';"";;', '"a";b"c', None, ""]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    want = [["a;b", "c"], ["a", "b;c"], ['a"b', "c"], ["a", "b"], ["a"], [""], ["", ""], ['a"b', "c;d"], None, None, ["a", "b;c", ""], ["a;\x01b", "c\x01"], ["", "", "", ""], ["a", 'b"c'], None, [""]]
    assert [r[0] for r in df.select(text.split_delimited(F.col("line"))).collect()] == want
    folded = df.select(F.when(F.col("line").contains('"'), text._fold_quoted(F.col("line"), ";")))
    assert [r[0] for r in folded.collect()] == [w if x and '"' in x else None for x, w in zip(lines, want)]


def test_numbers_with_leading_zeros(spark):
    lines = lines_of(spark, {1: [HEAD, line(boule_1="0" * 30 + "1"), line(boule_1="0" * 30 + "50")]})
    _, bad = rejects.separate(lines)
    assert [(r.row_no, r.columns) for r in bad.collect()] == [(2, ["boule_1"])]
