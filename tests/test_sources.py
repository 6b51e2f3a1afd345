from drawforge.plans import pipeline
from drawforge.session import cut
from drawforge.sources import draw_files
from tests.test_draws import made, table_of

HEAD = "annee_numero_de_tirage;jour_de_tirage;boule_1;boule_2;boule_3;boule_4;boule_5;numero_chance;nombre_de_gagnant_au_rang1;rapport_du_rang1;"


def write(tmp_path, name, *rows):
    path = tmp_path / name
    path.write_text("\n".join([HEAD, *rows]) + "\n", encoding="utf-8")
    return str(path)


def test_numbers(spark):
    texts = ["2,2", "-1,9", " 7 ", "1 651 848", "1_000", "nan", "1e3", "", "2.5d", ".5", "inf", "-Infinity", "1e999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.i, r.x) for r in df.select("t", draw_files.parse_int_safe(df.t).alias("i"), draw_files.number(df.t)[1].alias("x")).collect()}
    assert [got[t] for t in texts] == [(2, False), (-1, False), (7, False), (0, False), (1000, False), (0, False), (1000, False), (0, False), (0, False), (0, False), (0, True), (0, True), (0, True)]


def test_load_rules(spark, tmp_path):
    a = write(
        tmp_path, "a.csv", "k1;L ;1;2;3;4;50;1;0;0;", "k1;L ;1;2;3;4;5;1;2,7;1,5;", "k1;L;9;2;3;4;5;1;0;0;", " ;L;1;2;3;4;5;1;0;0;", "", "k2;L;1;2;3;4;5;11;0;0;", "k3;L;1;2", "k4;L;1;2;3;4;5;1;inf;0;", "k5;L;1;2;3;4;5;x;0;0;"
    )
    b = write(tmp_path, "b.csv", "k1;L;7;2;3;4;5;1;0;0;", "k6;L;1;2;3;4;5;1;n;0;")
    lines = draw_files.read_lines(spark, [a, str(tmp_path / "missing.csv"), b])
    rows, counters = draw_files.load(lines)
    got = {r.annee_numero: r for r in rows.collect()}
    assert set(got) == {"k1", "k6"} and got["k1"].gagnants_rang1 == 2 and got["k1"].rapport_rang1 == 1.5
    assert got["k1"].jour_tirage == "L" and got["k1"].devise == "EUR" and got["k1"].gagnants_rang9 == 0
    assert {r.file_no: (r.read, r.inserted, r.skipped) for r in counters.collect()} == {1: (8, 1, 7), 3: (2, 1, 1)}
    again, _ = draw_files.load(lines, rows)
    assert again.count() == 0
    assert {r.file_no: r.n for r in draw_files.count_lines(lines).collect()} == {1: 9, 3: 2}


def test_report(spark, tmp_path):
    b = pipeline.bundle(cut(table_of(spark, made(120))))
    pipeline.write_report(b, str(tmp_path))
    text = (tmp_path / "report.txt").read_text(encoding="utf-8")
    assert "Tirages analysés : 120" in text and (tmp_path / "results.json").exists()
    v = pipeline.validation(table_of(spark, made(5)))
    assert v["status"] == "SUCCES" and v["errors_count"] == 0
    assert pipeline.write_validation(v, str(tmp_path)) == 0
    twice = made(5) + made(5)[:1]
    faulty = pipeline.validation(table_of(spark, twice))
    assert faulty["status"] == "ECHEC" and faulty["errors_count"] == 1 and faulty["errors"][0].startswith("Doublon: ")
    assert pipeline.write_validation(faulty, str(tmp_path)) == 1 and "Doublon" in (tmp_path / "validation_report.json").read_text(encoding="utf-8")
    assert pipeline.validation(None)["errors_count"] == 1 and pipeline.validation(table_of(spark, []))["errors_count"] == 1
    assert pipeline.prize_analysis(None) == {"by_rank": None, "total_draws": 0}


def test_a_failing_stage_is_reported(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise ValueError("no backtest today")

    monkeypatch.setattr(pipeline, "backtests", broken)
    b = pipeline.bundle(cut(table_of(spark, made(60))))
    assert b["backtests_error"] == "ValueError: no backtest today" and len(b["markov"]) == 10
    assert "no backtest today" in pipeline.text_report(b)
