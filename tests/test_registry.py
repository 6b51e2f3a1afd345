import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from drawforge.plans import draw_queries, quality_queries

NAMES = sorted(set(draw_queries.ORACLE) | set(quality_queries.ORACLE))


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, views, name):
    df = entry_module.queries()[name](spark, sf)
    cur = views.execute(entry_module.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    key = lambda r: tuple(repr(x) for x in r)
    want = sorted((tuple(r) for r in cur.fetchall()), key=key)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == want


def test_only_a_missing_subpackage_is_passed_over(monkeypatch):
    monkeypatch.setattr(entry_module, "_OPTIONAL", ["drawforge.llm.broken"])
    if entry_module.importlib.util.find_spec("drawforge.llm") is None:
        assert entry_module.queries()
    else:
        with pytest.raises(ImportError):
            entry_module.queries()


def test_checkpoints_need_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("D", (), {"isDefined": lambda self: False})()})()})()
        getConf = lambda self: {}

    from drawforge.session import ensure_checkpoint_dir

    far = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(far)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark, sf):
    assert entry_module.entry(spark).count() >= 0
