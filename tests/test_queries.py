"""Every registered query against DuckDB on the smallest tables."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


OWN = sorted(n for n in entry.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline")


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name in entry.oracle_sql():
        result = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(result.fetchall(), names)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("siftglass.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "siftglass.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    bare = importlib.util.module_from_spec(importlib.util.spec_from_file_location("bare_entry", entry.__file__))
    bare.__spec__.loader.exec_module(bare)
    assert sorted(bare.queries()) == OWN
