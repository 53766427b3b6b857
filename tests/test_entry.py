import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lorekeep.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "video_id", "score", "rank"]


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(str([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())


def test_engine_works_without_the_llm_subpackage(monkeypatch):
    import importlib.util as util

    real = util.find_spec
    monkeypatch.setattr(util, "find_spec", lambda name, *a: None if name in ("lorekeep.llm", "corpus_pipeline") else real(name, *a))
    sys.modules.pop("__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    assert bare.queries() and not any(n.startswith("op") or n == "pipeline" for n in bare.queries())
    sys.modules.pop("__spark_entry__")
