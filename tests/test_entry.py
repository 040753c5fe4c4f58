import builtins
import glob
import importlib
import os
import sys

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not here")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else int(x) if not isinstance(x, str) else x
    return list(df.columns), sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def names():
    from chronostore.plans.oracles import ORACLES
    from chronostore.plans.queries import QUERIES

    assert set(ORACLES) == set(QUERIES)
    return list(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry

    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(db.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "value", "version"]


def test_entry_without_the_training_data_operators(monkeypatch):
    kept = {k: sys.modules.pop(k) for k in [*sys.modules] if k in ("__spark_entry__", "corpus_pipeline") or k.startswith("chronostore.llm")}
    real = builtins.__import__

    def absent(name, *args, **kwargs):
        if name == "corpus_pipeline" or "llm" in name:
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", absent)
    entry = importlib.import_module("__spark_entry__")
    assert "replay_chain" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__")
    sys.modules.update(kept)
