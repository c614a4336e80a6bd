import importlib.util
import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from webstrata.plans import catalog

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_unique():
    names = [name for module in catalog.MODULES for name in module.queries()]
    assert len(names) == len(set(names))


def test_core_stands_alone():
    """Nothing in the core imports the subpackage that may be left out."""
    root = Path(importlib.util.find_spec("webstrata").origin).parent
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert "webstrata.llm" not in path.read_text(), path


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value) if isinstance(value, (list, dict)) else value
    return None if math.isnan(value) else round(float(value), 6)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@here
@pytest.mark.parametrize("module", catalog.MODULES, ids=lambda m: m.__name__.rsplit(".", 1)[-1])
def test_queries_against_sql(spark, module):
    """Every query runs, and gives the rows of its SQL where it has one."""
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    sql = module.oracle_sql()
    for name, query in module.queries().items():
        got = query(spark, DATA).toPandas()
        assert len(got.columns), name
        if name in sql:
            want = con.execute(sql[name]).df()
            assert sorted(got.columns) == sorted(want.columns), name
            assert rows(got) == rows(want), name
