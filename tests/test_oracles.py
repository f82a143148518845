"""Every query with SQL gives the SQL's rows on the smallest tables."""

import pandas as pd
import pytest

from docweir.registry import ORACLES, QUERIES
from tests.conftest import SF


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "-"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].map(shown).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
