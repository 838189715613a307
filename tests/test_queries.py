"""Every query outside the optional subpackage against its SQL, at the smallest scale."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

from skarnwell.plans import registry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks parents chats messages memories answer_cache golden_public eval_items content_labels".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v.tz_localize(None) if v.tzinfo else v) if isinstance(v, pd.Timestamp) else v


def bag(pdf):
    return Counter(tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)
