import duckdb
import pytest

from skarnwell.llm import queries, sql
from tests.conftest import DATA


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("chunks", "parents", "messages", "memories", "answer_cache"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, str(DATA))
    want = c.execute(sql.oracle_sql()[name]).fetchdf()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.values.tolist()))
    assert len(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_results_behind_the_found_cases(spark):
    run = {k: f(spark, str(DATA)) for k, f in queries.queries().items() if k in ("p2_found", "p2_groups", "p3_found", "p3_pieces", "p4_forms")}
    group = {r.id: r.group for r in run["p2_groups"].collect()}
    pairs = run["p2_found"].collect()
    assert pairs and set(group) == {i for p in pairs for i in p} and all(group[a] == group[b] for a, b in pairs)
    assert run["p2_groups"].filter("path is null").count() == 0
    keys = ["tab", "doc_id", "ordinal"]
    assert set(run["p3_pieces"].select(*keys).filter("piece > 1").distinct().collect()) == set(run["p3_found"].select(*keys).collect())
    assert run["p4_forms"].filter("tab = 'golden_public'").count() == 120
