"""Every query with SQL of its own equals DuckDB on the smallest tables; the others give rows."""

import duckdb
import pytest

import __spark_entry__ as contract
from corvid.plans.queries import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    def one(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(list(x)) if isinstance(x, (list, tuple)) else str(x)

    return sorted([one(x) for x in r] for r in rows)


@pytest.mark.parametrize("name", sorted(registry()))
def test_query(spark, duck, name):
    df = registry()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in oracles():
        assert rows
        return
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({oracles()[name]})").fetchall()
    assert comparable(rows) == comparable(want)


def test_active_sets_at_the_bound(spark, duck, tmp_path):
    """The float next to 0.15 is not above 0.15."""
    spark.sql("select 1L as vec_id, array_repeat(0.15F, 64) as embedding, 3 as label union all select 2L, array_repeat(0.15000002F, 64), 3").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = oracles()["q_active_sets"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in registry()["q_active_sets"](spark, str(tmp_path)).collect()]
    assert comparable(got) == comparable(duck.execute(sql).fetchall()) and sorted(r[3] for r in got) == [0, 64]


def test_contract(spark):
    assert set(registry()) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
