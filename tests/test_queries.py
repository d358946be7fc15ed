"""Every query outside the training-data operators against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "conversations", "events", "supplier", "customer", "orders", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = [tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(plain, key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
