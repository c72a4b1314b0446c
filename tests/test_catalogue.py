"""Every query of the catalogue against its SQL, on a small table set of the same shape as the driver's."""

import datetime
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cadence.plans import catalogue


def write_tables(spark, d):
    """A small set of tables of the driver's shape under ``d``."""
    rng = random.Random(9)
    start = datetime.datetime(1995, 1, 2)
    made = {
        "region": ([(i, f"REGION_{i}") for i in range(2)], "r_regionkey int, r_name string"),
        "nation": ([(i, f"NATION_{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, rng.randrange(4)) for i in range(40)], "c_custkey long, c_nationkey int"),
        "orders": ([(i, rng.randrange(40), rng.choice("FOP"), rng.randrange(100_000, 300_000) + 0.25, start + datetime.timedelta(hours=rng.randrange(24 * 2400)), rng.choice(["1-URGENT", "2-HIGH", "5-LOW"])) for i in range(1500)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "events": ([(i, start + datetime.timedelta(hours=7 * i), rng.choice("ab")) for i in range(99)], "event_id long, ts timestamp_ntz, event_type string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = write_tables(spark, tmp_path_factory.mktemp("sf"))
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "orders", "events"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return d, db


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("" if pd.isna(v) else str(v)[:10] if hasattr(v, "isoformat") else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    d, db = tables
    got = catalogue.queries()[name](spark, d).toPandas()
    want = db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())
