"""The registered queries: contract, oracle agreement on a few, and plan shape."""

import duckdb
import pytest

import __spark_entry__ as E
from veilmap.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_has_an_oracle():
    own = set(catalog.PLANS)
    assert own == set(catalog.ORACLES) and len(own) > 110
    assert own <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    """Columns and rows in a fixed order, numbers rounded, so that ties in some columns don't matter."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu" or df[c].map(lambda v: v is None or isinstance(v, (int, float)) and not isinstance(v, bool)).all():
            df[c] = df[c].astype(float).round(5) + 0.0
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql())))
def test_oracle(spark, duck, name):
    got, want = normal(E.queries()[name](spark, SF).toPandas()), normal(duck.execute(E.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            assert ((got[c] - want[c]).abs().fillna(0) < 3e-5).all() and (got[c].isna() == want[c].isna()).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry_schema(spark):
    assert E.entry(spark).columns == ["subject_id", "m", "k", "phi", "v_all"]


def test_scans_are_pruned_and_unshuffled(spark):
    text = E.queries()["rating_histogram"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in text and "CartesianProduct" not in text
    text = E.queries()["mpl_mean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text  # scoring and the pair kernel keep rows where they are
