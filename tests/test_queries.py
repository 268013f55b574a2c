"""Registered graph queries against their SQL twins in DuckDB."""

import os

import duckdb
import pytest

from lamella.oracles import ORACLE_SQL
from lamella.queries import QUERIES

DATA = "/root/testdata/sf0.001"
#: Fifteen users are too few to plant communities over.
LARGER = "/root/testdata/sf0.01"
PLANTED = {"fit_exact", "fit_shared", "fit_restarts", "consensus_labels", "consensus_matrix_free", "real_study", "convergence_study", "scalability_study"}


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    out = {}
    for folder in (DATA, LARGER):
        out[folder] = c = duckdb.connect()
        for name in ("customer", "supplier", "orders", "lineitem", "events", "embeddings", "part"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return out


def canonical(frame, columns):
    out = frame[columns].apply(lambda x: x.map(lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v))
    return out.astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    folder = LARGER if name in PLANTED or name.startswith("method_") else DATA
    got, want = QUERIES[name](spark, folder).toPandas(), db[folder].execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert canonical(got, columns).equals(canonical(want, columns))


def test_every_twin_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["simulation_grid", "sparsity_study"])
def test_studies_run(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows and all(0 <= r.error_mean <= 1 and r.nmi_mean <= 1 for r in rows)
