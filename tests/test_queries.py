"""Every registered query against its SQL on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def table(arrow):
    """Column names and sorted rows; missing floats are NULL."""
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    clean = [[None if isinstance(v, float) and math.isnan(v) else v for v in c] for c in columns]
    return names, sorted(zip(*clean), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sql, name):
    got = table(queries()[name](spark, FOLDER).toArrow())
    assert got[1]
    if name in oracle_sql():
        assert got == table(sql.sql(oracle_sql()[name]).to_arrow_table())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[0] == "repo"


def test_normality_statistic_by_brute_force(spark, sql):
    """The statistic over the whole table, from the sorted values."""
    from repostrata.functions.distributions import normal_score, shapiro_weights

    for row in queries()["normality"](spark, FOLDER).collect():
        values = [v for (v,) in sql.execute(f"select {row.column} from lineitem order by 1").fetchall()]
        n, mean = len(values), math.fsum(values) / len(values)
        scores = [normal_score(i, n) for i in range(1, n + 1)]
        top, second, divisor = shapiro_weights(n, math.fsum(s * s for s in scores))
        middle = math.fsum(s * v for s, v in zip(scores[2:-2], values[2:-2])) / divisor
        total = middle + top * (values[-1] - values[0]) + second * (values[-2] - values[1])
        w = total**2 / math.fsum((v - mean) ** 2 for v in values)
        assert row.n == n and row.statistic == pytest.approx(w, abs=1e-6)


def test_unparsable_documents_by_brute_force(spark, sql):
    from repostrata.functions.statements import count_statements

    texts = sql.execute("select doc_id, text from documents").fetchall()
    want = {doc for doc, text in texts if not count_statements(text)[0]}
    assert {r.commit_hash for r in queries()["unparsable_sources"](spark, FOLDER).collect()} == want
