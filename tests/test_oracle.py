"""Every query with a SQL counterpart gives the same rows in both engines."""

import collections
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# A classifier needs some more rows to learn from before its held-out labels are the true ones.
LARGER = "/root/testdata/sf0.01"
LEARNED = (
    "decision_tree_url", "random_forest_url", "linear_svm_url", "predict_label_proba", "model_registry", "train_evaluate_report",
    "url_model_alerts", "model_score_stream", "alert_fanout_alerts", "alert_fanout_sent",
)
QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    def opened(folder):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
        return con

    return {folder: opened(folder) for folder in {SF, LARGER}}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    folder = LARGER if name in LEARNED else SF
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    ours = collections.Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck[folder].execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    theirs = collections.Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
