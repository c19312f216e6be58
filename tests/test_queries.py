"""Every registered query on the smallest tables, against DuckDB where SQL is given."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
# Iterative and long: covered by their own tests, run by the driver.
SLOW = {"fiedler", "pcoa", "pcoa_explained", "offline_embeddings", "split_pcoa", "split_spectral"}

# Minutes of predictors and pair products that other tests compare with brute force;
# TAXASPARK_ALL_QUERIES=1 runs them here too.
LONG = ("predict_", "loss_", "evaluate_", "aligned_nn", "best_of", "closest_leaf", "phylo_", "mean_linkage", "nearest_samples",
        "log_predictions", "cut_", "component", "pruned", "tree_", "patristic", "filter_", "root_js", "bray", "collated", "pcoa_plane", "split_pcoa", "offline")
ALL = bool(os.environ.get("TAXASPARK_ALL_QUERIES"))


def _chosen(names):
    return sorted(n for n in names if ALL or not n.startswith(LONG))


pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _canonical(names, rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            return str(x)
        return repr(float(x) + 0.0)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", _chosen(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    assert got == _canonical([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", _chosen(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert len(df.collect()) >= 0 and df.columns


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
