"""Queries that need a few numbers of a graph give those of their SQL, and no table of pairs or edges is made."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpusgraph.operators import pairs, tuning, vector_graph
from tests.test_oracles import rows

NAMES = [
    "cosine_pairs",
    "every_other_edge",
    "mean_edge_weight",
    "graph_quick_stats",
    "degree_centrality",
    "graph_components",
    "community_colours",
    "threshold_grid",
    "edge_threshold",
]


@pytest.mark.parametrize("name", NAMES)
def test_statistics_make_no_table_of_pairs(spark, sf, monkeypatch, name):
    def refuse(*a, **k):
        raise AssertionError("all pairs are made")

    for module in (pairs, tuning):
        monkeypatch.setattr(module, "all_pairs", refuse, raising=False)
    monkeypatch.setattr(vector_graph, "BLOCK_ROWS", 60)
    got = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns) and rows(got.columns, got.collect()) == rows(columns, cur.fetchall())
