import datetime as dt

import pytest

from corpusgraph import build
from corpusgraph.functions.metrics import METRICS
from corpusgraph.operators import scorers
from corpusgraph.sources import io


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["Bank Rate rose to 5.25 as prices rose", "Bank Rate fell as prices fell", "The weather was fine in May", "", None]
    return spark.createDataFrame([(i, t, f"d{i}.pdf") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_runs_from_documents_to_saved_graphs(spark, docs, tmp_path):
    for scorer, scale in (("dot", False), (scorers.EntityLinkScorer(), True)):
        path = build.build_run(docs, str(tmp_path), "exp", "r", scorer, scale)
        run = io.load_run(spark, path)
        assert set(run) == {"nodes", "edges", "params"} and run["nodes"].count() == 5
        threshold = run["params"].first().edge_thresh
        assert all(r.weight > threshold and r.src < r.dst for r in run["edges"].collect())
    assert io.list_runs(spark, str(tmp_path)).count() == 2


def test_evaluation_stages(spark, docs, tmp_path):
    nodes = build.prepare_nodes(docs)
    edges = build.score_edges(nodes)
    out = build.evaluate_qa(
        nodes, edges, str(tmp_path), 4, lambda p: "Question: what?\nAnswer: this" if "rate" in p else "nothing", lambda p: "Evaluation: fine\nTotal rating: 4",
        lambda p: "reply", lambda p: p + " good [RESULT] 5",
    ).collect()
    assert out and all((r.question, r.answer, r.response, r.judge_score, r.relevance_score) == ("what?", "this", "reply", "5", "4") for r in out)
    assert {p.name for p in tmp_path.iterdir()} == {"qa_pairs_raw", "qa_pairs_evaluated", "qa_pairs_answered", "qa_pairs_judged"}


def test_metric_table(spark):
    row = lambda i: (i, "name", [1.0], [1.0], [1.0], "Speech", ["a"], ["t"], ["b"], ["d"], "m", "f", dt.date(2024, 1, i))
    nodes = spark.createDataFrame([row(1), row(2)], "n long, name string, name_emb array<double>, embedding array<double>, desc_emb array<double>, type string, authors array<string>, topics array<string>, brands array<string>, divisions array<string>, mpc_round string, forecast_round string, date date")
    got = build.metric_table(nodes, "n").first().asDict()
    assert all(got[m] == 1 for m in METRICS) and got["average"] == 1
