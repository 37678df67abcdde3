import json

from corpusgraph.sources import io
from corpusgraph.streaming.feedback import stream_feedback


def test_runs_are_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    a, b, c = (io.save_run({"nodes": df, "edges": df}, str(tmp_path), "exp", "r1") for _ in range(3))
    assert [p.rsplit("/", 1)[1] for p in (a, b, c)] == ["r1", "r1_1", "r1_2"]
    assert [tuple(r) for r in io.list_runs(spark, str(tmp_path)).collect()] == [("exp", "r1"), ("exp", "r1_1"), ("exp", "r1_2")]
    assert set(io.load_run(spark, a)) == {"nodes", "edges"}
    assert spark.read.parquet(io.save_stamped(df, str(tmp_path / "out"))).count() == 3


def test_metadata_files_and_cases(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",".join(f.name for f in io.METADATA) + "\nn1,d,Speech,2024-01-01,a,t,nan,v,m,f\n")
    row = io.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert row.name == "n1" and row.Brands is None
    for n in "cab":
        (tmp_path / f"{n}.txt").write_text(n)
    assert [r.name for r in io.read_files(spark, str(tmp_path), "*.txt", 2).collect()] == ["a.txt", "b.txt"]
    (tmp_path / "cases.yml").write_text('- question: "What is it?"\n  anchor_document: report.pdf\n- question: Why\n  anchor_document: speech.pdf\n')
    assert [tuple(r) for r in io.read_test_cases(spark, str(tmp_path / "cases.yml")).collect()] == [("What is it?", "report.pdf"), ("Why", "speech.pdf")]
    assert io.test_cases(spark, [("q", "d")]).count() == 1
    stage = io.save_stage(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path), "qa")
    assert [tuple(r) for r in stage.collect()] == [(1, None)]


def test_links_widening_and_runs(spark, tmp_path):
    pages = spark.createDataFrame([(1, '<a href="x">1</a><a href="y">2</a><a href="x">'), (2, None)], "page_id long, html string")
    assert [r.link for r in io.extract_links(pages).orderBy("pos").collect()] == ["x", "y", "x"]
    wide = io.widen(spark.createDataFrame([(["a", "b"],)], "l array<string>"), "l", 3, "c").first()
    assert tuple(wide) == ("a", "b", None)
    runs = spark.createDataFrame([("r1", 2.0), ("r1", 1.0), ("r2", 5.0)], "run string, w double")
    assert [tuple(r) for r in io.scaled_by_run(runs, "run", "w").orderBy("n").collect()] == [(1, 1.0, 5.0), (2, 2.0, None)]
    io.save_evaluation(runs, str(tmp_path / "sheet"))
    assert spark.read.parquet(str(tmp_path / "sheet")).where("run = 'r1'").count() == 2


def test_feedback_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"rating": "5", "answer": "x"}) + "\n" + json.dumps({"answer": "no rating"}) + "\n")
    for _ in range(2):
        stream_feedback(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.rating for r in spark.read.schema(io.FEEDBACK).parquet(str(tmp_path / "out")).collect()] == ["5"]
