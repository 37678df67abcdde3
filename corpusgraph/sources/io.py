"""Readers and writers of documents, metadata, experiment runs, and evaluation tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions.text import file_name, links

METADATA = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "Description", "Type", "Date", "Authors", "Topics", "Brands", "Divisions", "MPC Round", "Forecast Round")])
FEEDBACK = T.StructType([T.StructField("rating", T.StringType(), False), *[T.StructField(c, T.StringType()) for c in ("rating_comment", "question", "content_type", "answer")]])


def read_metadata(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The document metadata table, keyed by its first column (``nan`` texts become null)."""
    df = spark.read.option("header", True).csv(path, schema=METADATA) if fmt == "csv" else spark.read.format(fmt).load(path)
    return df.select(*[F.when(F.lower(F.col(f"`{c}`").cast("string")) == "nan", None).otherwise(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def read_files(spark: SparkSession, path: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """``(path, name, content)`` of a folder's files; ``limit`` counts files in name order."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    df = df.select("path", file_name(F.col("path")).alias("name"), "content")
    return df if limit is None else df.orderBy("name", "path").limit(limit)


def limit_files(nodes: DataFrame, file: str, limit: int) -> DataFrame:
    """Nodes of the first ``limit`` files by name."""
    first = nodes.select(file).distinct().orderBy(file).limit(limit)
    return nodes.join(F.broadcast(first), file, "left_semi")


def extract_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, pos, link)``: link targets in page order, repeats kept."""
    return pages.select(key, F.posexplode(links(F.col(html))).alias("pos", "link"))


def attach_metadata(docs: DataFrame, metadata: DataFrame, docs_key: str, meta_key: str) -> DataFrame:
    """Documents with their metadata as text columns."""
    m = metadata.select(*[F.col(f"`{c}`").cast("string").alias(f"meta_{c}") for c in metadata.columns])
    return docs.join(m, docs[docs_key] == F.col(f"`meta_{meta_key}`"), "left")


def rename_metadata(metadata: DataFrame, names: dict[str, str], drop: Iterable[str] = ()) -> DataFrame:
    """Metadata columns under new names, some dropped; a name that isn't there is refused."""
    if unknown := {*names, *drop} - set(metadata.columns):
        raise ValueError(f"no columns {sorted(unknown)}")
    return metadata.drop(*drop).withColumnsRenamed(names)


def test_cases(spark: SparkSession, cases: Iterable[tuple[str, str]]) -> DataFrame:
    """``(case_id, question, anchor_document)`` of hand-written cases."""
    return spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(cases)], "case_id int, question string, anchor_document string")


def read_test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a simple YAML list of ``question`` and ``anchor_document`` entries, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^\\s*- ")).alias("entry"))
    value = lambda name: F.regexp_extract("entry", f"(?m)^\\s*{name}:\\s*[\"']?(.*?)[\"']?\\s*$", 1)
    return lines.select(value("question").alias("question"), value("anchor_document").alias("anchor_document")).where("question <> ''")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_run(tables: dict[str, DataFrame], root: str, experiment: str, run_id: str) -> str:
    """Write an experiment run; an earlier run of that name is never overwritten (``_1``, ``_2``, ...)."""
    spark = next(iter(tables.values())).sparkSession
    path, n = f"{root}/{experiment}/{run_id}", 0
    while _exists(spark, path):
        n += 1
        path = f"{root}/{experiment}/{run_id}_{n}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return path


def load_run(spark: SparkSession, path: str, names: Iterable[str] = ("nodes", "edges", "params")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if _exists(spark, f"{path}/{n}")}


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """``(experiment, run_id)`` of all runs under ``root``, sorted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString().rsplit("/", 2)[1:] for s in (fs.globStatus(p) or [])]
    return spark.createDataFrame(sorted(map(tuple, found)), "experiment string, run_id string")


def save_stamped(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write under a name of the current time, ``output_yyyyMMddHHmmss``."""
    stamp = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")).first()[0]
    df.write.mode("errorifexists").format(fmt).save(path := f"{root}/output_{stamp}")
    return path


def save_stage(df: DataFrame, root: str, stage: str) -> DataFrame:
    """Write a stage's rows as JSON and read them back: the stage's checkpoint."""
    df.write.mode("overwrite").json(f"{root}/{stage}")
    return df.sparkSession.read.schema(df.schema).json(f"{root}/{stage}")


def save_evaluation(df: DataFrame, root: str) -> None:
    """The human-evaluation sheet, one folder a run."""
    df.write.mode("append").partitionBy("run").parquet(root)


def append_feedback(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Append feedback rows; a row without a rating is refused."""
    for r in rows:
        if r.get("rating") is None:
            raise ValueError("feedback needs a rating")
    data = [tuple(None if r.get(f.name) is None else str(r[f.name]) for f in FEEDBACK) for r in rows]
    spark.createDataFrame(data, FEEDBACK).write.mode("append").parquet(path)


def positional_zip(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two tables side by side on an explicit case number."""
    return a.join(b, key)


def widen(df: DataFrame, array: str, n: int, prefix: str) -> DataFrame:
    """A list column as ``n`` columns."""
    return df.select("*", *[F.get(array, F.lit(i)).alias(f"{prefix}_{i}") for i in range(n)]).drop(array)


def scaled_by_run(weights: DataFrame, run: str, weight: str) -> DataFrame:
    """Weights numbered within their run, one column a run (shorter runs end in nulls)."""
    numbered = weights.withColumn("n", F.row_number().over(Window.partitionBy(run).orderBy(weight)))
    return numbered.groupBy("n").pivot(run).agg(F.first(weight))
