"""Written tables that cut lineage: they survive lost executors and are never recomputed."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for this application's written tables, in the folder that the cluster shares.

    ``spark.checkpoint.dir`` is read from the session; where it is absent, a temporary folder is
    used on a single machine, and a cluster is refused.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='corpusgraph-')}"
        _own[app] = f"{base.rstrip('/')}/corpusgraph-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Drop a scratch folder, or the application's whole one when the driver's interpreter ends."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already; the folder is then left to the cluster's own cleaning
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    One pass over the input (an eager ``checkpoint()`` may compute it twice), column pruning for
    every later reader, and no lineage to recompute when an executor is lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned and that nothing will read again."""
    if path := getattr(df, "_written_at", None):
        _remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
