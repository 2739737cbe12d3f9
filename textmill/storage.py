"""Tables in the folder that driver and executors share: they cut lineage, and a lost executor costs nothing of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _own
    _own = _own or "file://" + tempfile.mkdtemp(prefix="textmill-")
    return _own


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/textmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it again. Its path is added to ``paths``; the job is named after it."""
    spark, path, schema = df.sparkSession, shared_path(df.sparkSession, name), df.schema
    before = spark.sparkContext.getLocalProperty("spark.job.description")
    spark.sparkContext.setJobDescription(f"textmill: {name}")
    try:
        df.write.parquet(path)
    finally:
        spark.sparkContext.setLocalProperty("spark.job.description", before)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read again."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
