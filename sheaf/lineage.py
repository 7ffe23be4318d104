"""Tables written to the shared folder, so that a loop's lineage ends at each round and a lost executor costs little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session that names none.
_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="sheaf-")
    return _local


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/sheaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sheaf_path = path
    return out


def erased(*frames: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_sheaf_path", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
