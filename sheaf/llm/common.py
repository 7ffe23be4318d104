"""What the training-data operators share: table access, shared-folder materialisation, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder of a local session that names none.
_local: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is read from the session; only where the session names none (a local
    session, as in tests) is a temporary one set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="sheaf-")
    return _local


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no more than the
    tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheaf-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sheaf_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_sheaf_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def key_of(column: str) -> Column:
    """Join key that also matches null with null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that links reach. edges: (a long, b long); nodes without an edge have no row.

    Alternating large-star and small-star rounds: every round is two grouped minima and two joins, no group is
    collected, and the number of rounds grows with the logarithm of a component's size. Each step is written to the shared
    folder before it is joined, so that both sides of a join are plain exchanges, which can be split where a node has many
    links."""
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: larger neighbours move to the least of the neighbourhood
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = materialise(big.union(now.join(least, "u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # small star: smaller neighbours move to the least of them
        low = materialise(big.groupBy("u").agg(F.min("v").alias("m")))
        small = big.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        release(least, big, low)
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        release(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError("links did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
