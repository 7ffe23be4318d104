"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source has a weight and a cap of `max_epochs` times its size. The budget, `share` times all sizes, is spread by
weight; a source that would pass its cap is clamped there, and the excess goes to the others by weight until none is
above. Sorted by cap per unit of weight, the clamped sources are a prefix, so prefix sums find the level at once.

A document is taken floor(target / size of source) whole times. The rest of the target is drawn in a seeded order inside
small buckets of each source: documents are taken once more until the bucket's share is reached, the one on the border
for its leading words only. So every source meets its target to about half a word a bucket, a hot source is many
buckets, and reruns agree.

Defined results: null text has size 0; null source is a source, ordered last; a source of size 0 gets target 0; rows that
are equal in every column are drawn independently of which is which; an empty table gives an empty result; all other
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Documents in a bucket, on average. A bucket is the unit that one window sorts.
BUCKET = 2048
SEED = "mix-1"
RESULT = ("size", "source_size", "target", "taken", "__whole", "__extra")


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n, source_size) -> the same with target. One row a source, so the windows are over a few rows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = [F.col("cap") / F.col("w"), F.col("rn")]
    below = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here_up = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    return (
        sizes.withColumn("rn", F.row_number().over(by_name)).withColumn("w", pick).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(here_up))
        # the first source, in this order, that stays under its cap sets the level for all behind it
        .withColumn("first", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("rn"), F.col("level")))).over(everything))
        .withColumn("target", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first")["level"] * F.col("w"))))
        .select("source", "n", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, taken, and __whole, __extra: whole repetitions and words of one more. Columns of
    docs that have these names give way to them."""
    docs = docs.drop(*RESULT)
    order = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.withColumn("size", words_of(F.col("text")))
    slim = sized.select(F.col("source").alias("source"), "size")
    by_source = targets(slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s, n, part, place, bucket, goal = (fresh(docs, "__" + c) for c in ("s", "n", "part", "order", "bucket", "goal"))
    info = by_source.select(F.col("source").alias(s), F.col("n").alias(n), "source_size", "target", F.floor(ratio).alias("__whole"), (ratio - F.floor(ratio)).alias(part))
    deal = F.pmod(F.conv(F.substring(place, 1, 7), 16, 10).cast("long"), F.expr(f"1 + `{n}` div {BUCKET}"))
    dealt = sized.withColumn(place, order).join(info, F.col("source").eqNullSafe(F.col(s))).withColumn(bucket, deal)
    group = Window.partitionBy("source", bucket)
    before = group.orderBy(place, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn(goal, F.floor(F.sum("size").over(group) * F.col(part) + F.lit(0.5)))
        .withColumn("__extra", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col(goal) - F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))))
        .withColumn("taken", F.col("__whole") * F.col("size") + F.col("__extra"))
        .drop(s, n, part, place, bucket, goal)
    )


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: docs, each row as often as it is taken; the last may hold its leading words only."""
    names = {c: fresh(docs, "own_" + c) for c in RESULT if c in docs.columns}
    full = fresh(docs, "__full")
    whole = F.col("__extra") == F.col("size")
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("__whole") + F.when(F.col("__extra") > 0, 1).otherwise(0)), lambda i: i <= F.col("__whole"))
    lead = F.array_join(F.slice(F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, F.greatest(F.lit(1), F.col("__extra").cast("int"))), " ")
    out = mix(docs.withColumnsRenamed(names), **how).filter("taken > 0").withColumn(full, F.explode(copies))
    kept = [F.when(F.col(full) | whole, F.col("text")).otherwise(lead).alias("text") if c == "text" else F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]
    return out.select(*kept)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM s),
w AS (SELECT *, CAST(CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(2 AS DOUBLE) * source_size AS cap,
             CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level AS water FROM l WHERE level * w <= cap ORDER BY cap / w, rn LIMIT 1),
t AS (SELECT source, n, source_size, CASE WHEN (SELECT count(*) FROM f) = 0 THEN cap ELSE least(cap, (SELECT water FROM f) * w) END AS target FROM l),
i AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
b AS (SELECT d.doc_id, d.source, d.size, d.ord, i.source_size, i.target, CAST(floor(i.ratio) AS BIGINT) AS whole, i.ratio - floor(i.ratio) AS part,
             CAST('0x' || substr(d.ord, 1, 7) AS BIGINT) % (1 + i.n // 2048) AS bucket
      FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source),
g AS (SELECT *, CAST(floor(sum(size) OVER (PARTITION BY source, bucket) * part + 0.5) AS BIGINT) AS goal,
             CAST(coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM b)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, goal - before)) AS BIGINT) AS taken FROM g
"""
