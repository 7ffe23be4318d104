"""Embedding near-dedup by sorted projection passes.

A pass gives every vector a key of concatenated random-hyperplane bits, sorts all vectors by it, and compares each with
the neighbours in a bounded window. Links found in any pass are verified by cosine in double precision and united. Equal
vectors are one vector with a count, so a group of copies costs one row.

How many passes a vector takes part in isn't fixed. Where the rows that share the first k bits of a vector's key all lie
in its window, a link at the threshold was compared with a chance of at least (1 - angle / pi) ** k, whatever the data.
The chances of its passes are multiplied up until that of having missed such a link is below `MISS`; then the vector
leaves. A window that ends at the edge of a range partition counts for nothing. Passes come in rounds; when, after a
round, comparing all vectors that are left with one another costs less than the passes they still need, as in dense
ranges, they are compared in blocks, all with all.

Once it is known which vectors hang together, the vectors of each component are compared in blocks, all with all inside
the component, and only counts leave a block. A component larger than a block is dealt out as pairs of blocks.

Defined results: vectors that are null, empty, of zero length, or hold null or non-finite values link with nothing and
are components of their own; vectors of different dimension link with nothing; equal rows (same vec_id) count as vectors
of their own and share a component, and rows of one vec_id with different vectors are vectors like any others; a sound
vector with a null vec_id links like any other, and component_id is null only where no vec_id is reached; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, table

THRESHOLD = 0.9
PASSES = 20
BITS = 40
WINDOW = 256
BLOCK = 2048
#: Passes of a vector go on until the chance of having missed a link of it at the threshold is below this.
MISS = 1e-4


def unit(rows) -> np.ndarray:
    x = np.concatenate(list(rows)).astype(np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(passes: int, bits: int, first: int):
    planes: dict[int, np.ndarray] = {}

    def of(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                if dim not in planes:
                    planes[dim] = np.random.default_rng((7919 + dim, first)).standard_normal((dim, passes * bits))
                on = (unit(part["embedding"]) @ planes[dim] >= 0).reshape(len(part), passes, bits)
                key = on @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                yield pd.DataFrame({"dim": dim, "pass": np.tile(np.arange(passes, dtype=np.int32), len(part)), "key": key.ravel(), "id": np.repeat(part["id"].to_numpy(), passes), "embedding": part["embedding"].repeat(passes).to_numpy()})

    return of


def _agree(threshold: float) -> float:
    """Chance that two vectors at the threshold are on the same side of a random hyperplane."""
    return 1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi


def _log_miss(agree: float, bits):
    """Logarithm of the chance that a link at the threshold differs in one of so many bits."""
    return np.log1p(-np.minimum(agree**bits, 1 - 1e-9))


def _certified(pdf: pd.DataFrame, window: int, bits: int, agree: float) -> pd.DataFrame:
    """What the pass is worth to the rows that have `window` rows before and behind them: the bits that neither the first
    row before the window nor the first behind it shares are enough to hold the row's whole bucket inside the window."""
    key, group = pdf["key"].to_numpy(), pdf[["pass", "dim"]].to_numpy()

    def shared(other):
        far = np.frexp((key[window:-window] ^ key[other]).astype(np.float64))[1]
        return np.where((group[window:-window] == group[other]).all(1), bits - far, -1)

    deep = np.maximum(shared(slice(None, -2 * window)), shared(slice(2 * window, None))) + 1
    gain = np.where(deep > bits, 0.0, _log_miss(agree, deep.astype(np.float64)))
    return pd.DataFrame({"a": pdf["id"].to_numpy()[window:-window], "b": pd.array([None] * len(gain), "Int64"), "gain": gain})


def _window_links(window: int, threshold: float, bits: int):
    """Compares each row with at least `window` rows behind it, and gives one link from each row to the least row that the
    links of its window reach, and, with b null, what the pass is worth to it."""

    def links(x, ids, groups, fresh):
        sim = x[:fresh] @ x.T
        near = (sim >= threshold) & (groups[:fresh, None] == groups[None, :])
        near[np.arange(fresh), np.arange(fresh)] = False
        i, j = np.nonzero(near)
        label = np.arange(len(x))
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            if (low == label).all():
                break
            label = low
        k = np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({"a": ids[k], "b": pd.array(ids[label[k]], "Int64"), "gain": 0.0})

    def of(batches):
        held = seen = None
        for pdf in batches:
            seen = pdf[["pass", "dim", "key", "id"]] if seen is None else pd.concat([seen, pdf[["pass", "dim", "key", "id"]]], ignore_index=True)
            if len(seen) > 2 * window:
                yield _certified(seen, window, bits, _agree(threshold))
                seen = seen.iloc[-2 * window :]
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= 4 * window:
                yield from step(held.iloc[: 3 * window], 2 * window)
                held = held.iloc[2 * window :]
        if held is not None and len(held):
            yield from step(held, len(held))

    def step(part, fresh):
        for dim, p in part.groupby("dim", sort=False):
            known = int((part.iloc[:fresh]["dim"] == dim).sum())
            if known:
                out = links(unit(p["embedding"]), p["id"].to_numpy(), p["pass"].to_numpy(), known)
                if len(out):
                    yield out

    return of


def _block_links(threshold: float):
    """All links of a pair of chunks; gives one link from each row to the least row that they reach."""

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, p in pdf.groupby("dim", sort=False):
            ids, chunk = p["id"].to_numpy(), p["chunk"].to_numpy()
            left, right = np.flatnonzero(chunk == key[0]), np.flatnonzero(chunk == key[1])
            x = unit(p["embedding"])
            y = x[right]
            label = np.arange(len(p))
            for s in range(0, len(left), 512):
                i, j = np.nonzero(x[left[s : s + 512]] @ y.T >= threshold)
                i, j = left[s : s + 512][i], right[j]
                while (open_ := label[i] != label[j]).any():
                    i, j = i[open_], j[open_]
                    up = np.arange(len(p))
                    np.minimum.at(up, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
                    while (up[up] != up).any():
                        up = up[up]
                    label = up[label]
            k = np.flatnonzero(label != np.arange(len(p)))
            out.append(pd.DataFrame({"a": ids[k], "b": ids[label[k]]}))
        return pd.concat(out, ignore_index=True)

    return of


def _links(vectors: DataFrame, n: int, threshold: float, passes: int, bits: int, window: int, block: int) -> DataFrame:
    """vectors (id, embedding), n rows -> (a, b): links that hold together what links at the threshold hold together."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    parts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = vectors.select("id", "embedding", F.lit(0.0).alias("miss"))
    links = vectors.sparkSession.createDataFrame([], "a long, b long")
    enough, done = float(np.log(MISS)), 0
    need = enough / _log_miss(_agree(threshold), max(0.0, np.log2(max(n, 1) / window)) + 1.5)
    while n > 1:
        run = int(np.ceil(min(passes, need)))
        keyed = left.select("id", "embedding").mapInPandas(_keys(run, bits, done), "dim int, pass int, key long, id long, embedding " + kind)
        ordered = keyed.repartitionByRange(parts, "pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")
        found = materialise(ordered.mapInPandas(_window_links(window, threshold, bits), "a long, b long, gain double"))
        links = links.union(found.filter("b IS NOT NULL").select("a", "b"))
        gains = found.filter("b IS NULL").groupBy("a").agg(F.sum("gain").alias("gain"))
        left = materialise(left.join(gains, F.col("id") == F.col("a"), "left").select("id", "embedding", (F.col("miss") + F.coalesce("gain", F.lit(0.0))).alias("miss")).filter(F.col("miss") > enough))
        done += run
        n, mean = left.agg(F.count(F.lit(1)), F.avg("miss")).first()
        need = (enough - mean) * done / mean if n and mean < 0 else np.inf
        # a pass compares a row with about three windows of rows
        if need * 3 * window >= n:
            break
    if n < 2:
        return links
    chunks = max(-(-n // (8 * block)), min(8, -(-n // block)))
    pairs = (
        left.select("id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    )
    return links.union(pairs.select("lo", "hi", "dim", "chunk", "id", "embedding").groupBy("lo", "hi").applyInPandas(_block_links(threshold), "a long, b long"))


def _count_links(threshold: float):
    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        out = []
        for (_, _), p in pdf.groupby(["root", "dim"], sort=False):
            left = p if i == j else p[p["chunk"] == i]
            right = p if i == j else p[p["chunk"] == j]
            if not len(left) or not len(right):
                continue
            y, weight = unit(right["embedding"]), right["copies"].to_numpy()
            x = unit(left["embedding"])
            back = np.zeros(len(right), np.int64)
            for s in range(0, len(left), 512):
                near = x[s : s + 512] @ y.T >= threshold
                if i == j:
                    near[np.arange(len(near)), np.arange(s, s + len(near))] = False
                out.append(pd.DataFrame({"id": left["id"].to_numpy()[s : s + 512], "links": near @ weight}))
                back += left["copies"].to_numpy()[s : s + 512] @ near
            if i != j:
                out.append(pd.DataFrame({"id": right["id"].to_numpy(), "links": back}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})

    return of


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, n_links, component_id, kept)."""
    e = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    good = rows.filter("sound").select("vec_id", "embedding")
    # equal vectors are one, under a number of its own: vec_id may be null or stand for several vectors
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = materialise(distinct.withColumn("id", F.monotonically_increasing_id()))
    member = good.join(distinct.withColumnRenamed("embedding", "same"), F.col("embedding") == F.col("same")).select("vec_id", "id", "least", "copies")
    n = distinct.count()
    found = _links(distinct.select("id", "embedding"), n, threshold, passes, bits, window, block)
    roots = materialise(components(found))
    # small components share tasks, as many as the vectors need
    tasks = max(1, -(-n // block))
    sizes = roots.join(distinct.select(F.col("id").alias("node"), "least"), "node").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"), F.min("least").alias("name"))
    sizes = materialise(sizes)
    inside = (
        distinct.join(roots, F.col("id") == F.col("node")).join(sizes, "root")
        .withColumn("dim", F.size("embedding")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
        # a large component has a task for each pair of its chunks
        .withColumn("task", F.when(F.col("chunks") > 1, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks))))
    )
    counts = inside.select("task", "lo", "hi", "root", "dim", "chunk", "id", "embedding", "copies").groupBy("task", "lo", "hi").applyInPandas(_count_links(threshold), "id long, links long")
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    named = roots.join(sizes.select("root", "name"), "root").select(F.col("node").alias("id"), "name", F.lit(True).alias("linked"))
    linked = (
        member.join(counts, "id", "left").join(named, "id", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id"))
    )
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
