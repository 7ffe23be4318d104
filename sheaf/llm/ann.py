"""Approximate maximum-inner-product search: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

A codebook of 16 centroids for each block of `sub` dimensions is fitted on a bounded sample of rows. The loss weighs the
part of the residual that is parallel to the vector `eta` times as much as the part across it, because only the parallel
part moves the scores of queries that the vector would win. Every row is then encoded: two codes to a byte.

Rows are packed in blocks of `block`. A query's table holds its inner product with every centroid; a block is scanned by
adding up table entries. The `rerank` best rows of each block are scored again, on the original vectors in double
precision, and the best `k` of each block meet in one top-k a query, which Spark aggregates before it shuffles.

Queries are a stated set: they are packed in chunks, and each chunk visits each block. Defined results: vectors that are
null, empty, zero, or hold null or non-finite values take no part; vectors of another dimension than the most frequent
one are searched exactly among themselves; fewer than k candidates give fewer rows; ties go to the smaller vec_id; rows
equal in vec_id and vector are one; rows of one vec_id with different vectors are queries of their own, whose results
stand side by side under that query_id, and candidates of one another; rows without vec_id take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

K = 20
EVERY = 20
SAMPLE = 16_384
ETA = 4.0
SUB = 2
BLOCK = 4096
CHUNK = 256
RERANK = 160


def fit(x: np.ndarray, sub: int = SUB, eta: float = ETA, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """(blocks, 16, sub) codebooks. Assignment and update both use the anisotropic loss with the direction of x."""
    n, dim = x.shape
    pad = -dim % sub
    x = np.pad(x, ((0, 0), (0, pad)))
    blocks = (dim + pad) // sub
    rng = np.random.default_rng(seed)
    books = np.zeros((blocks, 16, sub))
    direction = x / np.linalg.norm(x, axis=1, keepdims=True)
    for b in range(blocks):
        part, d = x[:, b * sub : (b + 1) * sub], direction[:, b * sub : (b + 1) * sub]
        c = part[rng.choice(n, 16, replace=n < 16)].copy()
        for _ in range(rounds):
            code = _assign(part, d, c, eta)
            for k in range(16):
                p, e = part[code == k], d[code == k]
                if not len(p):
                    c[k] = part[rng.integers(n)]
                    continue
                # sum of (I + (eta - 1) d d^T) (x - c) = 0
                m = len(p) * np.eye(sub) + (eta - 1) * e.T @ e
                c[k] = np.linalg.solve(m, p.sum(0) + (eta - 1) * (e * (e * p).sum(1, keepdims=True)).sum(0))
        books[b] = c
    return books


def _assign(part: np.ndarray, direction: np.ndarray, c: np.ndarray, eta: float) -> np.ndarray:
    r = part[:, None, :] - c[None]
    return ((r**2).sum(2) + (eta - 1) * (r * direction[:, None, :]).sum(2) ** 2).argmin(1)


def encode(x: np.ndarray, books: np.ndarray, eta: float = ETA) -> np.ndarray:
    """Four-bit codes, two to a byte. The parallel residual of a row is that of all its blocks together, so after the
    first assignment each block is chosen again, given the others."""
    blocks, _, sub = books.shape
    x = np.pad(x, ((0, 0), (0, blocks * sub - x.shape[1])))
    direction = x / np.linalg.norm(x, axis=1, keepdims=True)
    code = np.empty((len(x), blocks), np.uint8)
    along = np.zeros(len(x))
    for b in range(blocks):
        s = slice(b * sub, (b + 1) * sub)
        code[:, b] = _assign(x[:, s], direction[:, s], books[b], eta)
        along += ((x[:, s] - books[b][code[:, b]]) * direction[:, s]).sum(1)
    for _ in range(2):
        for b in range(blocks):
            s = slice(b * sub, (b + 1) * sub)
            r = x[:, None, s] - books[b][None]
            p = (r * direction[:, None, s]).sum(2)
            now = code[:, b].astype(np.int64)
            rest = along - p[np.arange(len(x)), now]
            code[:, b] = ((r**2).sum(2) + (eta - 1) * (rest[:, None] + p) ** 2).argmin(1)
            along = rest + p[np.arange(len(x)), code[:, b].astype(np.int64)]
    if blocks % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return code[:, 0::2] | code[:, 1::2] << 4


def scan(queries: np.ndarray, packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, queries) approximate scores, by adding table entries."""
    blocks, _, sub = books.shape
    q = np.pad(queries, ((0, 0), (0, blocks * sub - queries.shape[1])))
    out = np.zeros((len(packed), len(q)), np.float32)
    for b in range(blocks):
        entries = (books[b] @ q[:, b * sub : (b + 1) * sub].T).astype(np.float32)
        code = packed[:, b // 2] >> 4 if b % 2 else packed[:, b // 2] & 15
        out += entries[code]
    return out


def _search(books: np.ndarray | None, dim: int, k: int, rerank: int):
    """Chunks of queries against blocks of rows. The blocks of a task come one after another for each chunk, so a query
    leaves the task with its k best of all of them."""

    def top(q, ids, rows, score):
        order = np.lexsort((rows, ids, -score, q))
        q, ids, rows, score = q[order], ids[order], rows[order], score[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < k
        return q[keep], ids[keep], rows[keep], score[keep]

    def out(q_ids, q_rows, held):
        q, ids, rows, score = top(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pd.DataFrame({"query_id": q_ids[q], "query_row": q_rows[q], "vec_id": ids, "row": rows, "score": score})

    def of(batches):
        chunk, q_ids, q_rows, q, held = None, None, None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.q_rows != chunk:
                    if held:
                        yield out(q_ids, q_rows, held)
                    chunk, held = row.q_rows, []
                    q_ids, q_rows, q = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_rows, np.int64), np.frombuffer(row.q_vectors, np.float64).reshape(-1, dim)
                x, ids, rows = np.frombuffer(row.vectors, np.float64).reshape(-1, dim), np.frombuffer(row.ids, np.int64), np.frombuffer(row.rows, np.int64)
                take = min(len(x), rerank + 1)
                if take < len(x):
                    rough = scan(q, np.frombuffer(row.codes, np.uint8).reshape(len(x), -1), books)
                    best = np.argpartition(-rough, take - 1, axis=0)[:take].T
                else:
                    best = np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
                found = []
                for n in range(len(q)):
                    at = best[n]
                    at = at[rows[at] != q_rows[n]]
                    score = (x[at] * q[n]).sum(1)
                    order = np.lexsort((rows[at], ids[at], -score))[:k]
                    found.append((np.full(len(order), n), ids[at][order], rows[at][order], score[order]))
                held.append(tuple(np.concatenate(y) for y in zip(*found, strict=True)))
                if len(held) > 8:
                    held = [top(*(np.concatenate(y) for y in zip(*held, strict=True)))]
        if held:
            yield out(q_ids, q_rows, held)

    return of


def _pack_rows(books: np.ndarray | None, size: int, eta: float):
    """Rows to blocks of at most `size`, with codes where a codebook is given."""

    def of(batches):
        held_id, held_row, held = [], [], []

        def out():
            x = np.array(held, dtype=np.float64)
            codes = encode(x, books, eta).tobytes() if books is not None else b""
            return pd.DataFrame({"ids": [np.array(held_id, np.int64).tobytes()], "rows": [np.array(held_row, np.int64).tobytes()], "vectors": [x.tobytes()], "codes": [codes]})

        for pdf in batches:
            for i, r, v in zip(pdf["vec_id"], pdf["row"], pdf["v"], strict=True):
                held_id.append(i)
                held_row.append(r)
                held.append(v)
                if len(held) == size:
                    yield out()
                    held_id, held_row, held = [], [], []
        if held:
            yield out()

    return of


_BLOCK = "ids binary, rows binary, vectors binary, codes binary"


def search(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, eta: float = ETA, sub: int = SUB, block: int = BLOCK, chunk: int = CHUNK, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the k rows with the largest inner product."""
    v = F.col("embedding").cast("array<double>")

    def sound(df: DataFrame) -> DataFrame:
        ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
        return df.filter(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()

    # a row is known by a hash of its vec_id and vector, in either table; -0.0 is 0.0
    named = lambda df: df.withColumn("row", F.xxhash64("vec_id", F.transform("v", lambda e: e + F.lit(0.0))))
    rows, asked = named(sound(vectors)), named(sound(queries))
    dims = sorted((r["count"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).count().collect())
    found = None
    for n, dim in reversed(dims):
        books = None
        of_dim = rows.filter(F.size("v") == dim)
        if dim == dims[-1][1]:
            # a bounded sample by hash: the same rows on every run, about `sample` of them, at most twice as many
            share = min(1.0, sample / n)
            drawn = of_dim.filter(F.pmod(F.xxhash64(F.lit("codebook"), "vec_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample)
            books = fit(np.array([r.v for r in drawn.select("v").toLocalIterator()]), sub, eta)
        blocks = of_dim.mapInPandas(_pack_rows(books, block if books is not None else rerank, eta), _BLOCK)
        number = vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")
        # blocks are as full as the input's partitions allow; each lies in one task, each chunk of queries visits each task
        blocks = materialise(blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(int(number)))))
        chunks = asked.filter(F.size("v") == dim).mapInPandas(_pack_rows(None, chunk, eta), _BLOCK).select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(number) - 1).cast("long"))).alias("part"))
        # the chunks are the streamed side of the merge join: each meets all blocks of its task before the next does
        met = chunks.join(blocks.hint("shuffle_merge"), "part").select("ids", "rows", "vectors", "codes", "q_ids", "q_rows", "q_vectors").mapInPandas(_search(books, dim, k, rerank), "query_id long, query_row long, vec_id long, row long, score double")
        found = met if found is None else found.union(met)
    if found is None:
        found = rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).cast("long").alias("query_row"), "vec_id", "row", F.lit(0.0).alias("score")).filter("false")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))
