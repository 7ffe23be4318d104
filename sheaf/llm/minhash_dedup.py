"""Near-dedup of documents by weighted Jaccard similarity of their five-word shingles, with BagMinHash signatures.

A document is the multiset of its runs of five words (a shorter one is a single shingle). Signatures: every shingle owns
Poisson processes over the discretised weight axis, one for each dyadic strip [0,1), [1,2), [2,4), ... with a rate in
proportion to the strip's width; a point carries a register and a position inside its strip, drawn bit by bit down the
strip's halves. A document sees the points below its shingle's count, and a register keeps the earliest. Two documents
agree in a register with probability equal to their weighted Jaccard similarity. Points are drawn in order of time and
only up to the time by which all registers are filled, so a signature costs about m log m points and one per shingle.

Then:
1. Equal texts are one node. `BANDS` bands of `ROWS` registers give buckets.
2. In each bucket every node is checked against the bucket's least node: exact multiset overlap on the whole texts.
3. A bucket whose nodes are in one class by now holds nothing new. The nodes of all other buckets are compared with one
   another inside blocks: those that the buckets connect meet in one task, or, if they are more than a block, in a task
   for each pair of blocks. Pairs of one class, and pairs that share no bucket, are skipped; no pair is dropped.
Classes are the connected components of the verified links.

Defined results: null or blank text is a class of its own; equal texts (rows equal in every column too) are one class;
class_id is the least doc_id of the class, nulls last; an empty table gives an empty result; other columns are kept by
`deduplicate` and play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fresh, key_of, materialise, table
from .textscan import U64, buffers, mix64, prefix_hash, slices, span_hash

WORDS = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
REGISTERS = BANDS * ROWS
BLOCK = 400

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the texts in one buffer, sorted by document and hash."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[at[:-1][at[:-1] < len(data)]] |= inside[at[:-1][at[:-1] < len(data)]]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    stops = at[1:][at[1:] > 0] - 1
    end[stops] |= inside[stops]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    word = span_hash(prefix_hash(data), b, e)
    doc = np.searchsorted(at, b, side="right") - 1
    n = np.bincount(doc, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    position = np.arange(len(word)) - first[doc]
    left = n[doc] - position
    keep = (left >= WORDS) | (position == 0)
    here = np.flatnonzero(keep)
    h = np.zeros(len(here), dtype=U64)
    for k in range(WORDS):
        ok = left[here] > k
        h = h * U64(0x9E3779B97F4A7C15)
        h[ok] += mix64(word[here[ok] + k] + U64(k))
    h = mix64(h)
    d = doc[here]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    f = np.flatnonzero(fresh)
    return d[f], h[f], np.diff(np.append(f, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: Documents signed together, and points of all their processes drawn at once.
TOGETHER, POINTS = 512, 1 << 14


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """(docs, m) of 64-bit register values; 0 for a document without shingles. doc is sorted."""
    out = [np.zeros((0, m), dtype=U64)]
    for s in range(0, docs, TOGETHER):
        e = min(s + TOGETHER, docs)
        i, j = np.searchsorted(doc, (s, e))
        out.append(_signed(doc[i:j] - s, h[i:j], count[i:j].astype(np.int64), e - s, m))
    return np.concatenate(out)


def _signed(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, m: int) -> np.ndarray:
    total = np.bincount(doc, weights=count, minlength=docs)
    out = np.zeros((docs, m), dtype=U64)
    horizon = (np.log(m) + 3.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = todo[doc]
        d, e, w = doc[live], h[live], count[live]
        cells, times, values = [], [], []
        strip = 0
        while len(d):
            low = 0 if strip == 0 else 1 << (strip - 1)
            width = 1 if strip == 0 else low
            seed, at, weight, until, time = mix64(e + U64((strip + 1) * 0xA24BAED4963EE407 % (1 << 64))), d, w, horizon[d], np.zeros(len(d))
            drawn = 0
            while len(at):
                # the next points of each process: time, register and position; how many at once changes nothing
                n = max(1, min(POINTS // len(at), int(((until - time) * width).max()) + 2))
                state = mix64(seed[:, None] + U64(0x9E3779B97F4A7C15) * np.arange(drawn + 1, drawn + n + 1, dtype=U64))
                steps = np.empty((len(at), n + 1))
                steps[:, 0] = time
                steps[:, 1:] = np.log(_uniform(state)) / -width
                t = np.cumsum(steps, axis=1)[:, 1:]
                p, k = np.nonzero(t < until[:, None])
                more = mix64(state[p, k] ^ U64(0xD1B54A32D192ED03))
                seen = low + (more & U64(width - 1)).astype(np.int64) < weight[p]
                register = ((more[seen] >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
                cells.append(at[p[seen]] * m + register)
                times.append(t[p[seen], k[seen]])
                values.append(more[seen])
                ok = t[:, -1] < until
                seed, at, weight, until, time = seed[ok], at[ok], weight[ok], until[ok], t[ok, -1]
                drawn += n
            strip += 1
            more_weight = w > (1 << (strip - 1))
            d, e, w = d[more_weight], e[more_weight], w[more_weight]
        cell, time, value = np.concatenate(cells), np.concatenate(times), np.concatenate(values)
        best, got = np.full(docs * m, np.inf), np.zeros(docs * m, dtype=U64)
        np.minimum.at(best, cell, time)
        won = time == best[cell]
        got[cell[won]] = value[won] | U64(1)
        got = got.reshape(docs, m)
        full = (got > 0).all(1) & todo
        out[full] = got[full]
        todo &= ~full
        horizon = horizon * 2
    return out


def _bands(batches):
    for batch in batches:
        data, at = buffers(batch.column(1))
        th = batch.column(0)
        for i, j in slices(at, 1_000_000):
            n = j - i
            d, h, c = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])
            rows = signatures(d, h, c, n).reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), dtype=U64)
            for r in range(ROWS):
                key = mix64(key * U64(0x9E3779B97F4A7C15) + rows[:, :, r])
            key += np.arange(BANDS, dtype=U64) * U64(0xD6E8FEB86659FD93)
            key = mix64(key).view(np.int64)
            empty = np.bincount(d, minlength=n) == 0
            values = pa.array(key.ravel())
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([th.slice(i, n), pa.array(~empty), bands], names=["th", "full", "bands"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as (sorted hashes, counts)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(both) / float(a[1].sum() + b[1].sum() - both)


def multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, h, c = shingles(raw, np.array([0, len(raw)]))
    return h, c


def _check_pairs(threshold: float):
    def of(batches):
        lead, lead_set = None, None
        for batch in batches:
            a, b, text_a, text_b = (batch.column(k).to_pylist() for k in range(4))
            got = []
            for x, y, s, t in zip(a, b, text_a, text_b, strict=True):
                if x != lead:
                    lead, lead_set = x, multiset(s)
                if overlap(lead_set, multiset(t)) >= threshold:
                    got.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

    return of


def _check_block(threshold: float):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, p in pdf.groupby("root", sort=False):
            sets = [multiset(t) for t in p["text"]]
            buckets = [set(x) for x in p["buckets"]]
            root = p["class"].tolist()
            up = {c: c for c in root}
            chunk, lo, hi, th = p["chunk"].tolist(), p["lo"].tolist(), p["hi"].tolist(), p["th"].tolist()

            def top(c):
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            for j in range(len(sets)):
                for i in range(j):
                    if lo[i] != hi[i] and chunk[i] == chunk[j]:
                        continue  # another task has them
                    x, y = top(root[i]), top(root[j])
                    if x != y and not buckets[i].isdisjoint(buckets[j]) and overlap(sets[i], sets[j]) >= threshold:
                        up[max(x, y)] = min(x, y)
                        found.append((th[i], th[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return of


def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc, th, class): of each row its key, its text's hash and the least key of its class."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(key_of("doc_id").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = keyed.select("th", "text")
    one = materialise(keyed.select("doc", "th").groupBy("th").agg(F.coalesce(F.min(F.when(F.col("doc") > F.lit(-(2**63)), F.col("doc"))), F.min("doc")).alias("doc")))
    signed = materialise(texts.mapInArrow(_bands, "th long, full boolean, bands array<long>").filter("full").groupBy("th").agg(F.min("bands").alias("bands")))
    placed = signed.select("th", F.explode("bands").alias("bucket"))
    # what is known of each bucket is written before it is joined back: then both sides of the join are plain exchanges,
    # which can be split where a bucket is large
    leaders = materialise(placed.groupBy("bucket").agg(F.min("th").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "a"))
    shared = materialise(placed.join(leaders, "bucket"))
    pairs = shared.filter("a <> th").select("a", F.col("th").alias("b")).distinct()
    wanted = shared.select("th").distinct().join(one, "th").select("doc", "th")
    # the only texts that move from here on
    held = materialise(keyed.join(wanted, ["doc", "th"]).dropDuplicates(["doc", "th"]).select("th", "text"))
    first = pairs.join(held.select(F.col("th").alias("b"), F.col("text").alias("text_b")), "b").join(held.select(F.col("th").alias("a"), F.col("text").alias("text_a")), "a")
    links = materialise(first.select("a", "b", "text_a", "text_b").mapInArrow(_check_pairs(threshold), "a long, b long"))
    roots = materialise(components(links))

    known = shared.select("bucket", "th").join(roots.withColumnRenamed("node", "th"), "th", "left").select("bucket", "th", F.coalesce("root", "th").alias("class"))
    mixed = materialise(known.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("bucket"))
    open_ = materialise(known.join(mixed, "bucket"))
    heads = materialise(open_.groupBy("bucket").agg(F.min("th").alias("a")))
    star = open_.join(heads, "bucket")
    together = materialise(components(star.select("a", F.col("th").alias("b"))))
    sizes = together.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    rows = (
        open_.groupBy("th").agg(F.min("class").alias("class"), F.collect_list("bucket").alias("buckets"))
        .join(together.withColumnRenamed("node", "th"), "th").join(sizes, "root").join(held, "th")
        .withColumn("chunk", F.pmod(F.xxhash64("th"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    )
    late = rows.groupBy("root", "lo", "hi").applyInPandas(_check_block(threshold), "a long, b long")
    every = materialise(links.union(late))
    final = components(every)
    least = one.join(final.withColumnRenamed("node", "th"), "th", "left").select("th", "doc", F.coalesce("root", "th").alias("root"))
    # blank texts are no copies of one another
    full = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    by_root = least.groupBy("root").agg(F.min(F.when(F.col("doc") > F.lit(-(2**63)), F.col("doc"))).alias("class"))
    known_ = least.join(by_root, "root").select("th", "class")
    return keyed.select("doc", "th", full.alias("full")).join(known_, "th").select("doc", "th", F.when(F.col("full"), F.col("class")).otherwise(F.col("doc")).alias("class"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each class (the one with the least doc_id)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc, th = fresh(docs, "doc"), fresh(docs, "th")
    found = classes(docs, threshold).filter(F.col("doc").eqNullSafe(F.col("class")) | F.col("class").isNull()).select("doc", "th").distinct()
    keyed = docs.withColumn(doc, key_of("doc_id")).withColumn(th, F.xxhash64(text))
    kept = keyed.join(found.withColumnsRenamed({"doc": doc, "th": th}), [doc, th], "left_semi")
    return kept.dropDuplicates([doc, th]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    null = F.lit(-(2**63))
    doc, cls = F.col("doc"), F.col("class")
    return classes(docs).select(F.when(doc != null, doc).alias("doc_id"), F.when(cls != null, cls).alias("class_id"), (cls.isNull() | (doc == cls)).alias("kept"))
