"""Conflict-constrained best-fit packing of documents into training sequences of a fixed number of words.

A document longer than a sequence is cut into full sequences and a rest. Full pieces are sequences of their own. The rest
of every document is packed, largest first: open bins are ordered by residual space, each carries a bitmap of the sources
and one of the duplicate clusters inside it, and the search starts at the tightest bin that is large enough and moves to
its successor until one holds neither the piece's source nor its cluster; if there is none, a bin is opened. So no
sequence sees two pieces of one source or two copies of one text.

Documents are dealt out by hash to shards of about `shard` documents, and a shard is packed on its own: memory is bounded,
a hot source is spread over all shards, and packing is within a few bins of what one large shard would give.

Defined results: null or blank text has size 0 and gets no bin (bin null, piece 0, 0 words), so that no row is lost;
null source is a source of its own; equal rows are copies of one another; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import words_of

CAPACITY = 2048
SHARD = 1024


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each item, in the order given. sources and clusters are small numbers, -1 for a cluster of one."""
    open_: list[tuple[int, int]] = []  # (residual, bin)
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_, (size, -1))
        while at < len(open_):
            b = open_[at][1]
            if not (source_bits[b] & s or cluster_bits[b] & c):
                break
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        if residual > size:
            insort(open_, (residual - size, b))
        out.append(b)
    return out


def _pack_shard(capacity: int):
    def pack(rows: pa.Table) -> pa.Table:
        # integers that may be null stay integers
        pdf = rows.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
        pdf = pdf.astype({"size": "int64", "cluster": "int64", "shard": "int64"})
        pdf = pdf.sort_values(["size", "doc_id", "cluster"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rest = pdf["size"] % capacity
        full = pdf["size"] // capacity
        rest_row = pdf.assign(piece=full, n_words=rest)[rest > 0].sort_values(["n_words", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        sources = pd.factorize(rest_row["source"], use_na_sentinel=False)[0]
        codes, _ = pd.factorize(rest_row["cluster"])
        counts = pd.Series(codes).value_counts()
        shared = {k: n for n, k in enumerate(sorted(counts[counts > 1].index))}
        bins = best_fit(rest_row["n_words"].tolist(), sources.tolist(), [shared.get(k, -1) for k in codes.tolist()], capacity)
        rest_row = rest_row.assign(bin=bins)
        whole = pdf.loc[pdf.index.repeat(full)]
        whole = whole.assign(piece=whole.groupby(level=0).cumcount(), n_words=capacity)
        first = (max(bins) + 1) if bins else 0
        whole = whole.assign(bin=range(first, first + len(whole)))
        none = pdf[pdf["size"] == 0].assign(piece=0, n_words=0, bin=None)
        out = pd.concat([x for x in (rest_row, whole, none) if len(x)], ignore_index=True)
        out["start_word"] = out["piece"] * capacity
        out["bin"] = out["bin"].astype("Int64")
        out = out[["doc_id", "source", "shard", "bin", "piece", "start_word", "n_words"]]
        return pa.Table.from_pandas(out, pa.schema([("doc_id", rows.schema.field("doc_id").type), ("source", pa.string()), *((c, pa.int64()) for c in out.columns[2:])]), preserve_index=False)

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, shard, bin, piece, start_word, n_words); (shard, bin) names a sequence. cluster: a column of
    duplicate classes; without it, texts equal but for white space and case are one cluster."""
    same = F.col(cluster) if cluster else F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\s+", " "))))
    slim = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), same.cast("long").alias("cluster"))
    shards = max(1, -(-docs.count() // shard))
    slim = slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, shard long, bin long, piece long, start_word long, n_words long"
    return slim.groupBy("shard").applyInArrow(_pack_shard(capacity), schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
