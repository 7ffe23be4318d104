"""Suffix-array dedup: removes every byte that a repeated string of at least `length` bytes covers.

How a string that starts in two places is found, whatever the size of the corpus:

1. Each text is scanned once. Of the `GRAM`-byte grams inside every `length`-byte window the one with the least hash is
   the window's anchor. The choice looks at nothing but the window's bytes, so equal windows have equal anchors at
   equal offsets. Neighbouring windows share an anchor; such a run is one row (about one row per 120 bytes), with the
   hash of the run's whole context.
2. Rows are counted by (anchor, context) and then by anchor. A context that stands in two places marks its whole run.
   An anchor that stands in one place only is done with. What is left are anchors with differing contexts; one place
   of each context goes on.
3. Those contexts are dealt out in blocks. A block cuts them into cells of `CELL` bytes, aligned at the anchor, and
   sorts all cell suffixes with the grouping suffix array of suffix_groups. Neighbours that agree in all whole cells of
   a window are the candidates; the bytes at both ends are then compared, so that the answer is exact to the byte.
4. An anchor with more than `block` contexts is hot. The windows of its contexts are split by where the anchor stands in
   them: a node of four to the power k neighbouring offsets has a core, the bytes that all its windows share, and, of
   each context, an extent, the bytes that any of the context's windows in it covers. Contexts with equal extents repeat
   there as a whole; those with equal cores and differing extents are split in four; any other holds nothing that
   repeats. So a context costs a few rows a level, not one a window, and no group is gathered in a task.
5. The marked runs come back to the texts, which are read once more to cut them.

Equality is that of 64-bit hashes of whole windows under equal 64-bit anchor hashes.

Defined results: a null text counts as empty; texts under `length` bytes lose nothing; equal rows each count as a place;
an empty table gives an empty result; other columns are kept by `dedup_text` and play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh, key_of, materialise, release, table
from .suffix_groups import suffix_array
from .textscan import U64, buffers, mix64, prefix_hash, rolling_hash, slices, sliding_min, span_hash

GRAM = 96
CELL = 16
#: Contexts in a block. One context has some 500 bytes, so a block takes a few MB.
BLOCK = 2000

#: Sizes of the nodes of offsets, falling.
NODES = (256, 64, 16, 4, 1)

_RUNS = "doc long, th long, h long, c long, lo long, n int, a int"
_SPANS = "doc long, th long, start long, stop long"


def _runs(length: int):
    gram = min(GRAM, length)

    def scan(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(at):
                d, o = data[at[i] : at[j]], at[i : j + 1] - at[i]
                if len(d) < length:
                    continue
                prefix = prefix_hash(d)
                grams = rolling_hash(prefix, gram)
                key = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
                anchor = (sliding_min(key, length - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
                row = np.repeat(np.arange(j - i), np.diff(o))[: len(anchor)]
                ok = np.flatnonzero(np.arange(len(anchor)) + length <= o[1:][row])
                if not len(ok):
                    continue
                fresh = np.ones(len(ok), bool)
                fresh[1:] = (anchor[ok[1:]] != anchor[ok[:-1]]) | (row[ok[1:]] != row[ok[:-1]])
                first = np.flatnonzero(fresh)
                lo = ok[first]
                hi = ok[np.append(first[1:], len(ok)) - 1]
                a = anchor[lo]
                context = span_hash(prefix, lo, hi + length) ^ mix64((a - lo + 1).astype(U64))
                r = row[lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[i:j][r]), pa.array(th[i:j][r]), pa.array(grams[a].view(np.int64)), pa.array(context.view(np.int64)),
                     pa.array(lo - o[r]), pa.array((hi - lo + 1).astype(np.int32)), pa.array((a - lo).astype(np.int32))],
                    names=["doc", "th", "h", "c", "lo", "n", "a"],
                )

    return scan


def _cut_contexts(length: int):
    """(doc, th, text, wanted) -> one row per wanted run, with its bytes."""

    def cut(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            want = batch.column(3)
            rows = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
            w = want.flatten()
            h, block, lo, n, a, hot = (w.field(x).to_numpy(zero_copy_only=False) for x in ("h", "block", "lo", "n", "a", "hot"))
            begin = at[rows] + lo
            blob = memoryview(data)
            for s in range(0, len(rows), 1000):
                e = min(s + 1000, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[s:e])), batch.column(1).take(pa.array(rows[s:e])), pa.array(h[s:e]), pa.array(block[s:e]), pa.array(lo[s:e]), pa.array(n[s:e]), pa.array(a[s:e]), pa.array(hot[s:e]),
                     pa.array([bytes(blob[x : x + y + length - 1]) for x, y in zip(begin[s:e].tolist(), n[s:e].tolist(), strict=True)], type=pa.binary())],
                    names=["doc", "th", "h", "block", "lo", "n", "a", "hot", "bytes"],
                )

    return cut


def repeated_windows(texts: list[bytes], anchors: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts aligned at their anchors: (context, offset) of the windows that stand in two places here.

    The suffix array over cells gives the candidates, whose bytes are then compared, under the hash of their anchors."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)))
    # cells: aligned at the anchor, whole cells only, an own end mark after each context
    lead = anchors % CELL
    cells = (sizes - lead) // CELL
    first = np.repeat(base[:-1] + lead, cells) + CELL * (np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells))
    wide = np.ascontiguousarray(data[first[:, None] + np.arange(CELL)]).view(f"V{CELL}").ravel()
    _, rank = np.unique(wide, return_inverse=True)
    total = int(cells.sum()) + len(texts)
    symbol = np.empty(total, dtype=np.int64)
    mark = np.cumsum(cells + 1) - 1
    is_cell = np.ones(total, bool)
    is_cell[mark] = False
    symbol[mark] = np.arange(len(texts))
    symbol[is_cell] = rank + len(texts)
    order = suffix_array(symbol)
    whole = (length - CELL + 1) // CELL  # cells that every window holds whole
    owner = np.repeat(np.arange(len(texts)), cells + 1)
    fits = np.arange(total) + whole <= mark[owner]
    order = order[fits[order]]
    same = np.ones(max(0, len(order) - 1), bool)
    for t in range(whole):
        at = symbol[order + t]
        same &= at[1:] == at[:-1]
    candidate = np.zeros(len(order), bool)
    candidate[1:] |= same
    candidate[:-1] |= same
    cell_at = order[candidate]
    # the windows that begin less than a cell before a candidate cell
    start = np.full(total, -1, dtype=np.int64)
    start[is_cell] = first
    who = owner[cell_at]
    begins = (start[cell_at][:, None] - np.arange(CELL)).ravel()
    who = np.repeat(who, CELL)
    ok = (begins >= base[who]) & (begins + length <= base[who + 1])
    begins, who = begins[ok], who[ok]
    seen, first_at = np.unique(begins, return_index=True)
    begins, who = seen, who[first_at]
    prefix = prefix_hash(data)
    offset = begins - base[who]
    key = span_hash(prefix, begins, begins + length) ^ mix64(groups[who].astype(np.int64).view(U64) + (anchors[who] - offset).astype(U64))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    return who[twice], offset[twice]


def _block(length: int):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        n, a = pdf["n"].to_numpy(), pdf["a"].to_numpy().astype(np.int64)
        w, o = repeated_windows(list(pdf["bytes"]), a, pdf["h"].to_numpy(), length)
        ok = o < n[w]
        w, o = w[ok], o[ok]
        doc, th, lo = (pdf[x].to_numpy() for x in ("doc", "th", "lo"))
        fresh_ = np.ones(len(w), bool)
        fresh_[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1] + 1)
        f = np.flatnonzero(fresh_)
        l = np.append(f[1:], len(w)) - 1 if len(f) else f
        return pd.DataFrame({"doc": doc[w[f]], "th": th[w[f]], "start": lo[w[f]] + o[f], "stop": lo[w[f]] + o[l] + length})

    return settle


_NODE = "id long, doc long, th long, first long, start long, stop long, key long, extent long"


def _nodes(length: int, size: int):
    """(id, doc, th, h, lo, n, a, bytes) -> the nodes of a size in which a context has windows; with a list of first
    offsets of larger nodes, only those inside them."""
    offsets = length - min(GRAM, length) + 1

    def of(batches):
        for batch in batches:
            ids, doc, th, h, lo, n, a = (batch.column(k).to_numpy().astype(np.int64) for k in range(7))
            data, at = buffers(batch.column(7), pa.large_binary())
            if batch.num_columns == 9:
                up = batch.column(8)
                row = np.repeat(np.arange(len(up)), np.diff(up.offsets.to_numpy()))
                least, count = up.flatten().to_numpy(), np.full(len(row), NODES[0] // NODES[1])
            else:
                row, least = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                count = np.full(len(row), -(-offsets // size))
            first = np.repeat(least, count) + size * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            row = np.repeat(row, count)
            last = np.minimum(first + size, offsets) - 1
            begin, end = np.maximum(first, (a - n + 1)[row]), np.minimum(last, a[row])
            ok = np.flatnonzero(begin <= end)
            row, first, last, begin, end = (x[ok] for x in (row, first, last, begin, end))
            prefix = prefix_hash(data)
            anchor = at[row] + a[row]
            core = span_hash(prefix, anchor - first, anchor + length - last)
            key = mix64(core ^ mix64(h[row].view(U64) + first.astype(U64)))
            extent = span_hash(prefix, anchor - end, anchor + length - begin) ^ mix64((begin * 1024 + end).astype(U64))
            start = lo[row] + a[row] - end
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[row], doc[row], th[row], first, start, start + (end - begin) + length, key.view(np.int64), extent.view(np.int64))],
                names=["id", "doc", "th", "first", "start", "stop", "key", "extent"],
            )

    return of


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, th, start, stop) of the repeated windows of contexts of hot anchors."""
    parts = ["id", "doc", "th", "h", "lo", "n", "a", "bytes"]
    contexts = materialise(contexts.withColumn("id", F.monotonically_increasing_id()).select(*parts))
    inside, found = contexts, None
    for size in NODES:
        nodes = materialise(inside.mapInArrow(_nodes(length, size), _NODE))
        by_extent = materialise(nodes.groupBy("key", "extent").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("id", "first")).alias("one")))
        cores = by_extent.groupBy("key").agg(F.count(F.lit(1)).alias("extents")).filter("extents > 1").select("key")
        # what is repeated as a whole leaves; of what is split one place of each extent goes on
        whole = materialise(nodes.join(by_extent.filter("places > 1").select("key", "extent"), ["key", "extent"], "left_semi").select("doc", "th", "start", "stop"))
        found = whole if found is None else found.union(whole)
        down = materialise(by_extent.join(cores, "key", "left_semi").select("one.*").groupBy("id").agg(F.collect_list("first").alias("firsts")))
        release(nodes, by_extent)
        if down.isEmpty():
            break
        inside = contexts.join(down, "id").select(*parts, "firsts")
    return found


def repeated_spans(keyed: DataFrame, length: int = 400, block: int = BLOCK) -> DataFrame:
    """(doc, th, start, stop): byte spans under repeated windows; spans of one text may overlap. keyed: doc, th, text."""
    runs = materialise(keyed.mapInArrow(_runs(length), _RUNS))
    by_context = runs.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "lo", F.col("n").alias("len"), "a")).alias("one"))
    by_anchor = by_context.groupBy("h").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("contexts")).filter("places > 1")
    shared = materialise(by_context.join(by_anchor, "h").select("h", "c", "n", "one", "contexts"))
    whole = runs.join(shared.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("doc", "th", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (length - 1)).alias("stop"))

    open_ = shared.filter("contexts > 1")
    hot = F.col("contexts") > block
    blocks = max(1, -(-open_.filter(~hot).count() // block))
    place = F.pmod(F.xxhash64("h"), F.lit(blocks))
    want = open_.select(F.col("one.doc").alias("doc"), F.col("one.th").alias("th"), F.struct("h", place.alias("block"), F.col("one.lo").alias("lo"), F.col("one.len").alias("n"), F.col("one.a").alias("a"), hot.alias("hot")).alias("w"))
    want = want.groupBy("doc", "th").agg(F.collect_list("w").alias("want"))
    # equal rows have equal texts: one of them is enough
    contexts = materialise(
        keyed.join(want, ["doc", "th"]).select("doc", "th", "text", "want")
        .mapInArrow(_cut_contexts(length), "doc long, th long, h long, block long, lo long, n int, a int, hot boolean, bytes binary")
    )
    settled = materialise(contexts.filter("NOT hot").groupBy("block").applyInPandas(_block(length), _SPANS))
    out = whole.union(settled)
    return out if open_.filter(hot).isEmpty() else out.union(_hot_spans(contexts.filter("hot"), length))


def merge_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs: spans that overlap or touch become one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > stop[:-1]
    f = np.flatnonzero(fresh)
    return start[f], stop[np.append(f[1:], len(start)) - 1] if len(f) else stop[:0]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(key_of("doc_id").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def dedup_text(docs: DataFrame, length: int = 400, block: int = BLOCK, digest: bool = False) -> DataFrame:
    """docs with `text` cut, and n_bytes, n_removed, n_spans. With digest, text gives way to kept_sha256. A column of docs
    that has the name of one of these gives way to it.

    A cut inside a character drops that character's other bytes from `text`, not from the digest or the counts."""
    last = "kept_sha256" if digest else "text"
    made = ["n_bytes", "n_removed", "n_spans", last]
    kept = [c for c in docs.columns if c not in (*made, "text")]
    doc, th, spans = fresh(docs, "doc"), fresh(docs, "th"), fresh(docs, "spans")
    found = repeated_spans(_keyed(docs), length, block).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias(spans)).withColumnsRenamed({"doc": doc, "th": th})
    joined = (
        docs.withColumn(doc, key_of("doc_id")).withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(found, [doc, th], "left")
        .select(*[F.col(f"`{c}`") for c in kept], "text", spans)
    )
    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(c, LongType()) for c in made[:3]), StructField(last, StringType())])

    def finish(batches):
        k = len(kept)
        for batch in batches:
            _, at = buffers(batch.column(k))
            for i, j in slices(at):
                yield cut(batch.slice(i, j - i), k)

    def cut(batch, k):
        data, at = buffers(batch.column(k))
        blob, spans_ = memoryview(data), batch.column(k + 1)
        offs = spans_.offsets.to_numpy()
        null = spans_.is_null().to_numpy(zero_copy_only=False)
        flat = spans_.values
        begin, end = flat.field("start").to_numpy(zero_copy_only=False), flat.field("stop").to_numpy(zero_copy_only=False)
        removed, number, result = [], [], []
        for i in range(len(batch)):
            text_ = blob[at[i] : at[i + 1]]
            lo, hi = (begin[:0], end[:0]) if null[i] else merge_spans(begin[offs[i] : offs[i + 1]], end[offs[i] : offs[i + 1]])
            pieces, done = [], 0
            for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                pieces.append(text_[done:x])
                done = y
            pieces.append(text_[done:])
            left = b"".join(pieces)
            removed.append(len(text_) - len(left))
            number.append(len(lo))
            result.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "ignore"))
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in range(k)), pa.array(np.diff(at).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(result, pa.string())], names=[*kept, *made])

    return joined.mapInArrow(finish, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_text(docs, digest=True)
