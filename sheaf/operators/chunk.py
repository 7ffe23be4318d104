"""Chunking, which folds over sentences in order: Arrow UDFs that give array<string>."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_end = re.compile(r"(?<=[.!?])\s+")


def pack_words(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Whole sentences up to `size` words; a chunk begins with the last sentences of the one before, up to `overlap`
    words. A sentence longer than a chunk is cut into pieces that reach `overlap` words back."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for sentence in _end.split(text) if text else ():
        parts = sentence.split()
        n = len(parts)
        if n > size:
            if held:
                out.append(" ".join(s for s, _ in held))
                held, total = [], 0
            out += [" ".join(parts[max(0, i - overlap) if i else 0 : i + size]) for i in range(0, n, size - overlap)]
            continue
        if total + n > size:
            out.append(" ".join(s for s, _ in held))
            back, carried = [], 0
            while held and carried + held[-1][1] <= overlap:
                back.append(held.pop())
                carried += back[-1][1]
            held, total = back[::-1], carried
        held.append((sentence, n))
        total += n
    if held:
        out.append(" ".join(s for s, _ in held))
    return [c for c in out if c]


def pack_chars(text: str | None, size: int = 1000, overlap: int = 100) -> list[str]:
    """Whole sentences up to `size` characters, separators not counted."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for sentence in _end.split(text) if text else ():
        if held and total + len(sentence) > size:
            out.append(" ".join(held))
            back, carried = [], 0
            while held and carried + len(held[-1]) <= overlap:
                back.append(held.pop())
                carried += len(back[-1])
            held, total = back[::-1], carried
        held.append(sentence)
        total += len(sentence)
    if held:
        out.append(" ".join(held))
    return out


def chunk_words(size: int = 500, overlap: int = 50):
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    @F.pandas_udf(ArrayType(StringType()))
    def of(t: pd.Series) -> pd.Series:
        return t.map(lambda x: pack_words(x, size, overlap))

    return of


def chunk_chars(size: int = 1000, overlap: int = 100):
    @F.pandas_udf(ArrayType(StringType()))
    def of(t: pd.Series) -> pd.Series:
        return t.map(lambda x: pack_chars(x, size, overlap))

    return of


def exploded(docs: DataFrame, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """One row per chunk with chunk_index and chunk_total; documents without text give none."""
    parts = docs.withColumn("_chunks", chunk_words(size, overlap)(F.col(text))).withColumn("chunk_total", F.size("_chunks"))
    return parts.select("*", F.posexplode("_chunks").alias("chunk_index", "chunk")).drop("_chunks")


_byte_end = re.compile(rb"[.!?]\s+")


def pack_bytes(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Pieces that end with the last sentence within ten bytes a word of `size` words, and reach `overlap` bytes back into
    the piece before; a longer sentence is cut there. No character is cut. A text of at most `size` words is one piece."""
    raw = (text or "").encode()
    if len((text or "").split()) <= size:
        return [text] if text else []
    ends = [m.end() for m in _byte_end.finditer(raw)] + [len(raw)]

    def whole(at):
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    out, at = [], 0
    while at < len(raw):
        k = bisect_right(ends, at + 10 * size)
        stop = ends[k - 1] if k and ends[k - 1] > at else whole(min(at + 10 * size, len(raw)))
        piece = raw[at:stop].decode().strip()
        if piece:
            out.append(piece)
        if stop >= len(raw):
            break
        at = whole(max(stop - overlap, at + 1)) if stop - overlap > at else stop
    return out


def by_bytes(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk, text) of docs (doc_id, text)."""
    cut = F.pandas_udf(lambda s: s.map(lambda t: pack_bytes(t, size, overlap)), ArrayType(StringType()))
    return docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("chunk", "text"))
