import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm.suffix_dedup import dedup_text
from sheaf.llm.suffix_groups import suffix_array


def brute(texts, length):
    places = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            places[w] = places.get(w, 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if places[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(3)]
    texts = [None, "", "short", "a" * 900, "ab" * 500]
    for _ in range(60):
        t = prose(r.randint(5, 60))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            cut = r.randint(0, 30)
            t += " " + s[cut : len(s) - r.randint(0, 30)] + " " + prose(r.randint(0, 30))
        texts.append(t)
    base = prose(120)
    for _ in range(25):
        words = base.split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts + [texts[7], texts[7], texts[9]]


def test_suffix_array_equals_sorting():
    r = random.Random(3)
    for _ in range(500):
        s = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(0, 40))]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed,length,block", [(1, 120, 4000), (2, 120, 7), (3, 400, 5), (4, 400, 1)])
def test_against_brute_force(spark, seed, length, block):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, th string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_text(docs, length, block, digest=True).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_columns_of_any_name_and_ids_beside_null(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(600))
    rows = [(2**60 + 1, t, 7, "a", 5), (None, t + "x", 8, "b", 6), (2**60 + 3, "z", 9, None, 7)]
    got = dedup_text(spark.createDataFrame(rows, "doc_id long, text string, doc int, spans string, n_bytes int"))
    assert got.columns == ["doc_id", "doc", "spans", "n_bytes", "n_removed", "n_spans", "text"]
    assert sorted((r.doc, r.doc_id, r.spans, r.n_bytes, r.text) for r in got.collect()) == [(7, 2**60 + 1, "a", 600, ""), (8, None, "b", 601, "x"), (9, 2**60 + 3, None, 1, "z")]


def test_nulls_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_text(docs).count() == 0
    t = "lorem ipsum dolor " * 3 + "".join(chr(97 + i * i % 23) for i in range(500))
    rows = [(None, t), (None, None), (1, None), (1, t), (1, t)]
    got = dedup_text(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("n_removed = n_bytes").count() == 5 and got.filter(F.col("text") != "").count() == 0
