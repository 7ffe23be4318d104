"""The pipeline, stage by stage, against brute force over what each stage was given."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sheaf.llm.queries import SQL
from tests_llm_brute import roots, shingle_counts, similarity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(110)
    rows, labels = [], []
    for i in range(420):
        w = prose(r.randint(20, 160))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                w[r.randrange(len(w))] = r.choice(["grumfle", "zaxxor", "blorptic"])
        if i % 9 == 1:
            w = w[:10] + passage + w[10:]
        rows.append((i, " ".join(w), "en", f"src{i % 5}" if i % 3 else "src0", 9, "extra"))
        labels.append((i, int(toxic)))
        if i % 10 == 3:  # an exact and a near copy
            rows.append((1000 + i, " ".join(w), "en", None, 9, None))
            near = list(w)
            near[len(near) // 2] = word()
            rows.append((2000 + i, " ".join(near), "en", "src2", 9, "x"))
    rows += [(3000, None, None, None, None, None), (3001, "", "en", "src1", 0, "y"), (None, " ".join(prose(30)), "en", "src1", 3, "z"), (5, rows[5][1], "en", rows[5][3], 9, "extra")]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def collected(df):
    return [tuple(r) for r in df.collect()]


def repeats_cut(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    places = Counter(hashlib.md5(t[p : p + length]).digest() for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if places[hashlib.md5(t[p : p + length]).digest()] > 1:
                gone[p : p + length] = True
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    given = collected(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "mix_sources", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)

    docs = corpus_pipeline.materialise(stages["toxicity"](spark, docs, folder))
    assert docs.columns == columns
    after = collected(docs)
    bad = lambda t: any(w in (t or "").split() for w in ("grumfle", "zaxxor", "blorptic"))
    assert sorted(after, key=key) == sorted((r for r in given if not bad(r[1])), key=key)

    given, docs = after, corpus_pipeline.materialise(stages["minhash_near_dedup"](spark, docs, folder))
    after = collected(docs)
    sets = [shingle_counts(r[1] or "") for r in given]
    top = roots(range(len(given)), [(i, j) for j in range(len(given)) for i in range(j) if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8])
    groups = {}
    for i, r in enumerate(given):
        groups.setdefault(top[i], []).append(r)
    assert len(after) == len(groups) < len(given)
    for g in groups.values():  # one of each group stays, the one with the least id, unchanged
        kept = [r for r in after if r in g]
        assert len(kept) >= 1 and min((r[0] for r in g if r[0] is not None), default=None) in {r[0] for r in kept}

    given, docs = after, corpus_pipeline.materialise(stages["suffix_array_dedup"](spark, docs, folder))
    after = collected(docs)
    assert docs.columns == columns
    cut = repeats_cut([r[1] for r in given])
    assert sorted(after, key=key) == sorted(((r[0], t, r[2], r[3], len(t), r[5]) for r, t in zip(given, cut, strict=True)), key=key)
    assert any(len(t) < len(r[1] or "") for r, t in zip(given, cut, strict=True))

    given, docs = after, corpus_pipeline.materialise(stages["mix_sources"](spark, docs, folder))
    after = collected(docs)
    assert docs.columns == columns
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in given])
    taken = Counter()
    for i, n in con.execute(f"SELECT doc_id, taken FROM ({SQL['op7_mix_sources']})").fetchall():
        taken[i] += n
    got = Counter()
    for r in after:
        got[r[0]] += len(r[1].split())
    assert got == Counter({k: v for k, v in taken.items() if v})
    whole = {r[0]: r[1].split() for r in given}
    assert all(r[1].split() == whole[r[0]][: len(r[1].split())] for r in after)

    packed = collected(stages["best_fit_packing"](spark, docs, folder).select("doc_id", "source", "shard", "bin", "piece", "start_word", "n_words"))
    words, bins = Counter(), {}
    for i, source, shard, bin_, _, _, n in packed:
        words[i] += n
        bins.setdefault((shard, bin_), []).append((source, n))
    assert words == got
    assert all(sum(n for _, n in b) <= 2048 and len({s for s, _ in b}) == len(b) for b in bins.values())

    assert sorted(collected(corpus_pipeline.run(spark, folder).select("doc_id", "n_words")), key=key) == sorted(((p[0], p[6]) for p in packed), key=key)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
