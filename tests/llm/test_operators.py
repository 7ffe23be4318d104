"""Small brute-force tests and edge cases of the training-data operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import ann, chat, embedding_dedup, html_extract, language, minhash_dedup, mixing, packing, toxicity
from sheaf.llm.queries import SQL
from tests_llm_brute import roots, shingle_counts, similarity


def prose(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))


# ---- 1
@pytest.mark.parametrize("block", [400, 3])
def test_minhash_classes_against_all_pairs(spark, block):
    r = random.Random(4)
    texts = ["", None, "  \n", "two words", "two words", "Two  words"]
    for _ in range(12):
        base = prose(r, r.choice([8, 60, 150])).split()
        texts.append(" ".join(base * r.choice([1, 1, 3])))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = prose(r, 1)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, class string, th int")
    got = {x.doc: x["class"] for x in minhash_dedup.classes(docs, block=block).collect()}
    sets = [shingle_counts(t or "") for t in texts]
    links = [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8]
    assert got == roots(range(len(texts)), links)
    kept = minhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values()))


def test_bag_signatures_estimate_weighted_jaccard():
    r = random.Random(1)
    a = [r.randrange(1 << 62) for _ in range(300)]
    wa, wb = [r.choice([1, 1, 2, 7]) for _ in a], [r.choice([0, 1, 3, 7]) for _ in a]
    h = np.array(sorted(a), dtype=np.uint64)
    doc = np.repeat([0, 1], len(h))
    both, w = np.concatenate((h, h)), np.array(wa + wb)
    on = w > 0
    m = 4096
    s = minhash_dedup.signatures(doc[on], both[on], w[on], 2, m)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / m)


def test_minhash_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert minhash_dedup.deduplicate(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, None)]
    assert sorted(x.doc_id for x in minhash_dedup.deduplicate(spark.createDataFrame(rows, schema)).collect()) == [1, 2, 3]


# ---- 3
def test_html_on_composed_pages_and_edge_cases(spark):
    r = random.Random(77)
    model = html_extract.trained()
    right = 0
    for _ in range(120):
        source = html_extract.compose(r)
        want = "\n".join(t.replace(html_extract._MARK, "").strip() for _, t in html_extract.Page(source).blocks() if html_extract._MARK in t)
        right += model.texts([source.replace(html_extract._MARK, "")])[0] == want
    assert right >= 110
    page = '<body><nav><a href=/>Home</a></nav><article class=post><h1>A &amp; B</h1><p>One\n two <b>three<p>Four &eacute;.</article><form>x</form><div id="comments"><p>nice, thanks</p></div></body>'
    rows = [(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "y"), (None, "<", "z")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [x.text for x in got] == ["A & B\nOne two three\nFour é."] * 2 + ["", "", "<"] or [x.text for x in got][:4] == ["A & B\nOne two three\nFour é."] * 2 + ["", ""]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_stays_linear_on_odd_markup():
    import time

    model = html_extract.trained()
    for source in ("<a " * 350_000, "<![CDATA[" * 100_000, "<script " * 100_000, "<div>" * 20_000 + "x", "<a \"'" * 100_000, "<div><li>" * 20_000):
        began = time.time()
        model.texts([source])
        assert time.time() - began < 10


# ---- 4
@pytest.mark.parametrize("window,block", [(256, 2048), (16, 8)])
def test_embedding_links_against_all_pairs(spark, window, block):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 16))
    for i in range(60, 120):
        x[i] = x[i % 7] + 0.12 * rng.standard_normal(16)
    x[120:135] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0] * 15 + [float("nan")]), (204, [1.0] * 15 + [None]), (205, [1.0] * 5)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=window, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    top = roots(range(150), zip(*np.nonzero(np.triu(near)), strict=True))
    assert all(got[i] == (near[i].sum(), top[i], top[i] == i) for i in range(150))
    assert all(got[i] == (0, i, True) for i in range(200, 206))


@pytest.mark.parametrize("shared", [0.0, 0.7])
def test_embedding_pairs_are_found_in_large_and_dense_tables(spark, shared):
    rng = np.random.default_rng(11)
    n, dim, window = 4000, 64, 32
    x = rng.standard_normal((n, dim))
    x[:, 0] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # the second half holds a partner at cosine 0.9 of each of the first 500, in a topic of mutual cosine `shared`
    other = rng.standard_normal((500, dim))
    other[:, 0] = 0
    other -= (other * x[:500]).sum(1, keepdims=True) * x[:500]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = (0.9001 - shared) / (1 - shared)
    x[2000:2500] = c * x[:500] + np.sqrt(1 - c * c) * other
    x *= np.sqrt(1 - shared)
    x[:, 0] = np.sqrt(shared)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), window=window).collect()
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    top = roots(range(n), zip(*np.nonzero(np.triu(near)), strict=True))
    assert near.sum() >= 1000
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (near[i].sum(), top[i]) for i in range(n)}


def test_embeddings_with_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 1.0, 0.0]
    rows = [(2**60 + 1, a), (2**60 + 3, b), (None, [1.0, 0.02, 0.1]), (None, None), (2**60 + 5, c), (2**60 + 5, a), (None, [0.0, 0.0, 1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got], key=key) == sorted(
        [(2**60 + 1, 3, 2**60 + 1, True), (2**60 + 3, 3, 2**60 + 1, False), (None, 3, 2**60 + 1, False), (None, 0, None, True), (2**60 + 5, 0, 2**60 + 5, True), (2**60 + 5, 3, 2**60 + 1, False), (None, 0, None, True)], key=key
    )


# ---- 5
def test_chat_links_quotes_and_orders_replies(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "I am fine"), (1, 2, "user", "On Monday bob wrote:\n> How are  you?\nanswer"),
        (1, 3, None, "> I am fine\nok"), (1, 4, "user", "> answer\n>> How are you?\ndeep"), (1, 5, "user", "> said by nobody"), (None, 1, None, None), (2, 0, "user", "> How are you?\nelsewhere"),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.turn, r.reply_to, r.text) for r in got] == [
        (None, 1, None, ""), (1, 0, None, "Hello there\nHow are you?"), (1, 2, 0, "answer"), (1, 4, 2, "deep"), (1, 1, None, "I am fine"), (1, 3, 1, "ok"), (1, 5, None, ""), (2, 0, None, "elsewhere"),
    ]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_links_passages_against_brute_force(spark):
    r = random.Random(17)
    rows, want, own = [], {}, {}
    for c in range(12):
        for t in range(14):
            text = " ".join(". ".join(prose(r, r.randint(3, 12)) for _ in range(r.randint(1, 4))).split())
            quoted = ""
            if t and r.random() < 0.7:
                o = r.randrange(t)
                words = own[c, o].split()
                n = r.randint(min(5, len(words)), len(words))
                at = r.randint(0, len(words) - n)
                some = [w.upper() if r.random() < 0.1 else w for w in words[at : at + n]]
                # wrapped anywhere, now and then below an attribution or with a word put wrong in a long passage
                if n > 40:
                    some[0] = "zzz"
                level = "> " if r.random() < 0.8 else ">> "
                lines = [" ".join(some[k : k + 7]) for k in range(0, n, 7)]
                quoted = ("On Monday someone wrote:\n" if r.random() < 0.5 else "") + "\n".join(level + x for x in lines) + "\n"
                if n >= 5:
                    want[c, t] = o if level == "> " else None
            own[c, t] = text
            rows.append((c, t, "user", quoted + text))
    got = {(x.conv_id, x.turn): x for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[k].text == own[k] for k in own)
    assert {k: got[k].reply_to for k in want} == want and all(got[k].n_linked == 1 for k in want)


def test_chat_short_quotes_need_one_author(spark):
    rows = [(1, 0, "user", "ok"), (1, 1, "user", "ok"), (1, 2, "user", "Fine by me. See you"), (1, 3, "user", "> ok\nwhich?"), (1, 4, "user", "> fine by me.\ngood")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.reply_to for r in got} == {0: None, 1: None, 2: None, 3: None, 4: 2}


# ---- 6
def test_search_recall_and_edge_cases(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("inf")] * 24), (2060, [1.0, 2.0]), (2061, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), block=512, chunk=16).collect()
    hits, s = 0, x @ x.T
    np.fill_diagonal(s, -np.inf)
    for q in range(0, 1500, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - s[q, r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(np.lexsort((np.arange(1500), -s[q]))[:20].tolist()))
    assert hits / (75 * 20) >= 0.9
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id >= 2000] == [(2060, 1, 2061, 5.0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.search(empty, empty).count() == 0
    big = 2**60
    rows = [(big, [1.0, 0.0]), (big, [1.0, 0.0]), (big, [0.0, 5.0]), (big + 1, [2.0, 3.0]), (None, [9.0, 9.0]), (big + 3, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter(f"vec_id = {big}"))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(
        [(big, 1, big + 1, 2.0), (big, 2, big + 3, 2.0), (big, 3, big, 0.0), (big, 1, big + 1, 15.0), (big, 2, big + 3, 15.0), (big, 3, big, 0.0)]
    )


# ---- 7
def test_mix_equals_sql_and_meets_targets(spark):
    import duckdb
    import pandas as pd

    r = random.Random(5)
    rows = [(i, prose(r, r.choice([0, 3, 50])) or None, r.choice(["a", "b", "c", "é", None])) for i in range(400)] + [(400, None, "only blank"), (401, "x y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = con.execute(SQL["op7_mix_sources"]).df().sort_values("doc_id", ignore_index=True)
    assert got.equals(want.astype(got.dtypes.to_dict()))
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.assign(source=[str(x[2]) for x in rows]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (by["taken"] - by["target"]).abs().max() <= 1
    assert abs(by["target"].sum() - 1.5 * got["size"].sum()) < 1e-6
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.select(F.sum(mixing.words_of(F.col("text")))).first()[0] == got["taken"].sum()
    assert mixing.mix(spark.createDataFrame([], df.schema)).count() == 0


# ---- 8
def test_toxicity_learns_words_and_spellings(spark):
    r = random.Random(6)
    bad = ["grumfle", "grumfled", "grumflest", "zaxxor"]
    rows = []
    for i in range(900):
        w = prose(r, r.randint(20, 80)).split()
        if i % 3 == 0:
            for _ in range(r.randint(2, 4)):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    model = toxicity.train(spark.createDataFrame(rows[:700], "doc_id long, text string, toxic int"))
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows[700:]] + [(9000, None), (9001, ""), (9002, "123")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].tox_label == y for i, _, y in rows[700:]]) > 0.95
    assert got[9000].tox_label == 0 and got[9000].tox_score == got[9001].tox_score == got[9002].tox_score
    # expressions beyond those sent at once come in parts, with the same result
    docs = docs.withColumn("word", F.lit(1)).withColumn("row", F.lit(None).cast("string")).withColumn("tox_score", F.lit(9))
    late = toxicity.score(docs, model, sent=1)
    assert model.known.number > 2 and late.columns == ["doc_id", "text", "word", "row", "tox_score", "tox_label"]
    late = {x.doc_id: x for x in late.collect()}
    assert late.keys() == got.keys() and all(abs(late[i].tox_score - got[i].tox_score) < 1e-9 and late[i].word == 1 for i in got)
    assert toxicity.score(docs, None).filter("tox_score = 0").count() == docs.count()
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    big = [(2**60 + i, "zaxxor said so") for i in range(4)] + [(None, "plain")]
    assert {x.doc_id for x in toxicity.score(spark.createDataFrame(big, "doc_id long, text string"), model).collect()} == {i for i, _ in big}


def test_toxicity_counts_against_plain_counting():
    import pyarrow as pa

    texts, toxic = ["Ab cd ab", "cd É-x cd", None, "", "“ab” 1cd"], [1, 0, 1, 0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(texts)], names=["toxic", "text"])
    got = {r["body"]: (r["t"], r["o"], r["f_t"], r["f_o"]) for b in toxicity._count_words([batch]) for r in b.to_pylist()}
    # a word's followers are counted with it; the start of a text has no body
    assert got == {b"ab": (2, 0, 2, 0), b"cd": (2, 1, 1, 1), "é".encode(): (0, 1, 0, 1), b"x": (0, 1, 0, 1), None: (0, 0, 2, 1)}
    assert toxicity.discounts([100, 40, 20, 10]) == pytest.approx((1 - 2 * 40 / 180, 2 - 3 * (100 / 180) * 0.5, 3 - 4 * (100 / 180) * 0.5))
    kept = sum((list(zip(*toxicity._summed([(w.word, np.ones(len(w), np.int64))]), strict=True)) for _, _, w in toxicity.words(pa.array(["a b a", "b"]))), [])
    assert sorted(n for _, n in kept) == [2, 2]


def test_toxicity_training_texts_are_distinct_and_not_held_out(spark):
    rows = [(i, f"text {i % 50}") for i in range(300)] + [(None, "text 0")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 50 < 10)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = [(r.text, r.toxic) for r in toxicity.labelled_rows(docs, labels).collect()]
    folds = {r.doc_id for r in docs.filter(language.fold(F.col("doc_id"), 5) != 0).collect()}
    assert sorted(got) == sorted({(t, int(i % 50 < 10)) for i, t in rows if i in folds})


# ---- 9
def test_language_held_out_accuracy_and_und(spark):
    r = random.Random(8)
    kinds = {"aa": "abcde", "bb": "bcdfg", "cc": "xyzéñ"}
    rows = [(i, prose(r, r.randint(5, 60), kinds[k := r.choice(sorted(kinds))]), k) for i in range(600)]
    model = language.train(spark.createDataFrame(rows[:400], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([x[:2] for x in rows[400:]] + [(1000, None), (1001, "12 34!"), (1002, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows[400:]]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and all(0 <= x.score <= 1 for x in got.values())


def test_language_training_draws_distinct_whole_texts(spark, monkeypatch):
    r = random.Random(12)
    texts = [prose(r, 20) for _ in range(30)]
    tail = "x" * 25_000 + " zq"
    rows = [(t, "aa") for t in texts] + [(texts[0], "aa")] * 3000 + [(tail, "bb"), (prose(r, 20, "xyz"), "bb")]
    seen = []
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda x, labels, *a: (seen.append((x, labels)), fit(x, labels, *a))[1])
    language.train(spark.createDataFrame(rows, "text string, lang string"), texts=20)
    (x, labels) = seen[0]
    assert labels.count("aa") == 20 and labels.count("bb") == 2
    assert len({row.tobytes() for row, k in zip(x, labels, strict=True) if k == "aa"}) == 20
    assert any((row == language.presence([language.tokens(tail)])[0]).all() for row in x)


# ---- 10
def test_packing_has_no_conflict_and_loses_no_word(spark):
    r = random.Random(9)
    rows = [(i, prose(r, r.choice([0, 5, 40, 130, 700])) or None, r.choice(["hot", "hot", "a", "b", None])) for i in range(300)] + [(500 + i, "same text here", f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, capacity=256, shard=100).collect()
    size = Counter()
    bins = {}
    for x in got:
        size[x.doc_id] += x.n_words
        if x.bin is not None:
            bins.setdefault((x.shard, x.bin), []).append(x)
    assert size == Counter({i: len((t or "").split()) for i, t, _ in rows})
    text = {i: t for i, t, _ in rows}
    for items in bins.values():
        assert sum(x.n_words for x in items) <= 256
        assert len({x.source for x in items}) == len(items) and len({text[x.doc_id] for x in items}) == len(items)
    assert packing.pack(spark.createDataFrame([], df.schema)).count() == 0


def test_null_ids_leave_large_ids_alone(spark):
    big = [2**60 + 1, 2**60 + 3, None]
    docs = spark.createDataFrame([(i, "some words here", "de", f"s{n}", "x", 7, 8.5, 9, "c") for n, i in enumerate(big)], "doc_id long, text string, lang string, source string, th string, doc int, score double, size int, target string")
    ids = lambda df, c="doc_id": sorted((r[c] for r in df.collect()), key=lambda x: (x is None, x))
    assert ids(packing.pack(docs)) == big
    assert ids(language.identify(docs, None)) == big
    assert ids(language.identify(docs, language.train(docs))) == big
    assert ids(html_extract.extract(docs.withColumnsRenamed({"text": "html"}))) == big
    kept = minhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2**60 + 1, "some words here", "de", "s0", "x", 7, 8.5, 9, "c")]
    mixed = mixing.mix(docs)
    assert ids(mixed) == big and {r.size for r in mixed.collect()} == {3}
    assert {tuple(r)[4:] for r in mixing.repeated(docs).collect()} == {("x", 7, 8.5, 9, "c")}


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit([6, 5, 4, 3], [0, 1, 0, 2], [-1] * 4, 10) == [0, 1, 1, 0]
    assert packing.best_fit([5, 5, 5], [0, 1, 2], [0, 0, -1], 10) == [0, 1, 0]
