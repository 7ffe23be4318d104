"""Toxicity by class-conditional Kneser-Ney language models.

Two models, one of toxic and one of ordinary texts, give every word, after the word before it, a log-likelihood each:

    P_c(w | h) = (n_c(h, w) - D) / n_c(h, .) + lambda_c(h) * P_c(w)
    P_c(w)     = (n_c(w) - D) / n_c(.) + kappa_c * P(w) * what the letters of w say about c

n_c counts the texts of class c that hold the expression, a dot sums over all words. The letters of a word are a chain of
n-grams of at most `ORDER` bytes inside the word, with its borders; they are counted once for each distinct word of the
class, as Kneser-Ney does for lower orders, and back off to the counts of the next shorter n-gram, which both classes
share. P(w) is shared as well: the number of classes that hold the word. D are Kneser-Ney discounts, estimated from how
many expressions of the class were seen once, twice, three and four times.

An expression gets counts of its own in the two classes only where that pays by the extended Bayesian information
criterion: where twice the gain in log-likelihood over its backoff is more than the logarithm of the number of
observations and that of the number of expressions to choose from. Any other
expression, and so every rare one, is the shared backoff in both models, and tells nothing. The counts are tables of
words, of pairs of words and of n-grams that grow with the corpus and are joined as such; what pays is a small part.

A document is the length-normalised difference of its two log-likelihoods, and its `TELLING` largest differences of different
words, so that a few words in a very long text still count. A logistic map of these and of the logarithm of
the length (a long text has larger differences by chance), fitted on at most `CALIBRATION_ROWS` labelled
texts that the counts haven't seen (a fifth of them, by hash), makes the score.

The paying expressions go to the tasks that read the texts `SENT` at most at a time; if there are more, the texts are read
once for each such part, and what the parts tell of a word is added up by word, with the same result.

Words are runs of letters, lower-cased, named by 64-bit hashes. Each distinct labelled text counts once.

Defined results: null or letterless text is scored like any other, from zero evidence; without training texts of both
classes every score is 0; where the calibration texts hold one class only, the map is the sum of the largest differences
and the logarithm of the class sizes; equal texts get equal scores; an empty table gives an empty result; columns of any
name and null ids pass through, but a column that has the name of a result column gives way to it; doc_id, lang and
source never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import fresh, materialise, release, table
from .language import fold
from .textscan import U64, buffers, mix64, prefix_hash, slices, span_hash

ORDER = 6
CALIBRATION_ROWS = 20_000
TELLING = 4
#: Expressions sent to every task, at most.
SENT = 500_000
#: Entries that a counting task holds before it hands them on.
HELD = 250_000
#: Counted pairs of words in a part of the table of pairs, about.
PART = 1_000_000
#: Bits of the map of labelled rows, which keeps most other texts out of the join with the labels. Its size is fixed.
MAP_BITS = 26
BEGIN = U64(0x5851F42D4C957F2D)
WORD, GRAM = U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)
EPS = 1e-12

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class Words:
    """The words of a slice of texts, in one buffer: row, begin and end, hash, hash of the word before."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        # every text has a space before and after it
        inside = _LETTER[data]
        # general punctuation and the signs of Latin-1 are no letters
        for lead, tail in ((np.flatnonzero(data == 0xC2), (0, 1)), (np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80)), (0, 1, 2))):
            for k in tail:
                inside[lead + k] = False
        self.data = np.where(inside, data, np.uint8(32))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.begin, self.end = edge[0::2], edge[1::2]
        self.row = np.searchsorted(at, self.begin, side="right") - 1
        self.prefix = prefix_hash(self.data)
        self.word = span_hash(self.prefix, self.begin, self.end)
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        first = np.ones(len(self.row), bool)
        first[1:] = self.row[1:] != self.row[:-1]
        self.before[first] = BEGIN

    def __len__(self) -> int:
        return len(self.word)

    def ends(self, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to): the n-gram that ends with each letter and with the end of each word."""
        begin, end = (self.begin, self.end) if of is None else (self.begin[of], self.end[of])
        n = end - begin + 1
        which = np.repeat(np.arange(len(n)), n)
        to = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which] + 1
        return which, np.maximum(begin[which] - 1, to - ORDER), to

    def bodies(self, of: np.ndarray) -> pa.Array:
        n = self.end[of] - self.begin[of]
        at = np.concatenate(([0], np.cumsum(n)))
        data = self.data[np.repeat(self.begin[of] - at[:-1], n) + np.arange(at[-1])]
        return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def words(column: pa.Array):
    """(first row, rows, words) of the slices of a string column."""
    for i, j in slices(buffers(column)[1]):
        yield i, j - i, Words(*buffers(pc.binary_join_element_wise("", pc.utf8_lower(column.slice(i, j - i)), "", " ")))


def pair_key(before, word):
    return mix64(before * U64(0x9E3779B97F4A7C15) + word)


def _once(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the distinct keys of each row."""
    order = np.lexsort((key, row))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
    return order[new]


def _summed(held: list[tuple]) -> tuple:
    """Entries summed by their first column; other columns of hashes, and bodies, go with it."""
    cols = [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*held, strict=True)]
    key, first, back = np.unique(cols[0], return_index=True, return_inverse=True)

    def one(c):
        if isinstance(c, pa.Array):
            return c.take(pa.array(first))
        return c[first] if c.dtype == U64 else np.bincount(back, c, len(key)).astype(np.int64)

    return (key, *map(one, cols[1:]))


def _gathered(entries):
    """Sums entries as far as a task can hold them."""
    held, n = [], 0
    for e in entries:
        held.append(e)
        n += len(e[0])
        if n > 2 * HELD:
            held = [_summed(held)]
            n = len(held[0][0])
            if n > HELD:
                yield held[0]
                held, n = [], 0
    if n:
        yield _summed(held)


def _batch(cols, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in cols], names=names)


_WORDS = "word long, body binary, t long, o long, f_t long, f_o long"


def _count_words(batches):
    """(toxic, text) -> a word, how many texts hold it, by class, and how many different words follow it, summed over texts."""

    def entries():
        for batch in batches:
            toxic = batch.column(0).to_numpy().astype(np.int64)
            for i, _, w in words(batch.column(1)):
                at, pair = _once(w.word, w.row), _once(pair_key(w.before, w.word), w.row)
                t, f = toxic[i + w.row[at]], toxic[i + w.row[pair]]
                none, nil = np.zeros(len(at), np.int64), np.zeros(len(pair), np.int64)
                # a word that is followed is there itself, so its body is found with it
                body = pa.concat_arrays([w.bodies(at), pa.nulls(len(pair), pa.binary())])
                yield _summed([(np.concatenate((w.word[at], w.before[pair])), body, *map(np.concatenate, ((t, nil), (1 - t, nil), (none, f), (none, 1 - f))))])

    for e in _gathered(entries()):
        yield _batch(e, ["word", "body", "t", "o", "f_t", "f_o"])


_GRAMS = "gram long, ctx long, low long, low_ctx long, t long, o long"


def _count_grams(batches):
    """Distinct words -> their n-grams; of each its context, itself and its context without their first byte."""

    def entries():
        for batch in batches:
            t, o = (batch.column(k).to_numpy() > 0 for k in (1, 2))
            body = pc.cast(batch.column(0), pa.string())
            for i, _, w in words(body):
                which, a, b = w.ends()
                word = i + w.row[which]
                h = [span_hash(w.prefix, x, y) ^ GRAM for x, y in ((a, b), (a, b - 1), (np.minimum(a + 1, b - 1), b), (np.minimum(a + 1, b - 1), b - 1))]
                yield _summed([(*h, t[word].astype(np.int64), o[word].astype(np.int64))])

    for e in _gathered(entries()):
        yield _batch(e, ["gram", "ctx", "low", "low_ctx", "t", "o"])


def _deal_pairs(parts: int):
    """(toxic, text) -> counted pairs of words as columns of bytes, one row for each part of the table of pairs."""

    def of(batches):
        def entries():
            for batch in batches:
                toxic = batch.column(0).to_numpy().astype(np.int64)
                for i, _, w in words(batch.column(1)):
                    key = pair_key(w.before, w.word)
                    at = _once(key, w.row)
                    t = toxic[i + w.row[at]]
                    yield key[at], w.before[at], w.word[at], t, 1 - t

        for key, before, word, t, o in _gathered(entries()):
            part = (key % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(parts + 1))
            cols = [c[order] for c in (before, word, t.astype(np.uint32), o.astype(np.uint32))]
            full = np.flatnonzero(at[1:] > at[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array([c[at[p] : at[p + 1]].tobytes() for p in full], pa.binary()) for c in cols)], names=["part", "before", "word", "t", "o"])

    return of


_PAIRS = "kind int, before long, word long, t long, o long"
PAIR, TIMES, ALL = range(3)


def _add_pairs(part: pa.Table) -> pa.Table:
    """Sums a part. Gives the pairs seen twice or more (PAIR), and by class how many pairs were seen once to four times
    (TIMES, under `word`), and the number of observations by class and of different pairs (ALL, under 0 and 1)."""
    cols = [np.frombuffer(b"".join(part[name].to_pylist()), kind) for name, kind in (("before", U64), ("word", U64), ("t", np.uint32), ("o", np.uint32))]
    _, before, word, t, o = _summed([(pair_key(cols[0], cols[1]), *cols)])
    twice, r = t + o > 1, np.arange(1, 5)
    out = [
        (np.full(int(twice.sum()), PAIR), before[twice].view(np.int64), word[twice].view(np.int64), t[twice], o[twice]),
        (np.full(4, TIMES), np.zeros(4, np.int64), r, np.array([(t == k).sum() for k in r]), np.array([(o == k).sum() for k in r])),
        (np.full(2, ALL), np.zeros(2, np.int64), np.arange(2), np.array([t.sum(), len(t)]), np.array([o.sum(), 0])),
    ]
    kind, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table([pa.array(kind.astype(np.int32)), *map(pa.array, rest)], names=["kind", "before", "word", "t", "o"])


def discounts(times: list[int]) -> tuple[float, float, float]:
    """What is taken off a count of one, of two, and of three or more, from how many expressions were seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in times)
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return tuple(min(max(x, 0.1), k - 0.1) for k, x in zip((1, 2, 3), d, strict=True))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n >= 3, F.lit(d[2])).when(n == 2, F.lit(d[1])).when(n == 1, F.lit(d[0])).otherwise(F.lit(0.0))


def _gain(t: Column, o: Column, odds: Column) -> Column:
    """Twice the log-likelihood gained over the odds that the backoff expects."""
    n = (t + o).cast("double")
    part = lambda x, p: F.when(x > 0, x * F.log(x / n) - x * F.log(p)).otherwise(F.lit(0.0))
    return 2 * (part(t, odds / (1 + odds)) + part(o, 1 / (1 + odds)))


def _price(observations: float, expressions: float) -> float:
    """What twice a gain has to pay."""
    return float(np.log(max(observations, 2)) + np.log(max(expressions, 2)))


def _times(df: DataFrame) -> tuple[list[int], list[int], list[float], int]:
    """By class: how many rows have a count of one to four; the sum of t and of o; the number of rows."""
    sums = [F.sum((F.col(c) == k).cast("long")) for c in ("t", "o") for k in (1, 2, 3, 4)] + [F.sum("t"), F.sum("o"), F.count(F.lit(1))]
    got = [int(x or 0) for x in df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    return got[:4], got[4:8], [float(x) for x in got[8:10]], got[10]


class Known:
    """Expressions that pay: (key, v), v the difference of log-likelihoods that the expression adds."""

    def __init__(self, rows: DataFrame):
        self.rows = materialise(rows)
        self.number = self.rows.count()

    def parts(self, sent: int):
        """(sorted keys, values) of at most about `sent` expressions, one part after the other."""
        k = max(1, -(-self.number // sent))
        for p in range(k):
            got = self.rows.filter(F.pmod("key", F.lit(k)) == p).toArrow()
            key = got["key"].to_numpy().view(U64)
            order = np.argsort(key)
            yield key[order], got["v"].to_numpy()[order]


def _lookup(keys: np.ndarray, values: np.ndarray):
    low = U64((1 << 18) - 1)
    seen = np.zeros(1 << 18, bool)
    seen[(keys & low).astype(np.int64)] = True

    def of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in key that are known, their values)."""
        at = np.flatnonzero(seen[(key & low).astype(np.int64)])
        if not len(at):
            return at, values[:0]
        to = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
        hit = keys[to] == key[at]
        return at[hit], values[to[hit]]

    return of


def _told(w: Words, lookup) -> np.ndarray:
    """What is known of each word: of its letters, of itself, and of the pair that it makes with the word before."""
    which, a, b = w.ends()
    at, values = lookup(span_hash(w.prefix, a, b) ^ GRAM)
    v = np.bincount(which[at], values, len(w)).astype(np.float64)
    for key in (w.word ^ WORD, pair_key(w.before, w.word)):
        at, values = lookup(key)
        v[at] += values
    return v


def _top(row: np.ndarray, word: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """(n, TELLING): the largest positive values of different words of each row, falling; 0 where there are fewer."""
    top = np.zeros((n, TELLING))
    on = np.flatnonzero(v > 0)
    on = on[np.lexsort((-v[on], word[on], row[on]))]
    new = np.ones(len(on), bool)
    new[1:] = (word[on][1:] != word[on][:-1]) | (row[on][1:] != row[on][:-1])
    on = on[new]
    on = on[np.lexsort((-v[on], row[on]))]
    place = np.arange(len(on)) - np.searchsorted(row[on], row[on])
    keep = place < TELLING
    top[row[on[keep]], place[keep]] = v[on[keep]]
    return top


def features(total: np.ndarray, number: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.column_stack((total / np.maximum(number, 1) * 100, np.log1p(number), np.minimum(top, 20.0)))


WIDTH = TELLING + 2


def _hits(parts):
    """(id, text) for one part of what is known -> (id, place of a word, its hash, v) where it tells anything."""

    def of(batches):
        lookup = _lookup(*parts)
        for batch in batches:
            ids = batch.column(0)
            for i, n, w in words(batch.column(1)):
                v = _told(w, lookup)
                on = np.flatnonzero(v)
                first = np.searchsorted(w.row, np.arange(n))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + w.row[on])), pa.array((on - first[w.row[on]]).astype(np.int32)), pa.array(w.word[on].view(np.int64)), pa.array(v[on])], names=["id", "at", "word", "v"])

    return of


_HITS = StructType([StructField("id", LongType()), StructField("at", IntegerType()), StructField("word", LongType()), StructField("v", DoubleType())])


def hits(texts: DataFrame, known: Known, sent: int) -> DataFrame:
    """texts (id, text) -> (id, at, word, v): the words that tell anything, over all parts of what is known."""
    out = None
    for part in known.parts(sent):
        one = texts.mapInArrow(_hits(part), _HITS)
        out = one if out is None else out.union(one)
    return out if known.number <= sent else out.groupBy("id", "at", "word").agg(F.sum("v").alias("v"))


class Model:
    def __init__(self, known: Known, prior: float):
        self.known = known
        self.coef = [prior, 0.0, 0.0] + [1.0] * TELLING

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = np.column_stack((np.ones(len(x)), x))
        w = np.zeros(z.shape[1])
        penalty = np.diag([0.0] + [0.1] * x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.coef = w.tolist()

    def scorer(self):
        w = np.array(self.coef)
        return lambda x: (1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))[:, None]


def _measured(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, ...], finish, sent: int) -> DataFrame:
    """The kept columns of docs and what finish makes of the features, under names."""
    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(n, DoubleType()) for n in names)])
    kept = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col("text"), F.lit(""))

    def out(batch, n, x):
        return pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(np.ascontiguousarray(c)) for c in finish(x).T)], names=[*keep, *names])

    k = len(keep)
    if model.known.number <= sent:
        (part,) = model.known.parts(sent)

        def of(batches):
            lookup = _lookup(*part)
            for batch in batches:
                x = [np.zeros((0, WIDTH))]
                for _, n, w in words(batch.column(k)):
                    v = _told(w, lookup)
                    x.append(features(np.bincount(w.row, v, n), np.bincount(w.row, minlength=n), _top(w.row, w.word, v, n)))
                yield out(batch, k, np.concatenate(x))

        return docs.select(*kept, text.alias(fresh(docs, "body"))).mapInArrow(of, schema)

    row, told = fresh(docs, "row"), fresh(docs, "told")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    found = hits(rows.select(F.col(f"`{row}`").alias("id"), text.alias("text")), model.known, sent).groupBy("id").agg(F.collect_list(F.struct("word", "v")).alias("told"))
    joined = rows.join(found.select(F.col("id").alias(row + "_"), F.col("told").alias(told)), F.col(f"`{row}`") == F.col(f"`{row}_`"), "left")

    def late(batches):
        for batch in batches:
            v = batch.column(k + 1)
            each, of_row = pc.list_flatten(v), pc.list_parent_indices(v).to_numpy(zero_copy_only=False)
            word, value = (each.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            number = np.concatenate([np.bincount(w.row, minlength=n) for _, n, w in words(batch.column(k))]) if len(batch) else np.zeros(0)
            yield out(batch, k, features(np.bincount(of_row, value, len(batch)), number, _top(of_row, word, value, len(batch))))

    return joined.select(*kept, text.alias(fresh(rows, "body")), F.col(f"`{told}`")).mapInArrow(late, schema)


def _paying_grams(every: DataFrame) -> DataFrame:
    """(key, v) of the n-grams of letters that pay."""
    grams = materialise(every.filter("body IS NOT NULL").select("body", "t", "o").mapInArrow(_count_grams, _GRAMS).groupBy("gram", "ctx", "low", "low_ctx").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    times_t, times_o, (n_t, n_o), number = _times(grams)
    d_t, d_o = discounts(times_t), discounts(times_o)
    t, o = F.col("t"), F.col("o")
    around = grams.groupBy("ctx").agg(F.sum("t").alias("c_t"), F.sum("o").alias("c_o"), F.sum(_discount(t, d_t)).alias("l_t"), F.sum(_discount(o, d_o)).alias("l_o"))
    odds = (F.col("c_t") + EPS) / (F.col("c_o") + EPS)
    paying = materialise(grams.filter("t + o > 1").join(around, "ctx").filter(_gain(t, o, odds) > _price(n_t + n_o, number)))
    # the shared backoff: in how many longer n-grams the shorter one stands
    low = grams.groupBy("low").agg(F.count(F.lit(1)).alias("low_n"))
    low_ctx = grams.groupBy("low_ctx").agg(F.count(F.lit(1)).alias("low_all"))
    shared = F.col("low_n") / F.col("low_all")
    p = lambda n, d, c, rest: F.when(F.col(c) > 0, (n - _discount(n, d) + F.col(rest) * shared) / F.col(c)).otherwise(shared)
    v = F.log(p(t, d_t, "c_t", "l_t") + EPS) - F.log(p(o, d_o, "c_o", "l_o") + EPS)
    out = materialise(paying.join(low, "low").join(low_ctx, "low_ctx").select(F.col("gram").alias("key"), v.alias("v")))
    release(grams, paying)
    return out


def train(labelled: DataFrame, sent: int = SENT) -> Model | None:
    """labelled: (text, toxic), each row counts. Four fifths by hash of the text are counted, the rest fits the map."""
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.pmod(F.xxhash64(F.lit("fit"), text), F.lit(5))
    rows = materialise(labelled.filter(F.col("toxic").isin(0, 1)).select(F.col("toxic").cast("int").alias("toxic"), text.alias("text"), part.alias("part")))
    counted = rows.filter("part > 0").select("toxic", "text")
    every = materialise(counted.mapInArrow(_count_words, _WORDS).groupBy("word").agg(F.max("body").alias("body"), *[F.sum(c).alias(c) for c in ("t", "o", "f_t", "f_o")]))
    times_t, times_o, (n_t, n_o), number = _times(every)
    if not (n_t and n_o):
        release(rows, every)
        return None
    t, o = F.col("t"), F.col("o")
    prior = n_t / n_o
    grams = _paying_grams(every)

    # words against what their letters say
    d_t, d_o = discounts(times_t), discounts(times_o)
    spelt = hits(every.filter("body IS NOT NULL AND t + o > 1").select(F.col("word").alias("id"), F.col("body").cast("string").alias("text")), Known(grams), sent)
    spelt = spelt.groupBy("id").agg(F.sum("v").alias("c"))
    several = every.filter("t + o > 1").join(spelt, F.col("word") == F.col("id"), "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    seen, lost_t, lost_o = every.agg(F.sum((t > 0).cast("long") + (o > 0).cast("long")), F.sum(_discount(t, d_t)), F.sum(_discount(o, d_o))).first()
    shared = ((t > 0).cast("int") + (o > 0).cast("int")) / float(seen)
    p_t = (t - _discount(t, d_t)) / n_t + float(lost_t / n_t) * shared * F.exp("c") + EPS
    p_o = (o - _discount(o, d_o)) / n_o + float(lost_o / n_o) * shared + EPS
    pays = _gain(t, o, F.lit(prior) * F.exp("c")) > _price(n_t + n_o, number)
    valued = materialise(several.withColumn("pays", pays).filter("pays OR c <> 0").withColumn("v", F.when(F.col("pays"), F.log(p_t) - F.log(p_o)).otherwise(F.col("c"))).select("word", "v", "c", "pays", "t", "o"))

    # pairs against what their words say
    parts = max(1, int(-(-3 * (n_t + n_o) // (2 * PART))))
    dealt = counted.mapInArrow(_deal_pairs(parts), "part long, before binary, word binary, t binary, o binary")
    pairs = materialise(dealt.groupBy("part").applyInArrow(_add_pairs, _PAIRS))
    numbers = {(r.kind, r.word): (r.t, r.o) for r in pairs.filter(F.col("kind") >= TIMES).groupBy("kind", "word").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect()}
    e_t, e_o = (discounts([numbers.get((TIMES, r), (0, 0))[i] for r in (1, 2, 3, 4)]) for i in (0, 1))
    there = valued.filter("pays").select(F.col("word").alias("before"), ((t + 0.5) / (o + 0.5)).alias("h"))
    met = pairs.filter(F.col("kind") == PAIR).select("before", "word", "t", "o").join(valued.select("word", "v"), "word", "left").join(there, "before", "left")
    odds = F.coalesce("h", F.lit(prior)) * F.exp(F.coalesce("v", F.lit(0.0)))
    telling = materialise(met.filter(_gain(t, o, odds) > _price(sum(numbers.get((ALL, 0), (0, 0))), numbers.get((ALL, 1), (0, 0))[0])).select("before", "word", "t", "o", F.coalesce("v", F.lit(0.0)).alias("v")))
    of_word = every.select("word", ((t + o) / (n_t + n_o)).alias("p"))
    of_before = every.select(F.col("word").alias("before"), "f_t", "f_o")
    joined = telling.join(of_word, "word").join(of_before, "before")
    own = lambda n, d, all_: F.when(F.col(all_) > 0, (F.col(n) - _discount(F.col(n), d)) / F.col(all_)).otherwise(F.lit(0.0))
    joined = materialise(joined.withColumn("m_t", own("t", e_t, "f_t")).withColumn("m_o", own("o", e_o, "f_o")))
    rest = joined.groupBy("before").agg((1 - F.sum("m_t")).alias("l_t"), (1 - F.sum("m_o")).alias("l_o"))
    value = F.log(F.col("m_t") + F.col("l_t") * F.col("p") * F.exp("v") + EPS) - F.log(F.col("m_o") + F.col("l_o") * F.col("p") + EPS)

    def keyed(batches):
        for batch in batches:
            before, word = (batch.column(c).to_numpy().view(U64) for c in (0, 1))
            single = batch.column(3).to_numpy(zero_copy_only=False)
            yield _batch((np.where(single, word ^ WORD, pair_key(before, word)), batch.column(2)), ["key", "v"])

    zero = F.lit(0).cast("long")
    told = valued.filter("pays").select(zero.alias("before"), "word", (F.col("v") - F.col("c")).alias("v"), F.lit(True).alias("single"))
    told = told.union(joined.join(rest, "before").select("before", "word", (value - F.col("v")).alias("v"), F.lit(False).alias("single")))
    model = Model(Known(grams.union(told.mapInArrow(keyed, "key long, v double"))), float(np.log(prior)))
    release(every, valued, pairs, telling, joined)

    rest = rows.filter("part = 0").select("toxic", "text")
    if rest.count() > CALIBRATION_ROWS:
        rest = rest.orderBy(F.xxhash64("text"), "text").limit(CALIBRATION_ROWS)
    names = tuple(f"x{i}" for i in range(WIDTH))
    got = _measured(rest, model, ["toxic"], names, lambda x: x, sent).toPandas()
    release(rows)
    if got["toxic"].nunique() == 2:
        model.calibrate(got[list(names)].to_numpy(np.float64), got["toxic"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model | None, sent: int = SENT, keep: list[str] | None = None, names: tuple[str, str] = ("tox_score", "tox_label")) -> DataFrame:
    """The columns of docs that are kept (all, if not named), a score and a label, 1 from a score of 0.5 on."""
    keep = [c for c in keep or docs.columns if c not in names]
    columns = [F.col(f"`{c}`") for c in keep]
    out = docs.select(*columns, F.lit(0.0).alias(names[0])) if model is None else _measured(docs, model, keep, names[:1], model.scorer(), sent)
    return out.select(*columns, F.col(f"`{names[0]}`"), (F.col(f"`{names[0]}`") >= 0.5).cast("int").alias(names[1]))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the training rows, those whose fold of five isn't 0; each text once a class.

    Labels grow with the documents, so they are joined by merge at every size, first with hashes of the texts. The texts
    that are wanted then pass a bitmap of fixed size, and the few others that it lets through fall out in the join."""
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).hint("merge")
    own = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("h")).filter(fold(F.col("doc_id"), 5) != 0)
    wanted = materialise(own.select("doc_id", "h").join(marks, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id")))
    bit = F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << MAP_BITS))
    marked = wanted.select(bit.alias("bit")).select(F.shiftright("bit", 15).alias("at"), (F.col("bit") % 32768).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(place DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    near = own.withColumn("bit", bit).withColumn("at", F.shiftright("bit", 15)).withColumn("place", F.col("bit") % 32768).join(F.broadcast(marked), "at")
    near = near.withColumn("byte", byte).filter(F.expr("shiftright(byte, CAST(place % 8 AS INT)) % 2 = 1"))
    return near.select("doc_id", "h", "text").join(wanted.hint("merge"), ["doc_id", "h"]).select("text", "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0), model, keep=["doc_id", "held_out"], names=("score", "predicted"))
