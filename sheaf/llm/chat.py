"""Chat formatting by quotation linking. DataFrame functions only.

The lines of a message are its own text or quotes: `> ` marks at the start of a line give its quote level. Neighbouring
quoted lines of one level are a passage: marks and attribution lines are dropped, lines joined, case and white space
folded, so that it doesn't matter how a mail program wrapped them. A passage is hashed as its runs of five words, and so is
the own text of every message. Each run is known by the first message of the conversation that wrote it; a passage of which
at least `SIMILARITY` is found in earlier messages links to the one that has most of it (the first of them on a tie). A
passage of fewer than five words is too short for that: it links if one earlier message, and no other, wrote it as a
line or a sentence of its own.

A message replies to the message it quotes most of at level 1 (runs of words found; on a tie the later one); deeper levels
are counted as links too. Without a quote that is found, a message stands on the main line. Only conversations that quote
anything are hashed.

Conversations are then ordered by reply: the path of a message is its parent's path and its own turn, so a reply follows
what it answers and the replies before it. Paths are found by pointer doubling, in as many rounds as the logarithm of the
deepest chain of quotes. The result is sorted by conversation and path, in parallel: no conversation has to fit into a
task.

Defined results: null text counts as empty; null role is "unknown"; rows that share conv_id and turn are one message for
linking and keep a row each; rows with null conv_id or turn are kept, unlinked; quotes are removed from the text whether
they are found or not, so a message of nothing but quotes has an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, release, table

WORDS = 5
SIMILARITY = 0.8
QUOTE = r"^(?:[\x20\x09]*>)+"
ATTRIBUTION = r"(?i)^\s*(on\b.{1,200}\bwrote|am\b.{1,200}\bschrieb.{0,100}|le\b.{1,200}\ba écrit|el\b.{1,200}\bescribió|.{1,80}\bsaid)\s*:\s*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[^>]", ""))


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _norm(line: Column) -> Column:
    """A quoted line without its marks; nothing is left of an attribution."""
    bare = F.regexp_replace(line, QUOTE, "")
    return F.when(F.rlike(bare, F.lit(ATTRIBUTION)), F.lit("")).otherwise(_folded(bare))


def _runs(words: Column) -> Column:
    """Hashes of the runs of five words of an array of at least five."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(WORDS)), " ")))


def _short(text: Column) -> Column:
    return F.xxhash64(F.lit("short"), text)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, text): the quoted passages of messages (conv_id, turn, text)."""
    lines = messages.select("conv_id", "turn", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("level", _level(F.col("line"))).filter("level > 0")
    # lines of one level that follow one another differ from their number by the same
    run = Window.partitionBy("conv_id", "turn", "row", "level").orderBy("at")
    lines = lines.withColumn("run", F.col("at") - F.row_number().over(run)).withColumn("norm", _norm(F.col("line"))).filter("norm <> ''")
    joined = lines.groupBy("conv_id", "turn", "row", "level", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]), " ").alias("text"))
    return joined.select("conv_id", "turn", "level", F.xxhash64("row", "level", "run").alias("passage"), "text")


def quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, origin, found): passages with the earlier message that they quote, and the runs of
    words of them found there."""
    quoted = passages(messages).withColumn("words", _words(F.col("text")))
    long_ = F.size("words") >= WORDS
    own = messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", own_text(F.col("text")).alias("own"))
    whole = own.withColumn("words", _words(_folded(F.col("own"))))
    source = whole.filter(F.size("words") >= WORDS).select("conv_id", "turn", F.explode(_runs(F.col("words"))).alias("h"))
    first = source.groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    asked = quoted.filter(long_).select("conv_id", "turn", "level", "passage", (F.size("words") - (WORDS - 1)).alias("n"), F.explode(_runs(F.col("words"))).alias("h"))
    met = asked.join(first, ["conv_id", "h"]).filter("origin < turn")
    by_origin = met.groupBy("conv_id", "turn", "level", "passage", "origin").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("found"))
    best = by_origin.groupBy("conv_id", "turn", "level", "passage").agg(F.max("n").alias("n"), F.sum("found").alias("all"), F.max(F.struct("found", (-F.col("origin")).alias("first"))).alias("best"))
    linked = best.filter(F.col("all") >= F.lit(SIMILARITY) * F.col("n")).select("conv_id", "turn", "level", "passage", (-F.col("best.first")).alias("origin"), F.col("best.found").alias("found"))

    parts = F.filter(F.transform(F.split("own", r"\r?\n|(?<=[.!?])\s+"), lambda x: _folded(x)), lambda x: x != "")
    lines = F.filter(F.transform(F.split("own", r"\r?\n"), lambda x: _folded(x)), lambda x: x != "")
    said = own.select("conv_id", "turn", F.explode(F.array_union(parts, lines)).alias("x")).filter(F.size(_words(F.col("x"))) < WORDS).select("conv_id", "turn", _short(F.col("x")).alias("h"))
    once = said.groupBy("conv_id", "h").agg(F.min("turn").alias("origin"), F.max("turn").alias("last")).filter("origin = last").drop("last")
    short = quoted.filter(~long_).select("conv_id", "turn", "level", "passage", _short(F.col("text")).alias("h")).join(once, ["conv_id", "h"]).filter("origin < turn")
    return linked.union(short.select("conv_id", "turn", "level", "passage", "origin", F.lit(1).cast("long").alias("found")))


def own_text(text: Column) -> Column:
    """text without quoted lines, and without attribution lines that stand before a quote."""
    lines = F.split(text, r"\r?\n")
    following = F.slice(lines, F.lit(2), F.size(lines))  # one shorter: the last line is paired with null
    marked = F.zip_with(lines, following, lambda x, y: F.struct(x.alias("x"), _level(x).alias("q"), (F.coalesce(F.rlike(y, F.lit(QUOTE)), F.lit(False)) & F.rlike(x, F.lit(ATTRIBUTION))).alias("a")))
    kept = F.filter(marked, lambda s: (s["q"] == 0) & ~s["a"])
    out = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"), r"^\s+|\s+$", ""))
    return F.when(F.rlike(text, F.lit("(?m)" + QUOTE)), out).otherwise(text)


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per message, in reply order."""
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = m.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    links = quotations(known.select("conv_id", "turn", "text"))
    by_origin = links.groupBy("conv_id", "turn", "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("found")).otherwise(0)).alias("w"), F.count(F.lit(1)).alias("k"))
    parents = materialise(by_origin.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("w") > 0, F.struct("w", "origin"))).alias("best"), F.sum("k").alias("linked")).select("conv_id", "turn", F.col("best.origin").alias("reply_to"), "linked"))

    # paths by doubling: `head` is the highest ancestor reached so far, `path` leads from below it to the message
    paths = parents.filter("reply_to IS NOT NULL").select("conv_id", "turn", F.col("reply_to").alias("head"), F.array(F.col("turn").cast("long")).alias("path"))
    held = None
    if not paths.isEmpty():
        held = paths = materialise(paths)
        while True:
            above = paths.select("conv_id", F.col("turn").alias("head"), F.col("head").alias("next"), F.col("path").alias("lead"))
            step = paths.join(above, ["conv_id", "head"], "left")
            more = materialise(step.select("conv_id", "turn", F.coalesce("next", "head").alias("head"), F.when(F.col("next").isNotNull(), F.concat("lead", "path")).otherwise(F.col("path")).alias("path"), F.col("next").isNotNull().alias("moved")))
            go_on = not more.filter("moved").isEmpty()
            release(held)
            held = paths = more
            paths = more.drop("moved")
            paths._sheaf_path = more._sheaf_path
            if not go_on:
                break
    order = F.concat(F.array(F.coalesce("head", F.col("turn"))), F.when(F.col("head").isNull(), F.array().cast("array<long>")).otherwise(F.col("path")))
    out = m.join(parents, ["conv_id", "turn"], "left").join(paths.select("conv_id", "turn", "head", "path"), ["conv_id", "turn"], "left")
    out = out.withColumn("own", own_text(F.col("text")))
    text = F.col("own")
    quotes = F.size(F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(QUOTE)))
    return out.select(
        "conv_id", "turn", "role", text.alias("text"), "reply_to", F.size(order).alias("depth"), order.alias("path"),
        quotes.cast("long").alias("n_quoted_lines"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n")).alias("formatted"),
    ).orderBy("conv_id", "path", "role")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
