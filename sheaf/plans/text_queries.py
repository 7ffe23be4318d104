"""Queries over text, URLs, pages, chunks, links and classification scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score, text, url
from ..operators import chunk, html
from ..operators.topics import tfidf_relevance
from .fixtures import expanded, view
from .registry import query

D_WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '')"


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar(name: str, column, sql: str | None) -> None:
    """A scalar over documents: (doc_id, v)."""
    query(name, f"SELECT doc_id, {sql} AS v FROM documents" if sql else None)(lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", column(F.col("text")).alias("v")))


scalar("clean_export", text.clean_export, r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g'))")
scalar("clean_extractor", text.clean_extractor, r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '[\x00-\x1F]', '', 'g'))")
scalar("clean_rust_html", text.clean_html_text, r"trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FEFF}]', '', 'g'), '\s+', ' ', 'g'))")
scalar("sanitize_output", text.sanitize_output, r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FEFF}]', '', 'g')")
scalar("normalize_whitespace", text.normalize_whitespace, r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
scalar("remove_special_chars", text.remove_special_chars, r"regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]', '', 'g')")
scalar("kb_normalize", text.kb_normalize, r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))")
scalar("json_nul_sanitize", text.json_nul_sanitize, "text")
scalar("count_chars_nonspace", text.count_chars_nonspace, r"CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT)")
scalar("count_paragraphs", text.count_paragraphs, "CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '')) AS BIGINT)")
scalar("count_words_unicode", text.count_words_unicode, r"CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+([.''’][\p{L}\p{M}\p{N}_]+)*')) AS BIGINT)")
scalar("get_tokens", lambda t: F.size(text.tokens(t)).cast("long"), r"CAST(len(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS BIGINT)")
scalar("slugify", text.slugify, r"regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', '_', 'g')")
scalar("detect_language", lambda t: F.lit("en"), "'en'")
scalar("detect_language_rust", lambda t: F.lit(None).cast("string"), "CAST(NULL AS VARCHAR)")
scalar("get_sentences", lambda t: F.size(text.sentences(t)).cast("long"), None)
_LINE = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]"
_HEAD = "trim(split_part(text, '.', 1))"
scalar("document_title_guess", text.document_title, f"CASE WHEN length({_LINE}) <= 150 THEN {_LINE} WHEN length({_HEAD}) <= 150 THEN {_HEAD} ELSE substr({_HEAD}, 1, 100) || '...' END")
_TIMES = " || ".join(f"list_transform(regexp_extract_all(text, '(?i){p}'), lambda x: x || ':{k}')" for p, k in text.TEMPORAL)
scalar("temporal_expressions", lambda t: F.array_join(F.transform(text.temporal_expressions(t), lambda x: F.concat(x["text"], F.lit(":"), x["kind"])), "|"), f"array_to_string({_TIMES}, '|')")
scalar("chunk_chars_fixed", lambda t: F.size(text.chunk_chars_fixed(t, 1000, 100)).cast("long"), "CAST(CASE WHEN length(text) > 0 THEN greatest(0, ceil((length(text) - 1000) / 900.0)) + 1 ELSE -1 END AS BIGINT)")
scalar("football_scores", lambda t: F.array_join(F.regexp_extract_all(t, F.lit(r"\b\d{1,2}[-:]\d{1,2}\b"), F.lit(0)), "|"), r"array_to_string(regexp_extract_all(text, '\b\d{1,2}[-:]\d{1,2}\b'), '|')")
scalar("ner_formation", lambda t: F.array_join(F.regexp_extract_all(t, F.lit(r"\b[3-5][-–][2-5][-–][1-3]\b"), F.lit(0)), "|"), r"array_to_string(regexp_extract_all(text, '\b[3-5][-–][2-5][-–][1-3]\b'), '|')")
scalar("example_dictionary_entities", lambda t: F.instr(t, "License").cast("long"), "CAST(instr(text, 'License') AS BIGINT)")


@query("word_frequency_keywords", r"""WITH w AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS t FROM documents) d)
    SELECT doc_id, word, n, rank_no FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank_no FROM w WHERE length(word) > 3 GROUP BY doc_id, word) r WHERE rank_no <= 10""")
def word_frequency_keywords(spark, sf_dir):
    from pyspark.sql import Window

    w = docs(spark, sf_dir).select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "word")).filter(F.length("word") > 3)
    counts = w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counts.withColumn("rank_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).filter("rank_no <= 10").select("doc_id", "word", "n", "rank_no")



@query("text_stats", r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(w) AS BIGINT) AS words, round(list_sum(list_transform(w, lambda x: length(x))) / CAST(len(w) AS DOUBLE), 6) AS avg_word
    FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) t""")
def text_stats(spark, sf_dir):
    w = text.words(F.col("text"))
    letters = F.length(F.array_join(w, ""))
    return docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"), F.size(w).cast("long").alias("words"), F.round(letters / F.size(w).cast("double"), 6).alias("avg_word"))


@query("example_clean_stats", r"""SELECT doc_id, CAST(length(c) AS BIGINT) AS cleaned_chars, CAST(len(list_filter(string_split(c, ' '), lambda x: x <> '')) AS BIGINT) AS words FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents) t""")
def example_clean_stats(spark, sf_dir):
    c = text.normalize_whitespace(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.length(c).cast("long").alias("cleaned_chars"), text.word_count(c).alias("words"))


@query("export_records")
def export_records(spark, sf_dir):
    """Clean, drop empty, chunk, describe: one JSON line per chunk."""
    c = view(spark, sf_dir, "content").withColumn("clean", text.clean_export(F.col("extracted_text"))).filter("clean <> ''")
    parts = chunk.exploded(c.select("content_id", "job_id", "url", "crawl_depth", "language", "clean"), "clean")
    meta = F.struct(
        F.lit("web").alias("source"), "url", F.lit("Untitled").alias("title"), F.col("job_id").cast("string").alias("job_id"), F.col("content_id").cast("string").alias("content_id"),
        F.col("crawl_depth").cast("string").alias("depth"), F.col("chunk_index").cast("string").alias("chunk_index"), F.col("chunk_total").cast("string").alias("chunk_total"), "language",
    )
    return parts.select("content_id", "chunk_index", F.to_json(F.struct(F.col("chunk").alias("text"), meta.alias("meta"))).alias("line"))


@query("chunk_words_py")
def chunk_words_py(spark, sf_dir):
    return chunk.exploded(docs(spark, sf_dir).select("doc_id", text.clean_export(F.col("text")).alias("t")), "t").select("doc_id", "chunk_index", "chunk_total", text.word_count(F.col("chunk")).alias("n_words"))


@query("chunk_index_total")
def chunk_index_total(spark, sf_dir):
    return chunk_words_py(spark, sf_dir).groupBy("doc_id").agg(F.max("chunk_index").alias("last_index"), F.max("chunk_total").alias("chunk_total"))


@query("chunk_chars_sentences")
def chunk_chars_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunk.chunk_chars()(F.col("text"))).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"))


# ---- URLs
def on_pages(name: str, column, sql: str | None) -> None:
    query(name, f"SELECT page_id, {sql} AS v FROM pages" if sql else None)(lambda spark, sf_dir: docs(spark, sf_dir, "pages").select("page_id", column(F.col("url")).alias("v")))


AUTHORITY = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
on_pages("url_domain", url.domain, AUTHORITY)
on_pages("url_host_rust", url.host, "regexp_replace(" + AUTHORITY + ", ':[0-9]+$', '')")
on_pages("url_is_valid", url.is_valid, "regexp_matches(url, '^https?://[^/?#]+')")
on_pages("url_normalize_rust", url.without_fragment, "regexp_replace(url, '#.*$', '')")
on_pages("url_display_name", url.display_name, "split_part(regexp_replace(url, '^https?://', ''), '/', 1)")
on_pages("url_same_domain", lambda u: url.host(u) == F.lit("thther.example.com"), AUTHORITY + " = 'thther.example.com'")
on_pages("url_join", lambda u: url.join(u, F.lit("/next/page.html")), "regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/next/page.html'")
_TRACK = ", ".join(f"'{x}'" for x in url.TRACKING)
on_pages("url_normalize_credibility", url.credibility_key, rf"""(SELECT s || '://' || regexp_replace(lower(n), '^www\.', '') || CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END FROM (SELECT regexp_extract(url, '^(https?)://', 1) AS s,
    regexp_extract(url, '^https?://([^/?#]*)', 1) AS n, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT (contains(x, '=') AND lower(split_part(x, '=', 1)) IN ({_TRACK}))), '&') AS q) z)""")
on_pages("url_structure_score", lambda u: F.round(score.url_structure(u), 6), None)


# ---- pages
def parsed_pages(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir, "pages").select("page_id", "url", html.parsed()(F.col("html")).alias("h"))


@query("html_title", "SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf_dir):
    return docs(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def _page_field(name: str, *fields: str) -> None:
    query(name)(lambda spark, sf_dir: parsed_pages(spark, sf_dir).select("page_id", *[F.col(f"h.{f}").alias(f) for f in fields]))


_page_field("html_main_content", "main")
_page_field("html_author", "author")
_page_field("html_date", "published")
_page_field("html_canonical", "canonical")
_page_field("page_text", "page_text")
_page_field("page_metrics", "words", "chars", "paragraphs", "ratio", "has_article", "has_headings", "has_images")
_page_field("extract_response", "title", "main", "author", "published", "words")


@query("html_meta_tags")
def html_meta_tags(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", F.to_json("h.meta").alias("meta"))


@query("extract_fallback")
def extract_fallback(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", F.coalesce("h.main", "h.page_text").alias("text"), F.col("h.main").isNull().alias("fell_back"))


@query("page_quality_score")
def page_quality_score(spark, sf_dir):
    h = F.col("h")
    return parsed_pages(spark, sf_dir).select("page_id", F.round(score.page_quality(h["words"], h["paragraphs"], h["ratio"], h["has_article"], h["has_headings"], h["has_images"]), 6).alias("quality"))


def links_of(spark, sf_dir) -> DataFrame:
    rows = parsed_pages(spark, sf_dir).select("page_id", "url", F.posexplode("h.links").alias("position", "l"))
    full = url.join(F.col("url"), F.col("l.href"))
    return rows.filter(~F.col("l.href").startswith("#")).withColumn("link", full).filter(url.is_valid(F.col("link")))


@query("html_links", r"""SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> '' AND NOT starts_with(x, '#'))) AS BIGINT) AS n_links FROM pages""")
def html_links(spark, sf_dir):
    counts = links_of(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return docs(spark, sf_dir, "pages").select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def scored_links(spark, sf_dir) -> DataFrame:
    found = links_of(spark, sf_dir)
    u, t, c = score.url_structure(F.col("link"), F.col("url")), score.link_text(F.col("l.text")), score.anchor_context(F.col("l.context"))
    p = score.prominence(F.col("l.ancestors"), F.col("l.image"), F.col("l.items"))
    return found.select("page_id", "url", "position", "link", F.round(u, 6).alias("url_score"), F.round(t, 6).alias("text_score"), F.round(c, 6).alias("context_score"), F.round(p, 6).alias("prominence"), F.round(score.link(u, t, c, p), 6).alias("score"))


for _name, _cols in {"link_score": ("score",), "link_text_score": ("text_score",), "anchor_context_score": ("context_score",), "link_prominence_score": ("prominence",)}.items():
    query(_name)(lambda spark, sf_dir, c=_cols: scored_links(spark, sf_dir).select("page_id", "position", *c))


@query("link_rank")
def link_rank(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "position")
    return scored_links(spark, sf_dir).select("page_id", "position", "score", F.row_number().over(w).alias("rank_no"))


@query("should_extend_depth", """SELECT seq, CASE WHEN d >= 5 THEN false WHEN d < 3 THEN true ELSE coalesce(quality_score, 0) > 0.7 OR coalesce(a, 0) > 0.7 END AS extend
    FROM (SELECT event_id AS seq, event_id % 7 AS d, least(value / 200, CAST(1 AS DOUBLE)) AS quality_score, avg(least(value / 200, CAST(1 AS DOUBLE))) OVER (PARTITION BY user_id) AS a FROM events) t""")
def should_extend_depth(spark, sf_dir):
    log = view(spark, sf_dir, "crawl_log")
    average = log.groupBy("domain").agg(F.avg("quality_score").alias("a"))
    depth = F.col("seq") % 7
    return log.join(average, "domain").select("seq", score.extend_depth(depth, F.col("quality_score"), F.col("a"), F.lit(None).cast("double")).alias("extend"))


@query("context_window", "SELECT doc_id, substr(text, 11, 50) AS before, substr(text, 71, 50) AS after FROM documents")
def context_window(spark, sf_dir):
    before, after = text.context_window(F.col("text"), F.lit(60), F.lit(70))
    return docs(spark, sf_dir).select("doc_id", before.alias("before"), after.alias("after"))


# ---- classification
RELEVANT = ("the", "and", "with", "that", "from", "have")
_RELEVANT = ", ".join(f"'{x}'" for x in RELEVANT)


@query("tfidf_filter", rf"""WITH tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: length(x) > 1)) AS term FROM documents),
    tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM tok GROUP BY doc_id, term), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS d FROM tf GROUP BY term), t AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS total FROM tf),
    w AS (SELECT tf.doc_id, tf.term, tf.n * (ln((1 + t.total) / (1 + df.d)) + 1) AS x, ln((1 + t.total) / (1 + df.d)) + 1 AS idf FROM tf JOIN df ON df.term = tf.term CROSS JOIN t), norm AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM w GROUP BY doc_id),
    qn AS (SELECT sqrt(sum(power(ln((1 + t.total) / (1 + coalesce(df.d, 0))) + 1, 2))) AS len FROM (SELECT unnest([{_RELEVANT}]) AS term) k LEFT JOIN df ON df.term = k.term CROSS JOIN t)
    SELECT w.doc_id, round(sum(w.x * w.idf) / max(norm.len) / (SELECT len FROM qn), 6) AS score FROM w JOIN norm ON norm.doc_id = w.doc_id WHERE w.term IN ({_RELEVANT}) GROUP BY w.doc_id""")
def tfidf_filter(spark, sf_dir):
    got = tfidf_relevance(docs(spark, sf_dir).select("doc_id", "text"), RELEVANT)
    return got.select("doc_id", F.round("score", 6).alias("score"))


KEYWORDS = ("license", "with", "that", "the", "and", "from", "this")


@query("keyword_filter", r"""SELECT doc_id, m, round(cap * least(1, log10(1 + m)), 6) AS confidence FROM (SELECT doc_id, CAST(len(list_filter(['license', 'with', 'that', 'the', 'and', 'from', 'this'], lambda k: list_contains(w, k))) AS BIGINT) AS m,
    CASE WHEN len(w) < 50 THEN 0.7e0 * len(w) / 50 ELSE 0.7e0 END AS cap FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents) a) b""")
def keyword_filter(spark, sf_dir):
    w = text.words(F.lower(F.col("text")))
    m = F.size(F.array_intersect(F.array(*[F.lit(k) for k in KEYWORDS]), w)).cast("long")
    rows = docs(spark, sf_dir).select("doc_id", m.alias("m"), F.when(F.size(w) < 50, F.lit(0.7) * F.size(w) / 50).otherwise(F.lit(0.7)).alias("cap"))
    return rows.select("doc_id", "m", F.round(F.col("cap") * F.least(F.lit(1.0), F.log10(1 + F.col("m"))), 6).alias("confidence"))


@query("keyword_set_intersect", rf"""SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f"'{k}'" for k in KEYWORDS)}], lambda k: list_contains(w, k)))[1:10], '|') AS keywords
    FROM (SELECT doc_id, string_split_regex(lower(text), '[\s\p{{Z}}]+') AS w FROM documents) t""")
def keyword_set_intersect(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(F.array_sort(F.array_intersect(text.words(F.lower(F.col("text"))), F.array(*[F.lit(k) for k in KEYWORDS]))), 1, 10), "|").alias("keywords"))


@query("chunk_bytes_rust")
def chunk_bytes_rust(spark, sf_dir):
    return chunk.by_bytes(docs(spark, sf_dir).select("doc_id", "text"))


CLUBS = {"Arsenal": "Arsenal FC", "Man City": "Manchester City", "Chelsea": "Chelsea FC", "Everton": "Everton FC", "Fulham": "Fulham FC"}
PLAYERS = {"Tim Cook": "T. Cook", "Elon Musk": "E. Musk", "Jeff Bezos": "J. Bezos"}


def _replaced(names: dict[str, str]) -> str:
    out = "text"
    for a, b in names.items():
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return out


for _name, _names in (("normalize_teams", CLUBS), ("normalize_players", PLAYERS)):

    def _normalized(spark, sf_dir, names=_names):
        return view(spark, sf_dir, "match_reports").select("doc_id", text.replace_names(F.col("text"), names).alias("v"))

    # none of these names stands in what another is replaced by, so one after the other is the same here
    query(_name, expanded(f"SELECT doc_id, {_replaced(_names)} AS v FROM match_reports"))(_normalized)


@query("domain_preprocessor", expanded(f"SELECT doc_id, {_replaced(PLAYERS | CLUBS)} AS v FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM match_reports) t"))
def domain_preprocessor(spark, sf_dir):
    clean = text.normalize_whitespace(F.col("text"))
    return view(spark, sf_dir, "match_reports").select("doc_id", text.replace_names(text.replace_names(clean, CLUBS), PLAYERS).alias("v"))
