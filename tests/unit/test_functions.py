import urllib.parse

import pytest
from pyspark.sql import functions as F

from sheaf.functions import score, text, url
from sheaf.operators import html
from sheaf.operators.chunk import pack_bytes, pack_words


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_cleaners(spark):
    assert one(spark, " a\x00b\x07 \n\n c d ", text.clean_export) == "ab c d"
    assert one(spark, None, text.clean_export) == ""
    assert one(spark, "The F.C. Club!", text.kb_normalize) == "the fc club"


def test_measures(spark):
    assert one(spark, "", text.word_count) == 0 and one(spark, None, text.word_count) == 0
    assert one(spark, "a\n\n b \n\n\n\n", text.count_paragraphs) == 2
    got = one(spark, "on 2022-01-31, yesterday at 3:00 PM", text.temporal_expressions)
    assert [(x.text, x.kind) for x in got] == [("2022-01-31", "ISO_DATE"), ("yesterday", "RELATIVE_DAY"), ("3:00 PM", "TIME")]


def test_urls(spark):
    assert one(spark, "HTTP-less.example.com/a/?utm_source=x&b=1#f", url.credibility_key) == "https://http-less.example.com/a?b=1"
    assert one(spark, "https://www.Example.com:80/", url.domain) == "www.Example.com:80"
    assert one(spark, "ftp://x", url.is_valid) is False and one(spark, "nonsense", url.is_valid) is False


@pytest.mark.parametrize("base", ["https://a.b/c/d", "https://a.b/c/d/?q=1#f", "https://a.b", "https://a.b/"])
@pytest.mark.parametrize("href", ["../x", "x", "./x?y=../z", "../../../x", "/p/./q/../r", "//c.d/e", "?z=1", "#g", "", "..", "x/y/..", "https://e.f/g", "mailto:x@y"])
def test_joined_urls(spark, base, href):
    assert one(spark, href, lambda h: url.join(F.lit(base), h)) == urllib.parse.urljoin(base, href)


def test_scores(spark):
    assert one(spark, "https://a.b/blog/post?id=3", lambda u: F.round(score.url_structure(u), 6)) == 1.0
    assert one(spark, "", score.link_text) == 0.4
    assert one(spark, "Read more about research papers", lambda t: F.round(score.link_text(t), 6)) == 0.85


def test_chunks_keep_all_words_in_order():
    t = " ".join(f"w{i}" + ("." if i % 9 == 0 else "") for i in range(1000))
    parts = pack_words(t, 50, 10)
    assert all(len(p.split()) <= 60 for p in parts)
    seen = []
    for p in parts:
        for w in p.split():
            if w not in seen[-80:]:
                seen.append(w)
    assert seen == t.split()
    assert pack_words(None) == [] and pack_words("") == []


def test_html_reader():
    r = html.read("<html><head><title>T</title><meta name=author content=Ann><link rel=canonical href=/c></head><body><nav><a href=/n>n</a></nav><article><h1>H</h1><p>One<p>Two <a href='/x'>link</a></article></body></html>")
    assert (r["title"], r["main"], r["author"], r["canonical"], r["paragraphs"]) == ("T", "H One Two link", "Ann", "/c", 2)
    assert html.read(None)["main"] is None


def test_byte_chunks_cut_no_character_and_keep_all_text():
    t = " ".join("ä" * (i % 7 + 1) + ("." if i % 11 == 0 else "") for i in range(900))
    parts = pack_bytes(t, 40, 25)
    assert all(len(p.encode()) <= 400 for p in parts) and all(p in t for p in parts)
    at = 0
    for p in parts:  # each begins inside or right after what came before
        here = t.index(p, max(0, at - 30))
        assert here <= at + 1
        at = here + len(p)
    assert at == len(t)
    assert pack_bytes(None) == [] and pack_bytes("") == [] and pack_bytes("a b.", 5) == ["a b."]
    long = "ß" * 3000 + " " + "x " * 100
    assert "".join(pack_bytes(long, 50, 0)).replace(" ", "") == long.replace(" ", "")


def test_names_are_replaced_in_one_pass(spark):
    names = {"A": "B", "B": "C", "A B": "D"}
    assert one(spark, "A B, BA (A) B", lambda t: text.replace_names(t, names)) == "B C, BA (B) C"
    assert one(spark, "none", lambda t: text.replace_names(t, names)) == "none" and one(spark, "", lambda t: text.replace_names(t, names)) == ""
    assert one(spark, None, lambda t: text.replace_names(t, names)) is None


def test_marked_elements_inside_one_another_count_once():
    assert html.read('<div class="content"><div class="content"><p>One</p></div></div>')["main"] == "One"
