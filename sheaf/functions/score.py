"""Scores of links, pages and depth decisions: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that raise or lower the score of a path or of a link's text.
CONTENT_INDICATORS = ("article", "post", "content", "blog", "news", "publication", "research", "paper", "study", "report", "analysis", "review")
LOW_VALUE_INDICATORS = ("login", "signup", "cart", "account", "privacy", "terms", "contact", "about", "faq", "help", "support", "tag", "category", r"page=\d+", "sort=", "filter=", "search=", "comment")
HUB_INDICATORS = ("publications", "articles", "blog", "research", "resources", "docs", "documentation", "papers", "journals")
READ_MORE = ("read more", "full article", "continue reading", "view article", "learn more", "read article")
DATES = (r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{1,2}-\d{1,2}", r"jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec \d{1,2}", "january|february|march|april|may|june|july|august|september|october|november|december")
AUTHORS = ("author", "written by", "posted by", "by:")


def _if(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def _any(t: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(t, F.lit("|".join(patterns)))


def _sum(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def url_structure(u: Column, source: Column | None = None) -> Column:
    path = F.lower(F.regexp_extract(u, "^[a-z]+://[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    keys = F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: F.rlike(p, F.lit("^[^=]+=.+"))), lambda p: F.split_part(p, F.lit("="), F.lit(1))))
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    same = F.lit(0.0) if source is None else _if(F.try_parse_url(u, F.lit("AUTHORITY")).eqNullSafe(F.try_parse_url(source, F.lit("AUTHORITY"))), 0.05)
    return clamp(_sum(
        F.lit(0.5), -F.least(F.lit(0.1) * F.size(keys), F.lit(0.3)), _if(F.arrays_overlap(keys, F.array(F.lit("id"), F.lit("article"), F.lit("post"))), 0.15),
        _if(_any(path, CONTENT_INDICATORS), 0.15), _if(_any(path, HUB_INDICATORS), 0.2), _if(_any(path, LOW_VALUE_INDICATORS), -0.2),
        _if(F.rlike(path, F.lit(r"\.(html|htm|php|asp|aspx)$")), 0.05), _if(F.rlike(path, F.lit(r"\.(pdf|doc|docx)$")), 0.2), _if(segments.between(1, 2), 0.1), same,
    ))


def link_text(t: Column, keywords: tuple[str, ...] = ()) -> Column:
    low = F.lower(F.coalesce(t, F.lit("")))
    n = F.length(low)
    key = _if(reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keywords]), 0.15) if keywords else F.lit(0.0)
    more = _if(reduce(lambda a, b: a | b, [low.contains(p) for p in READ_MORE]), 0.2)
    size = F.when(n > 20, 0.15).when(n > 10, 0.1).otherwise(0.0)
    return F.when(n < 3, F.lit(0.4)).otherwise(clamp(_sum(F.lit(0.5), size, _if(_any(low, CONTENT_INDICATORS), 0.2), _if(_any(low, LOW_VALUE_INDICATORS), -0.2), key, more)))


def anchor_context(t: Column) -> Column:
    low = F.lower(F.coalesce(t, F.lit("")))
    author = reduce(lambda a, b: a | b, [low.contains(p) for p in AUTHORS])
    return clamp(_sum(F.lit(0.5), _if(_any(low, CONTENT_INDICATORS), 0.1), _if(_any(low, DATES), 0.15), _if(author, 0.15)))


def prominence(ancestors: Column, has_image: Column, list_items: Column) -> Column:
    """ancestors: names of the elements around the link."""
    among = lambda *names: F.arrays_overlap(ancestors, F.array(*[F.lit(n) for n in names]))
    return clamp(_sum(
        F.lit(0.5), F.when(among("h1", "h2", "h3"), 0.3).when(among("h4", "h5", "h6"), 0.2).otherwise(0.0), _if(among("main", "article", "section"), 0.2),
        _if(among("nav", "footer"), -0.2), _if(has_image, 0.1), _if(among("li") & (list_items > 3) & (list_items < 20), 0.1),
    ))


def link(url: Column, text: Column, context: Column, prominent: Column) -> Column:
    return clamp(F.lit(0.1) * 0.5 + F.lit(0.3) * url + F.lit(0.3) * text + F.lit(0.2) * context + F.lit(0.1) * prominent)


def page_quality(words: Column, paragraphs: Column, ratio: Column, article: Column, headings: Column, images: Column) -> Column:
    size = F.when(words > 1000, 0.3).when(words > 500, 0.2).when(words > 200, 0.1).otherwise(0.0)
    para = F.when(paragraphs > 10, 0.2).when(paragraphs > 5, 0.1).otherwise(0.0)
    dense = F.when(ratio > 0.5, 0.2).when(ratio > 0.25, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), _sum(size, para, dense, _if(article, 0.1), _if(headings, 0.1), _if(images, 0.1)))


def extend_depth(depth: Column, parent_quality: Column, domain_average: Column, link_score: Column, max_depth: int = 3, extended: int = 2, threshold: float = 0.7) -> Column:
    good = (F.coalesce(parent_quality, F.lit(0.0)) > threshold) | (F.coalesce(domain_average, F.lit(0.0)) > threshold) | (F.coalesce(link_score, F.lit(0.0)) > threshold + 0.1)
    return F.when(depth >= max_depth + extended, False).when(depth < max_depth, True).otherwise(good)
