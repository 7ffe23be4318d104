"""Crawling as a loop over levels: each level is one plan over the fetched pages; visited pages are anti-joined away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score, url
from ..lineage import erased, written
from . import html


def bfs(fetched: DataFrame, seeds: DataFrame, max_depth: int = 3, extended: int = 2, threshold: float = 0.7) -> DataFrame:
    """fetched (url, html), seeds (url) -> (url, depth, quality). Levels are bounded by max_depth + extended; between the
    two only pages with a good parent, domain or link score are followed. A page that can't be had, or isn't valid, is left
    out; one that several links reach counts once, at its least depth. Each level is written to the shared folder."""
    page = fetched.select(url.without_fragment(F.col("url")).alias("url"), html.parsed()(F.col("html")).alias("h")).dropDuplicates(["url"])
    page = written(page)
    h = F.col("h")
    quality = score.page_quality(h["words"], h["paragraphs"], h["ratio"], h["has_article"], h["has_headings"], h["has_images"])
    frontier = seeds.select(url.without_fragment(F.col("url")).alias("url")).distinct().withColumn("parent_quality", F.lit(None).cast("double")).withColumn("link_score", F.lit(None).cast("double"))
    seen = None
    for depth in range(max_depth + extended + 1):
        level = frontier.filter(score.extend_depth(F.lit(depth), F.col("parent_quality"), F.lit(None).cast("double"), F.col("link_score"), max_depth, extended, threshold)).join(page, "url")
        level = level.select("url", F.lit(depth).alias("depth"), quality.alias("quality"), "h")
        fresh = written(level if seen is None else level.join(seen.select("url"), "url", "left_anti"))
        rows = fresh.select("url", "depth", "quality")
        before, seen = seen, rows if seen is None else written(seen.unionByName(rows))
        if depth > 1:
            erased(before)
        if fresh.isEmpty():
            break
        links = fresh.select("url", "quality", F.explode("h.links").alias("l")).withColumn("to", url.without_fragment(url.join(F.col("url"), F.col("l.href"))))
        links = links.filter(url.is_valid(F.col("to")) & url.host(F.col("to")).eqNullSafe(url.host(F.col("url"))))
        frontier = links.groupBy(F.col("to").alias("url")).agg(F.max("quality").alias("parent_quality"), F.max(score.url_structure(F.col("to"))).alias("link_score"))
    return seen
