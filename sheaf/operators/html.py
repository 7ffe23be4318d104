"""Structure of an HTML page in one pass of the standard parser: title, main text, metadata, links and measures."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

# Where a page's main content is looked for.
MAIN_IDS = ("content", "main", "main-content", "article")
MAIN_CLASSES = ("content", "main", "article", "post", "entry")
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
SKIPPED = frozenset(("script", "style", "nav", "footer"))
SCHEMA = (
    "title string, main string, page_text string, meta map<string,string>, canonical string, author string, published string, words int, chars int, "
    "paragraphs int, ratio double, has_article boolean, has_headings boolean, has_images boolean, "
    "links array<struct<href:string,text:string,context:string,ancestors:array<string>,image:boolean,items:int>>"
)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.meta, self.links, self.text = {}, [], []
        self.canonical = self.title = self.h1 = None
        self.main = {k: [] for k in ("main", "article", "id", "class")}
        self.counts = dict.fromkeys(("p", "article", "head", "img"), 0)
        self.link = None
        self.author, self.published = None, None

    def _names(self):
        return [n for n, _ in self.stack]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        skipped = SKIPPED & set(self._names())
        if tag == "meta":
            name = a.get("name") or a.get("property")
            if name and a.get("content", "").strip():
                self.meta[name] = a["content"]
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and self.canonical is None:
            self.canonical = a.get("href")
        elif tag == "time" and a.get("datetime") and self.published is None:
            self.published = a["datetime"]
        if not skipped:
            self.counts["p"] += tag == "p"
            self.counts["article"] += tag == "article"
            self.counts["head"] += tag in ("h1", "h2", "h3")
            self.counts["img"] += tag == "img"
        if tag == "img" and self.link:
            self.link["image"] = True
        if tag == "li":
            for n, x in reversed(self.stack):
                if n in ("ul", "ol"):
                    x["#li"] = x.get("#li", 0) + 1
                    break
        if tag == "a" and a.get("href"):
            around = next((x for n, x in reversed(self.stack) if n in ("ul", "ol")), {})
            self.link = {"href": a["href"], "text": "", "ancestors": self._names(), "image": False, "list": around, "context": []}
            self.links.append(self.link)
        if tag == "p" and "p" in self._names():
            while self.stack.pop()[0] != "p":
                pass
        if tag not in VOID:
            self.stack.append((tag, a))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        if tag in self._names():
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        names = self._names()
        if "title" in names:
            self.title = (self.title or "") + data
            return
        if "h1" in names and self.h1 != "":
            self.h1 = (self.h1 or "") + data
        if not SKIPPED & set(names):
            self.text.append(data)
        if "script" in names or "style" in names:
            return
        for key in ("main", "article"):
            if key in names:
                self.main[key].append(data)
        # once, however many of the elements around are marked
        if any(a.get("id") in MAIN_IDS for _, a in self.stack):
            self.main["id"].append(data)
        if any(MARKED.intersection(a.get("class", "").split()) for _, a in self.stack):
            self.main["class"].append(data)
        for _, a in self.stack:
            if self.author is None and ("author" in a.get("class", "").split() or a.get("rel") == "author") and data.strip():
                self.author = data.strip()
        if self.link is not None:
            self.link["text"] += data
        for x in self.links[-3:]:
            if x is not self.link and x["ancestors"] == names[: len(x["ancestors"])]:
                x["context"].append(data)


MARKED = frozenset(MAIN_CLASSES)
_space = re.compile(r"\s+")


def read(source: str | None) -> dict:
    source = source or ""
    r = _Reader()
    try:
        r.feed(source)
        r.close()
    except (AssertionError, ValueError):
        pass
    fold = lambda parts, sep=" ": _space.sub(" ", sep.join(parts)).strip()
    page = fold(r.text)
    main = next((t for k in ("main", "article", "id", "class") if (t := fold(r.main[k]))), None)
    pick = lambda *names: next((r.meta[n] for n in names if n in r.meta), None)
    return {
        "title": (r.title or r.h1 or "").strip() or None, "main": main, "page_text": page, "meta": r.meta, "canonical": r.canonical,
        "author": pick("author", "article:author", "dc.creator") or r.author, "published": pick("article:published_time", "date", "pubdate", "dc.date", "publish-date") or r.published,
        "words": len(page.split()), "chars": len(page), "paragraphs": r.counts["p"], "ratio": len(page) / len(source) if source else 0.0,
        "has_article": r.counts["article"] > 0, "has_headings": r.counts["head"] > 0, "has_images": r.counts["img"] > 0,
        "links": [{"href": x["href"], "text": fold([x["text"]]), "context": fold(x["context"])[:500], "ancestors": x["ancestors"], "image": x["image"], "items": int(x["list"].get("#li", 0))} for x in r.links],
    }


_FIELDS = re.findall(r"(\w+) (?:string|int|double|boolean|map<[^>]*>|array<struct<.*>>)(?:, |$)", SCHEMA)


def parsed():
    """Arrow UDF html -> struct: everything about a page, parsed once."""

    def of(source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(s) for s in source], columns=_FIELDS)

    return F.pandas_udf(of, SCHEMA)
