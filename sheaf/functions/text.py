"""Text scalars: Column -> Column. Each cleaner is a different one on purpose; see its docstring."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_whitespace(t: Column) -> Column:
    """Runs of white space (Unicode) to one space, trimmed."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_export(t: Column) -> Column:
    """Export cleaner: control characters but for line feed, return and tab go; white space folds."""
    return normalize_whitespace(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def clean_extractor(t: Column) -> Column:
    """Extractor cleaner: white space folds first, then what is below a space goes."""
    return F.trim(F.regexp_replace(normalize_whitespace(F.coalesce(t, F.lit(""))), r"[\x00-\x1F]", ""))


def clean_html_text(t: Column) -> Column:
    """Service cleaner: C0, DEL, C1 and BOM go, white space folds."""
    return normalize_whitespace(F.regexp_replace(F.trim(t), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F﻿]", ""))


def sanitize_output(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F﻿]", "")


def remove_special_chars(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)[^\w\s]", "")


def kb_normalize(t: Column) -> Column:
    """Key of the knowledge base: lower case, letters, digits and single spaces."""
    return normalize_whitespace(remove_special_chars(F.lower(t)))


def json_nul_sanitize(t: Column) -> Column:
    return F.regexp_replace(t, r"\x00", "")


def words(t: Column) -> Column:
    return F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.size(words(t)).cast("long")


def tokens(t: Column) -> Column:
    return words(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " "))


def count_words_unicode(t: Column) -> Column:
    """Word segments; inner apostrophes and points don't split."""
    return F.regexp_count(t, F.lit(r"(?U)\w+([.\x27’]\w+)*")).cast("long")


def count_chars_nonspace(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"(?U)\s", "")).cast("long")


def count_paragraphs(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"\n\n"), lambda x: F.trim(x) != "")).cast("long")


#: Fixed value: a sentence ends after . ? or !, but not after an initial or a short title.
SENTENCE_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s"


def sentences(t: Column) -> Column:
    return F.filter(F.split(t, SENTENCE_END), lambda x: F.trim(x) != "")


def slugify(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"(?U)[^\w]+", "_")


def document_title(t: Column) -> Column:
    """The first line that isn't blank if it has at most 150 characters; else the text before the first full stop, cut to
    100 characters and dots where that is over 150 too."""
    line = F.get(F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)
    head = F.trim(F.get(F.split(t, r"\."), 0))
    return F.when(F.length(line) <= 150, line).when(F.length(head) <= 150, head).otherwise(F.concat(F.substring(head, 1, 100), F.lit("...")))


#: Patterns of dates and times, each with its kind.
TEMPORAL = (
    (r"\b(\d{4}-\d{2}-\d{2})\b", "ISO_DATE"),
    (r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", "DATE"),
    (r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{2,4}\b", "WRITTEN_DATE"),
    (r"\b(yesterday|today|tomorrow)\b", "RELATIVE_DAY"),
    (r"\b(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b", "DAY_OF_WEEK"),
    (r"\b(\d{1,2}:\d{2}(?:\s*[AP]M)?)\b", "TIME"),
    (r"\b(last|this|next)\s+(week|month|year|season)\b", "RELATIVE_TIME"),
)


def _found(t: Column, pattern: str, kind: str) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(f"(?i){pattern}"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("kind")))


def temporal_expressions(t: Column) -> Column:
    """array<struct<text, kind>> in the order of the patterns."""
    return F.flatten(F.array(*[_found(t, p, k) for p, k in TEMPORAL]))


def context_window(t: Column, start: Column, end: Column, width: int = 50) -> tuple[Column, Column]:
    """Text before and after a span [start, end)."""
    low = F.greatest(F.lit(0), start - width)
    return F.substring(t, low + 1, start - low), F.substring(t, end + 1, F.lit(width))


def chunk_chars_fixed(t: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Windows of `size` characters, `size - overlap` apart; the last one ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - F.lit(size)) / step) * step).cast("int")
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(t, i + 1, F.lit(size))))


def replace_names(t: Column, names: Mapping[str, str]) -> Column:
    """Whole words that are a key give way to its value, in one pass: what a value holds isn't replaced again. Where several
    keys begin at one place, the first of the mapping counts."""
    if not names:
        return t
    either = "|".join(re.escape(k) for k in names)
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.regexp_extract_all(t, F.lit(rf"\b({either})\b"), F.lit(1))
    # the pieces between the names, and each name's value after its piece
    between = F.split(t, rf"\b(?:{either})\b", -1)
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(F.element_at(known, b), F.lit("")))), "")
