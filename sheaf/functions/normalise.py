"""Text scalars that need character references or Unicode normal forms. Those two steps run on Arrow arrays, as Spark has
neither built in; tags, controls and white space are patterns on the JVM."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import normalize_whitespace

#: Comments, declarations and tags; a tag may hold > inside quotes, and ends before the next < outside them.
TAG = r"(?s)<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[A-Za-z](?:[^<>\"\']|\"[^\"]*\"|\'[^\']*\')*>"
#: What has no glyph: controls, formats, unassigned and private characters, and all separators but the space.
HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"


@F.arrow_udf(StringType())
def _unescaped(t: pa.Array) -> pa.Array:
    return pa.array([x if x is None else html.unescape(x) for x in t.to_pylist()], pa.string())


def _form(t: pa.Array, form: str) -> pa.Array:
    # Arrow's own utf8_normalize leaves NFC decomposed
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize(form, x) for x in t.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _decomposed(t: pa.Array) -> pa.Array:
    return _form(t, "NFKD")


@F.arrow_udf(StringType())
def _composed(t: pa.Array) -> pa.Array:
    return _form(t, "NFC")


def _given(t: Column | str) -> Column:
    return F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit(""))


def unescape(t: Column) -> Column:
    """Character references resolved; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescaped(F.when(F.contains(t, F.lit("&")), t)), t)


def strip_html(t: Column | str) -> Column:
    """Character references first, then tags; so an escaped tag is a tag, and what was escaped twice is resolved. Null counts
    as empty."""
    return unescape(F.regexp_replace(unescape(_given(t)), TAG, ""))


def normalize_unicode(t: Column | str) -> Column:
    """Compatibility decomposition; null counts as empty."""
    return _decomposed(_given(t))


def clean_nlp(t: Column | str) -> Column:
    """No tags, compatibility decomposition, printable characters only (line ends go too), single spaces."""
    return normalize_whitespace(F.regexp_replace(normalize_unicode(strip_html(t)), HIDDEN, ""))


def clean_service_export(t: Column) -> Column:
    """Controls, format characters and line separators go (words on two lines join), canonical composition, single spaces."""
    return normalize_whitespace(_composed(_given(F.regexp_replace(t, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", ""))))


def normalize_text(t: Column | str) -> Column:
    return F.lower(clean_nlp(t))
