"""Decoding and whitespace helpers. Only ``html_unescape`` leaves the JVM, in Arrow batches; ``percent_decoded`` is for texts that are there already."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percent_decode(col: Column, times: int = 1) -> Column:
    """Lenient percent decoding: malformed escapes and ``+`` stay as they are."""
    out = col
    for _ in range(times):
        safe = F.replace(F.regexp_replace(out, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
        out = F.when(out.contains("%"), F.url_decode(safe)).otherwise(out)
    return out


_ESCAPES, _SURROGATE = re.compile(r"(?:%[0-9A-Fa-f]{2})+"), re.compile(rb"\xed[\xa0-\xbf][\x80-\xbf]?")


def percent_decoded(text: str) -> str:
    """``percent_decode`` of one text in Python; the bytes of a surrogate are one broken character, as in the JVM."""
    def run(m: re.Match) -> str:
        return _SURROGATE.sub(b"\xff", bytes.fromhex(m[0].replace("%", ""))).decode("utf-8", "replace")

    return _ESCAPES.sub(run, text) if "%" in text else text


def form_decode(col: Column) -> Column:
    """Percent decoding after ``+`` has become a space."""
    return percent_decode(F.replace(col, F.lit("+"), F.lit(" ")))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(col: Column) -> Column:
    """HTML5 entities to text. Spark has no such function; NULL in, NULL out."""
    return _unescape(col)


def squash_ws(col: Column) -> Column:
    return F.regexp_replace(col, r"[\t\n\r\x0B\f]+", " ")


def strip_comments(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)/\*.*?\*/", "")


def decode_variants(col: Column, unescaped: Column | None = None, unescaped_decoded: Column | None = None) -> Column:
    """Every reading of a value that the signature filter looks at, without repeats, raw first.

    The entity-decoded readings come in as columns because they need an Arrow batch; when they are
    not given they are left out (values without ``&`` do not need them).
    """
    forms = [col, percent_decode(col), percent_decode(col, 2), form_decode(col)]
    if unescaped is not None:
        forms += [unescaped, unescaped_decoded]
    forms += [squash_ws(col), strip_comments(col)]
    return F.array_distinct(F.flatten(F.array(*[F.array(f, F.lower(f)) for f in forms])))
