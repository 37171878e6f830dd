"""Character classes, counts, entropy and JSON helpers as plain column expressions."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = r"\p{Lu}"
LOWER = r"\p{Ll}\x{AA}\x{BA}"
DIGITS = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
ALNUM = r"\p{L}\p{N}"
BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def count_text(col: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal, from the bytes that vanish with it."""
    size = len(part.encode())
    return ((F.octet_length(col) - F.octet_length(F.replace(col, F.lit(part), F.lit("")))) / F.lit(size)).cast("int")


def count_class(col: Column, chars: str) -> Column:
    """Characters that belong to a class, without building a list of matches."""
    return F.length(col) - F.length(F.regexp_replace(col, f"[{chars}]+", ""))


def has(col: Column, *parts: str) -> Column:
    """Whether any of the literals occurs."""
    test = col.contains(parts[0])
    for p in parts[1:]:
        test = test | col.contains(p)
    return test


def fold(text: str) -> str:
    """Lower case, with the letters beyond ASCII that case-blind patterns take for an ASCII letter."""
    if not text.isascii():
        for odd, plain in (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k")):
            text = text.replace(odd, plain)
    return text.lower()


def guards_met(texts: Column, guards: list[list[list[str]]]) -> Column:
    """Per text of an array: numbers of the guards it meets. A guard is met when of each of its lists some literal occurs.

    The literals are looked for in Arrow batches: a substring test there takes a small part of what ``contains`` takes.
    """
    literals = sorted({part for lists in guards for parts in lists for part in parts})

    def numbers(text: str) -> list[int]:
        found = {part for part in literals if part in text}
        return [i for i, lists in enumerate(guards) if not any(found.isdisjoint(parts) for parts in lists)]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def met(rows: pd.Series) -> pd.Series:
        def of(row):
            if row is None:
                return None
            folded = [None if text is None else fold(text) for text in row]
            known = {text: numbers(text) for text in set(folded) - {None}}
            return [known.get(text, []) for text in folded]

        return rows.map(of)

    return met(texts)


def flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def count_present(col: Column, parts: list[str]) -> Column:
    total = flag(col.contains(parts[0]))
    for p in parts[1:]:
        total = total + flag(col.contains(p))
    return total


#: Classes that ``Counts`` counts: those of the patterns above, in categories.
CLASSES = {
    "digits": lambda c, kind: kind == "Nd" or c in "\xb2\xb3\xb9\u2070" or "\u2074" <= c <= "\u2079" or "\u2080" <= c <= "\u2089",
    "letters": lambda c, kind: kind[0] == "L",
    "alnum": lambda c, kind: kind[0] in "LN",
    "blank": lambda c, kind: kind[0] == "Z" or c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85",
    "upper": lambda c, kind: kind == "Lu",
    "lower": lambda c, kind: kind == "Ll" or c in "\xaa\xba",
}


def in_classes(code: int) -> list[int]:
    """1 or 0 for each of ``CLASSES``."""
    one = chr(code)
    kind = unicodedata.category(one)
    return [int(test(one, kind)) for test in CLASSES.values()]


@lru_cache(1)
def first_plane() -> np.ndarray:
    return np.array([in_classes(c) for c in range(1 << 16)])


class Counts:
    """How often each character occurs in a text: what sizes, classes and entropy follow from."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = len(codes)
        if self.n and codes.max() < 1 << 16:
            every = np.bincount(codes)
            self.codes = np.flatnonzero(every)
            self.counts = every[self.codes]
        else:
            self.codes, self.counts = np.unique(codes, return_counts=True)

    def classes(self) -> dict[str, int]:
        """Characters of each class."""
        if self.n and self.codes[-1] >= 1 << 16:
            table = np.array([in_classes(int(c)) for c in self.codes])
        else:
            table = first_plane()[self.codes]
        return dict(zip(CLASSES, (self.counts @ table).tolist()))

    def entropy(self, base: float = 2.0) -> float:
        """log n - sum(c log c)/n over the character counts c; 0 for empty text."""
        c = self.counts[self.counts > 1]
        return float((math.log(self.n) - (c * np.log(c)).sum() / self.n) / math.log(base)) if self.n else 0.0


def entropy(col: Column, base: float = 2.0) -> Column:
    """Shannon entropy of the characters, in Arrow batches; 0 for empty text and null."""
    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: Counts(text or "").entropy(base)).astype("float64")

    return of(col)


def profile(col: Column, exact: list[str], lower: list[str]) -> Column:
    """Struct of what one pass over a text in an Arrow batch tells; null counts as empty text.

    ``counts``: non-overlapping occurrences of each of ``exact``; ``seen``: 1 or 0 for each of ``lower`` in lower case; the
    classes of ``CLASSES`` by name; ``entropy`` in bits; ``decoded``: length after percent decoding.
    """
    from palisade.functions.decode import percent_decoded

    @F.pandas_udf("counts array<int>, seen array<int>, " + ", ".join(f"{c} int" for c in CLASSES) + ", entropy double, decoded int")
    def found(texts: pd.Series) -> pd.DataFrame:
        def of(text):
            text = text or ""
            low, counts = text.lower(), Counts(text)
            return [text.count(part) for part in exact], [int(part in low) for part in lower], *counts.classes().values(), counts.entropy(), len(percent_decoded(text))

        return pd.DataFrame([of(text) for text in texts], columns=["counts", "seen", *CLASSES, "entropy", "decoded"])

    return found(col)


def special_ratio(col: Column) -> Column:
    """Share of characters that are neither letters nor digits; 0 for empty text."""
    n = F.length(col)
    return F.when(n > 0, (n - count_class(col, ALNUM)) / n).otherwise(F.lit(0.0))


def json_field(col: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(col, path).try_cast(kind)


def salvage_json(col: Column, schema: str) -> Column:
    """JSON out of model text: fences stripped, else the outermost braces; NULL when neither parses."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(col, r"```(?:json)?\s*", "")), r"`+$", ""))
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    whole = F.from_json(bare, schema + ", _corrupt string", strict)
    inner = F.from_json(block, schema + ", _corrupt string", strict)
    parsed = lambda s, text: F.when(text.startswith("{") & s["_corrupt"].isNull(), s)
    return F.coalesce(parsed(whole, bare), parsed(inner, block))


def epoch_to_ts(col: Column) -> Column:
    return F.timestamp_micros(F.round(col * 1_000_000).cast("bigint"))


def iso_utc(ts_us: Column) -> Column:
    """ISO-8601 with microseconds only where there are any; the session zone must be UTC."""
    ts = F.timestamp_micros(ts_us)
    frac = F.pmod(ts_us, F.lit(1_000_000))
    tail = F.when(frac == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), tail, F.lit("+00:00"))


def flag_set(col: Column, bit: int) -> Column:
    return col.bitwiseAND(F.lit(bit)) != 0
