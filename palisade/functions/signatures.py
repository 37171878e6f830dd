"""Signatures over all readings of a request's texts, in Arrow batches.

A text crosses to Python once; its readings are made there, and only as long as a later one could give a better hit.
A literal test is far cheaper than a pattern, and a case-blind pattern runs on folded text without its flag: folding keeps
every position, so the match is cut from the reading itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.decode import percent_decoded
from palisade.functions.text import fold

BLIND = "(?i)"
_BLANKS, _COMMENT = re.compile(r"[\t\n\r\x0b\f]+"), re.compile(r"(?s)/\*.*?\*/")


def folded_pattern(pattern: str) -> str:
    """A case-blind pattern of ASCII letters as it reads folded text: without the flag, letters outside escapes in lower case."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern.removeprefix(BLIND))


def readings(value: str, coded: bool) -> Iterator[str]:
    """Every reading of a value without repeats, raw first, as ``decode.decode_variants`` lists them; entities only when ``coded``."""
    seen = set()
    once = percent_decoded(value)
    forms = [lambda: value, lambda: once, lambda: percent_decoded(once), lambda: percent_decoded(value.replace("+", " "))]
    if coded:
        forms += [lambda: html.unescape(value), lambda: html.unescape(once)]
    forms += [lambda: _BLANKS.sub(" ", value), lambda: _COMMENT.sub("", value) if "/*" in value else value]
    for form in forms:
        if (text := form()) not in seen:
            for one in (text, text.lower()):
                if one not in seen:
                    seen.add(one)
                    yield one


def in_order(text: str, first: tuple[str, ...], then: tuple[str, ...]) -> bool:
    """Whether some line has one of ``first`` and after it one of ``then``: linear, where ``first.*?then`` reads on from every ``first``."""
    for line in text.split("\n"):
        at = min((i for i in map(line.find, first) if i >= 0), default=-1)
        if at >= 0 and any(line.find(part, at) >= 0 for part in then):
            return True
    return False


class Judge:
    """The rules of a book, ordered by falling confidence: (confidence, pattern, flags, guards, order) each."""

    def __init__(self, plan: tuple):
        blind = lambda p, flags: not flags and p.startswith(BLIND)
        self.rules = [(c, re.compile(folded_pattern(p) if blind(p, flags) else p, flags), blind(p, flags), guards, order) for c, p, flags, guards, order in plan]

    def first(self, reading: str, floor: float, known: dict[str, dict[str, bool]]) -> tuple[int, str] | None:
        """First rule above ``floor`` that matches. Of a folded text met before, case-blind rules above the floor are known to fail."""
        folded = fold(reading)
        again, found = folded in known, known.setdefault(folded, {})
        for i, (confidence, pattern, blind, guards, order) in enumerate(self.rules):
            if confidence <= floor:
                break
            if again and blind:
                continue
            for parts in guards:
                for part in parts:
                    if part not in found:
                        found[part] = part in folded
                    if found[part]:
                        break
                else:
                    break
            else:
                if (not order or in_order(folded, *order)) and (m := pattern.search(folded if blind else reading)):
                    return i, reading[m.start():m.end()]
        return None

    def best(self, fields, values) -> tuple:
        """(code, field, reading, matched text) of the best hit, the first of equals."""
        hit, floor, known = (None, None, None, None), 0.0, {}
        coded = any("&" in value for value in values)
        for field, value in zip(fields, values):
            for reading in readings(value, coded):
                if got := self.first(reading, floor, known):
                    hit, floor = (got[0], field, reading, got[1]), self.rules[got[0]][0]
                    if floor >= self.rules[0][0]:
                        return hit
        return hit


@lru_cache(16)
def judge_of(plan: tuple) -> Judge:
    return Judge(plan)


def best_hits(fields: Column, values: Column, plan: tuple) -> Column:
    """Struct of the best hit over the values of a row; null values must be filtered out before."""
    @F.pandas_udf("code int, field string, decoded string, matched string")
    def hits(fields: pd.Series, values: pd.Series) -> pd.DataFrame:
        judge = judge_of(plan)
        rows = [judge.best(f, v) for f, v in zip(fields, values)]
        out = pd.DataFrame(rows, columns=["code", "field", "decoded", "matched"], dtype=object)
        out["code"] = out["code"].astype("Int32")
        return out

    return hits(fields, values)
