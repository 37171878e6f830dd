"""Lexical payload features for the payload classifiers, computed in one projection."""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import patterns as P
from palisade.functions.text import Counts, flag, profile

# Word lists.
SQL_WORDS = [
    "select", "insert", "update", "delete", "create", "drop", "alter", "truncate", "grant", "revoke",
    "union", "exec", "execute", "declare", "cast", "convert",
    "from", "where", "order", "group", "having", "limit", "join", "table", "database",
]
SQL_FUNCTIONS = ["concat", "substring", "ascii", "char", "version", "database", "user", "system_user", "current_user"]
XSS_MARKS = [
    "<script", "javascript:", "onerror=", "onload=", "onclick=", "onmouseover=", "onfocus=",
    "alert(", "prompt(", "confirm(", "eval(", "<iframe", "<object", "<embed", "<img", "<svg",
    "onabort=", "onblur=", "onchange=", "ondblclick=",
]
COMMAND_TOKENS = ["|", ";", "&&", "||", "`", "$"]
COMMAND_WORDS = [
    "/bin/", "/etc/passwd", "/etc/shadow", "cat ", "ls ", "wget ", "curl ", "nc ", "netcat",
    "bash", "sh ", "chmod", "chown", "rm ", "kill", "whoami",
]
TAUTOLOGIES = ["'1'='1'", '"1"="1"', " 1=1", " or 1=1"]
SLEEP_CALLS = ["sleep(", "benchmark(", "pg_sleep", "waitfor"]
QUOTED_COMMENTS = ["'--", '"--', "'#", '"#', "'/*", '"/*']
NORMAL_SQL = P.portable(r"(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER)\s")
QUOTE_THEN_LOGIC = P.portable(r"'\s*(or|and|union)")
EVENT_HANDLER = P.portable(r"on\w+\s*=")
TAG = r"<[^>]+>"
HEX_ESCAPE = r"\\x[0-9a-fA-F]{2}"
REST_PATH = r"^/[a-zA-Z0-9_-]+(/[a-zA-Z0-9_-]+)*(\?[a-zA-Z0-9_=&-]+)?\n?\z"

LEXICAL_FEATURES = [
    "length", "decoded_length", "num_special_chars", "num_digits", "num_uppercase", "num_lowercase", "num_spaces",
    "special_char_ratio", "digit_ratio", "upper_ratio", "lower_ratio", "entropy",
    "sql_keyword_count", "has_sql_comment", "has_union", "has_select", "has_insert", "has_delete", "has_drop",
    "is_union_injection", "has_quote_and_sql", "has_quote_comment", "has_select_null", "has_multiple_sql_keywords",
    "has_always_true", "has_or_with_quote", "has_and_with_quote", "has_sleep", "sql_function_count",
    "has_stacked_query", "is_normal_sql",
    "xss_pattern_count", "has_html_tags", "has_javascript", "has_event_handler", "has_script_tag", "html_tag_count",
    "cmd_char_count", "has_pipe", "has_semicolon", "has_backtick", "has_dollar", "cmd_keyword_count", "is_cmd_injection",
    "has_dotdot", "dotdot_count", "has_etc_passwd", "has_windows_path", "slash_count", "is_rest_api_path",
    "is_path_traversal_attack",
    "has_url_encoding", "has_html_encoding", "encoding_count", "hex_encoding_count", "unicode_encoding",
    "has_quotes", "quote_count", "has_parentheses", "parentheses_count", "has_brackets", "has_equals", "equals_count",
    "has_null_byte",
]


def _regex_count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def lexical_features(df: DataFrame, payload: str) -> DataFrame:
    """Append the 64 lexical features of a text column; NULL counts as empty text.

    Literals, character counts and entropy come from one Arrow batch helper; patterns run only on texts that have what they need.
    """
    exact, lower = {}, {}
    count_text = lambda _, part: F.col("__found.counts")[exact.setdefault(part, len(exact))]
    seen = lambda part: F.col("__found.seen")[lower.setdefault(part, len(lower))]
    has = lambda text, *parts: reduce(lambda a, b: a | b, [(seen(x) if text is low else count_text(text, x)) > 0 for x in parts])
    count_present = lambda _, parts: reduce(lambda a, b: a + b, [seen(x) for x in parts])
    p, low, n = F.col("__p"), F.col("__l"), F.col("__n")
    derived = lambda rows: (rows.withColumn("__l", F.lower("__p"))
              .withColumn("__n", F.length("__p"))
              .withColumn("__special", F.col("__n") - F.col("__found.alnum") - F.col("__found.blank"))
              .withColumn("__digits", F.col("__found.digits"))
              .withColumn("__upper", F.col("__found.upper"))
              .withColumn("__lower", F.col("__found.lower"))
              .withColumn("__sql", count_present(F.col("__l"), SQL_WORDS))
              .withColumn("__cmd", count_present(F.col("__l"), COMMAND_WORDS))
              .withColumn("__dots", count_text(F.col("__p"), ".."))
              .withColumn("__slashes", count_text(F.col("__p"), "/") + count_text(F.col("__p"), "\\"))
              .withColumn("__tags", F.when(has(p, "<") & has(p, ">"), _regex_count(F.col("__p"), TAG)).otherwise(0)))
    quote = has(p, "'", '"')
    ratio = lambda c: F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))
    etc = has(low, "/etc/passwd", "/etc/shadow")
    windows = has(low, "c:\\", "windows\\")
    f = {
        "length": n,
        "decoded_length": F.col("__found.decoded"),
        "num_special_chars": F.col("__special"),
        "num_digits": F.col("__digits"),
        "num_uppercase": F.col("__upper"),
        "num_lowercase": F.col("__lower"),
        "num_spaces": count_text(p, " "),
        "special_char_ratio": ratio("__special"),
        "digit_ratio": ratio("__digits"),
        "upper_ratio": ratio("__upper"),
        "lower_ratio": ratio("__lower"),
        "entropy": F.col("__found.entropy"),
        "sql_keyword_count": F.col("__sql"),
        "has_sql_comment": flag(has(p, "--", "/*", "#")),
        "has_union": flag(has(low, "union")),
        "has_select": flag(has(low, "select")),
        "has_insert": flag(has(low, "insert")),
        "has_delete": flag(has(low, "delete")),
        "has_drop": flag(has(low, "drop")),
        "is_union_injection": flag(has(low, "union") & has(low, "select") & has(p, "'", '"', "--")),
        "has_quote_and_sql": flag(quote & (F.col("__sql") >= 1)),
        "has_quote_comment": flag(has(p, *QUOTED_COMMENTS)),
        "has_select_null": flag(has(low, "select") & has(low, "null")),
        "has_multiple_sql_keywords": flag(F.col("__sql") >= 3),
        "has_always_true": flag(has(low, *TAUTOLOGIES) | has(p, "'=''")),
        "has_or_with_quote": flag(has(low, " or ", "' or '", '" or "') & quote),
        "has_and_with_quote": flag(has(low, " and ", "' and '", '" and "') & quote),
        "has_sleep": flag(has(low, *SLEEP_CALLS)),
        "sql_function_count": count_present(low, SQL_FUNCTIONS),
        "has_stacked_query": flag(has(p, ";") & has(low, "select", "insert", "update", "delete", "drop")),
        "is_normal_sql": flag(p.rlike(NORMAL_SQL) & ~has(p, "--", "/*") & (count_text(p, "'") <= 2)
                              & ~(has(p, "'") & low.rlike(QUOTE_THEN_LOGIC))),
        "xss_pattern_count": count_present(low, XSS_MARKS),
        "has_html_tags": flag(F.col("__tags") > 0),
        "has_javascript": flag(has(low, "javascript:")),
        "has_event_handler": flag(has(low, "on") & has(p, "=") & low.rlike(EVENT_HANDLER)),
        "has_script_tag": flag(has(low, "<script")),
        "html_tag_count": F.col("__tags"),
        "cmd_char_count": sum((count_text(p, t) for t in COMMAND_TOKENS[1:]), count_text(p, COMMAND_TOKENS[0])),
        "has_pipe": flag(has(p, "|")),
        "has_semicolon": flag(has(p, ";")),
        "has_backtick": flag(has(p, "`")),
        "has_dollar": flag(has(p, "$(", "${")),
        "cmd_keyword_count": F.col("__cmd"),
        "is_cmd_injection": flag(has(p, "|", ";", "`") & (F.col("__cmd") > 0)),
        "has_dotdot": flag(has(p, "..")),
        "dotdot_count": F.col("__dots"),
        "has_etc_passwd": flag(etc),
        "has_windows_path": flag(windows),
        "slash_count": F.col("__slashes"),
        "is_rest_api_path": flag(p.rlike(REST_PATH) & (F.col("__dots") == 0) & ~etc & ~has(p, "<", "'")
                                 & (F.col("__sql") == 0)),
        "is_path_traversal_attack": flag((F.col("__dots") >= 2) | etc | windows
                                         | ((F.col("__dots") >= 1) & (F.col("__slashes") >= 3))),
        "has_url_encoding": flag(has(p, "%")),
        "has_html_encoding": flag(has(p, "&") & has(p, ";")),
        "encoding_count": count_text(p, "%"),
        "hex_encoding_count": F.when(has(p, "\\x"), _regex_count(p, HEX_ESCAPE)).otherwise(0),
        "unicode_encoding": flag(has(p, "\\u")),
        "has_quotes": flag(quote),
        "quote_count": count_text(p, "'") + count_text(p, '"'),
        "has_parentheses": flag(has(p, "(") & has(p, ")")),
        "parentheses_count": count_text(p, "(") + count_text(p, ")"),
        "has_brackets": flag(has(p, "[", "{")),
        "has_equals": flag(has(p, "=")),
        "equals_count": count_text(p, "="),
        "has_null_byte": flag(has(p, "%00", "\\x00", "\x00")),
    }
    kept = [F.col(c) for c in df.columns]
    whole = df.withColumn("__p", F.coalesce(F.col(payload), F.lit("")))
    derived(whole.withColumn("__found", profile(p, [], [])))  # every feature has now named its literals
    base = derived(whole.withColumn("__found", profile(p, list(exact), list(lower))))
    return base.select(*kept, *[f[name].alias(name) for name in LEXICAL_FEATURES])


COMPACT_FEATURES = [
    "payload_len", "digit_count", "alpha_count", "special_char_count", "slash_count", "dot_count", "percent_count",
    "equals_count", "question_count", "amp_count", "has_sql_kw", "has_xss_kw", "has_path_kw", "has_cmd_kw", "entropy",
]


def payload_features(df: DataFrame, payload: str) -> DataFrame:
    """Append the 15 compact features of the anomaly model (entropy in nats); NULL counts as empty text."""
    signs = [(re.compile(pattern.removeprefix("(?i)")), sure, maybe) for pattern, sure, maybe in P.COMPACT]

    @F.pandas_udf(", ".join(f"{c} {'double' if c == 'entropy' else 'int'}" for c in COMPACT_FEATURES))
    def features(texts: pd.Series) -> pd.DataFrame:
        def of(text):
            text = text or ""
            # These patterns fold ASCII letters only; the two letters that fold to ASCII ones give way to others.
            low = (text if text.isascii() else text.replace("\u0130", "\u0131").replace("\u212a", "\u0138")).lower()
            counts = Counts(text)
            kinds = counts.classes()
            sign = lambda pattern, sure, maybe: int(any(x in low for x in sure) or (any(x in low for x in maybe) and pattern.search(low) is not None))
            return (counts.n, kinds["digits"], kinds["letters"], counts.n - kinds["alnum"], *[text.count(x) for x in "/.%=?&"], *[sign(*x) for x in signs], counts.entropy(math.e))

        return pd.DataFrame([of(text) for text in texts], columns=COMPACT_FEATURES)

    return df.select("*", F.explode(F.array(features(F.col(payload)))).alias("__told")).select(*df.columns, *[F.col(f"__told.{c}").alias(c) for c in COMPACT_FEATURES])
