"""Rule matching: static rules, suspicion, signature filter, user rules, honeypot families.

A rule table is small (hundreds of rows at most) and goes along with the code, so matching is a projection
over the payload table: no rule x payload join and no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import patterns as P
from palisade.functions.scores import confidence_to_score
from palisade.functions.signatures import best_hits
from palisade.functions.text import guards_met, has, special_ratio



def header(name: str) -> Column:
    """Header value by case-insensitive name; empty text when absent."""
    hits = F.map_filter("headers", lambda k, _: F.lower(k) == name)
    return F.coalesce(F.get(F.map_values(hits), F.lit(0)), F.lit(""))


# -- first layer -----------------------------------------------------------------------------------

def _any(text: Column, pats: list[str]) -> Column:
    guards = dict(zip([*P.STATIC_SQLI, *P.STATIC_XSS], P.STATIC_GUARDS, strict=True))
    return reduce(lambda a, b: a | b, [text.contains(guards[p]) & text.rlike(P.portable(p)) if p in guards else text.rlike(P.portable(p)) for p in pats])


def static_rules(df: DataFrame, rate_limited: Column | None = None) -> DataFrame:
    """Ordered first hit over body, path and agent; appends ``static_rule`` (NULL when nothing fires)."""
    body, path = F.col("__low_body"), F.col("__low_path")  # columns of their own: inside the tests they would be folded for each
    rule = (F.when(_any(body, P.STATIC_SQLI), "SQL Injection").when(_any(body, P.STATIC_XSS), "XSS")
             .when(_any(path, P.STATIC_PATH), "Path Traversal")
             .when(has(F.lower(header("user-agent")), *P.STATIC_AGENTS), "Malicious User-Agent"))
    if rate_limited is not None:
        rule = rule.when(rate_limited, "Rate Limiting")
    low = df.withColumns({f"__low_{c}": F.lower(F.coalesce(c, F.lit(""))) for c in ("body", "path")})
    return low.withColumn("static_rule", rule).drop("__low_body", "__low_path")


def suspicion(df: DataFrame) -> DataFrame:
    """Five weak signs; two or more send the request to the models. Appends the count, flag and score."""
    body, path = F.coalesce("body", F.lit("")), F.coalesce("path", F.lit(""))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    total = (one(body.contains("%")) + one(special_ratio(body) > 0.30)
             + one(has(F.lower(header("user-agent")), *P.TOOL_AGENTS))
             + one((F.length(body) > 200) | (F.length(path) > 150)) + one(has(F.lower(body), "%2e%2e", "%2f")))
    return (df.withColumn("suspicion_score", total)
              .withColumn("forward_to_models", F.col("suspicion_score") >= 2)
              .withColumn("suspicion_contribution",
                          F.when(F.col("suspicion_score") >= 2, F.least(F.lit(0.4), F.col("suspicion_score") * 0.1)).otherwise(0.0)))


def method_gate(df: DataFrame) -> DataFrame:
    return df.withColumn("uncommon_method", ~F.coalesce(F.col("method"), F.lit("")).isin("GET", "POST"))


def static_decision(df: DataFrame, rate_limited: Column | None = None) -> DataFrame:
    """The whole first layer: decision and reason per request."""
    out = method_gate(suspicion(static_rules(df, rate_limited)))
    return (out.withColumn("static_decision", F.when(F.col("static_rule").isNotNull(), "MITIGATE")
                           .when(F.col("forward_to_models") | F.col("uncommon_method"), "FORWARD_TO_ML").otherwise("ALLOW"))
               .withColumn("static_reason", F.coalesce("static_rule", F.when(F.col("forward_to_models"), "Suspicious but unclear")
                           .when(F.col("uncommon_method"), "Uncommon HTTP Method").otherwise("Normal Traffic"))))


# -- signatures ------------------------------------------------------------------------------------

def jvm_compiles(spark, pattern: str) -> bool:
    """Whether the engine that will run the pattern accepts it; a rule it rejects is ignored, not fatal."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(P.jvm(P.portable("(?is)" + pattern)))
    except Exception:  # noqa: BLE001 - any JVM complaint means unusable
        return False
    return True


class RuleBook:
    """Signatures and user rules in the order in which a single text is judged.

    HIGH signatures first (their order), then user rules, then MEDIUM signatures by confidence. The
    first entry that matches decides, which is what scanning group by group and keeping the best gives.
    """

    def __init__(self, adaptive: list[tuple[str, str, str]] | None = None):
        fixed = [(f, c, P.portable(p), d, None, g) for (f, c, p, d), g in zip(P.SIGNATURES, P.SIGNATURE_GUARDS, strict=True)]
        user = [(t, 1.0, P.portable("(?is)" + p), f"adaptive:{i}", i, None) for i, p, t in adaptive or []]
        high = [r for r in fixed if r[1] >= 1.0]
        medium = sorted((r for r in fixed if r[1] < 1.0), key=lambda r: -r[1])
        self.rules = high + user + medium
        #: User patterns as they were given, by their place among the rules.
        self.sources = {len(high) + k: p for k, (_, p, _) in enumerate(adaptive or [])}
        #: Digest of the user rules in their order: says which book judged a row. The same rules give the same digest.
        self.version = hashlib.md5("\n".join(f"{i}\t{p}" for i, p, _ in adaptive or []).encode()).hexdigest()

    @classmethod
    def from_table(cls, rules: DataFrame) -> "RuleBook":
        """All active user rules, newest first; their number is bounded where rules are admitted."""
        spark = rules.sparkSession
        active = (rules.where(F.col("status") == "active").orderBy(F.desc("created_us"), "rule_id")
                       .select("rule_id", "pattern", "attack_type"))
        got = active.collect()
        return cls([(r.rule_id, r.pattern, r.attack_type) for r in got if P.compiles(r.pattern) and jvm_compiles(spark, r.pattern)])

    def guards(self) -> list[list[list[str]]]:
        """What must occur for each rule, in folded text; user rules need nothing."""
        return [[r[5], *P.MORE_GUARDS.get(r[3], [])] if r[5] else [] for r in self.rules]

    def plan(self) -> tuple:
        """What judges a text in Arrow batches: confidence, Python pattern, flags, guards and order of each rule."""
        spelt = {d: p for _, _, p, d in P.SIGNATURES}
        return tuple((r[1], self.sources.get(i, spelt.get(r[3])), re.I | re.S if i in self.sources else 0, tuple(map(tuple, g)), None if i in self.sources else P.IN_ORDER.get(r[3]))
                     for i, (r, g) in enumerate(zip(self.rules, self.guards(), strict=True)))

    def column(self, code: Column, field: int) -> Column:
        kind = "double" if field == 1 else "string"
        values = F.array(*[F.lit(r[field]).cast(kind) for r in self.rules])
        return F.get(values, code)


def scan_targets() -> Column:
    """What the signature filter reads of a request: body, path, query values, four headers (in order)."""
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("field"), value.alias("value")))
    query = F.transform(F.map_entries("query_params"), lambda e: F.struct(F.concat(F.lit("query:"), e["key"]).alias("field"), e["value"].alias("value")))
    heads = F.transform(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]).isin(P.SCANNED_HEADERS)),
                        lambda e: F.struct(F.concat(F.lit("header:"), e["key"]).alias("field"), e["value"].alias("value")))
    empty = F.array().cast("array<struct<field:string,value:string>>")
    every = F.concat(one("body", F.col("body")), one("path", F.col("path")), F.coalesce(query, empty), F.coalesce(heads, empty))
    return F.filter(every, lambda t: F.coalesce(t["value"], F.lit("")) != "")


def signature_filter(df: DataFrame, book: RuleBook | None = None, only: Column | None = None) -> DataFrame:
    """Append the best signature hit of each request: decision, score and match detail. No shuffle.

    Rows outside ``only`` have nothing to scan and come back as no hit.

    Texts go to Python once, in Arrow batches (``palisade.functions.signatures``). The hit is produced by a one-element
    explode, which keeps later filters on the decision from being pushed below it and judging all texts twice.
    """
    book = book or RuleBook()
    targets = scan_targets()
    if only is not None:
        targets = F.when(only, targets).otherwise(F.array().cast("array<struct<field:string,value:string>>"))
    out = df.withColumn("__targets", targets)
    hit = best_hits(F.transform("__targets", lambda t: t["field"]), F.transform("__targets", lambda t: t["value"]), book.plan())
    out = out.select(*df.columns, F.explode(F.array(hit)).alias("__hit"))
    code = F.col("__hit.code")
    out = out.select(*df.columns, book.column(code, 0).alias("pattern_group"), book.column(code, 3).alias("pattern"), book.column(code, 1).alias("confidence"),
                     book.column(code, 4).alias("rule_id"), F.col("__hit.field").alias("matched_in"),
                     F.col("__hit.matched").alias("matched_text"), F.col("__hit.decoded").alias("decoded_input"))
    return out.withColumn(
        "decision", F.when(F.col("confidence") >= 1.0, "MITIGATE").when(F.col("confidence").isNotNull(), "FORWARD_TO_ML").otherwise("ALLOW")
    ).withColumn("score", F.when(F.col("confidence").isNull(), 0.0).otherwise(confidence_to_score(F.col("confidence"))))


def match_rules(df: DataFrame, key: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per (payload, rule) hit; rules are (id, pattern) and the hits come from one projection."""
    hits = F.array(*[F.when(F.col(text).rlike(P.jvm(P.portable(p))), F.lit(i)) for i, p in rules])
    return df.select(key, F.explode(F.array_compact(hits)).alias("rule_id"))


# -- rule admission ---------------------------------------------------------------------------------

@F.pandas_udf(T.BooleanType())
def _usable(patterns):
    """Compiles, does not match empty text, and hits fewer than three benign samples."""
    import re

    def ok(p):
        try:
            rx = re.compile(p, re.IGNORECASE | re.DOTALL)
        except (re.error, TypeError):
            return False
        return not rx.search("") and sum(1 for s in P.BENIGN_SAMPLES if rx.search(s)) < 3

    return patterns.map(ok).astype(bool)


def validate_patterns(rules: DataFrame, col: str = "pattern") -> DataFrame:
    """Append ``is_safe``: length 5 to 500, no bare wildcard, nothing that the JVM engine lacks (conditional groups,
    named characters, ASCII and locale flags), and the checks that need a regex engine.

    The cheap tests run first as a filter, because a Python branch of a CASE would be computed anyway.
    """
    p = F.trim(F.col(col))
    cheap = p.isNotNull() & F.length(p).between(5, 500) & ~p.isin(P.WILDCARDS) & ~p.rlike(P.NOT_PORTABLE)
    good = rules.where(cheap).withColumn("is_safe", _usable(p))
    return good.unionByName(rules.where(~F.coalesce(cheap, F.lit(False))).withColumn("is_safe", F.lit(False)))


def anti_existing(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not known yet."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def admit_rules(new: DataFrame, existing: DataFrame, cap: int | None = None) -> DataFrame:
    """Severe, safe and new patterns, one per pattern; with ``cap``, as many as a store of that size has room for.

    ``new`` needs pattern, attack_type, event_id, severity, confidence, proposed_us. Earliest proposals win.
    """
    cand = new.where(F.col("severity").isin("CRITICAL", "HIGH") & F.col("pattern").isNotNull()).withColumn("pattern", F.trim("pattern"))
    first = cand.groupBy("pattern").agg(F.min(F.struct("proposed_us", "event_id", "attack_type", "severity", "confidence")).alias("r")).select("pattern", "r.*")
    fresh = validate_patterns(anti_existing(first, existing, "pattern")).where("is_safe").drop("is_safe")
    kept = fresh if cap is None else fresh.orderBy("proposed_us", "event_id", "pattern").limit(max(0, cap - existing.count()))
    return kept.select(
        F.md5("pattern").alias("rule_id"), "pattern", "attack_type", F.col("event_id").alias("source_event_id"), "severity",
        F.round("confidence", 4).alias("confidence"), F.lit("active").alias("status"), F.lit(0).cast("bigint").alias("match_count"),
        F.col("proposed_us").alias("created_us"), F.lit(None).cast("bigint").alias("last_matched_us"))


# -- honeypot families --------------------------------------------------------------------------------

def honeypot_text() -> Column:
    """Path, query, form, headers and body of a hit, one part per line."""
    pairs = lambda m, mid, sep: F.coalesce(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(mid), e["value"])), sep), F.lit(""))
    return F.concat_ws("\n", F.coalesce("path", F.lit("")), pairs("query_params", "=", "&"), pairs("form_data", "=", "&"),
                       pairs("headers", ":", " "), F.coalesce("raw_body", F.lit("")))


def family_hits(text: Column, met: Column) -> Column:
    """Number of patterns hit, one entry per family; ``met`` has the patterns whose guard is met."""
    number = iter(range(sum(map(len, P.HONEYPOT_FAMILIES.values()))))
    one = lambda p: F.coalesce(F.array_contains(met, next(number)) & text.rlike(P.jvm(P.portable(p))), F.lit(False)).cast("int")
    return F.array(*[sum((one(p) for p in pats), F.lit(0)) for pats in P.HONEYPOT_FAMILIES.values()])


def family_tags(hits: Column) -> Column:
    """``Family:score`` for every family with at least a quarter of its patterns hit, best first."""
    scored = []
    for i, (name, pats) in enumerate(P.HONEYPOT_FAMILIES.items()):
        share = hits[i] / F.lit(len(pats))
        scored.append(F.when(share >= P.HONEYPOT_FLOOR,
                             F.struct((-F.round(share, 2)).alias("neg"), F.lit(i).alias("ord"), F.lit(name).alias("family"), F.round(share, 2).alias("score"))))
    ranked = F.array_sort(F.array_compact(F.array(*scored)))
    return F.transform(ranked, lambda t: F.concat(t["family"], F.lit(":"), t["score"].cast("string")))


def tag_requests(df: DataFrame) -> DataFrame:
    """Append ``tags``. Text and hits are columns of their own: inside the tags they would be computed many times."""
    told = df.select("*", honeypot_text().alias("__text"))
    guards = [g for family in P.HONEYPOT_FAMILIES for g in P.HONEYPOT_GUARDS[family]]
    told = told.withColumn("__met", guards_met(F.array("__text"), guards)[0])
    told = told.select(*df.columns, family_hits(F.col("__text"), F.col("__met")).alias("__hits"))
    return told.select(*df.columns, family_tags(F.col("__hits")).alias("tags"))
