"""Joins to dimensions: techniques, reputation, analyses, label routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.labels import map_labels


def map_attack(df: DataFrame, label: str) -> DataFrame:
    """Technique id, name, tactic and kill-chain phase of an attack label.

    The fixed tables have 16 and 13 rows, so they are map literals: no join at all.
    """
    raw = F.lower(F.col(label))
    norm = F.replace(F.replace(raw, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    part = lambda i: F.coalesce(map_labels(norm, {k: v[i] for k, v in K.TECHNIQUES.items()}),
                                map_labels(raw, {k: v[i] for k, v in K.TECHNIQUES.items()}))
    out = df.withColumn("technique_id", part(0)).withColumn("technique_name", part(1)).withColumn("tactic", part(2))
    return out.withColumn("kill_chain_phase", F.when(F.col("tactic").isNotNull(), map_labels(F.col("tactic"), K.KILL_CHAIN, "Unknown")))


def enrich_intel(df: DataFrame, reports: DataFrame, abuse: DataFrame, geo: DataFrame, key: str = "ip") -> DataFrame:
    """Honeypot reports, abuse scores and location by address.

    Of several reports on an address the last one seen, the one of most reports, and the first by name count, so no
    event is doubled. No broadcast hint: the intel tables grow with the address space, so the choice is left to the
    adaptive planner, which broadcasts a side only after it has measured it.
    """
    one = lambda df, best: df.groupBy(key).agg(best.alias("b")).select(key, "b.*")
    seen = F.struct("last_seen", "first_seen", F.col("count").alias("honeypot_count"))
    r = one(reports, F.max(seen)).select(key, "honeypot_count", "first_seen", "last_seen")
    a = one(abuse, F.max(F.struct("total_reports", "abuse_confidence_score", "country_code"))).select(key, "abuse_confidence_score", "total_reports", "country_code")
    g = one(geo, F.min(F.struct("org", "isp")))
    out = df.join(r, key, "left").join(a, key, "left").join(g, key, "left")
    c = F.col("honeypot_count")
    return out.withColumn("threat_level", F.when(c > 10, "high").when(c > 2, "medium").when(c.isNotNull(), "low"))


def prevalence(count: Column, abuse: Column) -> Column:
    c, a = F.coalesce(count, F.lit(0)), F.coalesce(abuse, F.lit(0))
    return F.when((c > 20) | (a > 80), "widespread").when((c > 5) | (a > 40), "emerging").otherwise("isolated")


def join_analysis(events: DataFrame, analyses: DataFrame) -> DataFrame:
    """Analysis state per event: its own status, or not_found."""
    a = analyses.select(F.col("event_id").alias("request_id"), F.col("status").alias("__s"), "severity")
    return events.join(a, "request_id", "left").withColumn("analysis_status", F.coalesce("__s", F.lit("not_found"))).drop("__s")


def route_labels(df: DataFrame, mapping: dict[str, str], raw: str = "raw_label", out: str = "unified_label") -> DataFrame:
    """Keep rows whose label is in the mapping and add the mapped label."""
    return df.withColumn(out, map_labels(F.col(raw), mapping)).where(F.col(out).isNotNull())


def unrouted_labels(df: DataFrame, mappings: list[dict[str, str]], raw: str = "raw_label") -> DataFrame:
    """Counts of the labels that no mapping knows."""
    known = [k for m in mappings for k in m]
    return df.where(F.col(raw).isNotNull() & ~F.col(raw).isin(known)).groupBy(raw).agg(F.count(F.lit(1)).alias("cnt"))


def route(df: DataFrame, raw: str = "raw_label") -> DataFrame:
    """One pass that marks each row benign, known or novel; unknown labels are dropped.

    ``route`` is a column instead of three frames, so a writer can partition by it in a single scan.
    """
    known = map_labels(F.col(raw), K.KNOWN_LABELS)
    novel = F.col(raw).isin(K.NOVEL_LABELS)
    return (df.withColumn("unified_label", F.coalesce(known, F.when(novel, "novel"))).where(F.col("unified_label").isNotNull())
              .withColumn("route", F.when(F.col("unified_label") == "benign", "benign").when(F.col("unified_label") == "novel", "novel").otherwise("known")))


def holdout_split(df: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is held out, the others)."""
    side = held.select(key).distinct()
    return df.join(side, key, "left_semi"), df.join(side, key, "left_anti")
