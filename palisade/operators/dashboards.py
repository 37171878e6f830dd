"""Event search and dashboard aggregates over detection events.

Every aggregate is a hash aggregate with map-side combine; key cardinality (addresses, labels, minutes)
bounds what is shuffled. Pass a slice from ``within`` so the time filter reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.text import iso_utc
from palisade.session import materialize

THROTTLED = ["THROTTLE", "CAPTCHA", "DELAY"]


def count_where(test: Column) -> Column:
    return F.count(F.when(test, 1))


# -- filters and search ---------------------------------------------------------------------------

def within(df: DataFrame, as_of_us: int, seconds: int, time: str = "event_time") -> DataFrame:
    """Rows of the last ``seconds`` before ``as_of_us``.

    The bound is a constant compared with the stored time column, so partitions and row groups are
    skipped by the scan.
    """
    bound = F.timestamp_micros(F.lit(as_of_us - seconds * 1_000_000)).cast(df.schema[time].dataType)
    return df.where(F.col(time) >= bound)


def newest(df: DataFrame, limit: int = 100, ts: str = "timestamp", tie: str = "request_id") -> DataFrame:
    """Newest rows first; sort and limit become one top-k operator."""
    return df.orderBy(F.desc(ts), F.asc(tie)).limit(limit)


def search_events(df: DataFrame, limit: int = 100, action: str = "", ip: str = "", attack_type: str = "") -> DataFrame:
    out = df
    if action:
        out = out.where(F.col("action") == action.upper())
    if ip:
        out = out.where(F.col("ip") == ip)
    if attack_type:
        like = f"%{attack_type}%"
        out = out.where(F.col("best_label").ilike(like) | F.col("block_reason").ilike(like))
    return newest(out, limit)


def search_events_nested(df: DataFrame, limit: int = 100, action: str = "", ip: str = "", attack_type: str = "") -> DataFrame:
    """The same search when labels live in the layer list only."""
    out = df
    if action:
        out = out.where(F.upper("action") == action.upper())
    if ip:
        out = out.where(F.col("ip") == ip)
    if attack_type:
        word = attack_type.lower()
        out = out.where(F.lower("block_reason").contains(word)
                        | F.exists("layer_scores", lambda s: F.lower(s["label"]).contains(word)))
    return newest(out, limit)


def filter_contains(df: DataFrame, ip: str = "", action: str = "", label: str = "", limit: int = 100) -> DataFrame:
    """Table filter of the console: substrings are case-sensitive; the label falls back to the reason."""
    out = df
    if ip:
        out = out.where(F.col("ip").contains(ip))
    if action:
        out = out.where(F.col("action") == action)
    if label:
        shown = F.coalesce(F.nullif(F.col("best_label"), F.lit("")), F.col("block_reason"), F.lit(""))
        out = out.where(shown.contains(label))
    return newest(out, limit)


# -- summaries -------------------------------------------------------------------------------------

def summary(df: DataFrame) -> DataFrame:
    """Totals of a time slice; no row at all when the slice is empty."""
    a = F.col("action")
    out = df.agg(
        F.count(F.lit(1)).alias("total_requests"),
        count_where(a == "BLOCK").alias("blocked_attacks"),
        count_where(a == "ALLOW").alias("allowed_requests"),
        count_where(a.isin(THROTTLED)).alias("throttled_captcha"),
        F.avg("latency_ms").alias("lat"))
    return out.where(F.col("total_requests") > 0).select(
        "total_requests", "blocked_attacks", "allowed_requests", "throttled_captcha",
        F.round(F.col("blocked_attacks") / F.col("total_requests") * 100, 1).alias("block_rate_pct"),
        F.round(F.coalesce("lat", F.lit(0.0)), 1).alias("avg_latency_ms"))


def rpm(df: DataFrame, as_of_us: int, minutes: int = 30) -> DataFrame:
    """Requests per minute back from ``as_of_us``."""
    ago = F.floor((F.lit(as_of_us) - F.col("ts_us")) / F.lit(60_000_000)).cast("int")
    return (within(df, as_of_us, minutes * 60).groupBy(ago.alias("mins_ago"))
            .agg(F.count(F.lit(1)).alias("total"), count_where(F.col("action") == "BLOCK").alias("blocked")))


def rpm_dense(df: DataFrame, as_of_us: int, minutes: int = 30) -> DataFrame:
    """``minutes`` slots, oldest first (slot 0), empty minutes as zero."""
    slots = df.sparkSession.range(minutes).select(
        F.col("id").cast("int").alias("slot"), (F.lit(minutes - 1) - F.col("id")).cast("int").alias("mins_ago"))
    filled = slots.join(rpm(df, as_of_us, minutes), "mins_ago", "left")
    return filled.select("slot", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("blocked", F.lit(0)).alias("blocked"))


def top_ips(df: DataFrame, limit: int = 20) -> DataFrame:
    """Most blocked sources, with the time of their last blocked request."""
    blocked = F.col("action") == "BLOCK"
    out = df.groupBy("ip").agg(
        F.count(F.lit(1)).alias("requests"), count_where(blocked).alias("blocked"),
        F.round(F.max("final_score"), 4).alias("max_score"),
        F.max(F.when(blocked, F.col("ts_us"))).alias("last"))
    return (out.orderBy(F.desc("blocked"), F.desc("max_score"), F.asc("ip")).limit(limit)
               .select("ip", "requests", "blocked", "max_score", F.coalesce(iso_utc(F.col("last")), F.lit("")).alias("last_attack_iso")))


def top_ips_argmax(df: DataFrame, limit: int = 20) -> DataFrame:
    """Variant whose last attack is the first event that reached the maximum score."""
    out = df.where(F.col("ip").isNotNull() & (F.col("ip") != "")).groupBy("ip").agg(
        F.count(F.lit(1)).alias("requests"), count_where(F.col("action") == "BLOCK").alias("blocked"),
        F.max("final_score").alias("top"),
        F.max_by("ts_us", F.struct(F.col("final_score"), (-F.col("ts_us")).alias("neg"))).alias("at"))
    return (out.orderBy(F.desc("blocked"), F.asc("ip")).limit(limit)
               .select("ip", "requests", "blocked", F.round("top", 4).alias("max_score"),
                       F.when(F.col("top") > 0, iso_utc(F.col("at"))).otherwise("").alias("last_attack_iso")))


def attack_types(df: DataFrame, limit: int = 10) -> DataFrame:
    return (df.where(~F.col("best_label").isin(K.BENIGN_CHART_LABELS)).groupBy("best_label")
              .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), F.asc("best_label")).limit(limit))


def _attack_label(layer: Column, reason: Column) -> Column:
    label = F.coalesce(F.nullif(layer["label"], F.lit("")), reason)
    return F.when((layer["triggered"] | (layer["score"] > 0.5)) & ~label.isin(K.BENIGN_EVENT_LABELS), label)


def attack_types_nested(df: DataFrame) -> DataFrame:
    """Label of the first layer that fired or scored above one half, counted once per event."""
    reason = F.coalesce(F.col("block_reason"), F.lit(""))
    labels = F.array_compact(F.transform("layer_scores", lambda s: _attack_label(s, reason)))
    return (df.select(F.get(labels, F.lit(0)).alias("label")).where(F.col("label").isNotNull())
              .groupBy("label").agg(F.count(F.lit(1)).alias("cnt")))


def explode_layers(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode("layer_scores").alias("pos", "ls")).select(*keep, "pos", "ls.*")


LAYER_JSON = "array<struct<layer:string,score:double,label:string,confidence:double,triggered:boolean>>"


def parse_layers(df: DataFrame, col: str) -> DataFrame:
    """Layer lists stored as JSON text back to structs; broken text gives an empty list."""
    return df.withColumn("layer_scores", F.coalesce(F.from_json(col, LAYER_JSON), F.array().cast(LAYER_JSON)))


def layer_counts(df: DataFrame) -> DataFrame:
    """Every triggered layer counts."""
    return (explode_layers(df).where(F.col("triggered") & F.col("layer").isNotNull())
            .groupBy("layer").agg(F.count(F.lit(1)).alias("cnt")))


def layer_first(df: DataFrame) -> DataFrame:
    """Only the first triggered layer of an event counts."""
    first = F.get(F.filter("layer_scores", lambda s: s["triggered"]), F.lit(0))
    return (df.select(first.alias("ls")).where(F.col("ls").isNotNull())
              .groupBy(F.coalesce(F.col("ls.layer"), F.lit("unknown")).alias("layer")).agg(F.count(F.lit(1)).alias("cnt")))


def dashboard_cube(df: DataFrame) -> DataFrame:
    """Total, by action, by label, by source and by minute in one pass over the slice."""
    cut = df.select("action", "best_label", "ip", F.floor(F.col("ts_us") / 60_000_000).alias("minute"), "final_score")
    sets = [[], ["action"], ["best_label"], ["ip"], ["minute"]]
    return cut.groupingSets([[F.col(c) for c in s] for s in sets], F.col("action"), F.col("best_label"), F.col("ip"), F.col("minute")).agg(
        F.grouping_id().cast("bigint").alias("grouping_id"), F.count(F.lit(1)).alias("cnt"),
        count_where(F.col("action") == "BLOCK").alias("blocked"), F.max("final_score").alias("max_score"))


def honeypot_metrics(df: DataFrame) -> DataFrame:
    """Totals, methods, sources, tag families and reputation hits in long form (metric, key, value).

    The narrow rows are stored: three aggregates read them, and the texts behind the tags must be judged once.
    """
    df = materialize(df.select("ip", "method", "tags", "ti_found"), "hits")
    base = df.agg(F.count(F.lit(1)).alias("total_requests"), F.countDistinct("ip").alias("unique_ips"),
                  count_where(F.col("ti_found")).alias("ti_hits"))
    totals = base.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(m).alias("value"))
        for m in ("total_requests", "unique_ips", "ti_hits")])).alias("m")).select("m.*")
    methods = df.groupBy(F.coalesce("method", F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    tags = (df.select(F.explode("tags").alias("t")).groupBy(F.split_part("t", F.lit(":"), F.lit(1)).alias("key"))
              .agg(F.count(F.lit(1)).alias("value")))
    tagged = lambda d, m: d.select(F.lit(m).alias("metric"), "key", "value")
    return totals.unionByName(tagged(methods, "by_method")).unionByName(tagged(tags, "tag_counts"))


def geo_feed(df: DataFrame, limit: int = 25) -> DataFrame:
    """Sources to draw on the map: blocked or above 0.4, newest event per source, newest sources first."""
    shown = df.where((F.col("action") == "BLOCK") | (F.col("final_score") > 0.4))
    first = shown.groupBy("ip").agg(F.max(F.struct("ts_us", "event_id", "final_score", "action", "best_label")).alias("e"))
    return first.select("ip", "e.*").orderBy(F.desc("ts_us"), F.desc("event_id")).limit(limit)


# -- profiles --------------------------------------------------------------------------------------

def class_dist(df: DataFrame, label: str) -> DataFrame:
    """Count and share per class; the share is taken over the few class rows, not the input."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "cnt", F.round(F.col("cnt") / F.col("total"), 6).alias("share"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    out = counts.agg(F.max("cnt").alias("max_class"), F.min("cnt").alias("min_class"))
    ratio = F.col("max_class") / F.col("min_class")
    return out.select("max_class", "min_class", F.round(ratio, 4).alias("ratio"),
                      F.when(ratio > 100, "high").when(ratio > 20, "moderate").otherwise("acceptable").alias("verdict"))


def feature_ranges(df: DataFrame, label: str, feats: list[str]) -> DataFrame:
    """Per class and feature: mean, sample deviation, extremes, non-null count."""
    wide = df.groupBy(label).agg(*[
        F.struct(F.avg(f"`{f}`").alias("mean"), F.stddev_samp(f"`{f}`").alias("std"), F.min(f"`{f}`").alias("min"),
                 F.max(f"`{f}`").alias("max"), F.count(f"`{f}`").alias("n")).alias(f"s{i}") for i, f in enumerate(feats)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("s")) for i, f in enumerate(feats)]))
    return wide.select(label, rows.alias("r")).select(
        label, F.col("r.feature").alias("feature"), F.round("r.s.mean", 6).alias("mean"), F.round("r.s.std", 6).alias("std"),
        F.round("r.s.min", 6).alias("min"), F.round("r.s.max", 6).alias("max"), F.col("r.s.n").alias("n"))


def rule_counters(hits: DataFrame) -> DataFrame:
    """How often and when last each rule fired."""
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("match_count"), F.max("ts_us").alias("last_matched_us"))


def rule_census(rules: DataFrame) -> DataFrame:
    s = F.col("status")
    return rules.agg(F.count(F.lit(1)).alias("total"), count_where(s == "active").alias("active"),
                     count_where(s == "rejected").alias("rejected"), F.max("created_us").alias("newest_us"))


def rules_newest_first(rules: DataFrame, status: str | None = None) -> DataFrame:
    kept = rules if status is None else rules.where(F.col("status") == status)
    return kept.orderBy(F.desc("created_us"), F.asc("rule_id"))
