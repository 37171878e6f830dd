"""Per-address ordered work: rate counts, gap sessions, look-backs, blacklists, correlation, histories.

An address may own a third of all rows (a flood), so no window here is partitioned by address alone:
range windows are cut into time buckets with a copied neighbour, and unbounded look-backs chain one
summary per (address, bucket). See ``palisade.operators.scale``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.scores import multiplier, round4
from palisade.operators.scale import US, null_safe_join, ordered_scan, previous_within, sliding_sum, time_bucket, top_n, with_context


# -- rates -----------------------------------------------------------------------------------------

def sliding_count(df: DataFrame, seconds: int = K.TTL_RATE, limit: int = K.RATE_LIMIT_SLIDING, key: str = "ip",
                  ts_us: str = "t_us") -> DataFrame:
    """Requests of the address in the last ``seconds`` (older edge excluded), itself included.

    Timestamps are counted first, so a burst at one instant is a single row in the window.
    """
    per_instant = df.groupBy(key, ts_us).agg(F.count(F.lit(1)).alias("__n"))
    counted = sliding_sum(per_instant, [key], ts_us, seconds * US, "__n", "request_count").drop("__n")
    return null_safe_join(df, counted, [key, ts_us]).select(*df.columns, "request_count").withColumn("rate_limited", F.col("request_count") > limit)


def session_count(df: DataFrame, seconds: int = K.TTL_RATE, limit: int = K.RATE_LIMIT_SESSION, key: str = "ip",
                  ts_us: str = "t_us", tie: str = "event_id") -> DataFrame:
    """Position of each request since the last silence of ``seconds`` or more."""
    order = [ts_us, tie]
    prev = previous_within(df, [key], order, ts_us, seconds, [ts_us])
    marked = (prev.withColumn("__bucket", time_bucket(F.col(ts_us), seconds))
                  .withColumn("__one", F.lit(1).cast("bigint"))
                  .withColumn("__first", F.col(f"prev_{ts_us}").isNull()))
    ranked = ordered_scan(marked, [key], "__bucket", order, running_sum={"__rank": "__one"})
    ranked = ranked.withColumn("__start", F.when(F.col("__first"), F.col("__rank")))
    out = ordered_scan(ranked, [key], "__bucket", order, running_max={"__from": "__start"})
    count = F.col("__rank") - F.col("__from") + 1
    return out.select(*df.columns, count.alias("session_requests"), (count > limit).alias("rate_limited"))


# -- look-backs ------------------------------------------------------------------------------------

def asof_threat(events: DataFrame, threats: DataFrame, ttl: int = K.TTL_NETWORK_THREAT, key: str = "ip", ts_us: str = "t_us",
                tie: str = "event_id") -> DataFrame:
    """Latest threat score of the address that is younger than ``ttl`` seconds, 0.0 otherwise."""
    e = events.withColumn("__kind", F.lit(1))
    t = threats.select(key, ts_us, F.lit(0).alias("__kind"), F.struct(F.col(ts_us).alias("at"), "score", "attack_type").alias("__threat"))
    both = e.unionByName(t, allowMissingColumns=True).withColumn("__bucket", time_bucket(F.col(ts_us), ttl))
    filled = ordered_scan(both, [key], "__bucket", [ts_us, "__kind", tie], fill={"__last": "__threat"})
    fresh = F.col(ts_us) - F.col("__last.at") < ttl * US
    return filled.where(F.col("__kind") == 1).select(
        *events.columns, F.when(fresh, F.col("__last.score")).otherwise(0.0).alias("threat_score"),
        F.when(fresh, F.col("__last.attack_type")).alias("threat_type"))


FOREVER_US = 1 << 62


def block_end(expires: str = "expires_us", unblocked: str = "unblocked_us") -> Column:
    """End of a block: expiry (never when NULL) or the earlier manual lift."""
    return F.least(F.coalesce(F.col(expires), F.lit(FOREVER_US)), F.coalesce(F.col(unblocked), F.lit(FOREVER_US)))


def blacklist_join(events: DataFrame, blocks: DataFrame, key: str = "ip", ts_us: str = "t_us", tie: str = "event_id",
                   bucket_seconds: int = 60) -> DataFrame:
    """Append ``is_blacklisted``: some block of the address has begun and not ended.

    Only the furthest end among the blocks begun so far matters, so this is a running maximum and not
    an events x blocks join, which would square on an address that is blocked again and again.
    """
    b = blocks.select(key, F.col("blocked_us").alias(ts_us), F.lit(0).alias("__kind"), block_end().alias("__end"))
    both = events.withColumn("__kind", F.lit(1)).unionByName(b, allowMissingColumns=True)
    both = both.withColumn("__bucket", time_bucket(F.col(ts_us), bucket_seconds))
    done = ordered_scan(both, [key], "__bucket", [ts_us, "__kind", tie], running_max={"__until": "__end"})
    return done.where(F.col("__kind") == 1).select(
        *events.columns, F.coalesce(F.col("__until") > F.col(ts_us), F.lit(False)).alias("is_blacklisted"))


def lookup_state(events: DataFrame, blocks: DataFrame, threats: DataFrame, key: str = "ip", ts_us: str = "t_us",
                 tie: str = "event_id", ttl: int = K.TTL_NETWORK_THREAT, limit: int = K.RATE_LIMIT_SESSION,
                 silence: int = K.TTL_RATE) -> DataFrame:
    """Blacklist flag, session count and threat score of every request, from one ordered scan.

    The three inputs are united once, keyed by (address, time bucket) and scanned together.
    """
    order = [ts_us, "__kind", tie]
    counted = previous_within(events, [key], [ts_us, tie], ts_us, silence, [ts_us])
    e = counted.withColumn("__kind", F.lit(1)).withColumn("__one", F.lit(1).cast("bigint")).withColumn("__first", F.col(f"prev_{ts_us}").isNull())
    b = blocks.select(key, F.col("blocked_us").alias(ts_us), F.lit(0).alias("__kind"), block_end().alias("__end"))
    t = threats.select(key, ts_us, F.lit(0).alias("__kind"), F.struct(F.col(ts_us).alias("at"), "score", "attack_type").alias("__threat"))
    both = (e.unionByName(b, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)
             .withColumn("__bucket", time_bucket(F.col(ts_us), max(ttl, silence))))
    one = ordered_scan(both, [key], "__bucket", order, fill={"__last": "__threat"}, running_sum={"__rank": "__one"}, running_max={"__until": "__end"})
    one = one.where(F.col("__kind") == 1).withColumn("__start", F.when(F.col("__first"), F.col("__rank")))
    two = ordered_scan(one, [key], "__bucket", [ts_us, tie], running_max={"__from": "__start"})
    fresh = F.col(ts_us) - F.col("__last.at") < ttl * US
    count = F.col("__rank") - F.col("__from") + 1
    return two.select(*events.columns, F.coalesce(F.col("__until") > F.col(ts_us), F.lit(False)).alias("is_blacklisted"),
                      count.alias("session_requests"), (count > limit).alias("rate_limited"),
                      F.when(fresh, F.col("__last.score")).otherwise(0.0).alias("threat_score"))


# -- correlation -----------------------------------------------------------------------------------

def trailing_sets(df: DataFrame, seconds: int = K.CORRELATION_WINDOW, key: str = "ip", ts_us: str = "t_us") -> DataFrame:
    """Layers, distinct attack types and event count of the address in the last ``seconds`` (edge included).

    Time is cut into buckets of ``seconds``. A name is in the set of an event when it was seen in the event's bucket by
    then, or late enough in the bucket before; so one first and one last time per (address, bucket, name) tell all, for
    any number of names, and no window is read again for each event.
    """
    span = seconds * US
    attack = F.when(~F.coalesce(F.col("type"), F.lit("")).isin(K.BENIGN_CORRELATION_TYPES), F.col("type"))
    place = F.nullif(F.col("layer"), F.lit(""))
    rows = df.withColumn("__b", F.floor(F.col(ts_us) / F.lit(span)))
    names = F.explode(F.array(F.struct(F.lit("t").alias("kind"), attack.alias("name")), F.struct(F.lit("l").alias("kind"), place.alias("name"))))
    named = rows.select(key, "__b", ts_us, names.alias("x")).select(key, "__b", ts_us, "x.kind", "x.name").where("name is not null")
    times = named.groupBy(key, "__b", "kind", "name").agg(F.min(ts_us).alias("first"), F.max(ts_us).alias("last"))
    both = times.select(key, "__b", "kind", "name", "first", F.lit(None).cast("bigint").alias("before")).unionByName(
        times.select(key, (F.col("__b") + 1).alias("__b"), "kind", "name", F.lit(None).cast("bigint").alias("first"), F.col("last").alias("before")))
    known = both.groupBy(key, "__b", "kind", "name").agg(F.min("first").alias("first"), F.max("before").alias("before"))
    # The names an address has in one bucket: what a set of the result may hold.
    listed = known.groupBy(key, "__b").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "first", "before"))).alias("__names"))
    instants = df.groupBy(key, ts_us).agg(F.count(F.lit(1)).alias("__n"))
    counted = sliding_sum(instants, [key], ts_us, span + 1, "__n", "history_count").select(key, ts_us, "history_count")
    joined = null_safe_join(null_safe_join(rows, counted, [key, ts_us]), listed, [key, "__b"], "left")
    seen = lambda kind: F.transform(F.filter("__names", lambda x: (x["kind"] == kind) & ((x["first"] <= F.col(ts_us)) | (x["before"] >= F.col(ts_us) - span))), lambda x: x["name"])
    none = F.array().cast("array<string>")
    return joined.select(*df.columns, F.coalesce(seen("l"), none).alias("layers_seen"), F.coalesce(seen("t"), none).alias("types_seen"), "history_count")


def trailing_sets_capped(df: DataFrame, seconds: int = K.CORRELATION_WINDOW, cap: int = K.CORRELATION_HISTORY_CAP,
                         key: str = "ip", ts_us: str = "t_us", tie: str = "event_id") -> DataFrame:
    """The same when the store keeps only the newest ``cap`` events of an address (its own size limit)."""
    w = Window.partitionBy(key, "__bucket").orderBy(ts_us, tie).rowsBetween(-(cap - 1), 0)
    seen = F.collect_list(F.struct(F.col(ts_us).alias("t"), "layer", "type")).over(w)
    out = with_context(df, ts_us, seconds).withColumn("__seen", seen).where(~F.col("__context"))
    recent = F.filter("__seen", lambda s: s["t"] >= F.col(ts_us) - seconds * US)
    out = out.withColumn("__seen", recent)
    types = F.filter(F.transform("__seen", lambda s: s["type"]), lambda t: ~F.coalesce(t, F.lit("")).isin(K.BENIGN_CORRELATION_TYPES))
    layers = F.filter(F.transform("__seen", lambda s: s["layer"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return out.select(*df.columns, F.array_sort(F.array_distinct(layers)).alias("layers_seen"),
                      F.array_sort(F.array_distinct(types)).alias("types_seen"), F.size("__seen").cast("bigint").alias("history_count"))


def amplify(df: DataFrame, score: str = "score") -> DataFrame:
    """Both layers in the window raise the score by the number of distinct attack types, up to 1."""
    both = F.array_contains("layers_seen", "network") & F.array_contains("layers_seen", "application")
    n = F.greatest(F.size("types_seen"), F.lit(1))
    out = df.withColumn("correlated", both).withColumn("distinct_types", n)
    out = out.withColumn("multiplier", F.when(F.col("correlated"), multiplier(F.col("distinct_types"))).otherwise(1.0))
    return out.withColumn("amplified_score", round4(F.least(F.col(score) * F.col("multiplier"), F.lit(1.0))))


def correlate(df: DataFrame, seconds: int = K.CORRELATION_WINDOW, cap: int | None = None, key: str = "ip", ts_us: str = "t_us",
              score: str = "score") -> DataFrame:
    sets = trailing_sets(df, seconds, key, ts_us) if cap is None else trailing_sets_capped(df, seconds, cap, key, ts_us)
    return amplify(sets, score)


def history(df: DataFrame, as_of_us: int, seconds: int = K.CORRELATION_RETENTION, ip: str | None = None, ts_us: str = "t_us") -> DataFrame:
    """Events of the last ``seconds`` up to ``as_of_us``, oldest first; of one address when given."""
    out = df.where((F.col(ts_us) >= as_of_us - seconds * US) & (F.col(ts_us) <= as_of_us))
    if ip is not None:
        out = out.where(F.col("ip") == ip)
    return out.orderBy("ip", ts_us)


# -- gaps, sequences, histories ----------------------------------------------------------------------

def gaps(df: DataFrame, key: str = "remote_ip", ts_us: str = "t_us", tie: str = "packet_id", timeout: int = K.FLOW_IDLE_SECONDS) -> DataFrame:
    """Gap to the previous packet of the same peer within ``timeout`` and, above one second, the idle time."""
    out = previous_within(df, [key], [ts_us, tie], ts_us, timeout, [ts_us])
    gap = F.col(ts_us) - F.col(f"prev_{ts_us}")
    return out.select(*df.columns, gap.alias("gap_us"), F.when(gap > K.IDLE_GAP_SECONDS * US, gap).alias("idle_us"))


def newest_n(df: DataFrame, key: list[str], n: int, ts_us: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Newest ``n`` rows per key (a bounded history)."""
    return top_n(df, key, [F.desc(ts_us), F.desc(tie)], n, [tie])


def newest_buffer(df: DataFrame, n: int = K.NEWEST_EVENTS_CAP, ts_us: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """The newest ``n`` rows overall, as the bounded event list keeps them."""
    return df.orderBy(F.desc(ts_us), F.desc(tie)).limit(n)


def first_per_key(df: DataFrame, key: list[str], ts_us: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """First row per key as a partial aggregate."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.min(F.struct(F.col(ts_us).alias("a"), F.col(tie).alias("b"), F.struct(*rest).alias("r"))).alias("m"))
              .select(*key, "m.r.*").select(*df.columns))


def sequences(df: DataFrame, key: list[str], ts_us: str, tie: str, features: list[str], length: int = 10,
              bucket_seconds: int = 60, block: int = 4096) -> DataFrame:
    """Every run of ``length`` consecutive rows of a key as an array of feature arrays.

    Rows get their position from a bucketed count; windows then run over blocks of positions, each
    with the ``length - 1`` rows before it copied in, so one long series spreads over many tasks.
    """
    vec = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    slim = df.select(*key, ts_us, tie, vec.alias("__v")).withColumn("__bucket", time_bucket(F.col(ts_us), bucket_seconds))
    slim = slim.withColumn("__one", F.lit(1).cast("bigint"))
    pos = ordered_scan(slim, key, "__bucket", [ts_us, tie], running_sum={"__pos": "__one"}).withColumn("__p", F.col("__pos") - 1)
    own = F.floor(F.col("__p") / block)
    tail = F.pmod(F.col("__p"), F.lit(block)) >= block - (length - 1)
    copies = F.when(tail, F.array(F.struct(own.alias("b"), F.lit(False).alias("c")), F.struct((own + 1).alias("b"), F.lit(True).alias("c")))) \
              .otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("c"))))
    spread = pos.withColumn("__x", F.explode(copies)).withColumn("__block", F.col("__x.b")).withColumn("__context", F.col("__x.c"))
    w = Window.partitionBy(*key, "__block").orderBy("__p").rowsBetween(-(length - 1), 0)
    out = spread.withColumn("sequence", F.collect_list("__v").over(w))
    return out.where(~F.col("__context") & (F.col("__pos") >= length)).select(*key, ts_us, tie, F.col("__pos").alias("position"), "sequence")
