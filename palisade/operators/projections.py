"""Row shaping: requests, labels, events, and the cleaning steps of flow corpora. Narrow throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.scores import clamp
from palisade.operators.rules import header
from palisade.operators.scale import ordered_scan


# -- requests --------------------------------------------------------------------------------------

def build_payload(mode: str = "classifier") -> Column:
    """Text handed to a payload model.

    ``classifier``: body, path (unless ``/``) and ``k=v`` pairs joined by spaces.
    ``anomaly``: the body, or else the path with its query string.
    """
    body, path = F.coalesce("body", F.lit("")), F.coalesce("path", F.lit(""))
    pairs = F.transform(F.map_entries("query_params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    some = F.coalesce(F.size("query_params"), F.lit(0)) > 0
    if mode == "anomaly":
        return F.when(body != "", body).when(some, F.concat(path, F.lit("?"), F.array_join(pairs, "&"))).otherwise(path)
    return F.array_join(F.array_compact(F.array(
        F.nullif(body, F.lit("")), F.when(~path.isin("", "/"), path), F.when(some, F.array_join(pairs, " ")))), " ")


def resolve_ip(proxies: list[str], peer: str = "peer_ip") -> Column:
    """Client address: forwarded headers count only when the peer is a trusted proxy."""
    forwarded = F.nullif(F.trim(F.split_part(header("x-forwarded-for"), F.lit(","), F.lit(1))), F.lit(""))
    real = F.nullif(header("x-real-ip"), F.lit(""))
    return F.when(F.col(peer).isin(proxies), F.coalesce(forwarded, real, F.col(peer))).otherwise(F.coalesce(F.col(peer), F.lit("0.0.0.0")))


def skip_paths(df: DataFrame, prefixes: list[str] | None = None, path: str = "path") -> DataFrame:
    """Drop requests whose path is never scored."""
    tests = [F.col(path).startswith(p) for p in prefixes or K.SKIP_PREFIXES]
    return df.where(~reduce(lambda a, b: a | b, tests))


def normalize_request(df: DataFrame) -> DataFrame:
    """Defaults of an incoming request."""
    empty = F.create_map().cast("map<string,string>")
    have = set(df.columns)
    take = lambda c, default: (F.coalesce(F.col(c), default) if c in have else default).alias(c)
    return df.select(*[c for c in df.columns if c not in ("headers", "body", "scores", "flags")],
                     take("headers", empty), take("body", F.lit("")), take("scores", empty), take("flags", empty))


def tag_mitigation(df: DataFrame, threat: str = "threat_type") -> DataFrame:
    t = F.coalesce(F.col(threat), F.lit(""))
    return (df.withColumn("mitigation_applied", F.lit(True))
              .withColumn("body", F.when(t == "SQL Injection", "[SANITIZED]").otherwise(F.col("body")))
              .withColumn("log_level", F.when(t == "SQL Injection", "HIGH"))
              .withColumn("sanitize_output", t == "XSS").withColumn("throttle", t == "Rate Limit Exceeded")
              .withColumn("monitor_only", ~t.isin("SQL Injection", "XSS", "Rate Limit Exceeded")))


# -- events ----------------------------------------------------------------------------------------

def best_label() -> Column:
    """First layer label that names an attack, else the block reason, else clean or unknown."""
    hit = F.filter("layer_scores", lambda s: ~F.coalesce(s["label"], F.lit("")).isin(K.BENIGN_EVENT_LABELS))
    return F.coalesce(F.get(hit, F.lit(0))["label"], F.nullif("block_reason", F.lit("")),
                      F.when(F.col("action") == "ALLOW", "clean").otherwise("unknown"))


def last_label() -> Column:
    """Last layer label that names an attack and is more than a suspicion."""
    skip = [*K.NORMAL_LABELS, "suspicious", ""]
    hit = F.filter("layer_scores", lambda s: ~F.coalesce(s["label"], F.lit("")).isin(skip))
    return F.when(F.size(hit) > 0, F.element_at(hit, -1)["label"]).otherwise("unknown")


def shape_event(df: DataFrame) -> DataFrame:
    """Event document with the scores gathered in one struct."""
    scores = F.struct("regex_conf", "app_lgbm_score", "net_lgbm_score", "deep_anomaly", F.col("final_score").alias("final_risk"))
    return df.select("request_id", "ip", "method", "path", "timestamp", "final_score", "action", F.coalesce("block_reason", F.lit("")).alias("block_reason"),
                     "short_circuited", "network_score", "latency_ms", "best_label", scores.alias("scores"), "layer_scores")


# -- flow corpora ----------------------------------------------------------------------------------

def q(name: str) -> Column:
    return F.col(f"`{name}`")


def map_columns(df: DataFrame, spellings: dict[str, list[str]]) -> DataFrame:
    """Rename to unified names; when several spellings of one column are present the first non-null wins."""
    have = {c for c in df.columns}
    used = {s for names in spellings.values() for s in names if s in have}
    made = []
    for out, names in spellings.items():
        present = [q(s) for s in names if s in have]
        if present:
            made.append(F.coalesce(*present).alias(out))
    return df.select(*[q(c) for c in df.columns if c not in used], *made)


def unified_spellings() -> dict[str, list[str]]:
    out = {u: [s] for u, s in K.UNIFIED_FEATURES.items() if s}
    for u, s in K.SECOND_SPELLINGS.items():
        out.setdefault(u, []).insert(0, s)
    return out


def ensure_features(df: DataFrame, feats: list[str] | None = None, constants: dict[str, float] | None = None) -> DataFrame:
    """Constant columns that the capture cannot deliver, and 0.0 for any other missing feature."""
    constants = constants if constants is not None else {"fwd_ttl_mean": K.IMPUTED_TTL, "bwd_ttl_mean": K.IMPUTED_TTL}
    feats = feats or list(K.UNIFIED_FEATURES)
    rest = [c for c in df.columns if c not in feats]
    cols = [F.lit(constants[f]).alias(f) if f in constants else q(f).alias(f) if f in df.columns else F.lit(0.0).alias(f) for f in feats]
    return df.select(*[q(c) for c in rest], *cols)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers where the text is one, NULL elsewhere."""
    swap = {c: F.trim(q(c).cast("string")).try_cast("double").alias(c) for c in cols}
    return df.select(*[swap.get(c, q(c)) for c in df.columns])


def finite(c: str) -> Column:
    """Not NULL, infinite or NaN (which Spark orders above every number)."""
    return F.abs(q(c)) < F.lit(float("inf"))


def nonfinite_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    swap = {c: F.when(finite(c), q(c)).alias(c) for c in cols}
    return df.select(*[swap.get(c, q(c)) for c in df.columns])


def drop_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose listed features are all finite numbers."""
    return df.where(reduce(lambda a, b: a & b, [finite(c) for c in cols]))


def clip(df: DataFrame, cols: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Clip columns; NULL stays NULL."""
    def one(c):
        e = q(c)
        if high is not None:
            e = F.least(e, F.lit(float(high)))
        if low is not None:
            e = F.greatest(e, F.lit(float(low)))
        return F.when(q(c).isNotNull(), e).alias(c)
    return df.select(*[one(c) if c in cols else q(c) for c in df.columns])


def drop_identifiers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.drop(*[c for c in (names or K.IDENTIFIER_COLUMNS) if c in df.columns])


def numeric_features(df: DataFrame) -> list[str]:
    """Feature names without identifiers and labels, in stable order."""
    return sorted(c for c in df.columns if c not in K.NON_NUMERIC_COLUMNS)


def align_features(df: DataFrame, feats: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly ``feats`` in order; matched ignoring case and ``_``/space, missing and NULL as 0, extras gone."""
    same = lambda s: s.lower().replace("_", " ")
    found = {same(c): c for c in df.columns}
    cols = [F.coalesce(q(found[same(f)]).cast("double"), F.lit(0.0)).alias(f) if same(f) in found else F.lit(0.0).alias(f) for f in feats]
    return df.select(*[q(c) for c in keep or []], *cols)


def ordinal_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct values to 0, 1, ...; the dictionary is ranked apart from the data and joined back."""
    out = df
    for c in cols:
        values = df.select(q(c).cast("string").alias("v")).where("v is not null").distinct()
        # Three leading bytes as a number never decrease along the sort order of the values.
        lead = F.conv(F.rpad(F.hex(F.substring(F.encode("v", "UTF-8"), 1, 3)), 6, "0"), 16, 10).cast("bigint")
        ranked = ordered_scan(values.withColumn("__all", F.lit(0)).withColumn("__b", lead).withColumn("__one", F.lit(1).cast("bigint")),
                              ["__all"], "__b", ["v"], running_sum={"code": "__one"})
        book = ranked.select(F.col("v").alias("__v"), (F.col("code") - 1).alias("__code"))
        out = out.join(book, q(c).cast("string") == F.col("__v"), "left").withColumn(c, F.col("__code")).drop("__v", "__code")
    return out


def clamp_scores(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(clamp(q(c)), 4).alias(c) if c in cols else q(c) for c in df.columns])


# -- set operations ------------------------------------------------------------------------------------

def union_common(dfs: list[DataFrame], label: str = "label") -> DataFrame:
    """Union over the shared columns, sorted by name, label last."""
    common = sorted(set.intersection(*[set(d.columns) for d in dfs]) - {label})
    cols = common + ([label] if all(label in d.columns for d in dfs) else [])
    return reduce(lambda a, b: a.unionByName(b), [d.select(*[q(c) for c in cols]) for d in dfs])


def dedupe_exact(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order`` as a partial aggregate (one struct per key is shuffled)."""
    rest = [c for c in df.columns if c not in key]
    m = df.groupBy(*key).agg(F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("r"))).alias("m"))
    return m.select(*key, "m.r.*").select(*df.columns)


def build_payload_corpus(honeypot: DataFrame, payloads: DataFrame, sqli: DataFrame, commands: DataFrame, xss: DataFrame) -> DataFrame:
    """Five labelled sources to (payload, attack_type, label); rows without a class are dropped."""
    from palisade.functions.labels import standardize_attack, tag_family
    flag = lambda df, text, name: df.select(q(text).alias("payload"), F.when(F.col("Label").cast("int") == 1, name).otherwise("norm").alias("attack_type"))
    h = honeypot.select(F.concat(F.col("path"), F.lit(" "), F.coalesce("query_params", F.lit(""))).alias("payload"),
                        standardize_attack(tag_family(F.col("tags"))).alias("attack_type"))
    p = payloads.select("payload", standardize_attack(F.col("attack_type")).alias("attack_type"))
    parts = [h, p, flag(sqli, "Query", "sqli"), flag(commands, "sentence", "cmdi"), flag(xss, "Sentence", "xss")]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.where(F.col("payload").isNotNull() & F.col("attack_type").isNotNull()).select("payload", "attack_type", F.col("attack_type").alias("label"))
