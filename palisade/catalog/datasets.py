"""Corpus cleaning, label routing, splits, balancing and hold-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalog.registry import query
from palisade.catalog.twins import lit, sql_case, sql_hash, sql_in
from palisade.operators import enrich as EN
from palisade.operators import evaluate as E
from palisade.operators import projections as PR
from palisade.operators import sampling as B
from palisade.operators import scaling as M
from palisade.sources import adapters as A

UNIFIED = list(K.UNIFIED_FEATURES)
CAPTURED = {u: s for u, s in K.UNIFIED_FEATURES.items() if s}
SPELL = {u: [s] for u, s in CAPTURED.items()}


def mapped(spark, d):
    """Captured flows under unified names, with the trimmed raw label."""
    raw = A.raw_flows(spark, d).withColumn("raw_label", F.trim("Label")).drop("Label")
    return PR.ensure_features(PR.map_columns(raw, SPELL))


MAPPED_SQL = "SELECT row_id, trim(\"Label\") AS raw_label, " + ", ".join(
    f'"{s}" AS {u}' if s else f"{K.IMPUTED_TTL}::DOUBLE AS {u}" for u, s in K.UNIFIED_FEATURES.items()) + " FROM raw_flows"


# -- cleaning ----------------------------------------------------------------------------------------

@query("p05_map_columns", "SELECT row_id, " + ", ".join(f'CASE WHEN isfinite("{s}") THEN "{s}" END AS {u}' for u, s in CAPTURED.items()) + " FROM raw_flows")
def _(spark, d):
    return PR.nonfinite_to_null(PR.map_columns(A.raw_flows(spark, d).drop("Label"), SPELL), list(CAPTURED))


_SECOND = {u: K.SECOND_SPELLINGS[u] for u in ("total_fwd_packets", "pkt_len_mean", "ack_flag_count")}


@query("p05_second_spellings", "SELECT row_id, " + ", ".join(f'coalesce("{CAPTURED[u]}", 0) AS {u}' for u in _SECOND) + " FROM raw_flows")
def _(spark, d):
    raw = A.raw_flows(spark, d).select("row_id", *[F.col(f"`{CAPTURED[u]}`") for u in _SECOND])
    both = raw.select("*", *[F.when(F.col("row_id") % 2 == 0, F.col(f"`{CAPTURED[u]}`")).alias(s) for u, s in _SECOND.items()])
    return PR.map_columns(both, {u: v for u, v in PR.unified_spellings().items() if u in _SECOND})


@query("p06_ensure_features", 'SELECT row_id, 64.0::DOUBLE AS fwd_ttl_mean, 0.0::DOUBLE AS down_up_ratio, "Flow Duration" AS flow_duration FROM raw_flows')
def _(spark, d):
    raw = A.raw_flows(spark, d).select("row_id", F.col("`Flow Duration`").alias("flow_duration"))
    return PR.ensure_features(raw, ["fwd_ttl_mean", "down_up_ratio", "flow_duration"])


@query("p07_coerce_numeric", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_totalprice END AS price, CAST(NULL AS DOUBLE) AS o_orderstatus FROM orders")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 3, "n/a").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).alias("price"))
    return PR.coerce_numeric(o, ["price", "o_orderstatus"])


@query("p08_drop_nonfinite", f"""SELECT row_id, flow_bytes_per_sec, init_win_fwd FROM ({MAPPED_SQL}) WHERE NOT isnan(flow_bytes_per_sec) AND NOT isinf(flow_bytes_per_sec)""")
def _(spark, d):
    return PR.drop_nonfinite(mapped(spark, d), UNIFIED).select("row_id", "flow_bytes_per_sec", "init_win_fwd")


@query("p09_clip", f"SELECT row_id, greatest(init_win_fwd, 0) AS init_win_fwd, least(greatest(pkt_len_mean, 0), 40.0) AS pkt_len_mean FROM ({MAPPED_SQL})")
def _(spark, d):
    df = mapped(spark, d).select("row_id", "init_win_fwd", "pkt_len_mean")
    return PR.clip(PR.clip(df, ["init_win_fwd"], low=0.0), ["pkt_len_mean"], low=0.0, high=40.0)


@query("p10_drop_identifiers", "SELECT o_totalprice AS price, o_custkey AS bytes FROM orders")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("flow_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("bytes"))
    return PR.drop_identifiers(o).select(*PR.numeric_features(PR.drop_identifiers(o)))


@query("p11_align_features", 'SELECT row_id, "Flow Duration" AS "flow duration", 0.0::DOUBLE AS "idle mean", "Init_Win_bytes_forward" AS "init win bytes_forward" FROM raw_flows')
def _(spark, d):
    return PR.align_features(A.raw_flows(spark, d), ["flow duration", "idle mean", "init win bytes_forward"], keep=["row_id"])


@query("j08_route_labels", f"""SELECT row_id, {sql_case('trim("Label")', K.KNOWN_LABELS)} AS unified_label FROM raw_flows WHERE trim("Label") IN {sql_in(list(K.KNOWN_LABELS))}""")
def _(spark, d):
    return EN.route_labels(mapped(spark, d), K.KNOWN_LABELS).select("row_id", "unified_label")


@query("j08_unrouted_labels", f"""SELECT trim("Label") AS raw_label, count(*) AS cnt FROM raw_flows WHERE trim("Label") NOT IN {sql_in(list(K.KNOWN_LABELS) + K.NOVEL_LABELS)} GROUP BY 1""")
def _(spark, d):
    return EN.unrouted_labels(mapped(spark, d), [K.KNOWN_LABELS, {n: "novel" for n in K.NOVEL_LABELS}])


_ROUTE = f"""SELECT row_id, unified_label, CASE unified_label WHEN 'benign' THEN 'benign' WHEN 'novel' THEN 'novel' ELSE 'known' END AS route FROM (
SELECT row_id, coalesce({sql_case('trim("Label")', K.KNOWN_LABELS)}, CASE WHEN trim("Label") IN {sql_in(K.NOVEL_LABELS)} THEN 'novel' END) AS unified_label FROM raw_flows) WHERE unified_label IS NOT NULL"""


@query("b11_route", _ROUTE)
def _(spark, d):
    return EN.route(mapped(spark, d)).select("row_id", "unified_label", "route")


@query("j10_holdout_split", """SELECT row_id, true_label, CASE WHEN true_label IN ('botnet') THEN 'holdout' ELSE 'seen' END AS side FROM scored""")
def _(spark, d):
    rows = A.scored(spark, d).select("row_id", "true_label")
    held, seen = EN.holdout_split(rows, rows.where("true_label = 'botnet'"), "true_label")
    return held.withColumn("side", F.lit("holdout")).unionByName(seen.withColumn("side", F.lit("seen"))).select("row_id", "true_label", "side")


# -- set operations ------------------------------------------------------------------------------------

@query("u01_union_common", "SELECT acctbal, nationkey, label FROM (SELECT c_acctbal AS acctbal, c_nationkey AS nationkey, 0 AS label FROM customer UNION ALL SELECT s_acctbal, s_nationkey, 1 FROM supplier)")
def _(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("seg"), F.lit(0).alias("label"))
    s = A.table(spark, d, "supplier").select(F.lit(1).alias("label"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return PR.union_common([c, s])


_HP = f"SELECT path || ' ' || 'page=' || q_page AS payload, CASE WHEN doc_id % 5 = 0 THEN 'SQLi:0.5' WHEN doc_id % 5 = 1 THEN 'AuthBruteforce:0.5' WHEN doc_id % 5 = 2 THEN 'PathTraversal:0.33' ELSE NULL END AS t FROM request_rows"


@query("u02_payload_corpus", f"""SELECT attack_type, label, count(*) AS n, count(DISTINCT md5(payload)) AS texts FROM (SELECT payload, attack_type, attack_type AS label FROM (
SELECT payload, CASE WHEN t IS NULL THEN 'norm' WHEN t LIKE 'SQLi%' THEN 'sqli' WHEN t LIKE 'Path%' THEN 'path-traversal' END AS attack_type FROM ({_HP})
UNION ALL SELECT payload, attack_type FROM payloads
UNION ALL SELECT text, CASE WHEN conv_id % 2 = 1 THEN 'sqli' ELSE 'norm' END FROM conversations
UNION ALL SELECT text, CASE WHEN item_id % 2 = 1 THEN 'cmdi' ELSE 'norm' END FROM benchmark
UNION ALL SELECT url, CASE WHEN page_id % 2 = 1 THEN 'xss' ELSE 'norm' END FROM pages) WHERE attack_type IS NOT NULL AND payload IS NOT NULL) GROUP BY 1, 2""")
def _(spark, d):
    n = F.col("doc_id")
    tags = F.when(n % 5 == 0, "SQLi:0.5").when(n % 5 == 1, "AuthBruteforce:0.5").when(n % 5 == 2, "PathTraversal:0.33")
    hp = A.requests(spark, d).select("path", F.concat(F.lit("page="), F.col("query_params")["page"]).alias("query_params"), tags.alias("tags"))
    c = A.table(spark, d, "conversations").select(F.col("text").alias("Query"), (F.col("conv_id") % 2).alias("Label"))
    b = A.table(spark, d, "benchmark").select(F.col("text").alias("sentence"), (F.col("item_id") % 2).alias("Label"))
    x = A.table(spark, d, "pages").select(F.col("url").alias("Sentence"), (F.col("page_id") % 2).alias("Label"))
    corpus = PR.build_payload_corpus(hp, A.payloads(spark, d).select("payload", "attack_type"), c, b, x)
    return corpus.groupBy("attack_type", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("payload")).alias("texts"))


@query("u04_dedupe_exact", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey) AS r FROM lineitem) WHERE r = 1")
def _(spark, d):
    return PR.dedupe_exact(A.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], ["l_orderkey"])


# -- splits and balancing -------------------------------------------------------------------------------

def flow_rows(spark, d):
    return A.flow_table(spark, d).select("flow_id", "src_id", "label", "day", F.when(F.col("label") == "benign", 0).otherwise(1).alias("y"))


FLOWS_SQL = "SELECT flow_id, src_id, label, \"day\", CASE WHEN label = 'benign' THEN 0 ELSE 1 END AS y FROM flow_table"
RANKED_SQL = f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('flow_id')}, flow_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM ({FLOWS_SQL})"
RANKED_Y = f"SELECT *, row_number() OVER (PARTITION BY y ORDER BY {sql_hash('flow_id')}, flow_id) AS rk, count(*) OVER (PARTITION BY y) AS n FROM ({FLOWS_SQL})"


@query("b01_stratified_split", f"SELECT flow_id, label, CASE WHEN rk <= round(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= round(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ({RANKED_SQL})")
def _(spark, d):
    return B.stratified_split(flow_rows(spark, d).select("flow_id", "label"), "label", ["flow_id"])


@query("b02_undersample", f"SELECT flow_id, label FROM ({RANKED_SQL}) WHERE label <> 'benign' OR rk <= (SELECT count(*) * 3 FROM flow_table WHERE label <> 'benign')")
def _(spark, d):
    return B.undersample(flow_rows(spark, d).select("flow_id", "label"), "label", "benign", ["flow_id"])


@query("b03_balance_down", f"SELECT flow_id, y, 0 AS \"copy\" FROM ({RANKED_Y}) WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM ({FLOWS_SQL}) GROUP BY y))")
def _(spark, d):
    return B.balance(flow_rows(spark, d).select("flow_id", "y"), "y", ["flow_id"], "downsample")


_UP = "SELECT flow_id, y, CAST(c AS INTEGER) AS \"copy\" FROM (SELECT *, unnest(generate_series(0, t // n)) AS c FROM (SELECT *, {t} AS t FROM ({r}))) WHERE c < t // n OR rk <= t % n"


@query("b03_balance_up", _UP.format(t="max(n) OVER ()", r=RANKED_Y))
def _(spark, d):
    return B.balance(flow_rows(spark, d).select("flow_id", "y"), "y", ["flow_id"], "upsample")


@query("b05_fixed_prevalence", _UP.format(t="CASE WHEN y = 0 THEN 19000 ELSE 1000 END", r=RANKED_Y))
def _(spark, d):
    return B.fixed_prevalence(flow_rows(spark, d).select("flow_id", "y"), "y", ["flow_id"], 0.95, 20_000)


@query("b06_n_per_class", f"SELECT flow_id, label FROM ({RANKED_SQL}) WHERE rk <= 200")
def _(spark, d):
    return B.n_per_class(flow_rows(spark, d).select("flow_id", "label"), "label", 200, ["flow_id"])


@query("b07_cap_rows", f"SELECT flow_id FROM (SELECT flow_id, row_number() OVER (ORDER BY {sql_hash('flow_id')}, flow_id) AS rk FROM flow_table) WHERE rk <= 5000")
def _(spark, d):
    return B.cap_rows(flow_rows(spark, d).select("flow_id"), ["flow_id"], 5000)


_RARE = """SELECT {c}, n FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*), {c}) AS r, count(*) OVER () AS k FROM {t} GROUP BY 1) WHERE r <= greatest(1, k // 4)"""


@query("t03_rarest_classes", _RARE.format(c="o_orderpriority", t="orders"))
def _(spark, d):
    return B.rarest_classes(A.table(spark, d, "orders"), "o_orderpriority")


@query("b08_holdout_types", """SELECT flow_id, label, CASE WHEN label = (SELECT label FROM flow_table WHERE label <> 'benign' GROUP BY label ORDER BY count(*), label LIMIT 1) THEN 'holdout' ELSE 'train' END AS split FROM flow_table""")
def _(spark, d):
    return B.holdout_types(flow_rows(spark, d).select("flow_id", "label"), "label")


_X = ["flow duration", "flow bytes/s", "packet length std"]
_XP = ", ".join(f'quantile_cont("{f}", 0.05) AS lo{i}, quantile_cont("{f}", 0.95) AS hi{i}' for i, f in enumerate(_X))
_XT = " OR ".join(f'"{f}" < lo{i} OR "{f}" > hi{i}' for i, f in enumerate(_X))


@query("b09_holdout_extremes", f"""WITH fl AS (SELECT *, CASE WHEN label = 'benign' THEN 0 ELSE 1 END AS y FROM flow_table), cut AS (SELECT {_XP} FROM fl WHERE y = 1),
att AS (SELECT fl.*, ({_XT}) AS ext FROM fl, cut WHERE y = 1)
SELECT flow_id, y, CASE WHEN ext THEN 'test' ELSE 'train' END AS role FROM att UNION ALL SELECT flow_id, y, 'train' FROM fl WHERE y = 0
UNION ALL SELECT flow_id, y, 'test' FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash('flow_id')}, flow_id) AS rk FROM fl WHERE y = 0) WHERE rk <= (SELECT count(*) FROM att WHERE ext)""")
def _(spark, d):
    fl = A.flow_table(spark, d).withColumn("y", F.when(F.col("label") == "benign", 0).otherwise(1))
    return B.holdout_extremes(fl.select("flow_id", "y", *_X), "y", _X, ["flow_id"]).select("flow_id", "y", "role")


@query("b10_holdout_temporal", f"""WITH fl AS (SELECT *, date_trunc('year', "day") AS p FROM ({FLOWS_SQL})), per AS (SELECT p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT p FROM fl)),
m AS (SELECT fl.*, r <= floor(k * 0.75) AS early FROM fl JOIN per ON fl.p = per.p)
SELECT flow_id, y, 'train' AS role FROM m WHERE early UNION ALL
SELECT flow_id, y, 'test' FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {sql_hash('flow_id')}, flow_id) AS rk FROM m WHERE NOT early) WHERE rk <= CASE WHEN y = 0 THEN 950 ELSE 50 END""")
def _(spark, d):
    fl = flow_rows(spark, d).withColumn("p", F.date_trunc("year", "day"))
    return B.holdout_temporal(fl.select("flow_id", "y", "p"), "y", "p", ["flow_id"], total=1000).select("flow_id", "y", "role")


@query("b12_class_weights", "SELECT label, n, round(CASE WHEN label = 'benign' THEN 0.5 ELSE 2.0 END * (sum(n) OVER ()) / (count(*) OVER () * n), 6) AS weight FROM (SELECT label, count(*) AS n FROM flow_table GROUP BY 1)")
def _(spark, d):
    return B.class_weights(flow_rows(spark, d), "label").withColumn("weight", F.round("weight", 6))


@query("b12_plain_weights", "SELECT flow_id, round((sum(1) OVER ())::DOUBLE / ((SELECT count(DISTINCT label) FROM flow_table) * count(*) OVER (PARTITION BY label)), 6) AS weight FROM flow_table")
def _(spark, d):
    return B.with_weights(flow_rows(spark, d).select("flow_id", "label"), "label", boost=False).select("flow_id", F.round("weight", 6).alias("weight"))


def _unit_sql(name: str) -> str:
    return f"(({sql_hash('flow_id', lit(name))} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


_NOISE = ", ".join(f"""round("{f}" + 3.0 * sqrt(-2.0 * ln({_unit_sql(f + '|r')})) * cos(2.0 * pi() * {_unit_sql(f + '|a')}) * s{i}, 3) AS "{f}\"""" for i, f in enumerate(_X))
_STDS = ", ".join(f'stddev_pop("{f}") + 1e-6 AS s{i}' for i, f in enumerate(_X))


@query("b13_pseudo_negatives", f"SELECT flow_id, {_NOISE} FROM flow_table, (SELECT {_STDS} FROM flow_table WHERE label = 'benign') WHERE label = 'benign'")
def _(spark, d):
    out = B.pseudo_negatives(A.flow_table(spark, d).where("label = 'benign'"), _X, ["flow_id"])
    return out.select("flow_id", *[F.round(f"`{f}`", 3).alias(f) for f in _X])


@query("b14_shuffle", f"SELECT flow_id, label FROM flow_table ORDER BY {sql_hash('flow_id')}, flow_id")
def _(spark, d):
    return B.shuffle(flow_rows(spark, d).select("flow_id", "label"), ["flow_id"])


@query("b15_contamination", "SELECT avg(y) AS ratio, greatest(0.001, least(0.499, avg(y))) AS contamination FROM scored WHERE y_true <> -1".replace("avg(y)", "avg(y_true)"))
def _(spark, d):
    return B.contamination(A.scored(spark, d), "y_true")


@query("t04_head_per_class", "SELECT flow_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY flow_id) AS r FROM flow_table) WHERE r <= 5")
def _(spark, d):
    return B.head_per_class(flow_rows(spark, d).select("flow_id", "label"), "label", 5, ["flow_id"])


@query("t05_top_confusions", """WITH w AS (SELECT true_label, pred_label, row_id FROM scored WHERE true_label <> pred_label), p AS (SELECT true_label, pred_label, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT *, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, true_label, pred_label) AS r FROM p),
s AS (SELECT true_label, pred_label, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY true_label, pred_label ORDER BY row_id) AS k FROM w) WHERE k <= 3 GROUP BY 1, 2)
SELECT t.true_label, t.pred_label, n, share, CASE WHEN r <= 5 THEN samples END AS samples FROM t JOIN s ON s.true_label = t.true_label AND s.pred_label = t.pred_label WHERE r <= 10""")
def _(spark, d):
    top = E.top_confusions(A.scored(spark, d), "true_label", "pred_label", "row_id")
    return top.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("t07_examples", """SELECT row_id, true_label, pred_label, correct, CAST(row_rank AS INTEGER) AS row_rank FROM (SELECT row_id, true_label, pred_label, pred_label = 'portscan' AS correct, row_number() OVER (PARTITION BY pred_label = 'portscan' ORDER BY row_id) AS row_rank
FROM scored WHERE true_label = 'portscan') WHERE row_rank <= CASE WHEN correct THEN 5 ELSE 3 END""")
def _(spark, d):
    return E.examples(A.scored(spark, d).select("row_id", "true_label", "pred_label"), "true_label", "pred_label", "portscan", "row_id")


# -- imputation and scaling -------------------------------------------------------------------------------

_NUM = ["flow_bytes_per_sec", "flow_pkts_per_sec", "pkt_len_std"]


def finite(spark, d, cols=None):
    return PR.drop_nonfinite(mapped(spark, d), UNIFIED).select("row_id", "raw_label", *(cols or _NUM))


FINITE_SQL = f"SELECT * FROM ({MAPPED_SQL}) WHERE NOT isnan(flow_bytes_per_sec) AND NOT isinf(flow_bytes_per_sec)"


@query("m01_impute", f"""WITH src AS (SELECT row_id, CASE WHEN NOT isnan(flow_bytes_per_sec) AND NOT isinf(flow_bytes_per_sec) THEN flow_bytes_per_sec END AS v, CASE WHEN row_id % 17 <> 0 THEN raw_label END AS l FROM ({MAPPED_SQL}))
SELECT row_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM src WHERE row_id % 4 <> 0)) AS flow_bytes_per_sec, coalesce(l, (SELECT l FROM src WHERE row_id % 4 <> 0 AND l IS NOT NULL GROUP BY l ORDER BY count(*) DESC, l LIMIT 1)) AS raw_label FROM src""")
def _(spark, d):
    df = PR.nonfinite_to_null(mapped(spark, d), ["flow_bytes_per_sec"]).select("row_id", "flow_bytes_per_sec", F.when(F.col("row_id") % 17 != 0, F.col("raw_label")).alias("raw_label"))
    train = df.where(F.col("row_id") % 4 != 0)  # medians come from the training rows, as the operator requires
    return M.impute(df, M.fit_impute(train, ["flow_bytes_per_sec"], ["raw_label"]))


@query(
    "m02_cap_upper", f"WITH f AS ({FINITE_SQL}) SELECT row_id, " + ", ".join(f"round(least({c}, (SELECT quantile_cont({c}, 0.999) FROM f)), 6) AS {c}" for c in K.RATE_FEATURES) + " FROM f")
def _(spark, d):
    out = M.cap_upper(finite(spark, d, K.RATE_FEATURES).drop("raw_label"), K.RATE_FEATURES)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in K.RATE_FEATURES])


_BEN = "raw_label = 'BENIGN'"


@query("m03_winsorize", f"WITH f AS ({FINITE_SQL}), b AS (SELECT * FROM f WHERE {_BEN}) SELECT row_id, " + ", ".join(
    f"round(greatest((SELECT quantile_cont({c}, 0.01) FROM b), least((SELECT quantile_cont({c}, 0.99) FROM b), {c})), 6) AS {c}" for c in _NUM) + " FROM f")
def _(spark, d):
    f = finite(spark, d)
    out = M.winsorize(f, M.fit_bounds(f.where(_BEN), _NUM))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _NUM])


@query("m04_standard_scale", f"WITH f AS ({FINITE_SQL}), b AS (SELECT * FROM f WHERE {_BEN}) SELECT row_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM b)) / (SELECT stddev_pop({c}) FROM b), 6) AS {c}" for c in _NUM) + " FROM f")
def _(spark, d):
    f = finite(spark, d)
    out = M.standard_scale(f, M.fit_standard(f.where(_BEN), _NUM))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _NUM])


@query("m05_minmax_scale", f"WITH f AS ({FINITE_SQL}), b AS (SELECT * FROM f WHERE {_BEN}) SELECT row_id, " + ", ".join(
    f"round(({c} - (SELECT min({c}) FROM b)) / ((SELECT max({c}) FROM b) - (SELECT min({c}) FROM b)), 6) AS {c}" for c in _NUM) + " FROM f")
def _(spark, d):
    f = finite(spark, d)
    out = M.minmax_scale(f, M.fit_minmax(f.where(_BEN), _NUM))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _NUM])
