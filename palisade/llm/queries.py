"""Registered queries of the corpus operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, hard_negatives, html_text, language, licenses, line_dedup, mixing, near_dedup, neighbours, prefix_trie, suffix_dedup, token_counts, toxicity
from palisade.llm.common import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX_RATES = r"""
sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM sizes GROUP BY source),
weights AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS HUGEINT) AS weight FROM totals),
walk AS (SELECT *, (SELECT sum(source_size) FROM weights)
           - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weights),
level AS (SELECT CAST(arg_max(rest, share) AS DOUBLE) AS rest, CAST(max(share) AS DOUBLE) AS share FROM walk WHERE 3 * source_size * share > weight * rest),
goals AS (SELECT source, source_size, CASE WHEN 3 * source_size * share <= weight * rest THEN CAST(3 * source_size AS DOUBLE)
           ELSE level_rest * CAST(weight AS DOUBLE) / level_share END AS target
          FROM (SELECT walk.*, coalesce(level.rest, 0) AS level_rest, coalesce(level.share, 1) AS level_share FROM walk, level)),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate FROM goals)"""

MIX_COPIES = """CAST(floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|42'), 1, 13) AS BIGINT) AS DOUBLE)
 / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT)"""


@query("op3_mix_sources", f"""WITH {MIX_RATES}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * {MIX_COPIES} AS BIGINT) AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source""")
def op3_mix_sources(spark, d):
    """Words that the mix takes of every document."""
    return mixing.take(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_spelling(column: str) -> str:
    for a, b in licenses.EQUAL_SPELLINGS:
        column = f"replace({column}, '{a}', '{b}')"
    return column


PLAIN_LINES = (f"list_filter(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(lower(x)[:{licenses.START_CHARS}], {sql_text(licenses.COPYRIGHT_START)}) "
               f"OR regexp_replace(lower(x), {sql_text(licenses.SEPARATORS)}, '', 'g') = '{licenses.RESERVED}' THEN '' ELSE regexp_replace(lower(x), {sql_text(licenses.SEPARATORS)}, '', 'g') END), lambda x: x <> '')")
KNOWN_ROWS = ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in licenses.known_texts())


@query("op4_license_scan", f"""WITH known AS (SELECT sha256({sql_spelling('t')}) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, array_to_string({PLAIN_LINES}, '') AS t FROM (VALUES {KNOWN_ROWS}) v(license_id, text)) GROUP BY 1),
rows AS (SELECT doc_id, {PLAIN_LINES} AS lines FROM documents),
found AS (SELECT doc_id, license_id FROM (SELECT doc_id, unnest(lines) AS line FROM rows) JOIN known ON sha256({sql_spelling('line')}) = digest),
per AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM found GROUP BY doc_id)
SELECT doc_id, license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM rows LEFT JOIN known ON sha256({sql_spelling("array_to_string(lines, '')")}) = digest LEFT JOIN per USING (doc_id)""")
def op4_license_scan(spark, d):
    """Documents, and lines of documents, that are a known licence or notice."""
    return licenses.scan(table(spark, d, "documents"))


WORDS = r"regexp_extract_all(" + LOWERED.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op5_decontaminate", f"""WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
phrase AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[j:j + 9], ' ') AS p
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
place AS (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS p
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM doc, (SELECT DISTINCT n FROM phrase))),
found AS (SELECT doc_id, place.n, j, item_id FROM place JOIN phrase ON place.n = phrase.n AND place.p = phrase.p),
hits AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS i FROM (SELECT DISTINCT doc_id, j, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op5_decontaminate(spark, d):
    """Words of every document inside benchmark phrases."""
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op7_language_id")
def op7_language_id(spark, d):
    """Language of every document, learned from the documents that are not held out."""
    return language.identify(table(spark, d, "documents"))


@query("op8_html_text")
def op8_html_text(spark, d):
    """Main text of every page."""
    return html_text.extracted(table(spark, d, "pages"))


@query("op9_token_counts")
def op9_token_counts(spark, d):
    """Tokens of every document under the byte-level vocabulary."""
    return token_counts.token_counts(table(spark, d, "documents"))


@query("op10_line_dedup", """WITH lines AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
solid AS (SELECT * FROM lines WHERE length(line) >= 20 OR regexp_matches(line, '\\S')),
firsts AS (SELECT line, min(struct_pack(d := doc_id, a := pos)) AS place FROM solid GROUP BY line),
longs AS (SELECT * FROM firsts WHERE length(line) >= 20),
variant AS (SELECT place, line, p, md5(line[:p - 1] || line[p + 1:]) AS v FROM (SELECT place, line, unnest(range(1, length(line) + 1)) AS p FROM longs)),
whole AS (SELECT place, line, md5(line) AS v FROM longs),
substituted AS (SELECT line FROM (SELECT line, place, min(place) OVER (PARTITION BY v, p, length(line)) AS earliest FROM variant) WHERE earliest < place),
longer AS (SELECT variant.line FROM variant JOIN whole USING (v) WHERE whole.place < variant.place),
shorter AS (SELECT whole.line FROM variant JOIN whole USING (v) WHERE variant.place < whole.place),
near AS (SELECT line FROM substituted UNION SELECT line FROM longer UNION SELECT line FROM shorter),
gone AS (SELECT doc_id, pos FROM solid JOIN firsts USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR struct_pack(d := doc_id, a := pos) > firsts.place),
kept AS (SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.pos IS NULL), '') AS t
         FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(t) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)""")
def op10_line_dedup(spark, d):
    """What is left of every document without lines that repeat, or nearly repeat, an earlier one."""
    out = line_dedup.line_dedup(table(spark, d, "documents"), fold_short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_near_dedup")
def op6_near_dedup(spark, d):
    """Groups of documents that share 85 of 100 word shingles, and which document of each stays."""
    return near_dedup.near_duplicates(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, d):
    """What is left of every document without strings of 50 bytes that start in an earlier one."""
    return suffix_dedup.repeats(table(spark, d, "documents"))


@query("op2_neighbours")
def op2_neighbours(spark, d):
    """The 20 nearest vectors of every twentieth one, by inner product."""
    return neighbours.nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0)


CRC32 = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: "
         "list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))")


@query("op11_prefix_trie", f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(key := sha256(length(role) || ':' || role || text), size := CAST(strlen(text) AS BIGINT)) ORDER BY turn NULLS FIRST) AS l FROM turns GROUP BY conv_id),
seq AS (SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:h], o.l[h + 1:]) AS l
        FROM (SELECT *, CAST({CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS INTEGER) AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
step AS (SELECT conv_id, len(l) AS n, l, unnest(range(0, len(l) + 1)) AS depth FROM seq),
spot AS (SELECT conv_id, n, depth, sha256(depth || array_to_string(list_transform(l[1:depth], lambda x: x.key), '')) AS node,
              CASE WHEN depth > 0 THEN sha256((depth - 1) || array_to_string(list_transform(l[1:depth - 1], lambda x: x.key), '')) END AS above,
              CASE WHEN depth > 0 THEN l[depth].size ELSE 0 END AS size FROM step),
nodes AS (SELECT node, above, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM spot GROUP BY node, above),
kids AS (SELECT above AS node, count(*) AS n FROM nodes GROUP BY above),
pairs AS (SELECT DISTINCT top.node AS top, low.node AS low FROM spot top JOIN spot low ON top.conv_id = low.conv_id AND top.depth <= low.depth),
below AS (SELECT top AS node, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM pairs JOIN nodes ON low = nodes.node LEFT JOIN kids ON low = kids.node GROUP BY top)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(nodes.n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes up ON nodes.above = up.node""")
def op11_prefix_trie(spark, d):
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, d, "conversations"))


@query("op12_hard_negatives", """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op12_hard_negatives(spark, d):
    """Rows of another label that score just below each of an anchor's nearest rows of its own label."""
    return hard_negatives.mined(table(spark, d, "embeddings"))


@query("op13_toxicity")
def op13_toxicity(spark, d):
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))
