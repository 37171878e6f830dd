"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are alike when their edit distance is at most 1. Equal lines are folded first. To keep the number of
variants in proportion to the lines that have a partner at all, every distinct line first posts its head and its
tail, each of nearly half its length: one edit leaves one of them as it is. Lines that share a head or tail with
another line post the head and tail of what is beside it, and so on, ``HALVINGS`` times in all. Only what is then
left of lines that still share a key emits its deletion variants, as hashed keys. Under a key, lines that
lost a character at one place differ by one substitution, and a line that is the variant itself differs by one
insertion; so the earliest partner is a grouped minimum and no pairs are listed. The partner found is verified by
edit distance on the full texts.

A bound of 2 edits (``earlier_within_2``) is another search. Lines are screened by their thirds first (``thirds``): two
edits leave the head, the tail, or, moved by one character at most, what is between them. Two edits leave alike a half, or two quarters, of which
one may have moved by one character (``halves``). Lines under a key of such a half are compared in pairs while they
are at most ``GROUP``; larger groups are split by the halves of what is beside the shared part, until that has
at most ``SHORT`` characters, and then emit variants with up to two characters masked or deleted, under which the
earliest partner is again a grouped minimum. No pair within the bound is left out. ``op10_line_dedup`` has a bound
of 1, as its SQL twin says; the pipeline has 2.

The earliest line stays (smallest doc_id, then text hash, then position); a line is removed when an earlier like
line exists in the input, whether or not that one is removed itself. Lines of fewer than ``LEAST`` characters
are removed as exact repeats only, and only with ``fold_short`` (blank lines always stay). Lines are split at ``\\n``. Null text: no lines, stays null. Null doc_id: before all others.
Repeated rows (equal doc_id and text) count as one and are all treated alike. Empty table: empty result. Extra
columns are kept.

A group under a deletion key holds at most (length + 1) x alphabet distinct lines, so windows over it are
bounded; heads, tails and equal lines, which may be hot, are aggregated with partial sums and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stored

LEAST = 20
HALVINGS = 3
GROUP = 256
SHORT = 16
#: Parts of more characters are halved again before they emit variants, so a line of any length emits few bytes.
LONG = 512
#: Up to so many bytes of rows with candidates are broadcast to the texts; more are joined by a shuffle.
WANTED_BYTES = 64_000_000


def _cuts(line: Column) -> Column:
    """Lengths of head and tail: one that lines of n and n + 1 characters share, or both where there is none."""
    n = F.char_length(line)
    c = (F.floor(n / 16) * 8).cast("int")
    return F.when(n % 16 == 15, F.array(c, c + 8)).otherwise(F.array(c))


def ends(line: Column) -> Column:
    """(key, side, c): head (side 1) and tail (side 0) of every cut."""
    n = F.char_length(line)

    def both(c: Column) -> Column:
        head, tail = F.substr(line, F.lit(1), c), F.substr(line, n - c + 1, c)
        return F.array(F.struct(F.xxhash64(F.lit(1), c, head).alias("key"), F.lit(1).alias("side"), c.alias("c")),
                       F.struct(F.xxhash64(F.lit(0), c, tail).alias("key"), F.lit(0).alias("side"), c.alias("c")))

    return F.flatten(F.transform(_cuts(line), both))


def deletion_keys(end: Column, part: Column, size: Column) -> Column:
    """Keys of ``part``: itself (role 0), without each of its characters (1), and that with the place as well (2)."""

    def without(i: Column) -> Column:
        return F.xxhash64(end, F.concat(F.substr(part, F.lit(1), i), F.substr(part, i + 2, size)))

    left = F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)")), without)
    return F.concat(F.array(F.struct(F.xxhash64(end, part).alias("key"), F.lit(0).alias("role"))),
                    F.transform(left, lambda k: F.struct(k.alias("key"), F.lit(1).alias("role"))),
                    F.transform(left, lambda k, i: F.struct(F.xxhash64(k, i).alias("key"), F.lit(2).alias("role"))))


def _beside(rows: DataFrame, whole: Column, key: Column) -> DataFrame:
    """(place, key, part): what is beside the head or tail ``e`` of ``whole``."""
    n = F.char_length(whole)
    part = F.when(F.col("e.side") == 1, F.substr(whole, F.col("e.c") + 1, n)).otherwise(F.substr(whole, F.lit(1), n - F.col("e.c")))
    return rows.select("place", key.alias("key"), part.alias("part"))


def halves(line: Column, above: Column) -> Column:
    """(key, rest) of every half that lines within 2 edits may share, and what is beside it with a line break for each
    shared part (a line has none of its own).

    Of quarters Q1 to Q4 at the ends (and what is between them), 2 edits leave Q1 Q2 or Q3 Q4, or else lie one in each
    of these halves: then a quarter of each half stays, that next to the middle moved by one character at most.
    """
    n = F.char_length(line)

    def quarter(size: Column) -> Column:
        return (F.floor(F.greatest(size, F.lit(0)) / 8) * 2).cast("int")

    def shared(kind: int, q: Column, i: Column, m: Column, j: Column, k: Column) -> Column:
        a, b = F.substr(line, i + 1, m), F.substr(line, j + 1, k)
        rest = F.concat(F.substr(line, F.lit(1), i), F.lit("\n"), F.substr(line, i + m + 1, j - i - m), F.lit("\n"), F.substr(line, j + k + 1, n))
        return F.struct(F.xxhash64(above, F.lit(kind), q, a, b).alias("key"), rest.alias("rest"))

    def of(q: Column) -> Column:
        none = F.lit(0)
        out = [shared(0, q, none, 2 * q, n, none), shared(1, q, n - 2 * q, 2 * q, n, none), shared(2, q, none, q, n - q, q)]
        for moved in (-1, 0, 1):
            out += [shared(3, q, q + moved, q, n - q, q), shared(4, q, none, q, n - 2 * q + moved, q), shared(5, q, q + moved, 2 * q, n, none)]
        # Too short for quarters: compared with all under the key.
        return F.when(q > 0, F.array(*out)).otherwise(F.array(F.struct(F.xxhash64(above, F.lit(6)).alias("key"), line.alias("rest"))))

    # Lines whose lengths differ by up to 2 have one size of quarter in common.
    return F.flatten(F.transform(F.array_distinct(F.array(quarter(n), quarter(n - 2))), of))


def thirds(line: Column) -> Column:
    """Keys of which lines of ``LEAST`` characters or more within 2 edits share one."""
    n = F.char_length(line)

    def third(size: Column) -> Column:
        return (F.floor(size / 12) * 4).cast("int")

    def of(q: Column) -> Column:
        at = [(0, F.lit(1)), (1, n - q + 1), *((2, q + moved + 1) for moved in (-1, 0, 1))]
        return F.array(*[F.xxhash64(F.lit(kind), q, F.substr(line, start, q)) for kind, start in at])

    # Lines whose lengths differ by up to 2 have one size of third in common.
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(F.array(third(n), third(n - 2))), of)))


def variants(key: Column, rest: Column) -> Column:
    """(key, masked, deleted): ``rest`` with up to two characters masked or deleted; its line breaks stay."""
    places = F.filter(F.sequence(F.lit(1), F.char_length(rest)), lambda i: F.substr(rest, i, F.lit(1)) != "\n")
    places = F.when(rest == "", F.expr("cast(array() as array<int>)")).otherwise(places)

    def without(text: Column, i: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, F.char_length(text)))

    def row(text: Column, deleted: int, *masked: Column) -> Column:
        """A mask is a place from which a character is gone."""
        return F.struct(F.xxhash64(key, F.lit(len(masked)), text, *masked).alias("key"), F.lit(len(masked)).alias("masked"), F.lit(deleted).alias("deleted"))

    def both(i: Column, j: Column) -> Column:
        text = without(without(rest, j), i)
        return F.array(row(text, 0, i, j), row(text, 2), row(text, 1, i), row(text, 1, j - 1))

    one = F.transform(places, lambda i: F.array(row(without(rest, i), 0, i), row(without(rest, i), 1)))
    two = F.flatten(F.transform(places, lambda j: F.transform(F.filter(places, lambda i: i < j), lambda i: both(i, j))))
    return F.concat(F.array(row(rest, 0)), F.flatten(one), F.flatten(two))


def earlier_within_2(lines: DataFrame) -> DataFrame:
    """(h, g) of those ``lines`` (h, g, place, line; distinct) that have an earlier one within 2 edits."""
    posted = lines.select("h", F.explode(F.transform(halves(F.col("line"), F.lit(0)), lambda e: e["key"])).alias("key"))
    shared = posted.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    screened = posted.join(shared, "key", "left_semi").groupBy("h").agg(F.collect_set("key").alias("keys"))
    some = lines.join(screened, "h").select("place", "h", "g", "line", "keys", F.explode(halves(F.col("line"), F.lit(0))).alias("e")).where(F.array_contains("keys", F.col("e.key")))
    rows = stored(some.select("place", "h", "g", "line", "e.key", "e.rest").dropDuplicates(["key", "h", "g"]), "halves")
    found = None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("rest")).alias("longest")).where("n > 1")
        sized = rows.join(sizes, "key")
        few = sized.where(F.col("n") <= GROUP)
        other = few.select("key", F.col("place").alias("before"), F.col("line").alias("other"))
        pairs = few.join(other, "key").where((F.col("before") < F.col("place")) & (F.levenshtein("line", "other", 2) >= 0)).select("h", "g")
        emitted = sized.where((F.col("n") > GROUP) & (F.col("longest") <= SHORT)).select("place", "h", "g", F.explode(variants(F.col("key"), F.col("rest"))).alias("v"))
        under = Window.partitionBy("v.key")
        first = [F.min(F.when(F.col("v.deleted") == d, F.col("place"))).over(under) for d in range(3)]
        free = 2 - F.col("v.masked") - F.col("v.deleted")
        partner = F.when(free == 0, first[0]).when(free == 1, F.least(*first[:2])).otherwise(F.least(*first))
        masked = emitted.select("h", "g", (partner < F.col("place")).alias("near")).where("near").select("h", "g")
        new = stored(pairs.unionByName(masked).distinct(), "near")
        found = new if found is None else found.unionByName(new)
        deeper = sized.where((F.col("n") > GROUP) & (F.col("longest") > SHORT)).select("place", "h", "g", "line", F.explode(halves(F.col("rest"), F.col("key"))).alias("e"))
        rows = stored(deeper.select("place", "h", "g", "line", "e.key", "e.rest").dropDuplicates(["key", "h", "g"]), "halves")
        if not rows.limit(1).count():
            return found.distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text").alias("k2"))


def removed_lines(docs: DataFrame, least: int = LEAST, bound: int = 1, fold_short: bool = False) -> DataFrame:
    """(k1, k2, drop): the keys of a row and the sorted positions (from 0) of its lines to remove; lines within ``bound``
    (1 or 2) edits are alike. ``fold_short``: exact repeats of shorter lines that are not blank go as well."""
    if bound not in (1, 2):
        raise ValueError("the bound is 1 or 2 edits")
    base = _keyed(docs)
    lines = base.select("doc_id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    long = F.char_length("line") >= least
    lines = lines.where(long | F.col("line").rlike(r"\S") if fold_short else long)
    place = F.struct("doc_id", "k1", "k2", "at")
    named = lines.select(place.alias("place"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line")
    keys = thirds(F.col("line")) if bound == 2 else F.array_distinct(F.transform(ends(F.col("line")), lambda e: e["key"]))
    once = named.select("place", "h", "g", F.char_length("line").alias("n"), F.when(long, keys).alias("ends")).groupBy("h", "g")
    once = once.agg(F.min("place").alias("first"), F.max("place").alias("last"), F.any_value("ends").alias("ends"), F.any_value("n").alias("n"))
    distinct = stored(once.select("h", "g", "first", (F.col("first") != F.col("last")).alias("several"), "ends", "n"), "lines")

    posted = distinct.select("h", F.explode("ends").alias("key"))
    shared = posted.groupBy("key").count().where("count > 1").select("key")  # lines and their keys are distinct
    screened = posted.join(shared, "key", "left_semi").groupBy("h").agg(F.collect_set("key").alias("keys"))  # a few keys a line
    wanted = (distinct.select("h", "g", "first").join(screened, "h").select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.struct(F.col("first.at").alias("at"), "h", "g", "keys").alias("w"))
              .groupBy("k1", "k2").agg(F.collect_list("w").alias("ws")))
    if bound == 2:  # few rows have a candidate: where their keys are small, the texts stay where they are
        wanted = stored(wanted, "wanted")
        rows, some_lines = wanted.agg(F.count(F.lit(1)), F.sum(F.size("ws"))).first()
        wanted = F.broadcast(wanted) if 64 * rows + 128 * (some_lines or 0) <= WANTED_BYTES else wanted
    some = base.join(wanted, ["k1", "k2"]).select("doc_id", "k1", "k2", F.split("text", "\n").alias("lines"), F.explode("ws").alias("w"))
    some = some.select(F.struct("doc_id", "k1", "k2", F.col("w.at").alias("at")).alias("place"), F.col("w.h").alias("h"), F.col("w.g").alias("g"), F.col("w.keys").alias("keys"), F.get("lines", F.col("w.at")).alias("line"))

    if bound == 2:
        near = earlier_within_2(some.select("h", "g", "place", "line"))
        return _positions(named, distinct, distinct.join(near, ["h", "g"], "left_semi").select("h", "g", "first", F.lit(True).alias("near")))

    # Exploding first makes the parts columns: inside a lambda they would be cut again for every variant.
    first = some.select("place", "line", F.explode(F.filter(ends(F.col("line")), lambda e: F.array_contains("keys", e["key"]))).alias("e"))
    parts, done = _beside(first, F.col("line"), F.col("e.key")), None
    longest, rounds = distinct.agg(F.max("n")).first()[0] or 0, HALVINGS - 1
    while longest >> rounds + 1 > LONG:
        rounds += 1
    for step in range(rounds):
        if step >= HALVINGS - 1:
            short = parts.where(F.char_length("part") <= LONG)
            done, parts = short if done is None else done.unionByName(short), parts.where(F.char_length("part") > LONG)
        deeper = parts.select("place", "key", "part", F.explode(ends(F.col("part"))).alias("e"))
        deeper = _beside(deeper, F.col("part"), F.xxhash64("key", "e.key"))
        # With doc_id, which the other side needs as well: both sides then read one exchange of the texts.
        doc = F.col("place.doc_id")
        again = deeper.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("a"), F.max(doc).alias("b")).where("n > 1 or a <> b").select("key")
        parts = deeper.join(again, "key", "left_semi")
        if step >= HALVINGS - 1:
            parts = stored(parts, "parts")
    parts = parts if done is None else done.unionByName(parts)
    emitted = parts.select("place", F.explode(deletion_keys(F.col("key"), F.col("part"), F.char_length("part"))).alias("v")).select("place", "v.key", "v.role")
    under = Window.partitionBy("key")
    whole, deleted, same = (F.min(F.when(F.col("role") == r, F.col("place"))).over(under) for r in (0, 1, 2))
    partner = F.when(F.col("role") == 0, deleted).when(F.col("role") == 1, whole).otherwise(same)
    near = emitted.withColumn("partner", partner).where(F.col("partner") < F.col("place")).groupBy("place").agg(F.min("partner").alias("partner"))
    needed = near.select("place").unionByName(near.select(F.col("partner").alias("place"))).distinct()
    texts = some.select("place", "h", "g", "line").join(needed, "place")
    pairs = near.join(texts, "place").join(texts.select(F.col("place").alias("partner"), F.col("line").alias("other")), "partner")
    alike = pairs.where(F.levenshtein("line", "other", 1) >= 0).select("h", "g", F.col("place").alias("first"), F.lit(True).alias("near"))

    return _positions(named, distinct, alike)


def _positions(named: DataFrame, distinct: DataFrame, alike: DataFrame) -> DataFrame:
    status = distinct.where("several").select("h", "g", "first", F.lit(False).alias("near")).unionByName(alike)
    gone = named.select("h", "g", "place").join(status, ["h", "g"]).where(F.col("near") | (F.col("place") > F.col("first")))
    return gone.groupBy(F.col("place.k1").alias("k1"), F.col("place.k2").alias("k2")).agg(F.sort_array(F.collect_set("place.at")).alias("drop"))


def kept_lines(lines: Column, drop: Column) -> Column:
    """The lines at positions other than ``drop`` (sorted): what lies between the removed ones.

    ``lines`` should be a column: as an expression it would be computed again for every piece.
    """
    edges = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size(drop) + 1), lambda i: F.slice(lines, F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1))
    return F.flatten(between)


def line_dedup(docs: DataFrame, least: int = LEAST, bound: int = 1, fold_short: bool = False) -> DataFrame:
    """Per row: doc_id, text without the removed lines, n_lines, n_removed."""
    drop = removed_lines(docs, least, bound, fold_short)
    joined = _keyed(docs).join(drop, ["k1", "k2"], "left")
    joined = joined.withColumn("__lines", F.when(F.col("drop").isNotNull(), F.split("text", "\n")))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(F.col("__lines"), F.col("drop")), "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc_id", "k1", "k2", text.alias("text"), F.coalesce(n_lines, F.lit(0)).cast("bigint").alias("n_lines"),
                         F.coalesce(F.when(F.col("drop").isNotNull(), F.size("drop")), F.lit(0)).cast("bigint").alias("n_removed"))


def deduplicated(docs: DataFrame, least: int = LEAST, bound: int = 1, fold_short: bool = False) -> DataFrame:
    """``docs`` with the text that is left and n_chars, where there is one, to match; rows of which every line was
    removed are repeats as a whole and go."""
    names = docs.columns
    drop = removed_lines(docs, least, bound, fold_short).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "drop": "__drop"})
    keyed = docs.withColumn("__a", F.xxhash64("doc_id", "text")).withColumn("__b", F.hash("text"))
    joined = keyed.join(drop, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    joined = joined.where(F.col("__drop").isNull() | (F.size("__drop") < n_lines))
    joined = joined.withColumn("__lines", F.when(F.col("__drop").isNotNull(), F.split("text", "\n")))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(F.col("__lines"), F.col("__drop")), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in names])
