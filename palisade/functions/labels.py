"""Label clean-up, mapping and display."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.text import has


def standardize_attack(col: Column) -> Column:
    """Free-text attack type to a payload class; NULL for login guessing, which is dropped later."""
    s = F.lower(F.trim(col))
    return (F.when(col.isNull(), "norm")
             .when(has(s, "sql"), "sqli").when(has(s, "xss"), "xss").when(has(s, "cmd"), "cmdi")
             .when(has(s, "path", "traversal"), "path-traversal")
             .when(has(s, "auth", "bruteforce"), F.lit(None).cast("string"))
             .otherwise("norm"))


def simplify_label(col: Column, dialect: str = "flows") -> Column:
    """Flow label to its family; labels outside the dialect become NULL and are skipped."""
    s = F.lower(F.trim(col))
    out = F.when(s == "benign", "benign").when(has(s, "dos"), "ddos").when(has(s, "portscan"), "portscan")
    return out.when(s == "bot", "bot") if dialect == "ensemble" else out


def binary_label(col: Column) -> Column:
    """0 normal, 1 attack, -1 unknown."""
    s = F.lower(F.trim(col.cast("string")))
    return (F.when(s.isin(K.BENIGN_TOKENS), 0).when(s.isNull() | s.isin(K.BLANK_TOKENS), -1).otherwise(1)).cast("int")


def map_labels(col: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.element_at(table, col)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def map_multiclass(col: Column) -> Column:
    return map_labels(F.trim(col), K.SECOND_CORPUS_LABELS, "other")


def tag_family(col: Column) -> Column:
    return F.split_part(col, F.lit(":"), F.lit(1))


def repair_label(col: Column) -> Column:
    """Undo the replacement character some exports contain, then trim and lower."""
    return F.lower(F.replace(F.trim(col), F.lit("\ufffd"), F.lit("-")))


def canonical_label(col: Column) -> Column:
    """One spelling for labels that different producers write differently."""
    s = F.lower(col)
    return F.when(s == "bot", "botnet").when(s == "path_traversal", "path-traversal").otherwise(s)


def display_label(col: Column) -> Column:
    return F.when(col.isNull() | (col == ""), "").when(col == "unknown", "zero-day").otherwise(col)


def owner_tags(org: Column, isp: Column) -> Column:
    """What kind of network an address belongs to, from its owner names."""
    o, i = F.lower(F.coalesce(org, F.lit(""))), F.lower(F.coalesce(isp, F.lit("")))
    tags = F.array(
        F.when(has(o, "tor") | has(i, "tor"), F.lit("Tor Exit Node")),
        F.when(has(o, *K.VPN_WORDS) | has(i, *K.VPN_WORDS), F.lit("VPN Provider")),
        F.when(has(o, "proxy") | has(i, "proxy"), F.lit("Proxy Service")),
        F.when(has(o, *K.HOSTING_WORDS), F.lit("Hosting / Cloud")))
    return F.array_compact(tags)
