"""Similarity and scoring as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.functions.text import strip_type


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of the members as sets, case-sensitive; 0 if either side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def edge_score(cos: Column, entities: Column, keywords: Column) -> Column:
    """The blend of cosine and the Jaccard similarities of entities and keywords."""
    return config.COSINE_WEIGHT * cos + config.ENTITY_WEIGHT * entities + config.KEYWORD_WEIGHT * keywords


def priority(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in config.EDGE_PRIORITY.items() for x in kv]), kind), F.lit(0))


def classify_edge(a: Column, b: Column) -> Column:
    """Type of the edge from ``a`` to ``b`` (packed entities): that of the most telling shared name.

    Names are compared in lower case without their types; the type is the one that the last entry
    of that name has in ``a``. FAC, LOC or no shared name give 'semantic'.
    """
    named = lambda c: F.transform(F.filter(c, lambda e: F.instr(e, ":") > 0), lambda e: F.struct(F.substring_index(e, ":", 1).alias("t"), F.lower(strip_type(e)).alias("n")))
    lists = F.struct(named(a).alias("a"), F.transform(named(b), lambda e: e["n"]).alias("b"))

    def types(x: Column) -> Column:  # the lists are made once a row, not once an entry
        # entries of a whose name is shared and does not come again later in a
        last = lambda e, i: F.array_contains(x["b"], e["n"]) & ~F.exists(F.slice(x["a"], i + 2, F.size(x["a"]) + 1), lambda f: f["n"] == e["n"])
        return F.filter(F.transform(x["a"], lambda e, i: F.when(last(e, i), e["t"])), lambda t: t.isNotNull())

    shared = F.element_at(F.transform(F.array(lists), types), 1)
    out = F.lit("semantic")
    for kind in sorted(config.EDGE_PRIORITY, key=config.EDGE_PRIORITY.get):
        out = F.when(F.array_contains(shared, kind), F.lit(kind)).otherwise(out)
    return out


def keyword_boost(hints: Column, keywords: Column) -> Column:
    """1 + 0.3 x the share of hints that contain, or lie in, a keyword; 1 if either list is empty."""
    low = F.transform(keywords, lambda k: F.lower(k))
    hit = F.filter(hints, lambda h: F.exists(low, lambda k: k.contains(F.lower(F.trim(h))) | F.lower(F.trim(h)).contains(k)))
    empty = (F.coalesce(F.size(hints), F.lit(0)) < 1) | (F.coalesce(F.size(keywords), F.lit(0)) < 1)
    return F.when(empty, F.lit(1.0)).otherwise(1.0 + config.KEYWORD_BOOST * (F.size(hit) / F.size(hints)))


def lexical_score(terms: Column, text: Column, entities: Column) -> Column:
    """Term frequency over the root of the word count, plus half a point for each term in an entity."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda t: (F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)
    tf = F.aggregate(F.transform(terms, count), F.lit(0.0), lambda s, x: s + x)
    names = F.transform(entities, lambda e: F.lower(strip_type(e)))
    hits = F.aggregate(F.transform(terms, lambda t: F.size(F.filter(names, lambda n: n.contains(t)))), F.lit(0), lambda s, x: s + x)
    length = F.greatest(F.regexp_count(low, F.lit(r"[A-Za-z'-]+")), F.lit(1))
    return tf / F.sqrt(length.cast("double")) + 0.5 * hits


def hop_factor(hop: Column) -> Column:
    return F.when(hop == 2, F.lit(config.HOP2_FACTOR)).otherwise(F.lit(1.0))


def intent_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in config.INTENT_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(table, kind), F.lit(1.0))
