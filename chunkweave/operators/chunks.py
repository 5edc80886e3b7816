"""Chunks: word windows of node bodies, and the clean view of stored chunks that the graph uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.functions import text as tx
from chunkweave.sources.tables import current_chunks, current_nodes


def published(nodes: DataFrame, nid: int | None = None) -> DataFrame:
    """The export: current published topics, or with ``nid`` that one published node of any type.

    Tags are stripped; missing texts are '' and missing keywords []. Older revisions don't count.
    """
    if nid is not None:
        nodes = nodes.where(F.col("nid") == nid)
    rows = current_nodes(nodes, ["title", "body", "age_range", "keywords", "type", "status"]).where("status = 1")
    if nid is None:
        rows = rows.where("type = 'topic'")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "nid", blank("title").alias("title"), tx.strip_tags("body").alias("body"), blank("age_range").alias("age_range"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
    )


def chunk_windows(nodes: DataFrame) -> DataFrame:
    """``chunk_id, source_nid, idx, text, age_range, keywords`` of exported nodes.

    Windows of at most 10 characters are dropped; the index counts the kept windows of a node.
    The windows of one body are made by one expression, so a node is the largest unit of a task.
    """
    kept = F.filter(tx.windows("body"), lambda w: F.length(F.trim(w["text"])) > config.CHUNK_LEAST_CHARS)
    rows = nodes.select("nid", "age_range", "keywords", F.posexplode(kept).alias("idx", "w"))
    return rows.select(
        F.concat(F.lit("nid_"), F.col("nid"), F.lit("_c_"), F.col("idx")).alias("chunk_id"), F.col("nid").alias("source_nid"), "idx",
        F.col("w.text").alias("text"), "age_range", tx.cap("keywords", config.MOST_KEYWORDS, config.KEYWORD_CHARS).alias("keywords"),
    )


def packed_entities(c: str | Column) -> Column:
    """Typed entities as 'TYPE:name': known types, trimmed names, distinct by first occurrence, capped."""
    c = F.col(c) if isinstance(c, str) else c
    types = F.array(*[F.lit(t) for t in config.ENTITY_TYPES])
    fine = F.filter(F.coalesce(c, F.array().cast(c_type(c))), lambda e: F.array_contains(types, e["type"]) & (F.trim(e["name"]) != ""))
    packed = F.transform(fine, lambda e: F.substring(tx.encode_typed(e["type"], F.trim(e["name"])), 1, config.ENTITY_CHARS))
    return F.slice(F.array_distinct(packed), 1, config.MOST_ENTITIES)


def c_type(_: Column) -> str:
    return "array<struct<type:string,name:string>>"


def usable(vector: str | Column, dim: int = config.DIM) -> Column:
    """Whether a vector can be searched: the right length, no nulls, finite, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(v) == dim) & (norm > 0) & (norm < 1e300), F.lit(False))


def graph_chunks(chunks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each chunk once, clean: ``chunk_id, source_nid, idx, text, age_range, keywords, entities, vector``.

    ``entities`` are packed; ``vector`` is null where it can't be searched. Only the asked columns
    (all by default) are read from the scan and moved.
    """
    columns = columns or ["source_nid", "text", "age_range", "keywords", "entities", "vector"]
    rows = current_chunks(chunks, columns)
    made = {
        "text": F.coalesce("text", F.lit("")),
        "age_range": F.coalesce("age_range", F.lit("")),
        "keywords": tx.cap("keywords", config.MOST_KEYWORDS, config.KEYWORD_CHARS),
        "entities": packed_entities("entities"),
        "vector": F.when(usable("vector"), F.col("vector")),
        "source_nid": F.col("source_nid"),
    }
    idx = F.expr("try_cast(regexp_extract(chunk_id, '_c_([0-9]+)$', 1) as bigint)")
    return rows.select("chunk_id", idx.alias("idx"), *[made[c].alias(c) for c in columns])
