"""Views of the tables that queries share, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.operators import graph, retrieve, signals
from chunkweave.operators.chunks import graph_chunks, published
from chunkweave.session import stage
from chunkweave.sources.tables import current_nodes, table


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return graph_chunks(table(spark, d, "chunks"), list(columns) or None)


def stored_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The clean chunks, only the asked columns, written once: searches read them several times."""
    return stage(chunks(spark, d, *columns), "chunks")


LINKED = ("vector", "entities", "keywords")
SEARCHED = ("vector", "age_range")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return current_nodes(table(spark, d, "nodes"), ["title", "type", "status"])


def export(spark: SparkSession, d: str) -> DataFrame:
    return published(table(spark, d, "nodes"))


def every_20th(rows: DataFrame) -> DataFrame:
    """A stated query set: every chunk whose number is divisible by 20 (searched against all)."""
    return rows.where((F.col("idx") % 20 == 0) & F.col("vector").isNotNull())


def candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = stored_chunks(spark, d, *LINKED)
    return stage(graph.exact_candidates(every_20th(rows), rows), "candidates")


def steps(spark: SparkSession, d: str, upto: str = "best") -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(clean chunks, queries, phases of the retrieval), with edges worked out exactly when asked for."""
    rows = stored_chunks(spark, d, "source_nid", "age_range", *LINKED, *(["text"] if upto == "best" else []))
    queries = table(spark, d, "queries")
    return rows, queries, retrieve.traverse(queries, rows, retrieve.exact_edges(rows), signals.corpus_signals(rows), upto)


# --- the same views in SQL ---------------------------------------------------------------------

NODES = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY changed_at DESC NULLS LAST) AS rn FROM nodes WHERE nid IS NOT NULL) WHERE rn = 1)"
TAGS = r"""<!--[\s\S]*?-->|<[!/?a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
EXPORT = f"""{NODES}, x AS (SELECT nid, coalesce(title, '') AS title, regexp_replace(coalesce(body, ''), '{TAGS}', '', 'g') AS body,
  coalesce(age_range, '') AS age_range, coalesce(keywords, CAST([] AS VARCHAR[])) AS keywords FROM n WHERE type = 'topic' AND status = 1)"""
CHUNKS = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY synced_at DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1),
p0 AS (SELECT *, list_transform(list_filter(coalesce(entities, []), lambda e: e.type IN ('PERSON','ORG','GPE','EVENT','NORP','FAC','LOC') AND trim(e.name) <> ''),
         lambda e: left(e.type || ':' || trim(e.name), 200)) AS p FROM r),
c1 AS (SELECT chunk_id, source_nid, TRY_CAST(regexp_extract(chunk_id, '_c_([0-9]+)$', 1) AS BIGINT) AS idx, coalesce(text, '') AS text, coalesce(age_range, '') AS age_range,
  list_transform(list_filter(coalesce(keywords, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL), lambda x: left(x, 200))[1:30] AS keywords,
  list_filter(p, lambda x, i: list_position(p, x) = i)[1:150] AS entities,
  CASE WHEN len(vector) = 64 AND list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) > 0
        AND list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) < 1e300 THEN CAST(vector AS DOUBLE[]) END AS vector FROM p0),
c AS (SELECT *, list_transform(entities, lambda e: lower(substr(e, instr(e, ':') + 1))) AS names FROM c1)"""

_BOTH = """
  CASE WHEN len(a.entities) = 0 OR len(b.entities) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.entities, b.entities)) AS DOUBLE) / len(list_distinct(list_concat(a.entities, b.entities))) END AS ent_jaccard,
  CASE WHEN len(a.keywords) = 0 OR len(b.keywords) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.keywords, b.keywords)) AS DOUBLE) / len(list_distinct(list_concat(a.keywords, b.keywords))) END AS kw_jaccard,
  list_transform(list_filter(a.entities, lambda e, i: list_contains(b.names, a.names[i]) AND NOT list_contains(a.names[i + 1:], a.names[i])), lambda e: split_part(e, ':', 1)) AS shared"""
_TYPE = """CASE WHEN list_contains(shared, 'PERSON') THEN 'PERSON' WHEN list_contains(shared, 'EVENT') THEN 'EVENT' WHEN list_contains(shared, 'NORP') THEN 'NORP'
  WHEN list_contains(shared, 'ORG') THEN 'ORG' WHEN list_contains(shared, 'GPE') THEN 'GPE' ELSE 'semantic' END"""


def candidates_sql(where: str) -> str:
    """CTEs down to ``cand``: the scored edges of the chunks that meet a condition, against all."""
    return f"""{CHUNKS},
q0 AS (SELECT * FROM c WHERE vector IS NOT NULL AND {where}),
pairs AS (SELECT q0.chunk_id AS src, c.chunk_id AS dst, round(list_cosine_similarity(q0.vector, c.vector), 9) AS cosine FROM q0 JOIN c ON c.vector IS NOT NULL AND c.chunk_id <> q0.chunk_id),
near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS ann_rank FROM pairs QUALIFY ann_rank <= 10),
both_ AS (SELECT src, dst, ann_rank, cosine, {_BOTH} FROM near JOIN c a ON a.chunk_id = src JOIN c b ON b.chunk_id = dst),
cand AS (SELECT src, dst, ann_rank, cosine, ent_jaccard, kw_jaccard, 0.60 * cosine + 0.25 * ent_jaccard + 0.15 * kw_jaccard AS score, {_TYPE} AS edge_type FROM both_)"""


SIBLINGS = f"""{CHUNKS},
cv AS (SELECT chunk_id, source_nid, idx, vector FROM c WHERE vector IS NOT NULL),
dots AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, list_inner_product(a.vector, b.vector) AS dot, list_cosine_similarity(a.vector, b.vector) AS cos
  FROM cv a JOIN cv b ON a.source_nid = b.source_nid AND a.idx + 1 = b.idx),
both_ AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, {_BOTH}
  FROM c a JOIN c b ON a.source_nid = b.source_nid AND a.idx + 1 = b.idx),
sib AS (SELECT both_.*, dot, coalesce(cos, 0.0) AS cosine, {_TYPE} AS edge_type FROM both_ LEFT JOIN dots USING (src, dst))"""

PRIORITY = "CASE edge_type WHEN 'PERSON' THEN 5 WHEN 'EVENT' THEN 4 WHEN 'NORP' THEN 3 WHEN 'ORG' THEN 2 WHEN 'GPE' THEN 1 ELSE 0 END"
SIGNALS = """sig AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS rank FROM
  (SELECT split_part(e, ':', 1) AS type, substr(e, instr(e, ':') + 1) AS name, count(*) AS n FROM (SELECT unnest(entities) AS e FROM c) GROUP BY ALL) QUALIFY rank <= 50)"""
