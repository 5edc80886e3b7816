"""Queries of the retrieval, phase by phase, for the whole table of queries.

The edges are worked out when asked for, exactly, at the fixed threshold, so that every phase can be
checked; ``retrieve_built`` runs on the graph that the index builds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.functions import scoring as sc
from chunkweave.operators import graph, intent, retrieve, signals
from chunkweave.plans import views as v
from chunkweave.plans.corpus_queries import WEIGHTS
from chunkweave.plans.text_queries import TOKENS
from chunkweave.sources.tables import table


def _pos(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


def seed_search(s, d):
    found = retrieve.seeds(table(s, d, "queries"), v.stored_chunks(s, d, *v.SEARCHED))
    return _pos(found).withColumn("cosine", F.round("cosine", 6))


def retrieve_errors(s, d):
    q = table(s, d, "queries")
    return retrieve.status(q, retrieve.seeds(q, v.stored_chunks(s, d, *v.SEARCHED)))


def hop1_expand(s, d):
    return v.steps(s, d, "hop1")[2]["hop1"]


def topk_hop1_expand(s, d):
    return _pos(v.steps(s, d, "start")[2]["start"].select("query_id", "chunk_id", F.round("dot", 6).alias("dot"), "rank"))


def hop2_expand(s, d):
    return v.steps(s, d, "hop2")[2]["hop2"]


def rerank_vector(s, d):
    return _pos(v.steps(s, d)[2]["best"].select("query_id", "chunk_id", "edge_type", "hop", F.round("score", 6).alias("score"), "rank"))


def rerank_lexical(s, d):
    """Hop-1 candidates scored by words, as rows without a usable vector are."""
    rows, q, x = v.steps(s, d)
    best = retrieve.rerank(x["hop1"].withColumn("hop", F.lit(1)), retrieve.answerable(q), rows, x["weights"], lexical=True)
    return _pos(best.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"))


def rerank_mixed(s, d):
    """The two chunks before and after each seed, with and without a usable vector: vector rows first, then the others by words."""
    rows, q = v.stored_chunks(s, d), table(s, d, "queries")
    found = retrieve.seeds(q, rows).join(rows.select("chunk_id", "source_nid", "idx"), "chunk_id")
    near = F.explode(F.array(*[F.lit(i) for i in (-2, -1, 1, 2)]))
    asked = found.select("query_id", "source_nid", "idx", near.alias("o")).select("query_id", "source_nid", (F.col("idx") + F.col("o")).alias("idx"))
    beside = asked.join(rows.select("source_nid", "idx", "chunk_id"), ["source_nid", "idx"]).select("query_id", "chunk_id").distinct()
    beside = beside.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    candidates = beside.select("query_id", "chunk_id", F.lit("semantic").alias("edge_type"), F.lit(1).alias("hop"))
    best = retrieve.rerank(candidates, retrieve.answerable(q), rows, intent.weights(q, signals.corpus_signals(rows)))
    return _pos(best.select("query_id", "chunk_id", "has_vector", F.round("score", 6).alias("score"), "rank"))


def keyword_boost(s, d):
    rows, q = v.stored_chunks(s, d, "keywords", *v.SEARCHED), table(s, d, "queries")
    both = retrieve.seeds(q, rows).join(rows.select("chunk_id", "keywords"), "chunk_id").join(q.select("query_id", "keyword_hints"), "query_id")
    return both.select("query_id", "chunk_id", F.round(sc.keyword_boost(F.col("keyword_hints"), F.col("keywords")), 6).alias("boost"))


def first_per_nid(s, d):
    rows, _, x = v.steps(s, d)
    docs = retrieve.documents(retrieve.merged(x["seeds"], x["best"]), rows, v.nodes(s, d))
    return docs.select("query_id", F.col("pos").cast("long").alias("pos"), "nid", "chunk_id", "title")


def entity_freq(s, d):
    rows, _, x = v.steps(s, d)
    return _pos(retrieve.entity_frequency(retrieve.merged(x["seeds"], x["best"]), rows))


def expand_entity_pages(s, d):
    rows, _, x = v.steps(s, d)
    merged, nodes = retrieve.merged(x["seeds"], x["best"]), v.nodes(s, d)
    docs = retrieve.documents(merged, rows, nodes)
    pages = retrieve.entity_pages(retrieve.entity_frequency(merged, rows), docs, rows, nodes.where("type = 'topic' and status = 1"))
    return pages.select("query_id", F.col("pos").cast("long").alias("pos"), "nid", "chunk_id", "title")


def _flat(df):
    return df.select(
        "query_id", F.col("result_count").cast("long").alias("result_count"), F.array_join(F.transform("results", lambda r: r["nid"].cast("string")), ",").alias("nids"),
        F.array_join(F.transform("results", lambda r: r["title"]), "|").alias("titles"), F.array_join("all_entities", "|").alias("all_entities"),
    )


def retrieve_(s, d):
    rows = v.stored_chunks(s, d)
    return _flat(retrieve.retrieve(table(s, d, "queries"), rows, v.nodes(s, d), retrieve.exact_edges(rows), signals.corpus_signals(rows)))


def retrieve_built(s, d):
    """The whole retrieval on the graph built by the index and pruned at the corpus percentile."""
    rows = v.stored_chunks(s, d)
    edges = v.stage(graph.build(rows).select("src", "dst", "edge_type"), "edges")
    return _flat(retrieve.retrieve(table(s, d, "queries"), rows, v.nodes(s, d), retrieve.stored_edges(edges), signals.corpus_signals(rows)))


QUERIES = {
    "seed_search": seed_search, "retrieve_errors": retrieve_errors, "hop1_expand": hop1_expand, "topk_hop1_expand": topk_hop1_expand, "hop2_expand": hop2_expand,
    "rerank_vector": rerank_vector, "rerank_lexical": rerank_lexical, "rerank_mixed": rerank_mixed, "keyword_boost": keyword_boost, "first_per_nid": first_per_nid, "entity_freq": entity_freq,
    "expand_entity_pages": expand_entity_pages, "retrieve": retrieve_, "retrieve_built": retrieve_built,
}

_SEEDS = """qv AS (SELECT query_id, text, CAST(vector AS DOUBLE[]) AS qv, CASE WHEN age_range IS NOT NULL AND age_range NOT IN ('', 'All') THEN age_range END AS age,
    coalesce(keyword_hints, CAST([] AS VARCHAR[])) AS hints FROM queries WHERE len(vector) = 64 AND list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) > 0),
  cvec AS (SELECT * FROM c WHERE vector IS NOT NULL),
  sc AS (SELECT query_id, chunk_id, round(list_cosine_similarity(qv, vector), 9) AS cosine FROM qv JOIN cvec ON age IS NULL OR age_range = age),
  seeds AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5)"""
_EDGES = v.candidates_sql("true")
_HOPS = f"""{_EDGES}, e AS (SELECT src, dst, edge_type FROM cand WHERE score >= 0.55), {_SEEDS},
  h1 AS (SELECT query_id, dst AS chunk_id, edge_type FROM seeds JOIN e ON e.src = seeds.chunk_id WHERE NOT EXISTS (SELECT 1 FROM seeds s2 WHERE s2.query_id = seeds.query_id AND s2.chunk_id = e.dst)
    QUALIFY row_number() OVER (PARTITION BY query_id, dst ORDER BY {v.PRIORITY} DESC, edge_type DESC) = 1),
  st AS (SELECT query_id, chunk_id, list_inner_product(qv, vector) AS dot, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(qv, vector), 9) DESC, chunk_id) AS rank
    FROM h1 JOIN cvec USING (chunk_id) JOIN qv USING (query_id) QUALIFY rank <= 10),
  seen AS (SELECT query_id, chunk_id FROM seeds UNION SELECT query_id, chunk_id FROM h1),
  h2 AS (SELECT st.query_id, dst AS chunk_id, edge_type FROM st JOIN e ON e.src = st.chunk_id WHERE NOT EXISTS (SELECT 1 FROM seen s2 WHERE s2.query_id = st.query_id AND s2.chunk_id = e.dst)
    QUALIFY row_number() OVER (PARTITION BY st.query_id, dst ORDER BY {v.PRIORITY} DESC, edge_type DESC) = 1)"""
_BOOST = """CASE WHEN len(hints) = 0 OR len({k}) = 0 THEN 1.0 ELSE 1.0 + 0.3 * (CAST(len(list_filter(hints, lambda h: len(list_filter({k}, lambda y: contains(lower(y), lower(trim(h))) OR contains(lower(trim(h)), lower(y)))) > 0)) AS DOUBLE) / len(hints)) END"""
_BEST = f"""{_HOPS}, {v.SIGNALS}, {WEIGHTS},
  ca AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 AS hop FROM h2),
  ra AS (SELECT ca.query_id, ca.chunk_id, ca.edge_type, hop, list_inner_product(qv, vector) * coalesce(weight, 1.0) * CASE WHEN hop = 2 THEN 0.75 ELSE 1.0 END
      * CASE WHEN hop = 2 THEN 1.0 ELSE {_BOOST.format(k='keywords')} END AS score
    FROM ca JOIN cvec USING (chunk_id) JOIN qv USING (query_id) LEFT JOIN wt ON wt.query_id = ca.query_id AND wt.type = ca.edge_type),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ra QUALIFY rank <= 25)"""
_DOCS = f"""{_BEST}, mg AS (SELECT query_id, chunk_id, rank AS pos FROM seeds UNION ALL SELECT query_id, chunk_id, rank + 5 FROM best), {v.NODES},
  docs AS (SELECT query_id, pos, source_nid AS nid, mg.chunk_id, coalesce(title, '') AS title, entities FROM mg JOIN c USING (chunk_id) LEFT JOIN n ON n.nid = c.source_nid
    QUALIFY row_number() OVER (PARTITION BY query_id, source_nid ORDER BY pos) = 1)"""
_FREQ = f"""{_DOCS}, en AS (SELECT query_id, pos, unnest(range(0, len(entities))) AS i, unnest(entities) AS e FROM mg JOIN c USING (chunk_id)),
  et AS (SELECT query_id, pos, i, split_part(e, ':', 1) AS edge_type, substr(e, instr(e, ':') + 1) AS name FROM en),
  tp AS (SELECT query_id, name, edge_type AS type FROM et QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY {v.PRIORITY} DESC, edge_type DESC) = 1),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS rank FROM (SELECT query_id, name, count(*) AS n, min(pos * 1000 + i) AS first FROM et GROUP BY ALL) QUALIFY rank <= 15)"""
_PAGES = f"""{_FREQ}, pg AS (SELECT title AS name, min(nid) AS nid FROM n WHERE type = 'topic' AND status = 1 AND title <> '' GROUP BY 1),
  pf AS (SELECT query_id, nid, min_by(name, rank) AS name, min(rank) AS rank FROM fr JOIN pg USING (name) WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.query_id = fr.query_id AND docs.nid = pg.nid) GROUP BY ALL),
  fc AS (SELECT source_nid AS nid, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY source_nid ORDER BY idx NULLS LAST, chunk_id) = 1),
  pages AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) + 30 AS pos, pf.nid, fc.chunk_id, name AS title, entities FROM pf JOIN fc USING (nid) JOIN c USING (chunk_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5)"""
_ALL = f"""{_PAGES}, rs AS (SELECT * FROM docs UNION ALL SELECT * FROM pages),
  en2 AS (SELECT query_id, pos, unnest(range(0, len(entities))) AS i, unnest(entities) AS e FROM rs),
  nm AS (SELECT query_id, substr(e, instr(e, ':') + 1) AS name, min(pos * 1000 + i) AS first FROM en2 GROUP BY 1, 2),
  nm2 AS (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) <= 30),
  al AS (SELECT query_id, string_agg(name, '|' ORDER BY first) AS all_entities FROM nm2 GROUP BY 1)"""
_LEX = f"""{_HOPS}, {v.SIGNALS}, {WEIGHTS},
  qt AS (SELECT query_id, {TOKENS.format('text')} AS terms, hints FROM qv),
  lx AS (SELECT h1.query_id, h1.chunk_id, edge_type, lower(text) AS low, names, keywords, terms, hints FROM h1 JOIN c USING (chunk_id) JOIN qt USING (query_id)),
  ls AS (SELECT lx.query_id, chunk_id, CASE WHEN len(terms) = 0 THEN 0.0 ELSE
      coalesce(list_sum(list_transform(terms, lambda t: CAST(length(low) - length(replace(low, t, '')) AS DOUBLE) / length(t))), 0)
        / sqrt(CAST(greatest(len(regexp_extract_all(low, '[A-Za-z''-]+')), 1) AS DOUBLE))
      + 0.5 * coalesce(list_sum(list_transform(terms, lambda t: len(list_filter(names, lambda n: contains(n, t))))), 0) END
      * coalesce(weight, 1.0) * {_BOOST.format(k='keywords')} AS score FROM lx LEFT JOIN wt ON wt.query_id = lx.query_id AND wt.type = lx.edge_type)"""
_WORDS = """CASE WHEN len(terms) = 0 THEN 0.0 ELSE
      coalesce(list_sum(list_transform(terms, lambda t: CAST(length(low) - length(replace(low, t, '')) AS DOUBLE) / length(t))), 0)
        / sqrt(CAST(greatest(len(regexp_extract_all(low, '[A-Za-z''-]+')), 1) AS DOUBLE))
      + 0.5 * coalesce(list_sum(list_transform(terms, lambda t: len(list_filter(names, lambda n: contains(n, t))))), 0) END"""
_MIXED = f"""WITH {v.CHUNKS}, {_SEEDS}, qt AS (SELECT query_id, {TOKENS.format('text')} AS terms FROM qv),
  sd AS (SELECT query_id, source_nid, idx FROM seeds JOIN c USING (chunk_id)),
  bs AS (SELECT DISTINCT sd.query_id, c.chunk_id FROM sd JOIN c ON c.source_nid = sd.source_nid AND abs(c.idx - sd.idx) IN (1, 2)
    WHERE NOT EXISTS (SELECT 1 FROM seeds s2 WHERE s2.query_id = sd.query_id AND s2.chunk_id = c.chunk_id)),
  mx AS (SELECT bs.query_id, chunk_id, vector IS NOT NULL AS has_vector, qv, hints, keywords, terms, names, lower(text) AS low FROM bs JOIN c USING (chunk_id) JOIN (SELECT query_id, qv, hints FROM qv) q USING (query_id) JOIN qt USING (query_id)),
  ms AS (SELECT query_id, mx.chunk_id, has_vector, list_inner_product(mx.qv, cvec.vector) * {_BOOST.format(k='mx.keywords')} AS score FROM mx JOIN cvec USING (chunk_id)
    UNION ALL SELECT query_id, chunk_id, has_vector, ({_WORDS}) * {_BOOST.format(k='keywords')} AS score FROM mx WHERE NOT has_vector)
  SELECT query_id, chunk_id, has_vector, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY has_vector DESC, round(score, 9) DESC, chunk_id) AS rank FROM ms QUALIFY rank <= 25"""

SQL = {
    "rerank_mixed": _MIXED,
    "seed_search": f"WITH {v.CHUNKS}, {_SEEDS} SELECT query_id, chunk_id, round(cosine, 6) AS cosine, rank FROM seeds",
    "retrieve_errors": f"WITH {v.CHUNKS}, {_SEEDS} SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM qv) THEN 'no query vector' WHEN query_id NOT IN (SELECT query_id FROM seeds) THEN 'no seeds' ELSE 'ok' END AS status FROM queries",
    "hop1_expand": f"WITH {_HOPS} SELECT query_id, chunk_id, edge_type FROM h1",
    "topk_hop1_expand": f"WITH {_HOPS} SELECT query_id, chunk_id, round(dot, 6) AS dot, rank FROM st",
    "hop2_expand": f"WITH {_HOPS} SELECT query_id, chunk_id, edge_type FROM h2",
    "rerank_vector": f"WITH {_BEST} SELECT query_id, chunk_id, edge_type, hop, round(score, 6) AS score, rank FROM best",
    "rerank_lexical": f"WITH {_LEX} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ls QUALIFY rank <= 25",
    "keyword_boost": f"WITH {v.CHUNKS}, {_SEEDS} SELECT query_id, chunk_id, round({_BOOST.format(k='keywords')}, 6) AS boost FROM seeds JOIN c USING (chunk_id) JOIN qv USING (query_id)",
    "first_per_nid": f"WITH {_DOCS} SELECT query_id, pos, nid, chunk_id, title FROM docs",
    "entity_freq": f"WITH {_FREQ} SELECT query_id, name, n, type, rank FROM fr JOIN tp USING (query_id, name)",
    "expand_entity_pages": f"WITH {_PAGES} SELECT query_id, pos, nid, chunk_id, title FROM pages",
    "retrieve": f"WITH {_ALL} SELECT query_id, count(*) AS result_count, string_agg(CAST(nid AS VARCHAR), ',' ORDER BY pos) AS nids, string_agg(title, '|' ORDER BY pos) AS titles, coalesce(any_value(all_entities), '') AS all_entities FROM rs LEFT JOIN al USING (query_id) GROUP BY query_id",
}
