"""Queries of stores, filters, aggregates and corpus operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import corpus, entities, intent, retrieve, signals
from chunkweave.operators.chunks import chunk_windows, usable
from chunkweave.plans import views as v
from chunkweave.session import fresh
from chunkweave.sources import store
from chunkweave.sources.tables import current_chunks, current_nodes, table

TYPES = ["topic", "article"]


def _place(s, name):
    return fresh(s, name)


def src_fetch_nodes(s, d):
    """The export written as JSON and read back by its schema."""
    path = _place(s, "export")
    store.write_nodes(v.export(s, d), path)
    return store.fetch_nodes(s, path).select("nid", "title", F.md5("body").alias("body_md5"), "age_range", F.array_join("keywords", "|").alias("keywords"))


def _filled(s, d):
    """A store made and filled with the chunks in two appends."""
    path = _place(s, "chunks")
    rows = v.stored_chunks(s, d, "source_nid", "text", "age_range", "keywords", "entities")
    store.create(s, path)
    odd = F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 1
    store.insert(rows.where(odd), path)
    store.insert(rows.where(~odd), path)
    return path


def sink_insert(s, d):
    return store.read(s, _filled(s, d)).select("chunk_id", "source_nid", F.length("text").alias("n_chars"), F.size("entities").alias("n_entities"))


def sink_upsert(s, d):
    """The next chunk of its node written into every chunk of a store as its neighbour; nothing else changes."""
    path = _filled(s, d)
    rows = v.chunks(s, d, "source_nid")
    after = rows.select(F.col("chunk_id").alias("dst"), "source_nid", (F.col("idx") - 1).alias("idx"))
    lists = rows.join(after, ["source_nid", "idx"]).select("chunk_id", F.array(F.concat(F.lit("semantic:"), "dst")).alias("neighbors"))
    store.upsert_neighbours(s, path, lists)
    return store.read(s, path).select("chunk_id", "source_nid", F.length("text").alias("n_chars"), F.coalesce(F.array_join("neighbors", "|"), F.lit("")).alias("neighbors"))


def sink_delete_by_nid(s, d):
    """What a store holds after the chunks of unpublished nodes were deleted from it."""
    path = _filled(s, d)
    store.change_nodes(s, path, v.nodes(s, d).where("status <> 1").select("nid"))
    return store.read(s, path).select("chunk_id", "source_nid")


def get_chunks_by_ids(s, d):
    """Chunks of a store by id: the first ten chunks of every node that a collection names; absent ones are silently left out."""
    nids = table(s, d, "collections").select(F.explode("nids").alias("nid")).where("nid is not null").distinct()
    asked = nids.select("nid", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select(F.concat(F.lit("nid_"), "nid", F.lit("_c_"), "i").alias("chunk_id"))
    return store.by_ids(store.read(s, _filled(s, d)), asked).select("chunk_id", "source_nid", F.length("text").alias("n_chars"))


def collection_append(s, d):
    """Collections saved in two appends to one table, and read back."""
    path, saved = _place(s, "collections"), corpus.save_collection(table(s, d, "collections"))
    store.append_collection(saved.where("collection_id % 2 = 0"), path)
    store.append_collection(saved.where("collection_id % 2 = 1"), path)
    return s.read.parquet(path).select("collection_id", "title", "status", F.array_join("nids", ",").alias("nids"))


def cloud_types(s, d):
    """The chunks' entities as a cloud service would label them, packed again under the types of the graph."""
    rows = current_chunks(table(s, d, "chunks"), ["entities"])
    named = F.transform(F.coalesce("entities", F.array().cast("array<struct<type:string,name:string>>")), lambda e: F.struct(
        F.coalesce(F.element_at(F.create_map(F.lit("ORG"), F.lit("ORGANIZATION"), F.lit("GPE"), F.lit("LOCATION")), e["type"]), e["type"]).alias("type"), e["name"].alias("name")
    ))
    return rows.select("chunk_id", F.array_join(entities.cloud_types(named), "|").alias("entities"))


def sink_config_json(s, d):
    """A threshold written as JSON and read back: the share of chunks with a usable vector."""
    share = current_chunks(table(s, d, "chunks"), ["vector"]).agg(F.round(F.avg(usable("vector").cast("int")), 6)).first()[0]
    path = _place(s, "threshold")
    store.save_threshold(s, share or 0.0, path)
    return s.createDataFrame([(store.load_threshold(s, path), store.load_threshold(s, path + "-none"))], "stored double, missing double")


def get_by_ids(s, d):
    """The nodes that collections refer to; references to deleted ones are silently absent."""
    asked = table(s, d, "collections").select("collection_id", F.explode("nids").alias("nid")).distinct()
    return asked.join(v.nodes(s, d).select("nid", "title"), "nid").select("collection_id", "nid", F.coalesce("title", F.lit("")).alias("title"))


def query_by_filter(s, d):
    return retrieve.first_chunks(v.chunks(s, d, "source_nid"))


def corpus_signals(s, d):
    return signals.corpus_signals(v.chunks(s, d, "entities"))


def src_import_signals(s, d):
    """Signals written as JSON, one object a type, and read back."""
    path = _place(s, "signals")
    signals.write_json(corpus_signals(s, d), path)
    return signals.read_json(s, path)


def signals_total(s, d):
    return signals.totals(corpus_signals(s, d))


def collection_save(s, d):
    return corpus.save_collection(table(s, d, "collections")).withColumn("nids", F.array_join("nids", ","))


def filter_age_range(s, d):
    """Chunks that each query's age filter lets through; no filter counts all of them."""
    rows = v.chunks(s, d, "age_range").groupBy("age_range").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("every"))
    asked = table(s, d, "queries").select("query_id", F.when(F.col("age_range").isNotNull() & ~F.col("age_range").isin("", "All"), F.col("age_range")).alias("age_range"))
    out = asked.join(rows, "age_range", "left").join(F.broadcast(total))  # one row
    return out.select("query_id", F.when(F.col("age_range").isNull(), F.col("every")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))


def filter_missing_field(s, d):
    rows = current_nodes(table(s, d, "nodes"), ["age_range", "type"])
    return corpus.missing_field(rows, "age_range", TYPES).select("nid", "type")


def filter_entity_type(s, d):
    e = F.explode("entities").alias("e")
    rows = current_chunks(table(s, d, "chunks"), ["entities"]).select("chunk_id", e)
    return rows.where(F.col("e.type").isin("PERSON", "ORG", "GPE", "EVENT", "NORP", "FAC", "LOC")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def filter_min_len(s, d):
    return v.chunks(s, d, "text").where(F.length(F.trim("text")) > 10).select("chunk_id", F.length("text").alias("n_chars"))


def filter_has_vector(s, d):
    """Stored vectors: not empty (a zero vector passes), and those that can be searched."""
    rows = current_chunks(table(s, d, "chunks"), ["vector"])
    return rows.where(F.size("vector") > 0).select("chunk_id", F.size("vector").alias("dim"), usable("vector").alias("usable"))


def probe_dim(s, d):
    rows = current_chunks(table(s, d, "chunks"), ["vector"]).where(F.size("vector") > 0)
    return rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))


def batch_limit(s, d):
    nodes = v.nodes(s, d).select("nid")
    return corpus.batches(nodes, "nid", 50, 3)


def seed_balanced(s, d):
    """How many nodes each term gets: equally many, but for one."""
    nodes = v.nodes(s, d).select("nid")
    return corpus.distribution(corpus.assign_balanced(nodes, table(s, d, "terms")), "tid").agg(
        F.count("*").alias("n_terms"), F.sum("n").alias("n_nodes"), (F.max("n") - F.min("n")).alias("spread")
    )


def seed_balanced_rows(s, d):
    """Every node with its drawn term."""
    return corpus.assign_balanced(v.nodes(s, d).select("nid"), table(s, d, "terms")).select("nid", "tid", "label")


def distribution(s, d):
    rows = current_nodes(table(s, d, "nodes"), ["age_range"])
    return corpus.distribution(rows.select(F.coalesce("age_range", F.lit("")).alias("label")))


def intent_lexicon(s, d):
    return intent.lexicon_types(table(s, d, "queries"))


def intent_corpus(s, d):
    q = table(s, d, "queries")
    return intent.corpus_types(q, corpus_signals(s, d), intent.lexicon_types(q))


def intent_weights(s, d):
    return intent.weights(table(s, d, "queries"), corpus_signals(s, d))


def chunk_counts(s, d):
    """Windows that a full build makes of each published topic."""
    return chunk_windows(v.export(s, d)).groupBy("source_nid").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


QUERIES = {
    "src_fetch_nodes": src_fetch_nodes, "sink_insert": sink_insert, "sink_upsert": sink_upsert, "sink_delete_by_nid": sink_delete_by_nid, "get_by_ids": get_by_ids, "get_chunks_by_ids": get_chunks_by_ids, "collection_append": collection_append, "cloud_types": cloud_types, "sink_config_json": sink_config_json,
    "query_by_filter": query_by_filter, "corpus_signals": corpus_signals, "src_import_signals": src_import_signals, "signals_total": signals_total,
    "collection_save": collection_save, "filter_age_range": filter_age_range, "filter_missing_field": filter_missing_field, "filter_entity_type": filter_entity_type,
    "filter_min_len": filter_min_len, "filter_has_vector": filter_has_vector, "probe_dim": probe_dim, "batch_limit": batch_limit, "seed_balanced": seed_balanced,
    "seed_balanced_rows": seed_balanced_rows, "distribution": distribution, "intent_lexicon": intent_lexicon, "intent_corpus": intent_corpus,
    "intent_weights": intent_weights, "chunk_counts": chunk_counts,
}


def _lexicon_sql() -> str:
    from chunkweave.functions.lexicon import INTENT_TERMS

    rows = ", ".join(f"('{kind}', '{t}')" for kind, terms in INTENT_TERMS.items() for t in terms)
    return f"lex(type, term) AS (VALUES {rows}), byword AS (SELECT DISTINCT query_id, type FROM queries JOIN lex ON contains(lower(coalesce(text, '')), term))"


LEXICON = _lexicon_sql()
BY_NAME = """byname AS (SELECT DISTINCT query_id, sig.type FROM queries JOIN sig ON sig.name <> '' AND contains(lower(coalesce(text, '')), lower(sig.name))
  WHERE NOT EXISTS (SELECT 1 FROM byword b WHERE b.query_id = queries.query_id AND b.type = sig.type))"""
WEIGHT = "CASE WHEN type IN ('PERSON', 'ORG') THEN 1.4 WHEN type IN ('GPE', 'EVENT') THEN 1.3 WHEN type = 'NORP' THEN 1.2 ELSE 1.0 END"
WEIGHTS = f"""{LEXICON}, {BY_NAME}, wt AS (SELECT query_id, type, max(CAST({WEIGHT} AS DOUBLE)) AS weight FROM (SELECT * FROM byword UNION ALL SELECT * FROM byname
  UNION ALL SELECT query_id, unnest(type_hints) AS type FROM queries) WHERE type IS NOT NULL GROUP BY ALL)"""

SQL = {
    "src_fetch_nodes": f"WITH {v.EXPORT} SELECT nid, title, md5(body) AS body_md5, age_range, array_to_string(keywords, '|') AS keywords FROM x",
    "sink_insert": f"WITH {v.CHUNKS} SELECT chunk_id, source_nid, length(text) AS n_chars, len(entities) AS n_entities FROM c",
    "sink_upsert": f"""WITH {v.CHUNKS} SELECT a.chunk_id, a.source_nid, length(a.text) AS n_chars, coalesce('semantic:' || b.chunk_id, '') AS neighbors FROM c a LEFT JOIN c b ON a.source_nid = b.source_nid AND a.idx + 1 = b.idx""",
    "get_chunks_by_ids": f"WITH {v.CHUNKS}, a AS (SELECT DISTINCT 'nid_' || nid || '_c_' || k AS chunk_id FROM (SELECT unnest(nids) AS nid FROM collections), range(0, 10) x(k)) SELECT chunk_id, source_nid, length(text) AS n_chars FROM c JOIN a USING (chunk_id)",
    "collection_append": "SELECT collection_id, title, 1 AS status, coalesce(array_to_string(nids, ','), '') AS nids FROM collections",
    "cloud_types": f"""WITH {v.CHUNKS}, k AS (SELECT chunk_id, list_transform(list_filter(coalesce(entities, []), lambda e: e.type IN ('PERSON', 'ORG', 'GPE', 'EVENT')), lambda e: e.type || ':' || e.name)[1:150] AS e FROM r)
      SELECT chunk_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '|') AS entities FROM k""",
    "sink_config_json": f"WITH {v.CHUNKS} SELECT round(avg(CAST(vector IS NOT NULL AS INT)), 6) AS stored, CAST(0.55 AS DOUBLE) AS missing FROM c",
    "sink_delete_by_nid": f"WITH {v.CHUNKS}, {v.NODES} SELECT chunk_id, source_nid FROM c WHERE source_nid IS NULL OR source_nid NOT IN (SELECT nid FROM n WHERE status <> 1)",
    "get_by_ids": f"WITH {v.NODES}, a AS (SELECT DISTINCT collection_id, unnest(nids) AS nid FROM collections) SELECT collection_id, nid, coalesce(title, '') AS title FROM a JOIN n USING (nid)",
    "query_by_filter": f"WITH {v.CHUNKS} SELECT source_nid, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY source_nid ORDER BY idx NULLS LAST, chunk_id) = 1",
    "corpus_signals": f"WITH {v.CHUNKS}, {v.SIGNALS} SELECT type, name, n, rank FROM sig",
    "src_import_signals": f"WITH {v.CHUNKS}, {v.SIGNALS} SELECT type, name, n, rank FROM sig",
    "signals_total": f"WITH {v.CHUNKS}, {v.SIGNALS} SELECT count(*) AS n_entries, count(DISTINCT type) AS n_types FROM sig",
    "collection_save": """SELECT collection_id, title, 1 AS status, coalesce(array_to_string(nids, ','), '') AS nids,
      'Successfully created collection "' || coalesce(title, '') || '" with ' || coalesce(len(nids), 0) || ' item(s). Collection URL: /node/' || collection_id AS message FROM collections""",
    "filter_age_range": f"""WITH {v.CHUNKS}, q AS (SELECT query_id, CASE WHEN age_range IS NOT NULL AND age_range NOT IN ('', 'All') THEN age_range END AS age FROM queries)
      SELECT query_id, (SELECT count(*) FROM c WHERE q.age IS NULL OR c.age_range = q.age) AS n FROM q""",
    "filter_missing_field": f"WITH {v.NODES} SELECT nid, type FROM n WHERE type IN ('topic', 'article') AND (age_range IS NULL OR age_range = '')",
    "filter_entity_type": f"WITH {v.CHUNKS}, e AS (SELECT unnest(entities) AS e FROM r) SELECT e.type AS type, count(*) AS n FROM e WHERE e.type IN ('PERSON','ORG','GPE','EVENT','NORP','FAC','LOC') GROUP BY 1",
    "filter_min_len": f"WITH {v.CHUNKS} SELECT chunk_id, length(text) AS n_chars FROM c WHERE length(trim(text)) > 10",
    "filter_has_vector": f"WITH {v.CHUNKS} SELECT r.chunk_id, len(r.vector) AS dim, c.vector IS NOT NULL AS usable FROM r JOIN c USING (chunk_id) WHERE len(r.vector) > 0",
    "probe_dim": f"WITH {v.CHUNKS} SELECT len(vector) AS dim, count(*) AS n FROM r WHERE len(vector) > 0 GROUP BY 1",
    "batch_limit": f"WITH {v.NODES} SELECT nid, CAST(ceil(row_number() OVER (ORDER BY nid) / 50.0) AS BIGINT) AS batch FROM n QUALIFY batch <= 3",
    "seed_balanced": f"WITH {v.NODES} SELECT (SELECT count(*) FROM terms) AS n_terms, count(*) AS n_nodes, CAST(count(*) % (SELECT count(*) FROM terms) > 0 AS BIGINT) AS spread FROM n",
    "distribution": f"WITH {v.NODES} SELECT coalesce(age_range, '') AS label, count(*) AS n FROM n GROUP BY 1",
    "intent_lexicon": f"WITH {LEXICON} SELECT query_id, type FROM byword",
    "intent_corpus": f"WITH {v.CHUNKS}, {v.SIGNALS}, {LEXICON}, {BY_NAME} SELECT query_id, type FROM byname",
    "intent_weights": f"WITH {v.CHUNKS}, {v.SIGNALS}, {WEIGHTS} SELECT query_id, type, weight FROM wt",
    "chunk_counts": rf"""WITH {v.EXPORT},
      w AS (SELECT nid, list_filter(string_split_regex(body, '[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+'), lambda w: w <> '') AS ws FROM x),
      o AS (SELECT *, unnest(range(0, len(ws), 100)) AS o FROM w),
      t AS (SELECT nid, array_to_string(ws[o + 1:o + 120], ' ') AS text FROM o)
      SELECT nid AS source_nid, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM t WHERE length(trim(text)) > 10 GROUP BY 1""",
}
