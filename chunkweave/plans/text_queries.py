"""Queries of sources and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.functions import text as tx
from chunkweave.functions.lexicon import STOP_WORDS
from chunkweave.operators import chat, corpus, entities
from chunkweave.operators.chunks import chunk_windows, published
from chunkweave.plans import views as v
from chunkweave.sources.tables import current_nodes, table

PROMPT = "Name 5 to 8 keywords or short phrases for the main subjects of the text below, one a line.\n\nText:\n{{ context }}"


def src_export_nodes(s, d):
    return v.export(s, d).withColumn("keywords", F.array_join("keywords", "|"))


def src_export_nid(s, d):
    """One node by its id, of whatever type; here the digest that holds a tenth of the rows."""
    return published(table(s, d, "nodes"), 7).withColumn("keywords", F.array_join("keywords", "|"))


def src_age_label(s, d):
    """Stated age resolved to a term: the label of the term it names, else ''."""
    terms = table(s, d, "terms").select("label").distinct()
    nodes = current_nodes(table(s, d, "nodes"), ["age_range"])
    return nodes.join(F.broadcast(terms), nodes["age_range"] == terms["label"], "left").select("nid", F.coalesce("label", F.lit("")).alias("age_label"))


def src_split_keywords(s, d):
    rows = current_nodes(table(s, d, "nodes"), ["keywords"]).select("nid", F.array_join("keywords", " , ").alias("line"))
    return rows.select("nid", F.array_join(tx.split_keywords("line"), "|").alias("keywords"))


def strip_tags(s, d):
    return current_nodes(table(s, d, "nodes"), ["body"]).select("nid", F.md5(tx.strip_tags("body")).alias("body_md5"))


def chunk_windows_(s, d):
    return chunk_windows(v.export(s, d)).select("chunk_id", "source_nid", F.col("idx").cast("long").alias("idx"), "text", "age_range", F.array_join("keywords", "|").alias("keywords"))


def encode_typed(s, d):
    return v.chunks(s, d, "entities").select("chunk_id", F.array_join("entities", "|").alias("entities"), F.size("entities").alias("n"))


def parse_typed(s, d):
    rows = v.chunks(s, d, "entities").select("chunk_id", F.posexplode("entities").alias("i", "e"))
    return rows.select("chunk_id", "i", tx.parse_typed("e").alias("p"), tx.strip_type("e").alias("plain")).select("chunk_id", "i", F.col("p.type").alias("type"), F.col("p.value").alias("value"), "plain")


def tokenize(s, d):
    return table(s, d, "queries").select("query_id", F.array_join(tx.tokenize("text"), " ").alias("terms"))


def cap_arrays(s, d):
    """Arrays cut to small caps, so that the caps show on this data."""
    return v.chunks(s, d, "keywords", "entities").select("chunk_id", F.array_join(tx.cap("keywords", 3, 12), "|").alias("keywords"), F.array_join(tx.cap("entities", 4, 20), "|").alias("entities"))


def parse_keyword_lines(s, d):
    return table(s, d, "keyword_raw").select("nid", F.array_join(tx.parse_keyword_lines("raw"), "|").alias("keywords"))


def prompt_render(s, d):
    return v.export(s, d).select("nid", F.md5(tx.render_prompt(PROMPT, "body")).alias("prompt_md5"))


def _replies(s, d):
    """Model answers made from the lists of keywords: plain JSON, fenced, behind prose, without a type, or prose only."""
    raw = table(s, d, "keyword_raw").select("nid", F.coalesce("raw", F.lit("")).alias("raw")).distinct()
    kind = F.pmod("nid", F.lit(5))
    body = lambda typed: F.to_json(F.struct(*([F.lit("results").alias("response_type")] if typed else []), F.col("raw").alias("message"), F.array(F.substring("raw", 1, 20)).alias("search_suggestions")))
    text = (
        F.when(kind == 0, body(True)).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), body(True), F.lit("\n```\n")))
        .when(kind == 2, F.concat(F.lit("Sure. "), body(True))).when(kind == 3, body(False)).otherwise(F.col("raw"))
    )
    return raw.select("nid", text.alias("text"))


def parse_structured(s, d):
    rows = _replies(s, d).select("nid", tx.parse_structured("text").alias("p"))
    return rows.select("nid", F.col("p.response_type").alias("response_type"), F.col("p.message").alias("message"), F.array_join("p.search_suggestions", "|").alias("search_suggestions"))


def json_extract_message(s, d):
    return _replies(s, d).select("nid", tx.message_of("text").alias("message"))


def chat_turn(s, d):
    """A turn's answer, with the retriever's result count where the node's number is even."""
    rows = _replies(s, d).select(F.col("nid").alias("id"), "text", F.when(F.col("nid") % 2 == 0, F.lit(3)).alias("result_count"))
    return chat.answers(rows).withColumn("search_suggestions", F.array_join("search_suggestions", "|"))


def strip_suggestion_cue(s, d):
    return table(s, d, "queries").select("query_id", tx.strip_cue(F.concat("text", F.lit(". Try the search suggestions below. Read on"))).alias("text"))


def compose_message(s, d):
    return table(s, d, "queries").select("query_id", tx.compose_message("text", "age_range").alias("message"))


def html_escape(s, d):
    return v.nodes(s, d).select("nid", tx.html_escape(F.concat(F.lit('<b title="'), F.coalesce("title", F.lit("")), F.lit('"> & more'))).alias("html"))


def url_term(s, d):
    return current_nodes(table(s, d, "nodes"), ["keywords"]).select("nid", F.posexplode("keywords").alias("i", "k")).where("k is not null").select("nid", "i", tx.url_term("k").alias("term"))


def filter_hints(s, d):
    return table(s, d, "queries").select("query_id", F.array_join(F.array_sort(tx.filter_hints("type_hints")), "|").alias("hints"))


def array_envelope(s, d):
    """Keywords written in three encodings and read back alike."""
    rows = v.chunks(s, d, "keywords").withColumn("j", F.to_json("keywords"))
    kind = F.pmod("idx", F.lit(3))
    quoted = F.expr("substring(to_json(struct(j)), 6, length(to_json(struct(j))) - 6)")  # the list as a JSON string
    boxed = F.concat(F.lit('{"Data":{"StringData":{"data":'), "j", F.lit("}}}"))
    text = F.when(kind == 0, F.col("j")).when(kind == 1, boxed).otherwise(quoted)
    return rows.select("chunk_id", F.array_join(tx.array_envelope(text), "|").alias("keywords"))


def type_labels_distinct(s, d):
    return v.chunks(s, d, "entities").select("chunk_id", F.array_join(F.array_sort(entities.type_labels(F.col("entities"))), "|").alias("types"))


def dedup_entities(s, d):
    """Members of the stored entity lists before and after they are made distinct and capped."""
    rows = table(s, d, "chunks").select(F.col("chunk_id").alias("id"), F.coalesce(F.size("entities"), F.lit(0)).alias("n")).groupBy("id").agg(F.max("n").alias("stored"))
    return v.chunks(s, d, "entities").join(rows, F.col("chunk_id") == F.col("id")).select("chunk_id", F.greatest("stored", F.lit(0)).alias("stored"), F.size("entities").alias("kept"))


def udf_ner(s, d):
    """Pattern extractor over all chunk texts: names found per type."""
    rows = v.chunks(s, d, "text").select("chunk_id", "text")
    found = entities.extract(rows, "chunk_id").select(F.explode("entities").alias("e"))
    return found.groupBy(F.substring_index("e", ":", 1).alias("type")).agg(F.count("*").alias("n"), F.countDistinct("e").alias("n_names"))


def ner_query(s, d):
    rows = table(s, d, "queries").select("query_id", "text")
    return entities.extract(rows, "query_id").select("query_id", F.array_join(entities.type_labels(F.col("entities")), "|").alias("types"))


def llm_keywords(s, d):
    """Stand-in for generated keywords: the eight most frequent terms of each body."""
    return corpus.frequent_terms(v.export(s, d).select("nid", "body")).select("nid", F.array_join("keywords", "|").alias("keywords"))


QUERIES = {
    "src_export_nodes": src_export_nodes, "src_export_nid": src_export_nid, "src_age_label": src_age_label, "src_split_keywords": src_split_keywords,
    "strip_tags": strip_tags, "chunk_windows": chunk_windows_, "encode_typed": encode_typed, "parse_typed": parse_typed, "tokenize": tokenize, "cap_arrays": cap_arrays,
    "parse_keyword_lines": parse_keyword_lines, "prompt_render": prompt_render, "parse_structured": parse_structured, "json_extract_message": json_extract_message,
    "chat_turn": chat_turn, "strip_suggestion_cue": strip_suggestion_cue, "compose_message": compose_message, "html_escape": html_escape, "url_term": url_term,
    "filter_hints": filter_hints, "array_envelope": array_envelope, "type_labels_distinct": type_labels_distinct, "dedup_entities": dedup_entities,
    "udf_ner": udf_ner, "ner_query": ner_query, "llm_keywords": llm_keywords,
}

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = f"list_filter(string_split_regex(lower(regexp_replace(coalesce({{}}, ''), '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+'), lambda t: length(t) > 2 AND t NOT IN ({_STOPS}))"
_REPLIES = """rep AS (SELECT nid, raw, nid % 5 AS kind FROM (SELECT DISTINCT nid, coalesce(raw, '') AS raw FROM keyword_raw))"""

SQL = {
    "src_export_nodes": f"WITH {v.EXPORT} SELECT nid, title, body, age_range, array_to_string(keywords, '|') AS keywords FROM x",
    "src_export_nid": f"WITH {v.EXPORT.replace('type = ' + chr(39) + 'topic' + chr(39), 'nid = 7')} SELECT nid, title, body, age_range, array_to_string(keywords, '|') AS keywords FROM x",
    "src_age_label": f"WITH {v.NODES} SELECT nid, coalesce(label, '') AS age_label FROM n LEFT JOIN (SELECT DISTINCT label FROM terms) t ON t.label = n.age_range",
    "src_split_keywords": f"""WITH {v.NODES} SELECT nid, array_to_string(list_filter(list_transform(string_split(coalesce(array_to_string(keywords, ' , '), ''), ','), lambda x: trim(x)), lambda x: x NOT IN ('', '0')), '|') AS keywords FROM n""",
    "strip_tags": f"WITH {v.NODES} SELECT nid, md5(regexp_replace(coalesce(body, ''), '{v.TAGS}', '', 'g')) AS body_md5 FROM n",
    "chunk_windows": rf"""WITH {v.EXPORT},
      w AS (SELECT nid, age_range, keywords, list_filter(string_split_regex(body, '[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+'), lambda w: w <> '') AS ws FROM x),
      o AS (SELECT *, unnest(range(0, len(ws), 100)) AS o FROM w),
      t AS (SELECT nid, age_range, keywords, o, array_to_string(ws[o + 1:o + 120], ' ') AS text FROM o),
      k AS (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY o) - 1 AS idx FROM t WHERE length(trim(text)) > 10)
      SELECT 'nid_' || nid || '_c_' || idx AS chunk_id, nid AS source_nid, idx, text, age_range,
        array_to_string(list_transform(list_filter(keywords, lambda x: x IS NOT NULL), lambda x: left(x, 200))[1:30], '|') AS keywords FROM k""",
    "encode_typed": f"WITH {v.CHUNKS} SELECT chunk_id, array_to_string(entities, '|') AS entities, len(entities) AS n FROM c",
    "parse_typed": f"""WITH {v.CHUNKS}, e AS (SELECT chunk_id, unnest(range(0, len(entities))) AS i, unnest(entities) AS e FROM c)
      SELECT chunk_id, i, split_part(e, ':', 1) AS type, substr(e, instr(e, ':') + 1) AS value, substr(e, instr(e, ':') + 1) AS plain FROM e""",
    "tokenize": f"SELECT query_id, array_to_string({TOKENS.format('text')}, ' ') AS terms FROM queries",
    "cap_arrays": f"WITH {v.CHUNKS} SELECT chunk_id, array_to_string(list_transform(keywords, lambda x: left(x, 12))[1:3], '|') AS keywords, array_to_string(list_transform(entities, lambda x: left(x, 20))[1:4], '|') AS entities FROM c",
    "parse_keyword_lines": r"""SELECT nid, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(coalesce(raw, ''), '^\s+|\s+$', '', 'g'), '\r?\n'),
        lambda l: trim(regexp_replace(regexp_replace(l, '^\s*[0-9]+[.)]\s*', ''), '^\s*[-•*]\s*', ''), ' ' || chr(9) || '",.;:' || chr(39))), lambda x: x <> '')[1:8], '|') AS keywords FROM keyword_raw""",
    "prompt_render": f"WITH {v.EXPORT} SELECT nid, md5(replace('{PROMPT}', '{{{{ context }}}}', body)) AS prompt_md5 FROM x",
    "parse_structured": f"WITH {_REPLIES} SELECT nid, CASE WHEN kind < 3 THEN 'results' END AS response_type, CASE WHEN kind < 3 THEN raw END AS message, CASE WHEN kind < 3 THEN left(raw, 20) END AS search_suggestions FROM rep",
    "chat_turn": f"""WITH {_REPLIES}, t AS (SELECT *, CASE WHEN kind = 3 THEN CAST(json_object('message', raw, 'search_suggestions', [left(raw, 20)]) AS VARCHAR) ELSE raw END AS txt FROM rep)
      SELECT nid AS id, txt AS response, CASE WHEN nid % 2 = 0 THEN 3 END AS result_count, CASE WHEN nid % 2 = 0 AND kind < 3 THEN left(raw, 20) ELSE '' END AS search_suggestions, '' AS collection_title FROM t""",
    "strip_suggestion_cue": r"SELECT query_id, trim(regexp_replace(regexp_replace(text || '. Try the search suggestions below. Read on', '(?i)[^\n.!?]*\b(?:search suggestions?|suggested search terms?|suggestions? below|search terms? below)\b[^\n.!?]*[.!?]', '', 'g'), '[ \t]{2,}', ' ', 'g')) AS text FROM queries",
    "compose_message": "SELECT query_id, trim(text) || CASE WHEN age_range IS NOT NULL AND age_range NOT IN ('', 'All') THEN chr(10) || chr(10) || 'Filters: Age range: ' || age_range || '.' ELSE '' END AS message FROM queries",
    "html_escape": f"""WITH {v.NODES} SELECT nid, replace(replace(replace(replace('<b title="' || coalesce(title, '') || '"> & more', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM n""",
    "url_term": f"""WITH {v.NODES}, k AS (SELECT nid, unnest(range(0, len(keywords))) AS i, unnest(keywords) AS k FROM n) SELECT nid, i,
      replace(replace(replace(replace(replace(replace(replace(url_encode(k), '%20', '+'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~') AS term FROM k WHERE k IS NOT NULL""",
    "filter_hints": "SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(coalesce(type_hints, []), lambda x: x IN ('PERSON','ORG','GPE','EVENT','NORP')))), '|') AS hints FROM queries",
    "array_envelope": f"WITH {v.CHUNKS} SELECT chunk_id, array_to_string(keywords, '|') AS keywords FROM c",
    "type_labels_distinct": f"WITH {v.CHUNKS} SELECT chunk_id, array_to_string(list_sort(list_distinct(list_transform(entities, lambda e: split_part(e, ':', 1)))), '|') AS types FROM c",
    "dedup_entities": f"WITH {v.CHUNKS} SELECT c.chunk_id, coalesce(len(r.entities), 0) AS stored, len(c.entities) AS kept FROM c JOIN r USING (chunk_id)",
    "llm_keywords": f"""WITH {v.EXPORT}, t AS (SELECT nid, unnest({TOKENS.format('body')}) AS term FROM x), n2 AS (SELECT nid, term, count(*) AS n FROM t GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY n DESC, term) AS r FROM n2 QUALIFY r <= 8) SELECT nid, string_agg(term, '|' ORDER BY r) AS keywords FROM k GROUP BY nid""",
}
