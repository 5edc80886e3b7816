"""The queries of the training-data problems over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave.llm import cut_texts, leaks, name_variants, reading_level, similar_sets, similar_vectors, source_mix, split_items
from chunkweave.session import stage
from chunkweave.sources.tables import current_chunks, current_nodes, table

BODY_LIMIT, BODY_OVERLAP = 6_000, 200
CHUNK_LIMIT, CHUNK_OVERLAP = 1_200, 80


def _band_of(label: F.Column) -> F.Column:
    """The two numbers of an age band in whatever spelling, as '9-12'; null without two numbers."""
    ages = F.regexp_extract_all(label, F.lit(r"(\d+)"), 1)
    return F.when(F.size(ages) == 2, F.concat_ws("-", ages))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    nodes = current_nodes(table(spark, d, "nodes"), ["body", "age_range", "type"]).withColumn("band", _band_of(F.col("age_range")))
    order = Window.orderBy("tid")  # four rows
    bands = table(spark, d, "terms").select(_band_of(F.col("label")).alias("band"), (F.row_number().over(order) - 1).alias("label"))
    rows = nodes.join(F.broadcast(bands), "band", "left").select(F.col("nid").alias("key"), F.col("type").alias("source"), "label", F.col("body").alias("text"))
    return reading_level.score_levels(rows, 4)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where((F.col("n_words") >= 60) & (F.abs(F.col("level") - F.col("label")) >= 2)).select(F.col("key").alias("nid"))


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    """Score and band of every node's body, beside its stated band."""
    return _levels(spark, d).select(F.col("key").alias("nid"), "n_words", F.col("label").alias("stated"), "score", "level")


def p3_quality(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.quality(_levels(spark, d).where("n_words >= 60"))


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    """Every PERSON and ORG name with its bearer."""
    rows = table(spark, d, "chunks").select("source_nid", F.explode("entities").alias("e"))
    return name_variants.link_names(rows.select("e.name", "e.type", F.col("source_nid").alias("context")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.name_pairs(p4_names(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    bodies = current_nodes(table(spark, d, "nodes"), ["body"]).select(
        F.lit("body").alias("item_kind"), F.col("nid").cast("string").alias("item_key"), F.col("body").alias("text"),
        F.lit(BODY_LIMIT).alias("max_size"), F.lit(BODY_OVERLAP).alias("overlap"),
    )
    # the rows of a chunk_id are alike but for synced_at, so that only long texts need be told apart
    long = table(spark, d, "chunks").where(F.length("text") > CHUNK_LIMIT)
    texts = current_chunks(long, ["text"]).select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text",
        F.lit(CHUNK_LIMIT).alias("max_size"), F.lit(CHUNK_OVERLAP).alias("overlap"),
    )
    return bodies.unionByName(texts)


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return split_items.split_oversized(_items(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d).select("item_kind", "item_key", "cut_kind")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized item, with its offsets."""
    return _oversized(spark, d).select("item_kind", "item_key", F.posexplode("pieces").alias("piece", "p")).select(
        "item_kind", "item_key", "piece", "p.start", "p.stop", "p.cut", "p.text"
    )


def p5_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each piece starts and stops, and how it was cut."""
    return p5_pieces(spark, d).drop("text")


def p5_token_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The bodies again, in pieces of at most 1,500 tokens of the public tokenizer that overlap by 50."""
    bodies = _items(spark, d).where("item_kind = 'body'").withColumn("max_size", F.lit(1_500)).withColumn("overlap", F.lit(50))
    rows = split_items.split_oversized(bodies, tokens=True, vocabulary=source_mix.VOCABULARY)
    return rows.select("item_key", F.posexplode("pieces").alias("piece", "p")).select("item_key", "piece", "p.start", "p.stop", "p.cut")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: how many documents leak it, and the most runs found in one of them."""
    items = table(spark, d, "eval_items").select("item_id", "suite").distinct()
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    sums = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_runs").alias("most_runs"))
    return items.join(sums, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_runs", F.lit(0)).alias("most_runs"))


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """The mix by source: shares, exponent, quotas and the shares actually reached."""
    counts = source_mix.with_tokens(table(spark, d, "documents"))
    return source_mix.plan_mix(counts, table(spark, d, "source_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_plan(spark, d).where("falls_short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the number of times that the mix uses it."""
    counts = stage(source_mix.with_tokens(table(spark, d, "documents")), "tokens")
    return source_mix.realise(counts, source_mix.plan_mix(counts, table(spark, d, "source_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What the mix holds of each planned source, beside the plan: tokens, share of the mix, most uses of a text."""
    counts = stage(source_mix.with_tokens(table(spark, d, "documents")), "tokens")
    plan = source_mix.plan_mix(counts, table(spark, d, "source_targets"))
    used = source_mix.realise(counts, plan).groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed"), F.max("uses").alias("most_uses"))
    total = used.agg(F.sum("mixed").alias("all"))
    both = plan.join(used, "source", "left").join(F.broadcast(total))  # one row
    return both.select("source", "target_share", "quota_tokens", F.coalesce("mixed", F.lit(0)).alias("mixed"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.try_divide(F.coalesce("mixed", F.lit(0)), F.col("all")).alias("actual_share"))


def _one_blank(c: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """``key, owner, members``: clean keywords, and clean names behind their type, of each chunk.

    The key is (field, chunk_id) and each member carries its field, so one pass serves both fields.
    """
    rows = current_chunks(table(spark, d, "chunks"), ["source_nid", "keywords", "entities"])
    keywords = F.filter(F.transform("keywords", lambda k: F.lower(_one_blank(k))), lambda k: k != "")
    named = F.filter("entities", lambda e: _one_blank(e["name"]) != "")
    names = F.transform(named, lambda e: F.concat(F.coalesce(e["type"], F.lit("")), F.lit(":"), F.lower(_one_blank(e["name"]))))
    fields = F.array(
        F.struct(F.lit("entities").alias("field"), F.transform(names, lambda m: F.concat(F.lit("entities "), m)).alias("members")),
        F.struct(F.lit("keywords").alias("field"), F.transform(keywords, lambda m: F.concat(F.lit("keywords "), m)).alias("members")),
    )
    return rows.select("chunk_id", F.col("source_nid").alias("owner"), F.explode(fields).alias("x")).select(
        F.struct("x.field", "chunk_id").alias("key"), "owner", "x.members"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_sets.similar_pairs(_sets(spark, d), 0.6, 4).select(
        "key_a.field", F.col("key_a.chunk_id").alias("chunk_id_a"), F.col("key_b.chunk_id").alias("chunk_id_b")
    )


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's class of equal sets, named by its first chunk, and how many other classes are similar: no pair of copies."""
    members, links = similar_sets.similar_points(_sets(spark, d), 0.6, 4)
    ends = links.select(F.explode(F.array("a", "b")).alias("pid")).groupBy("pid").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("pid").agg(F.min("key").alias("first")).join(ends, "pid", "left")
    return members.join(classes, "pid").select("key.field", "key.chunk_id", F.col("first.chunk_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs of classes, each named by its first chunk."""
    members, links = similar_sets.similar_points(_sets(spark, d), 0.6, 4)
    first = stage(members.groupBy("pid").agg(F.min("key").alias("first")), "classes")
    a, b = (first.select(F.col("pid").alias(p), F.col("first").alias(f"f{p}")) for p in "ab")
    both = links.join(a, "a").join(b, "b").select(F.least("fa", "fb").alias("x"), F.greatest("fa", "fb").alias("y"), "similarity")
    return both.select("x.field", F.col("x.chunk_id").alias("class_a"), F.col("y.chunk_id").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest chunks of each chunk, with cosine."""
    return similar_vectors.nearest(table(spark, d, "chunks"), k=5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.neighbour_pairs(p2_nearest(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return cut_texts.judge(docs.select("doc_id", source_mix.clean_source("source").alias("source"), "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts.rates(_judged(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_classes": p1_classes,
        "p1_links": p1_links,
        "p2_found": p2_found,
        "p2_nearest": p2_nearest,
        "p3_found": p3_found,
        "p3_levels": p3_levels,
        "p3_quality": p3_quality,
        "p4_found": p4_found,
        "p4_names": p4_names,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p5_offsets": p5_offsets,
        "p5_token_pieces": p5_token_pieces,
        "p6_found": p6_found,
        "p6_by_item": p6_by_item,
        "p7_found": p7_found,
        "p7_plan": p7_plan,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_rates": p8_rates,
    }


_P1_SETS = r"""
  WITH c AS (SELECT chunk_id, max_by(source_nid, synced_at) AS nid, max_by(keywords, synced_at) AS k, max_by(entities, synced_at) AS e
             FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
  m AS (SELECT 'keywords' AS field, chunk_id, nid, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS m FROM (SELECT chunk_id, nid, unnest(k) AS x FROM c)
        WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''
        UNION SELECT 'entities', chunk_id, nid, coalesce(x.type, '') || ':' || lower(trim(regexp_replace(x.name, '\s+', ' ', 'g')))
        FROM (SELECT chunk_id, nid, unnest(e) AS x FROM c) WHERE trim(regexp_replace(x.name, '\s+', ' ', 'g')) <> ''),
  n AS (SELECT field, chunk_id, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 4),
  s AS (SELECT m.*, n.n FROM m JOIN n USING (field, chunk_id))
"""
_P1 = (
    _P1_SETS
    + """
  SELECT a.field, a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b
  FROM s a JOIN s b ON a.field = b.field AND a.m = b.m AND a.chunk_id < b.chunk_id AND a.nid IS DISTINCT FROM b.nid
  GROUP BY ALL HAVING count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
"""
)
_P1_LINKS = (
    _P1_SETS
    + """,
  w AS (SELECT field, chunk_id, list_sort(list(m)) AS w FROM s GROUP BY ALL),
  g AS (SELECT field, chunk_id, min(chunk_id) OVER (PARTITION BY field, w) AS class_id FROM w),
  f AS (SELECT s.* FROM s JOIN g USING (field, chunk_id) WHERE class_id = chunk_id),
  l AS (SELECT a.field, a.chunk_id AS class_a, b.chunk_id AS class_b, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS similarity
    FROM f a JOIN f b ON a.field = b.field AND a.m = b.m AND a.chunk_id < b.chunk_id
    GROUP BY ALL HAVING count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9)
"""
)

_P5_LONG = """
  WITH n AS (SELECT nid, body, row_number() OVER (PARTITION BY nid ORDER BY changed_at DESC, body) AS r FROM nodes WHERE nid IS NOT NULL),
  c AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE length(text) > 1200 GROUP BY chunk_id),
  long AS (SELECT 'body' AS item_kind, CAST(nid AS VARCHAR) AS item_key, body AS text, 6000 AS most FROM n WHERE r = 1 AND length(body) > 6000
           UNION ALL SELECT 'chunk', chunk_id, text, 1200 FROM c)
"""

_P5_OFFSETS = r"""
  WITH RECURSIVE n AS (SELECT nid, body, row_number() OVER (PARTITION BY nid ORDER BY changed_at DESC, body) AS r FROM nodes WHERE nid IS NOT NULL),
  c AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE length(text) > 1200 GROUP BY chunk_id),
  long AS (SELECT 'body' AS item_kind, CAST(nid AS VARCHAR) AS item_key, body AS text, 6000 AS most, 200 AS lap FROM n WHERE r = 1 AND length(body) > 6000
           UNION ALL SELECT 'chunk', chunk_id, text, 1200, 80 FROM c),
  p AS (SELECT *, length(text) AS size, list_filter(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(1)), '([.!?][\x22\x27”’)\]]*[\s\x01]+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM long),
  m AS (SELECT item_kind, item_key, most, lap, size, list_transform(parts, lambda x, i: CAST(list_sum(list_transform(parts[1:i], lambda y: length(y))) AS BIGINT)) AS marks FROM p),
  w AS (SELECT *, 0 AS piece, CAST(0 AS BIGINT) AS start, coalesce(list_max(list_filter(marks, lambda x: x <= most)), most) AS stop, list_has_any(marks, range(1, most + 1)) AS nat, size <= most AS done FROM m
    UNION ALL
    SELECT item_kind, item_key, most, lap, size, marks, piece + 1, s2,
      CASE WHEN size - s2 <= most THEN size ELSE coalesce(list_max(list_filter(marks, lambda x: x > stop AND x <= s2 + most)), s2 + most) END,
      len(list_filter(marks, lambda x: x > stop AND x <= s2 + most)) > 0, size - s2 <= most
    FROM (SELECT *, CASE WHEN back + most < nxt AND nxt <= stop + most THEN nxt - most ELSE back END AS s2
      FROM (SELECT *, greatest(start + 1, stop - lap) AS back, coalesce(list_min(list_filter(marks, lambda x: x > stop)), size) AS nxt FROM w WHERE NOT done)))
  SELECT item_kind, item_key, piece, start, stop, CASE WHEN done THEN 'end' WHEN nat THEN 'natural' ELSE 'forced' END AS cut FROM w
"""

_P6_RUNS = r"""
  WITH d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
  i AS (SELECT DISTINCT item_id AS id, list_transform(regexp_extract_all(passage, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE passage IS NOT NULL),
  dr AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS run FROM d WHERE len(w) >= 12),
  ir AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS run FROM i WHERE len(w) >= 12),
  hit AS (SELECT DISTINCT dr.id AS doc_id, ir.id AS item_id FROM dr JOIN ir USING (run))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_links": _P1_LINKS + "SELECT field, class_a, class_b, round(similarity, 6) AS similarity FROM l",
        "p1_classes": _P1_LINKS
        + """, e AS (SELECT field, class_a AS class_id FROM l UNION ALL SELECT field, class_b FROM l), k AS (SELECT field, class_id, count(*) AS n_links FROM e GROUP BY ALL)
  SELECT field, chunk_id, class_id, coalesce(n_links, 0) AS n_links FROM g LEFT JOIN k USING (field, class_id)""",
        "p5_found": _P5_LONG
        + r"""
  SELECT item_kind, item_key,
    CASE WHEN list_max(list_transform(string_split_regex(regexp_replace(text, '([.!?][\x22\x27”’)\]]*\s+)', '\1' || chr(10), 'g'), '\n'), lambda x: length(x))) > most
         THEN 'forced' ELSE 'natural' END AS cut_kind
  FROM long""",
        "p5_offsets": _P5_OFFSETS,
        "p6_by_item": _P6_RUNS
        + """, c AS (SELECT dr.id AS doc_id, ir.id AS item_id, count(*) AS n FROM dr JOIN (SELECT DISTINCT id, run FROM ir) ir USING (run) GROUP BY ALL),
  k AS (SELECT item_id, count(*) AS n_docs, max(n) AS most_runs FROM c GROUP BY 1)
  SELECT item_id, suite, coalesce(n_docs, 0) AS n_docs, coalesce(most_runs, 0) AS most_runs FROM (SELECT DISTINCT item_id, suite FROM eval_items) LEFT JOIN k USING (item_id)""",
        "p6_found": _P6_RUNS + "SELECT doc_id, item_id FROM hit",
    }
