"""Corpus operations: missing fields, batches, balanced assignment, keywords, collections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave import config
from chunkweave.functions.text import tokenize
from chunkweave.session import stage

#: Rows of a part that a dense numbering is made from, about; only one count per part is put in order.
PART_ROWS = 50_000


def missing_field(nodes: DataFrame, field: str, types: list[str]) -> DataFrame:
    """Nodes of some types whose text field is null or ''; whatever their status."""
    return nodes.where(F.col("type").isin(types) & (F.col(field).isNull() | (F.col(field) == "")))


def numbered(df: DataFrame, order: str, name: str = "i", seed: int | None = None) -> DataFrame:
    """Rows numbered 0, 1, ... by ``order`` (or, with a seed, by a seeded shuffle of it), without one task for all.

    Ranges of the order, cut where the rows lie, are numbered apart; how many rows lie before a range is a
    running sum of one count per range. The order column should be unique.
    """
    key = F.col(order) if seed is None else F.xxhash64(order, F.lit(seed))
    parts = max(1, -(-df.count() // PART_ROWS))
    ranged = df.withColumn("_k", key).repartitionByRange(parts, "_k")
    rows = stage(ranged.withColumn("_p", F.spark_partition_id()), "ranges")  # written, so that no range is drawn anew
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_k", order)) - 1
    return rows.withColumn("_r", inside).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_k", "_p", "_r", "_before")


def batches(df: DataFrame, order: str, size: int, most: int | None = None) -> DataFrame:
    """Rows with a ``batch`` number from 1; batches after ``most`` are left out if it is given."""
    rows = numbered(df, order).withColumn("batch", (F.floor(F.col("i") / size) + 1).cast("long")).drop("i")
    return rows if most is None else rows.where(F.col("batch") <= most)


def assign_balanced(nodes: DataFrame, terms: DataFrame, order: str = "nid", seed: int = 13) -> DataFrame:
    """Every node with a term, at random but equally often (counts differ by at most 1).

    ``terms(tid, label)`` is a small fixed table; it is numbered whole and joined by the remainder.
    """
    few = terms.select("tid", "label", (F.row_number().over(Window.orderBy("tid")) - 1).alias("slot"))
    n = few.count()
    if not n:
        return nodes.withColumn("tid", F.lit(None).cast("long")).withColumn("label", F.lit(None).cast("string"))
    return numbered(nodes, order, seed=seed).withColumn("slot", F.col("i") % n).join(F.broadcast(few), "slot").drop("i", "slot")


def distribution(assigned: DataFrame, column: str = "label") -> DataFrame:
    return assigned.groupBy(column).agg(F.count("*").alias("n"))


def frequent_terms(nodes: DataFrame, most: int = config.GENERATED_KEYWORDS) -> DataFrame:
    """``nid, keywords``: stand-in for generated keywords, the most frequent terms of a body.

    Ties go by the term. A body is grouped by (nid, term), never held whole in a group.
    """
    terms = nodes.select("nid", F.explode(tokenize("body")).alias("term"))
    counts = terms.groupBy("nid", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("nid").orderBy(F.col("n").desc(), "term")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))


def generate_keywords(nodes: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``nid, raw``: a model's answers for ``nodes(nid, prompt)``, a batch of prompts at a time.

    ``model`` maps prompts to answers and is called once per Arrow batch in each task; limit the
    rate by the number of partitions. An exception gives an empty answer for its batch.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            try:
                raw = model(list(pdf["prompt"]))
            except Exception:
                raw = [""] * len(pdf)
            yield pd.DataFrame({"nid": pdf["nid"], "raw": raw})

    return nodes.select("nid", "prompt").mapInPandas(run, "nid long, raw string")


def save_collection(requests: DataFrame) -> DataFrame:
    """``collection_id, title, status, nids, message`` of ``requests(collection_id, title, nids)``.

    Node ids that are no numbers become 0, as a cast to an integer does; a null list is empty.
    """
    ids = F.transform(F.coalesce("nids", F.array().cast("array<bigint>")), lambda x: F.coalesce(x.cast("bigint"), F.lit(0)))
    message = F.concat(
        F.lit('Successfully created collection "'), F.coalesce("title", F.lit("")), F.lit('" with '), F.size("ids").cast("string"),
        F.lit(" item(s). Collection URL: /node/"), F.col("collection_id").cast("string"),
    )
    return requests.withColumn("ids", ids).select("collection_id", "title", F.lit(1).alias("status"), F.col("ids").alias("nids"), message.alias("message"))
