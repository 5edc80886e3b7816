"""Corpus signals: the names that occur in most chunks, by type, and their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave import config
from chunkweave.functions.text import parse_typed


def corpus_signals(chunks: DataFrame, most: int = config.SIGNALS_PER_TYPE) -> DataFrame:
    """``type, name, n, rank``: names by the number of chunks that hold them, the first per type.

    Entities are distinct within a chunk, so counting is one grouped sum; ties go by name. The rank
    filter runs before the final sort (a limit per type and partition), so a type may be large.
    """
    said = chunks.select(F.explode("entities").alias("e")).select(parse_typed("e").alias("p"))
    counts = said.groupBy(F.col("p.type").alias("type"), F.col("p.value").alias("name")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("type").orderBy(F.col("n").desc(), "name")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def totals(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count("*").alias("n_entries"), F.countDistinct("type").alias("n_types"))


def write_json(signals: DataFrame, path: str) -> None:
    """One JSON object a type: the names in order of rank."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n")))
    signals.groupBy("type").agg(names.alias("names")).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The signals back from JSON, by an explicit schema; rows that don't fit it are dropped."""
    rows = spark.read.schema("type string, names array<struct<name:string,n:long>>").json(path)
    rows = rows.where(F.col("type").isNotNull() & F.col("names").isNotNull())
    return rows.select("type", F.posexplode("names").alias("i", "x")).select("type", "x.name", "x.n", (F.col("i") + 1).alias("rank"))
