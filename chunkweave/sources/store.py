"""Reading exports, writing chunk stores, and stages that a rerun may reuse."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.session import shared_dir, stage

NODE = "nid long, title string, body string, age_range string, keywords array<string>"
CHUNK = "chunk_id string, source_nid long, text string, age_range string, keywords array<string>, entities array<string>, vector array<float>, neighbors array<string>"

#: Parts of a chunk store, by node. A node lies in one bucket; a bucket holds many.
BUCKETS = 32


def fetch_nodes(spark: SparkSession, path: str, nid: int | None = None, lines: bool = True) -> DataFrame:
    """An export of nodes as JSON, one object a line or (not ``lines``) one array a file; with ``nid`` only that node."""
    rows = spark.read.schema(NODE).option("multiLine", not lines).json(path)
    return rows if nid is None else rows.where(F.col("nid") == nid)


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.select("nid", "title", "body", "age_range", "keywords").write.mode("overwrite").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _bucket(node: str = "source_nid", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int").alias("bucket")


def create(spark: SparkSession, path: str, recreate: bool = False) -> None:
    """An empty chunk store, unless there is one; with ``recreate`` what is there is replaced."""
    if recreate or not _exists(spark, path):
        spark.createDataFrame([], CHUNK + ", bucket int").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a store, with the ``bucket`` that their node lies in."""
    return spark.read.schema(CHUNK + ", bucket int").parquet(path)


def _as_stored(chunks: DataFrame) -> DataFrame:
    have = set(chunks.columns)
    columns = []
    for field in CHUNK.split(", "):
        c, kind = field.split(" ", 1)
        column = F.substring("text", 1, 65_535) if c == "text" and c in have else F.col(c) if c in have else F.lit(None)
        columns.append(column.cast(kind).alias(c))
    return chunks.select(*columns, _bucket())


def insert(chunks: DataFrame, path: str) -> None:
    """Append chunks, each text capped as the schema demands. Failed tasks are retried by Spark.

    A store is cut into ``BUCKETS`` by node, so that a change touches the buckets of its nodes only.
    """
    _as_stored(chunks).write.mode("append").partitionBy("bucket").parquet(path)


def _replace_buckets(spark: SparkSession, path: str, touched: list[int], rows: DataFrame) -> None:
    """The touched buckets hold ``rows`` now; the others are left alone. Rows are staged before any old file goes."""
    rows = stage(rows, "buckets")
    left = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most BUCKETS numbers
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in set(touched) - left:  # nothing is left there
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _touched(keys: DataFrame) -> list[int]:
    return [r.bucket for r in keys.select("bucket").distinct().collect()]  # at most BUCKETS numbers


def change_nodes(spark: SparkSession, path: str, nids: DataFrame, chunks: DataFrame | None = None) -> None:
    """Delete all chunks of some nodes (``nids(nid)``) and insert others in their place; only their buckets are read and written.

    ``chunks`` are of those nodes (others are not inserted); without them the nodes are only deleted.
    Null nids and nodes without chunks change nothing.
    """
    ids = stage(nids.select("nid").where("nid is not null").distinct(), "nids")
    touched = _touched(ids.select(_bucket("nid")))
    old = without_nodes(read(spark, path).where(F.col("bucket").isin(touched)), ids)
    if chunks is not None:
        mine = chunks.join(ids.select(F.col("nid").alias("source_nid")), "source_nid", "left_semi")
        old = old.unionByName(_as_stored(mine))
    _replace_buckets(spark, path, touched, old)


def upsert_neighbours(spark: SparkSession, path: str, lists: DataFrame) -> None:
    """Write neighbour lists (``chunk_id, neighbors``) into stored chunks; chunks without a list keep theirs."""
    stored = read(spark, path)
    touched = _touched(stored.select("chunk_id", "bucket").join(lists.select("chunk_id"), "chunk_id", "left_semi"))
    rows = stored.where(F.col("bucket").isin(touched)).join(lists.select("chunk_id", F.col("neighbors").alias("new")), "chunk_id", "left")
    _replace_buckets(spark, path, touched, rows.withColumn("neighbors", F.coalesce("new", "neighbors")).select(stored.columns))


def without_nodes(chunks: DataFrame, nids: DataFrame) -> DataFrame:
    """The chunks of all other nodes (``nids(nid)``)."""
    return chunks.join(nids.select(F.col("nid").alias("source_nid")), "source_nid", "left_anti")


def with_neighbours(chunks: DataFrame, lists: DataFrame) -> DataFrame:
    """Chunks with their neighbour lists; [] where there is none. Rows are told by chunk_id."""
    rest = [c for c in chunks.columns if c != "neighbors"]
    return chunks.select(*rest).join(lists, "chunk_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the asked ids; ids without a row are silently absent."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def append_collection(saved: DataFrame, path: str) -> None:
    """Append saved collections; older ones stay as they are."""
    saved.select("collection_id", "title", "status", "nids").write.mode("append").parquet(path)


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


class Stages:
    """Named outputs of a build that a rerun with the same inputs and parameters takes up again."""

    def __init__(self, spark: SparkSession, build: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/build-{build}"

    def run(self, name: str, key: str, make) -> DataFrame:
        """The stage's stored output if it ended under this key, else ``make()``, written."""
        path = f"{self.at}/{name}-{key}"
        if not self.has(name, key):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def has(self, name: str, key: str) -> bool:
        return _exists(self.spark, f"{self.at}/{name}-{key}/_SUCCESS")

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def may_rebuild(spark: SparkSession, path: str, resume: bool, has_stages: bool) -> bool:
    """False where a resume without stages would destroy rows that are stored."""
    if not resume or has_stages or not _exists(spark, path):
        return True
    return spark.read.parquet(path).limit(1).count() == 0


def save_threshold(spark: SparkSession, value: float, path: str) -> None:
    spark.createDataFrame([(float(value),)], "edge_threshold double").coalesce(1).write.mode("overwrite").json(path)


def load_threshold(spark: SparkSession, path: str) -> float:
    """The corpus threshold of the last build, or the fixed one if none is stored or it is no number."""
    if not _exists(spark, path):
        return config.FALLBACK_THRESHOLD
    row = spark.read.schema("edge_threshold double").json(path).where("edge_threshold is not null").limit(1).collect()
    return row[0][0] if row else config.FALLBACK_THRESHOLD
