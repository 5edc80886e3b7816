"""Nearest vectors: exact for a stated set of queries, and an inverted-file index for all rows.

Exact search scans the rows once per block of queries; a block has a bounded size and is what is
broadcast. The index assigns each row to the nearest of some centroids, fitted on a bounded sample,
level by level inside large cells, and compares a query with the rows of its nearest cells. Cells are
split so that no task holds more than ``CELL_ROWS`` rows, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave import config
from chunkweave.session import fresh, stage

#: Queries that are searched together: 4,096 x 64 doubles are 2 MB. Rows of a part that more queries meet.
QUERY_BLOCK, ROW_PART = 4_096, 20_000
#: Rows that centroids are fitted on, at most; the fewest and most cells of a level; rows of a cell part.
FIT_ROWS, LEAST_CELLS, FAN_CELLS, CELL_ROWS = 16_384, 4, 1_024, 6_000
#: A cell with more rows at home is cut into cells of its own; levels of that, at most.
SPLIT_ROWS, LEVELS = 12_000, 6
#: Digits of a similarity that count for ranking; ties fall to the smaller id.
DIGITS = 9


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query by (similarity, id), both rounded and exact at the edge."""
    if len(ids) > k:
        edge = np.partition(sims, len(sims) - k)[len(sims) - k]
        at = np.nonzero(sims >= edge)[0]
        ids, sims = ids[at], sims[at]
    order = np.lexsort((ids, -sims))[:k]
    return ids[order], sims[order]


def _best_of(asked: tuple, batches: Iterator[pa.RecordBatch | pa.Table], k: int, dim: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The k most similar rows of some batches for each of (names, unit vectors, tags)."""
    names, v, tags = asked
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], object), np.array([]))] * len(names)
    own = np.array([str(n) for n in names], object)
    for b in batches:
        if not b.num_rows:
            continue
        x = matrix(b.column("vector"), dim)
        if metric == "cosine":
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids = np.array(b.column("id").to_pylist(), object)
        at_id = {i: n for n, i in enumerate(ids)}
        tag = np.array(b.column("tag").to_pylist(), object)
        other = {t: tag != t for t in set(tags) if t is not None}
        for a in range(0, len(names), 256):
            s = np.round(v[a : a + 256] @ x.T, DIGITS)
            for i in range(len(s)):
                q = a + i
                if (n := at_id.get(own[q])) is not None:
                    s[i, n] = -np.inf
                if tags[q] is not None:
                    s[i, other[tags[q]]] = -np.inf
                edge = held[q][1][-1] if len(held[q][1]) == k else -1e300
                at = np.nonzero(s[i] >= edge)[0]
                if len(at):
                    held[q] = _best(np.concatenate([held[q][0], ids[at]]), np.concatenate([held[q][1], s[i, at]]), k)
    for name, (ids, sims) in zip(names, held):
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.string()), pa.array(sims)], ["query", "id", "score"])


def _asked(table: pa.Table, dim: int, metric: str) -> tuple:
    v = matrix(table.column("vector").combine_chunks(), dim)
    if metric == "cosine":
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return table.column("query").to_pylist(), v, table.column("tag").to_pylist()


def exact_search(queries: DataFrame, rows: DataFrame, k: int, dim: int = config.DIM, metric: str = "cosine") -> DataFrame:
    """``query, id, score, rank``: the k most similar of ``rows(id, vector[, tag])`` for each query.

    ``queries(query, vector[, tag])``: a query with a tag only sees rows of that tag; null sees all.
    Vectors must be usable (see ``chunks.usable``); a row is never found for a query of the same
    name. The queries are a stated set. One block of them (``QUERY_BLOCK``) is sent to all tasks and the
    rows are scanned where they lie; more are met on the executors, each block of queries with each
    part of the rows. Each task sends at most k rows per query on. Fewer than k rows give what there is.
    """
    spark = rows.sparkSession
    if "tag" not in queries.columns:
        queries = queries.withColumn("tag", F.lit(None).cast("string"))
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.lit(None).cast("string"))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id string, score double"
    queries = stage(queries.select("query", "vector", "tag"), "queries")
    n = queries.count()
    rows = rows.select("id", "vector", "tag")
    if not n:
        out = spark.createDataFrame([], schema)
    elif n <= QUERY_BLOCK:
        sent = spark.sparkContext.broadcast(_asked(queries.toArrow(), dim, metric))
        out = rows.mapInArrow(lambda batches: _best_of(sent.value, batches, k, dim, metric), schema)
    else:
        blocks, parts = -(-n // QUERY_BLOCK), max(1, -(-rows.count() // ROW_PART))
        block = F.pmod(F.xxhash64("query", F.lit(1)), F.lit(blocks)).cast("int")
        part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        asked = queries.select(block.alias("block"), every(parts).alias("part"), "query", "vector", "tag")
        data = rows.select(every(blocks).alias("block"), part.alias("part"), "id", "vector", "tag")

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            kind = pa.schema([("query", q.schema.field("query").type), ("id", pa.string()), ("score", pa.float64())])
            found = list(_best_of(_asked(q, dim, metric), x.combine_chunks().to_batches(), k, dim, metric)) if q.num_rows and x.num_rows else []
            return pa.Table.from_batches([f.cast(kind) for f in found], kind)

        out = asked.groupBy("block", "part").cogroup(data.groupBy("block", "part")).applyInArrow(meet, schema)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kmeans(v: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means."""
    c = v[np.random.default_rng(seed).choice(len(v), cells, replace=False)]
    for _ in range(rounds):
        at = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def _units(column: pa.Array, dim: int) -> np.ndarray:
    v = matrix(column, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centroids(rows: DataFrame, dim: int = config.DIM, seed: int = 3) -> np.ndarray:
    """Unit centroids of the first level, fitted on a hash-drawn sample of at most about ``FIT_ROWS`` rows."""
    n = rows.count()
    if not n:
        return np.zeros((0, dim))
    share = min(1.0, FIT_ROWS / n)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("vector")
    found = drawn.limit(2 * FIT_ROWS).toArrow()
    v = _units((found if found.num_rows else rows.select("vector").limit(1).toArrow()).column("vector").combine_chunks(), dim)
    return _kmeans(v, int(min(FAN_CELLS, len(v), max(LEAST_CELLS, n // 1_500))), seed)


def _fitting(level: int, dim: int, seed: int):
    """(cell, a sample of its rows at home) -> its centroids."""

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
        c = _kmeans(v, int(min(FAN_CELLS, len(v), max(2, group.column("n")[0].as_py() // 1_500))), seed + level).astype(np.float32)
        return pa.table({"cell": [key[0].as_py()] * len(c), "parts": pa.array([group.column("parts")[0].as_py()] * len(c), pa.int32()), "centroid": pa.array([x.tobytes() for x in c], pa.binary())})

    return fit


def _placing(level: int, dim: int, probes: int):
    """(cell and part, its rows, the cell's centroids) -> the rows in the cells of those centroids."""

    def place(key: tuple, rows: pa.Table, near: pa.Table) -> pa.Table:
        columns = ["cell", "id", "unit", "home"]
        if not rows.num_rows or not near.num_rows:
            return rows.select(columns)
        c = np.frombuffer(b"".join(sorted(near.column("centroid").to_pylist())), np.float32).reshape(-1, dim)
        v = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float32).reshape(-1, dim)
        take = min(probes, len(c))
        at = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :take]
        names = np.array([xxhash.xxh64_intdigest(f"{level} {key[0].as_py()} {i}") >> 1 for i in range(len(c))], np.int64)
        row = np.repeat(np.arange(len(v)), take)
        home = rows.column("home").to_numpy(zero_copy_only=False)[row] & (np.tile(np.arange(take), len(v)) == 0)
        again = rows.take(pa.array(row))
        return pa.table({"cell": names[at.ravel()], "id": again.column("id"), "unit": again.column("unit"), "home": home})

    return place


def _split_cells(placed: DataFrame, dim: int, probes: int, seed: int) -> DataFrame:
    """``placed`` with every cell of more than ``SPLIT_ROWS`` rows at home cut into cells of its own.

    The cell's centroids are fitted on a hash-drawn sample of its rows; a row at home goes to the
    nearest, and a row that asks the cell asks the nearest ``probes`` of them. Rows meet the centroids
    of their cell in parts, so a cell may be of any size; levels go on until no cell is too large.
    """
    schema = "cell long, id string, unit binary, home boolean"
    done = None
    for level in range(LEVELS):
        large = placed.where("home").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS)
        sizes = placed.groupBy("cell").agg(F.count("*").alias("every"))
        large = stage(large.join(sizes, "cell").withColumn("parts", F.ceil(F.col("every") / ROW_PART).cast("int")), "large")  # a row per SPLIT_ROWS at most
        if large.isEmpty():
            break
        rest = placed.join(large.select("cell"), "cell", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        inner = placed.join(large, "cell")
        drawn = inner.where("home").where(F.pmod(F.xxhash64("id", F.lit(seed + level)), F.lit(1 << 30)) < (1 << 30) * FIT_ROWS / F.col("n"))

        inside = stage(drawn.select("cell", "n", "parts", "unit").groupBy("cell").applyInArrow(_fitting(level, dim, seed), "cell long, parts int, centroid binary"), "inside")
        centroids = inside.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centroid")
        spread = inner.select("cell", F.pmod(F.xxhash64("id", F.lit(4)), F.col("parts")).cast("int").alias("part"), "id", "unit", "home")

        placed = stage(spread.groupBy("cell", "part").cogroup(centroids.groupBy("cell", "part")).applyInArrow(_placing(level, dim, probes), schema), "placed")
    return placed if done is None else done.unionByName(placed)


def build_index(rows: DataFrame, path: str, probes: int = 6, dim: int = config.DIM, seed: int = 3) -> None:
    """Write the index of ``rows(id, vector)`` to ``path``: ``cell, id, unit, home``, each row in its home
    cell and in the other cells that it would ask."""
    spark = rows.sparkSession
    centroids = fit_centroids(rows, dim, seed)
    sent = spark.sparkContext.broadcast(centroids.astype(np.float32))
    take = min(probes, len(centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            v = _units(b.column("vector"), dim).astype(np.float32)
            near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :take].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), pa.array([x.tobytes() for x in v], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, near.size + 1, take, dtype=np.int32), pa.array(near.ravel())),
                ],
                ["id", "unit", "near"],
            )

    if not len(centroids):
        spark.createDataFrame([], "cell long, id string, unit binary, home boolean").write.mode("overwrite").parquet(path)
        return
    near = rows.select("id", "vector").mapInArrow(place, "id string, unit binary, near array<long>")
    placed = stage(near.select("id", "unit", F.posexplode("near").alias("i", "cell")).select("cell", "id", "unit", (F.col("i") == 0).alias("home")), "placed")
    _split_cells(placed, dim, probes, seed).write.mode("overwrite").parquet(path)


def index_search(rows: DataFrame, k: int, probes: int = 6, dim: int = config.DIM, seed: int = 3) -> DataFrame:
    """``query, id, score, rank``: about the k most similar other rows of every row of ``rows(id, vector)``.

    Every row is indexed and is a query. Approximate: rows outside the ``probes`` nearest cells of a
    query are not seen. Similarities are those of single precision.
    """
    path = fresh(rows.sparkSession, "index")
    build_index(rows, path, probes, dim, seed)
    return search_index(rows.sparkSession, path, k, dim)


def search_index(spark: SparkSession, path: str, k: int, dim: int = config.DIM) -> DataFrame:
    """``query, id, score, rank`` of all rows of a stored index, each against the cells that it asks."""
    placed = spark.read.parquet(path)
    # parts of the cell's rows, and parts of its queries: a row per cell, joined and not collected
    sizes = placed.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("n"), F.count("*").alias("m"))
    sizes = stage(sizes.where("n > 0").select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("p"), F.ceil(F.col("m") / CELL_ROWS).cast("int").alias("t")), "sizes")
    hash_ = lambda n, s: F.pmod(F.xxhash64("id", F.lit(s)), n).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = placed.join(sizes, "cell")
    data = rows.where("home").select("cell", hash_(F.col("p"), 1).alias("part"), span(F.col("t")).alias("turn"), F.lit(0).alias("role"), "id", "unit")
    asked = rows.select("cell", span(F.col("p")).alias("part"), hash_(F.col("t"), 2).alias("turn"), F.lit(1).alias("role"), "id", "unit")

    def search(group: pa.Table) -> pa.Table:
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float32).reshape(-1, dim)
        ids = np.array(group.column("id").to_pylist(), object)
        role = group.column("role").to_numpy()
        d_ids, d, q_ids, q = ids[role == 0], unit[role == 0], ids[role == 1], unit[role == 1]
        found: list[tuple] = []
        if len(d):
            place_of = {x: i for i, x in enumerate(d_ids)}
            n = min(k, len(d))
            for a in range(0, len(q), 512):
                s = q[a : a + 512] @ d.T
                for i in range(len(s)):
                    if (j := place_of.get(q_ids[a + i])) is not None:
                        s[i, j] = -4
                at = np.argpartition(s, len(d) - n, axis=1)[:, len(d) - n :]
                top = np.take_along_axis(s, at, 1)
                found.append((np.repeat(q_ids[a : a + 512], n), d_ids[at.ravel()], np.round(top.ravel().astype(np.float64), 6)))
        if not found:
            return pa.table({"query": pa.array([], pa.string()), "id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        qs, xs, sims = (np.concatenate([f[i] for f in found]) for i in range(3))
        ok = sims > -2
        return pa.table({"query": pa.array(qs[ok], pa.string()), "id": pa.array(xs[ok], pa.string()), "score": pa.array(sims[ok])})

    hits = data.unionByName(asked).groupBy("cell", "part", "turn").applyInArrow(search, "query string, id string, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cell_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``cell, n``: rows at home in each cell of a stored index."""
    return spark.read.parquet(path).where("home").groupBy("cell").agg(F.count("*").alias("n"))
