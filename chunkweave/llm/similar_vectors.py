"""Most similar vectors for every vector: a hash-prefix forest.

Each tree gives every vector a long string of hyperplane bits; a sorted array of the strings is the
tree. A search descends to the longest prefix that its string shares with others, then ascends in all
trees together, one bit at a time, until the rows that share what is left of the prefix, summed over
the trees, are enough candidates. So each vector has its own prefix length, the same in all trees.

On Spark a tree's array is cut into blocks at prefixes, each the shortest prefix that few enough rows
share, so that a block holds whole runs. A first pass over ids and strings counts the runs of each
row; the counts of all trees meet at the row and give its prefix length. A second pass carries the
vectors and compares each row with the rows of its runs, those with the same run together.

Rows that share a whole string and are too many for a block are a dense group: it is centred on its
mean and hashed again with fresh planes, which makes the strings longer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave.session import stage

#: Bits of a hash string.
HASH_BITS = 40
#: Vectors, at most about, that the planes are fitted on (a hash draws them); every vector is indexed.
FIT_ROWS = 16_384
#: Candidates of a row: this many times the cube root of the rows. Rows of a block: this many times a tree's share of them.
PER_ROOT, BLOCK_RUNS = 87, 16
#: Bits that blocks grow by, and levels that are counted below a block's prefix.
STEP, LEVELS = 2, 14
#: Rows of one tree that a task takes, about; sets the number of partitions.
TASK_ROWS = 24_000
#: Trees that a dense group gets for each tree it is dense in, and the most times it is hashed again.
AGAIN, ROUNDS = 3, 8


def sizes(n: int) -> tuple[int, int]:
    """(trees, candidates) for ``n`` rows: trees grow with the logarithm, candidates with the cube root."""
    n = max(n, 2)
    return max(4, math.ceil(math.log2(n) / 2.9)), max(64, math.ceil(PER_ROOT * n ** (1 / 3)))


def fit_planes(sample: np.ndarray, dim: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, planes dim x trees*HASH_BITS): directions drawn by the sample's covariance, orthogonal by blocks.

    Directions in which the vectors vary most tell neighbours from others best.
    """
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    spread = np.eye(dim) / dim
    if len(sample) > 1:
        spread = 0.999 * np.cov(sample.T).reshape(dim, dim) + 0.001 * spread
    rnd = np.random.default_rng(seed)
    wide = min(16, dim)
    blocks = [np.linalg.qr(spread @ rnd.standard_normal((dim, wide)))[0] for _ in range(trees * math.ceil(HASH_BITS / wide))]
    per_tree = math.ceil(HASH_BITS / wide)
    planes = [np.concatenate(blocks[t * per_tree : (t + 1) * per_tree], axis=1)[:, :HASH_BITS] for t in range(trees)]
    return mean.astype(np.float32), np.concatenate(planes, axis=1).astype(np.float32)


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows have one): none for all-zero and non-finite vectors."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    top = np.abs(v).max(axis=1)
    ok = np.isfinite(top) & (top > 0)
    v = v[ok].astype(np.float64) / top[ok, None].astype(np.float64)  # no overflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True), ok


_PLACE = (1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)).astype(np.float64)


def _hash(dim: int, mean: np.ndarray, planes: np.ndarray):
    """Arrow batches (rid, chunk_id, synced_at, vector) -> with unit vector and a string per tree."""
    trees = planes.shape[1] // HASH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, ok = _unit(b.column("vector"), dim)
            keys = (((v.astype(np.float32) - mean) @ planes > 0).reshape(len(v), trees, HASH_BITS) @ _PLACE).astype(np.int64)
            keep = pa.array(ok)
            raw = [row.tobytes() for row in v.astype(np.float16)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rid").filter(keep), b.column("chunk_id").filter(keep), b.column("synced_at").filter(keep), pa.array(raw, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, trees, dtype=np.int32), pa.array(keys.ravel())),
                ],
                names=["rid", "chunk_id", "synced_at", "unit", "keys"],
            )

    return run


def _units(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("unit").to_pylist()), np.float16).reshape(-1, dim)


def _sums(dim: int):
    """Arrow batches (run, unit) -> the sum of each run's vectors, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                names, at = np.unique(b.column("run").to_numpy(), return_inverse=True)
                v = _units(b, dim).astype(np.float64)
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + v[at == i].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["run", "sums"])

    return run


def _hash_again(dim: int, trees: int, seed: int):
    """Arrow batches (rid, unit, tree, run, mean) -> with the string of the centred vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dim, trees, HASH_BITS))
        for b in batches:
            if not b.num_rows:
                continue
            v = _units(b, dim).astype(np.float64) - b.column("mean").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            tree = b.column("tree").to_numpy()
            keys = np.empty(len(v), np.int64)
            for t in np.unique(tree):
                mine = tree == t
                keys[mine] = ((v[mine] @ planes[:, t] > 0) @ _PLACE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("tree"), b.column("run"), pa.array(keys)], names=["rid", "tree", "run", "key"])

    return run


def _cut(left: DataFrame, most: int, largest: int) -> tuple[DataFrame, DataFrame | None]:
    """``left(rid, tree, run, base, key)`` in blocks: (with block and bits, what shares a whole string).

    Groups of more than ``most`` rows by their first bits are taken further. The table of such groups
    is what is broadcast: a row per ``most`` rows at most.
    """
    done = None
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1.0, largest / most)))))
    while True:
        prefix = F.shiftright("key", HASH_BITS - bits)
        large = left.groupBy("tree", "run", prefix.alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = stage(large, "large")
        named = left.withColumn("prefix", prefix).withColumn("bits", F.lit(bits)).withColumn("block", F.xxhash64("tree", "run", "prefix", "bits"))
        out = ["rid", "tree", "run", "base", "key", "block", "bits"]
        if large.isEmpty():
            kept = named.select(out)
            return (kept if done is None else done.unionByName(kept)), None
        marked = named.join(F.broadcast(large), ["tree", "run", "prefix"], "left")
        kept = marked.where("n is null").select(out)
        done = kept if done is None else done.unionByName(kept)
        left = stage(marked.where("n is not null").select("rid", "tree", "run", "base", "key", "prefix", "n"), "left")
        if bits == HASH_BITS:
            return done, left
        left = left.select("rid", "tree", "run", "base", "key")
        bits = min(HASH_BITS, bits + STEP)


def _grow(forest: DataFrame, units: DataFrame, n: int, dim: int, trees: int, most: int, seed: int) -> DataFrame:
    """``rid, tree, base, bits, block, key``: every string in a block of at most ``most`` rows."""
    left, done, largest = forest.withColumn("run", F.lit(0).cast("long")).withColumn("base", F.lit(0)), None, n
    for i in range(ROUNDS):
        cut, dense = _cut(left, most, largest)
        done = cut if done is None else done.unionByName(cut)
        if dense is None:
            return done.drop("run")
        dense = dense.withColumn("next", F.xxhash64("tree", "run", "prefix"))
        groups = stage(dense.groupBy("next").agg(F.count("*").alias("n")), "dense")  # a row per ``most`` rows at most
        largest = groups.agg(F.max("n")).first()[0]
        inside = dense.select("rid", "tree", F.col("next").alias("run"), F.col("base") + HASH_BITS).toDF("rid", "tree", "run", "base").join(units, "rid")
        sums = inside.select("run", "unit").mapInArrow(_sums(dim), "run long, sums array<double>").select("run", F.posexplode("sums").alias("at", "x"))
        means = sums.groupBy("run", "at").agg(F.sum("x").alias("x")).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("sums"))
        means = means.join(groups.select(F.col("next").alias("run"), "n"), "run").select("run", F.transform("sums", lambda s: s["x"] / F.col("n")).alias("mean"))
        copies = AGAIN if i == 0 else 1
        more = inside.join(F.broadcast(stage(means, "means")), "run").withColumn("tree", F.explode(F.array(*[F.col("tree") + trees * c for c in range(copies)])))
        again = more.select("rid", "unit", "tree", "run", "mean").mapInArrow(_hash_again(dim, trees * AGAIN, seed + 1 + i), "rid long, tree int, run long, key long")
        left = stage(again, "again").withColumn("base", F.lit((i + 1) * HASH_BITS))
    # what no planes tell apart is as good as equal; it is compared in pieces
    piece = F.xxhash64("tree", "run", F.pmod(F.xxhash64("rid", "tree"), F.lit(max(1, largest // most))))
    return done.drop("run").unionByName(left.select("rid", "tree", "base", "key", piece.alias("block"), F.lit(HASH_BITS).alias("bits")))


def run_sizes(keys: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Rows that share the first ``bits``, ``bits`` + 1 ... of each sorted key, ``LEVELS`` columns, at most ``most``."""
    out = np.zeros((len(keys), LEVELS), np.int32)
    for j in range(min(LEVELS, HASH_BITS - bits + 1)):
        p = keys >> (HASH_BITS - bits - j)
        group = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])
        out[:, j] = np.bincount(group)[group]
    return np.minimum(out, most)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks, each as one table, of batches that are sorted by block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            ids = b.column("block").to_numpy()
            if held and held[-1].column("block")[0].as_py() != ids[0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            first = int(np.argmax(ids != ids[0])) if ids[-1] != ids[0] else len(ids)
            held.append(b.slice(0, first))
            b = b.slice(first)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _kind(most: int):
    return np.uint16 if most * AGAIN < 65_536 else np.uint32


def _count(most: int):
    """Blocks of (rid, tree, base, bits, block, key) -> with the sizes of each row's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_block(batches):
            counts = run_sizes(b.column("key").to_numpy(), b.column("bits")[0].as_py(), most * AGAIN).astype(_kind(most))
            raw = pa.array([row.tobytes() for row in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "tree", "base", "bits", "block", "key")), raw], names=["rid", "tree", "base", "bits", "block", "key", "counts"])

    return run


def ascend(row: np.ndarray, base: np.ndarray, bits: np.ndarray, counts: np.ndarray, rows: int, most: int | np.ndarray) -> np.ndarray:
    """The longest prefix of each row at which the runs of its places in all trees hold ``most`` rows (one number, or one a row).

    Places are (row, base, bits, counts by level); above its block's prefix a place counts its block.
    A row that has fewer rows in all its blocks gets 0: it is compared with all of them.
    """
    level0 = base + bits
    deepest = int(level0.max(initial=0)) + LEVELS
    sums = np.zeros((rows, deepest + 1), np.int64)
    for j in range(LEVELS):
        np.add.at(sums, (row, level0 + j), counts[:, j])
    above = np.zeros((rows, deepest + 2), np.int64)  # each block's size on all levels above its prefix
    np.add.at(above, (row, level0), counts[:, 0])
    sums += np.cumsum(above[:, ::-1], axis=1)[:, ::-1][:, 1 : deepest + 2]
    enough = sums >= np.broadcast_to(most, rows)[:, None]
    return np.where(enough.any(axis=1), deepest - np.argmax(enough[:, ::-1], axis=1), 0).astype(np.int32)


def _levels(most: int, trees: int):
    """Arrow batches (rid, places array) -> (rid, level, places without counts).

    ``most`` is for rows with a place in each of ``trees``; rows of dense groups have more places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("places")
            flat = lists.flatten()
            base, bits = flat.field("base").to_numpy(), flat.field("bits").to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            counts = np.frombuffer(b"".join(flat.field("counts").to_pylist()), _kind(most)).reshape(-1, LEVELS)
            places_of = np.bincount(row, minlength=b.num_rows)
            level = ascend(row, base, bits, counts, b.num_rows, most * np.maximum(places_of, trees) // trees)
            names = ["base", "bits", "block", "key"]
            offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int32)
            places = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat.field(c) for c in names], names))
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(level), places], names=["rid", "level", "places"])

    return run


def _search(dim: int, k: int):
    """Blocks of (block, key, base, bits, level, rid, unit) -> the best candidates of each row's run."""

    def best(rid: np.ndarray, v: np.ndarray, asked: np.ndarray, a: int, b: int) -> pa.RecordBatch:
        take = min(k, b - a - 1)
        ids, sims = np.empty((len(asked), take), np.int64), np.empty((len(asked), take), np.float32)
        for i in range(0, len(asked), 512):  # bounds the block of similarities held at a time
            q = asked[i : i + 512]
            s = v[q] @ v[a:b].T
            s[np.arange(len(q)), q - a] = -4
            at = np.argpartition(s, b - a - take, axis=1)[:, b - a - take :]
            ids[i : i + 512] = rid[a + at]
            # the same two vectors give the same bits in every tree
            sims[i : i + 512] = np.einsum("ij,ikj->ik", v[q], v[a + at])
        near = pa.StructArray.from_arrays([pa.array(-sims.ravel()), pa.array(ids.ravel())], ["far", "rid"])
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[asked]), pa.ListArray.from_arrays(np.arange(0, len(asked) * take + 1, take, dtype=np.int32), near)], names=["rid", "near"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_block(batches):
            if b.num_rows < 2:
                continue
            key, rid, base, bits = (b.column(c).to_numpy() for c in ("key", "rid", "base", "bits"))
            v = _units(b, dim).astype(np.float64)
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)  # half precision changes lengths more than near-copies differ
            off = HASH_BITS - np.clip(b.column("level").to_numpy() - base, bits, HASH_BITS).astype(np.int64)
            prefix = key >> off
            order = np.lexsort((prefix, off))
            edges = np.nonzero((np.diff(off[order]) != 0) | (np.diff(prefix[order]) != 0))[0] + 1
            for asked in np.split(order, edges):  # the rows that ask for the same run
                o, p = off[asked[0]], prefix[asked[0]]
                start, stop = np.searchsorted(key, p << o), np.searchsorted(key, (p + 1) << o)
                if stop - start > 1:
                    yield best(rid, v, asked, int(start), int(stop))

    return run


def nearest(
    chunks: DataFrame, k: int = 5, dim: int = 64, trees: int | None = None, candidates: int | None = None, most: int | None = None, seed: int = 11
) -> DataFrame:
    """``chunk_id, neighbour_id, rank, cosine``: for each chunk the ``k`` most similar others.

    ``chunks(chunk_id, vector, synced_at)``; null, all-zero, non-finite vectors and those not
    ``dim`` long take no part; a chunk_id written twice counts with its latest row. Ties fall to the
    smaller chunk_id. Vectors that are equal (in half precision, as unit vectors) form one class:
    one of them is searched, and the copies are each other's nearest at 1. A collection of fewer
    than k + 1 vectors gives what there is; an empty one gives no rows. The number of trees and of
    ``candidates`` follow from the rows unless given (``sizes``), as do the rows of a block (``most``).
    Approximate: see README for measured recall.
    """
    n = chunks.count()
    trees, candidates = trees or sizes(n)[0], candidates or sizes(n)[1]
    most = most or max(64, BLOCK_RUNS * candidates // trees)
    rows = (
        chunks.where(F.col("chunk_id").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull()))
        .select(F.monotonically_increasing_id().alias("rid"), "chunk_id", F.col("synced_at").cast("timestamp").alias("synced_at"), "vector")
    )
    drawn = rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1_000_000)) < max(1, int(min(1.0, FIT_ROWS / max(n, 1)) * 1_000_000)))
    sample = drawn.select("vector").limit(2 * FIT_ROWS).toArrow().column("vector").combine_chunks()
    planes = fit_planes(_unit(sample, dim)[0] if len(sample) else np.zeros((0, dim)), dim, trees, seed)
    hashed = stage(
        rows.mapInArrow(_hash(dim, *planes), "rid long, chunk_id string, synced_at timestamp, unit binary, keys array<long>"), "hashed"
    )
    # Copies: the latest row per chunk_id, then classes of equal vectors. Only ids move here.
    light = hashed.select("rid", "chunk_id", "synced_at", F.xxhash64("unit").alias("same"))
    members = (
        light.groupBy("chunk_id").agg(F.max_by(F.struct("rid", "same"), F.struct(F.col("synced_at").isNotNull(), "synced_at", "rid")).alias("x"))
        .select("chunk_id", "x.rid", "x.same")
    )
    members = stage(members, "members")
    # pre-aggregated, so that a class that holds a third of all rows is no single task
    classes = members.groupBy("same").agg(F.min("rid").alias("rep"), F.count("*").alias("n"))

    order = Window.partitionBy("same").orderBy("chunk_id")
    first = members.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)
    heads = first.groupBy("same").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids")).join(classes, "same")
    heads = stage(heads.select("same", "rep", "n", "ids"), "heads")

    keys = hashed.select("rid", "keys").join(heads.select(F.col("rep").alias("rid")), "rid", "left_semi")
    forest = stage(keys, "keys").select("rid", F.posexplode("keys").alias("tree", "key"))
    units = hashed.select("rid", "unit")
    blocks = _grow(forest, units, n, dim, trees, most, seed)
    tasks = max(1, -(-n * trees // TASK_ROWS))
    counted = (
        blocks.repartition(tasks, "block").sortWithinPartitions("block", "key").select("rid", "tree", "base", "bits", "block", "key")
        .mapInArrow(_count(candidates), "rid long, tree int, base int, bits int, block long, key long, counts binary")
    )
    placed = counted.groupBy("rid").agg(F.collect_list(F.struct("base", "bits", "block", "key", "counts")).alias("places"))  # one entry a tree
    levels = placed.mapInArrow(_levels(candidates, trees), "rid long, level int, places array<struct<base:int,bits:int,block:long,key:long>>")
    asked = levels.join(units, "rid").select("rid", "level", "unit", F.explode("places").alias("p")).select("rid", "level", "unit", "p.*")
    found = (
        asked.repartition(tasks, "block").sortWithinPartitions("block", "key").select("block", "key", "base", "bits", "level", "rid", "unit")
        .mapInArrow(_search(dim, k), "rid long, near array<struct<far:float,rid:long>>")
    )
    merged = found.groupBy("rid").agg(F.collect_list("near").alias("all"))  # one entry a tree
    best = merged.select(F.col("rid").alias("rep"), F.explode(F.slice(F.array_sort(F.array_distinct(F.flatten("all"))), 1, k)).alias("x"))
    own = heads.where("n > 1").select("rep", F.lit(-1.0).cast("float").alias("far"), F.col("rep").alias("near_rep"))
    links = best.select("rep", F.col("x.far").alias("far"), F.col("x.rid").alias("near_rep")).unionByName(own)
    named = links.join(heads.select(F.col("rep").alias("near_rep"), "ids"), "near_rep").select("rep", "far", F.explode("ids").alias("chunk_id"))
    lists = named.groupBy("rep").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("far", "chunk_id"))), 1, k + 1).alias("top")  # at most (k + 1)^2 entries
    )
    mine = lists.join(heads.select("rep", "same"), "rep").join(members.select("same", "chunk_id"), "same")
    others = F.slice(F.filter("top", lambda x: x["chunk_id"] != F.col("chunk_id")), 1, k)
    return mine.select("chunk_id", F.posexplode(others).alias("i", "x")).select(
        "chunk_id", F.col("x.chunk_id").alias("neighbour_id"), (F.col("i") + 1).alias("rank"), (-F.col("x.far")).alias("cosine")
    )


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Unordered pairs, each once: ``chunk_id_a < chunk_id_b``."""
    return near.select(
        F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")
    ).distinct()
