"""All similar pairs between set-valued records: metric pivot partitioning under Jaccard distance.

Equal sets are one point. In each round pivots are drawn from the points that have no cell yet, and a
point goes home to its nearest pivot, if one is near enough for the bounds below to tell anything.
What is left goes to the next round, with more pivots for fewer points, so dense regions are
partitioned by few pivots and sparse ones by many. A point y can have a partner x in the cell of p only
within the triangle inequality: with D the size of the symmetric difference, whose share of the
union is the Jaccard distance, ``D(y, p) <= D(x, p) + D(x, y)``, and two sets that are similar enough
have ``D(x, y) <= c (|x| + |y|)``, ``c = (1 - s) / (1 + s)``. y is replicated to exactly the cells
that this allows. Large cells are partitioned again by pivots drawn inside them. Points at home and
replicas are joined exactly within a cell, and nowhere else.

A point that shares no member with a pivot is at distance 1 of it, so distances to pivots are worked
out where members are shared: points meet pivots (never other points) on members, the most frequent
ones of each set left aside, as one or two shared members never suffice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.session import stage

#: Pivots of the first round, how many times more each later round has, and the share of the points
#: without a cell that they may be; the share of all points at which the rest become pivots.
FIRST, GROWTH, MOST_SHARE, LAST_SHARE = 1_024, 8, 0.5, 0.02
#: Pivots that are sent to all tasks together: 10,000 sets of ten members are some 10 MB.
FEW = 10_000
#: Sets that hold a member, per part of a member's sets.
HOT = 20_000
#: Points at home in a cell that is not partitioned again; pivots drawn inside a larger one; how often.
CELL, FAN, DEPTH = 256, 32, 5
#: Points at home, and replicas, that meet in one piece of a cell.
HOME_BLOCK, GUEST_BLOCK = 512, 4_096
_EPS = 1e-9


def _points(records: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(points: pid, s = members rarest first, parts = parts of each member, size), (membership: pid, key, owner)."""
    sets = records.select("key", "owner", F.array_sort(F.array_distinct(F.transform(F.filter("members", lambda m: m.isNotNull()), lambda m: F.xxhash64(m)))).alias("s"))
    sets = sets.where(F.col("key").isNotNull() & (F.size("s") >= min_size))
    sets = stage(sets.select("key", "owner", "s", F.xxhash64("s").alias("pid")), "sets")
    unique = sets.groupBy("pid").agg(F.first("s").alias("s"))
    rare = unique.select(F.explode("s").alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    ranked = (
        unique.select("pid", F.explode("s").alias("m"))
        .join(rare, "m")
        .groupBy("pid")
        .agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("x"))  # the members of one set
    )
    parts = F.transform("x", lambda e: (1 + F.floor(e["n"] / HOT)).cast("int"))
    points = ranked.select("pid", F.transform("x", lambda e: e["m"]).alias("s"), parts.alias("parts")).withColumn("size", F.size("s"))
    return stage(points, "points"), sets.select("pid", "key", "owner")


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def _near(points: DataFrame, pivots: DataFrame, least: int, few: bool) -> DataFrame:
    """(pid, pivot, size, psize, d) of points and pivots that share ``least`` members; d is the symmetric difference.

    A member that many sets hold is split into parts by its points, and its pivots are repeated for
    each part. ``few`` pivots are sent to all tasks, so that the points stay where they are.
    """
    first = lambda s: F.slice(s, F.lit(1), F.size(s) - (least - 1))
    lk = points.select("pid", "s", "size", "parts", F.posexplode(first("s")).alias("i", "m"))
    lk = lk.select("pid", "s", "size", "m", F.pmod(F.xxhash64("pid", F.lit(7)), F.element_at("parts", F.col("i") + 1)).cast("int").alias("part"))
    rk = pivots.select(F.col("pid").alias("pivot"), F.col("s").alias("ps"), F.col("size").alias("psize"), "parts", F.posexplode(first("s")).alias("i", "m"))
    rk = rk.select("pivot", "ps", "psize", "m", F.explode(F.sequence(F.lit(0), F.element_at("parts", F.col("i") + 1) - 1)).alias("part"))
    met = lk.join(F.broadcast(rk) if few else rk, ["m", "part"]).withColumn("both", F.array_intersect("s", "ps"))
    # a pair that shares several of these members is kept at the first of them only
    met = met.where((F.size("both") >= least) & (F.element_at("both", 1) == F.col("m")))
    return met.select("pid", "pivot", "size", "psize", (F.col("size") + F.col("psize") - 2 * F.size("both")).alias("d"))


def _cells(home: DataFrame, c: float) -> DataFrame:
    """(cell, reach, n): how far a replica may lie, and the points at home."""
    return home.groupBy("cell").agg(F.max(F.col("d") + c * F.col("size")).alias("reach"), F.count("*").alias("n"))


def _within(c: float) -> Column:
    return F.col("d") - c * F.col("size") <= F.col("reach") + _EPS


def partition(points: DataFrame, threshold: float, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(home: cell, pid, size, d; guests: the same columns) of points(pid, s, parts, size).

    Every point is at home in one cell. Of two points that are similar enough, at least one is a guest
    in the cell of the other; a point is also a guest of its own cell.
    """
    c = (1 - threshold) / (1 + threshold)
    # members that a replica shares with a pivot at least: what the smallest set has, as its own pivot
    least = max(1, math.ceil((1 - c) * (math.ceil(threshold * min_size - _EPS) + min_size) / 2 - _EPS))
    n = points.count()
    homes, nears = None, None
    rest, left, wanted = points, n, float(FIRST)
    turn = 0
    while left:
        last = left <= max(64, LAST_SHARE * n)
        share = 1.0 if last else min(MOST_SHARE, wanted / left)
        drawn = F.lit(True) if last else F.pmod(F.xxhash64("pid", F.lit(31 + turn)), F.lit(1_000_000_000)) < int(share * 1_000_000_000)
        near = stage(_near(rest, rest.where(drawn), least, share * left <= FEW), "near")
        # a pivot tells of a point's partners if the smallest of them must share enough with it
        partner = (1 - c) * F.ceil(threshold * F.col("size") - _EPS)
        tells = partner + F.col("psize") - F.col("d") - c * F.col("size") > 2 * (least - 1) + _EPS  # half of it, rounded up
        nearest = near.where(tells).groupBy("pid").agg(F.min(F.struct((F.col("d") / (F.col("size") + F.col("psize") + F.col("d"))).alias("far"), "pivot", "d", "size")).alias("x"))
        home = stage(nearest.select(F.col("x.pivot").alias("cell"), "pid", "x.size", "x.d"), "home")
        homes = home if homes is None else homes.unionByName(home)
        near = near.select(F.col("pivot").alias("cell"), "pid", "size", "d")
        nears = near if nears is None else nears.unionByName(near)
        left = 0 if last else left - home.count()
        rest = points.join(homes.select("pid"), "pid", "left_anti")
        turn, wanted = turn + 1, wanted * GROWTH
    if homes is None:
        none = points.sparkSession.createDataFrame([], "cell long, pid long, size int, d int")
        return none, none
    homes = stage(homes, "homes")
    guests = nears.join(_cells(homes, c), "cell").where(_within(c)).select("cell", "pid", "size", "d")
    return _refine(homes, stage(guests, "guests"), points, c)


def _refine(home: DataFrame, guests: DataFrame, points: DataFrame, c: float) -> tuple[DataFrame, DataFrame]:
    """Cells with more than ``CELL`` points at home, partitioned again by pivots drawn inside them."""
    done_home, done_guests = None, None
    join = lambda a, b: b if a is None else a.unionByName(b)
    sets = points.select("pid", "s")
    for level in range(DEPTH):
        large = home.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
        large = stage(large.join(guests.groupBy("cell").agg(F.count("*").alias("g")), "cell"), "large")  # a row per CELL points at most
        if large.isEmpty():
            break
        done_home = join(done_home, home.join(large, "cell", "left_anti"))
        done_guests = join(done_guests, guests.join(large, "cell", "left_anti"))
        parts = large.select("cell", "n", (1 + F.floor(F.col("g") / HOT)).cast("int").alias("parts"))
        inner = home.join(parts, "cell")
        drawn = inner.where(F.pmod(F.xxhash64("pid", F.lit(91 + level)), F.lit(1_000_000)) < 1_000_000 * FAN / F.col("n")).join(sets, "pid")
        pivots = stage(drawn.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pid").alias("pivot"), F.col("s").alias("ps"), F.col("size").alias("psize")), "inner")

        def to_pivots(df: DataFrame, role: str) -> DataFrame:
            rows = df.select("cell", "pid", "size", "d").join(parts, "cell").join(sets, "pid")
            rows = rows.withColumn("part", F.pmod(F.xxhash64("pid", F.lit(7)), F.col("parts")).cast("int")).select("cell", "part", "pid", "size", "s", F.col("d").alias("old"))
            met = rows.join(pivots, ["cell", "part"], "left")  # a cell without a drawn pivot stays as it is
            d = F.when(F.col("pivot").isNull(), F.col("old")).otherwise(F.col("size") + F.col("psize") - 2 * _shared("s", "ps"))
            inside = F.when(F.col("pivot").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "pivot", F.lit(level)))
            return met.select(F.col("cell").alias("outer"), inside.alias("cell"), "pid", "size", d.alias("d")).withColumn("role", F.lit(role))

        near_home = to_pivots(home.join(large, "cell", "left_semi"), "home")
        home = near_home.groupBy("outer", "pid").agg(F.min(F.struct("d", "cell", "size")).alias("x")).select("x.cell", "pid", "x.size", "x.d")
        home = stage(home, "inner_home")
        near_guests = to_pivots(guests.join(large, "cell", "left_semi"), "guest")
        guests = stage(near_guests.join(_cells(home, c), "cell").where(_within(c)).select("cell", "pid", "size", "d"), "inner_guests")
    return join(done_home, home), join(done_guests, guests)


def point_pairs(points: DataFrame, threshold: float, min_size: int = 1) -> DataFrame:
    """Pairs ``a < b`` of points (pid, s, parts, size) with Jaccard similarity >= threshold, and it.

    ``alone`` tells pairs that no cell with more than one point at home has met.
    """
    c = (1 - threshold) / (1 + threshold)
    home, guests = partition(points, threshold, min_size)
    sizes = home.groupBy("cell").agg(F.count("*").alias("n")).join(guests.groupBy("cell").agg(F.count("*").alias("g")), "cell")
    sizes = sizes.where("g > 1").select("cell", "n", F.ceil(F.col("n") / HOME_BLOCK).cast("int").alias("hb"), F.ceil(F.col("g") / GUEST_BLOCK).cast("int").alias("gb"))
    sizes = stage(sizes, "cells")
    block = lambda n, seed: F.pmod(F.xxhash64("pid", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sets = points.select("pid", "s")
    rows = lambda df: df.join(sizes, "cell").join(sets, "pid")
    left = rows(home).select("cell", "n", block(F.col("hb"), 1).alias("i"), every(F.col("gb")).alias("j"), F.col("pid").alias("x"), F.col("size").alias("xn"), F.col("d").alias("xd"), F.col("s").alias("xs"))
    right = rows(guests).select("cell", every(F.col("hb")).alias("i"), block(F.col("gb"), 2).alias("j"), F.col("pid").alias("y"), F.col("size").alias("yn"), F.col("d").alias("yd"), F.col("s").alias("ys"))
    most = c * (F.col("xn") + F.col("yn")) + _EPS
    met = left.join(right, ["cell", "i", "j"]).where((F.col("x") != F.col("y")) & (F.abs(F.col("xd") - F.col("yd")) <= most))
    met = met.withColumn("o", _shared("xs", "ys")).where(F.col("xn") + F.col("yn") - 2 * F.col("o") <= most)
    similarity = F.col("o") / (F.col("xn") + F.col("yn") - F.col("o"))
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(similarity).alias("similarity"), F.bool_and(F.col("n") == 1).alias("alone"))


def similar_points(records: DataFrame, threshold: float = 0.6, min_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """(membership: pid, key, owner), (links: a, b, similarity, alone): the pairs of different sets, copies not expanded."""
    points, members = _points(records, min_size)
    return members, point_pairs(points, threshold, min_size)


def similar_pairs(records: DataFrame, threshold: float = 0.6, min_size: int = 4, right: DataFrame | None = None) -> DataFrame:
    """``key_a, key_b, similarity``: records of different owners with similar sets.

    ``records(key, owner, members array<string>)``, one row per key. Null members don't count and
    repeated members count once; null, empty or small sets (under ``min_size`` members) and null
    keys take no part; a null owner differs from every other owner but not from null. Equal sets are
    one point, so copies are compared once and only expanded into the pairs that are asked for.
    Without ``right`` pairs are within the table, key_a < key_b; with it key_a is from ``records``
    and key_b from ``right`` (owners are then compared too). Empty tables give an empty result.
    Members are compared by 64-bit hashes.
    """
    if right is not None:
        records = records.select(F.lit(0).alias("side"), "key", "owner", "members").unionByName(right.select(F.lit(1).alias("side"), "key", "owner", "members"))
        records = records.select(F.struct("side", "key").alias("key"), "owner", "members")
    points, members = _points(records, min_size)
    links = point_pairs(points, threshold, min_size).select("a", "b", "similarity")
    links = links.unionByName(points.select(F.col("pid").alias("a"), F.col("pid").alias("b"), F.lit(1.0).alias("similarity")))
    # Owners first: a point and a point of one and the same owner give no pair, however many rows.
    owned = members.select("pid", "owner").distinct()
    a, b = (owned.select(F.col("pid").alias(p), F.col("owner").alias(f"owner_{p}")) for p in "ab")
    wanted = links.join(a, "a").join(b, "b").where(~F.col("owner_a").eqNullSafe(F.col("owner_b")))
    wanted = wanted.where((F.col("a") != F.col("b")) | (F.col("owner_a") < F.col("owner_b")) | F.col("owner_a").isNull() & F.col("owner_b").isNotNull())
    ka, kb = (
        members.select(F.col("pid").alias(f"pid_{p}"), F.col("owner").alias(f"o_{p}"), F.col("key").alias(f"k_{p}")) for p in ("a", "b")
    )
    full = wanted.join(ka, (F.col("a") == F.col("pid_a")) & F.col("owner_a").eqNullSafe(F.col("o_a"))).join(
        kb, (F.col("b") == F.col("pid_b")) & F.col("owner_b").eqNullSafe(F.col("o_b"))
    )
    if right is None:
        return full.select(F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b"), "similarity")
    full = full.where(F.col("k_a.side") != F.col("k_b.side"))
    first = F.col("k_a.side") == 0
    return full.select(F.when(first, F.col("k_a.key")).otherwise(F.col("k_b.key")).alias("key_a"), F.when(first, F.col("k_b.key")).otherwise(F.col("k_a.key")).alias("key_b"), "similarity")
