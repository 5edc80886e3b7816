import random
from itertools import combinations

import pytest

from chunkweave.llm import similar_sets as ss

SCHEMA = "key string, owner long, members array<string>, pid string, size int"


def brute(rows, threshold, least):  # a null owner is no other owner than null
    out = {}
    clean = [(k, o, {m for m in (s or []) if m is not None}) for k, o, s in rows if k is not None]
    for (k, o, a), (l, p, b) in combinations(clean, 2):
        if o != p and len(a) >= least and len(b) >= least and len(a & b) / len(a | b) >= threshold - 1e-12:
            out[min(k, l), max(k, l)] = len(a & b) / len(a | b)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed,threshold", [(1, 0.6), (2, 0.6), (3, 0.8), (4, 0.5)])
def test_against_brute_force(spark, seed, threshold):
    rnd = random.Random(seed)
    rows, base = [], []
    for i in range(260):
        if base and rnd.random() < 0.7:  # clusters of near copies
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                (s.discard(rnd.choice(sorted(s))) if rnd.random() < 0.5 and s else s.add(f"t{rnd.randint(0, 60)}"))
        else:
            s = {f"t{int(rnd.paretovariate(0.6)) % 60}" for _ in range(rnd.randint(0, 12))}
        base.append(s)
        members = list(s) + [rnd.choice([None, *sorted(s)]) for _ in range(2)]
        rows.append((f"k{i:03}", rnd.choice([1, 2, 3, None, 4]), members))
    rows += [("n1", 1, None), ("n2", 2, []), (None, 3, ["a", "b", "c", "d"])]
    rows += [(f"c{i:02}", i % 3, ["p", "q", "r", "s"]) for i in range(30)]  # copies with few owners
    got = {(r.key_a, r.key_b): r.similarity for r in ss.similar_pairs(frame(spark, rows), threshold, 4).collect()}
    want = brute(rows, threshold, 4)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_small_bounds_lose_nothing(spark, monkeypatch):
    """Rounds, cells in cells, parts of hot members and pieces of cells, all crossed by one dense group."""
    for name, value in {"FIRST": 4, "GROWTH": 3, "HOT": 15, "CELL": 10, "FAN": 4, "DEPTH": 3, "HOME_BLOCK": 6, "GUEST_BLOCK": 9, "FEW": 10}.items():
        monkeypatch.setattr(ss, name, value)
    rnd = random.Random(9)
    rows = []
    for i in range(220):
        core = "abcdef" if i < 130 else "ghijkl"  # a group of more than half of the rows
        s = {m for m in core if rnd.random() < 0.9} | {f"t{rnd.randint(0, 6)}" for _ in range(rnd.randint(0, 3))}
        rows.append((f"k{i:03}", i, sorted(s)))
    got = {(r.key_a, r.key_b): r.similarity for r in ss.similar_pairs(frame(spark, rows), 0.6, 4).collect()}
    assert set(got) == set(brute(rows, 0.6, 4)) and len(got) > 1000


def test_pairs_come_from_cells(spark, monkeypatch):
    monkeypatch.setattr(ss, "FIRST", 60)
    rnd = random.Random(4)
    rows = [(f"k{i:04}", i, [f"g{i // 30}m{m}" for m in rnd.sample(range(9), 7)] + [f"x{rnd.randint(0, 999)}"]) for i in range(600)]
    points, _ = ss._points(frame(spark, rows), 4)
    home, guests = ss.partition(points, 0.6, 4)
    n = points.count()
    assert home.count() == home.select("pid").distinct().count() == n and home.select("cell").distinct().count() < n / 3, home.select("cell").distinct().count()
    alone = {r.alone: r["count"] for r in ss.point_pairs(points, 0.6, 4).groupBy("alone").count().collect()}
    assert alone.get(True, 0) < 0.02 * alone[False] and guests.count() < 40 * n


def test_tiny_sets(spark):
    rows = [("a", 1, ["x"]), ("b", 2, ["x", "y"]), ("c", 3, ["x"]), ("d", 4, ["y", "z"]), ("e", 5, ["z", "y", "w"])]
    got = {(r.key_a, r.key_b) for r in ss.similar_pairs(frame(spark, rows), 0.5, 1).collect()}
    assert got == set(brute(rows, 0.5, 1))


def test_between_two_tables(spark):
    left = [("a", 1, list("abcd")), ("b", 1, list("wxyz"))]
    right = [("a", 2, list("abcd")), ("c", 1, list("abcd")), ("d", 3, list("abcde"))]
    got = {(r.key_a, r.key_b) for r in ss.similar_pairs(frame(spark, left), 0.6, 4, frame(spark, right)).collect()}
    assert got == {("a", "a"), ("a", "d")}


def test_empty(spark):
    assert ss.similar_pairs(frame(spark, []), 0.6).count() == 0
    assert ss.similar_pairs(frame(spark, [("a", 1, ["x"]), ("b", 2, ["x"])]), 0.6).count() == 0
