import datetime as dt

import numpy as np
import pytest

from chunkweave.llm import similar_vectors as sv

SCHEMA = "chunk_id string, vector array<float>, synced_at timestamp, rid long, unit string"
T = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], t, 0, "x") for k, v, t in rows], SCHEMA)


def brute(vectors, k):
    names = sorted(vectors)
    x = np.array([vectors[n] for n in names])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {n: {names[j] for j in np.argsort(-s[i], kind="stable")[:k]} for i, n in enumerate(names)}


def test_exact_on_a_small_collection(spark):
    rnd = np.random.default_rng(2)
    rows = [(f"c{i:03}", rnd.standard_normal(8), T) for i in range(120)]
    got = {}
    for r in sv.nearest(frame(spark, rows), 5, dim=8).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    want = brute({k: v for k, v, _ in rows}, 5)
    assert np.mean([len(got[k] & want[k]) / 5 for k in want]) > 0.99


def test_recall_of_the_forest(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((60, 16))
    x = centres[rnd.integers(0, 60, 4000)] + 0.6 * rnd.standard_normal((4000, 16))
    rows = [(f"c{i:04}", v, T) for i, v in enumerate(x)]
    got = {}
    for r in sv.nearest(frame(spark, rows), 5, dim=16, trees=6, candidates=900, most=1200).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    want = brute({k: v for k, v, _ in rows}, 5)
    assert np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.9


def test_copies_bad_vectors_and_latest_rows(spark):
    e = np.eye(4)
    rows = [(f"d{i}", [1, 0, 0, 0], T) for i in range(9)]  # copies: more than k
    rows += [("d0", [1, 0, 0, 0], T), ("e", [0.9, 0.1, 0, 0], T), ("f", 100 * e[1], T)]
    rows += [("z", [0, 0, 0, 0], T), ("n", None, T), ("s", [1, 0], T), ("m", [1, None, 0, 0], T), ("i", [float("inf"), 0, 0, 0], T), (None, e[0], T)]
    rows += [("f2", e[1], T), ("f2", e[2], T - dt.timedelta(days=1)), ("f2", e[3], None)]
    got = {}
    for r in sv.nearest(frame(spark, rows), 5, dim=4).orderBy("rank").collect():
        got.setdefault(r.chunk_id, []).append((r.neighbour_id, round(r.cosine, 3)))
    assert set(got) == {*(f"d{i}" for i in range(9)), "e", "f", "f2"}
    assert [n for n, _ in got["d0"]] == ["d1", "d2", "d3", "d4", "d5"] and [n for n, _ in got["d3"]] == ["d0", "d1", "d2", "d4", "d5"]
    assert got["f"][0] == ("f2", 1.0) and got["e"][0][0] == "d0"
    assert all(len(v) == 5 and k not in dict(v) for k, v in got.items())


def test_few_and_none(spark):
    assert sv.nearest(frame(spark, []), 5, dim=3).count() == 0
    assert sv.nearest(frame(spark, [("a", [1, 2, 3], T)]), 5, dim=3).count() == 0
    got = sv.neighbour_pairs(sv.nearest(frame(spark, [("b", [1, 2, 3], T), ("a", [1, 2, 4], T)]), 5, dim=3)).collect()
    assert [tuple(r) for r in got] == [("a", "b")]


@pytest.mark.parametrize("seed", range(4))
def test_runs_and_ascent_against_brute_force(seed):
    rnd = np.random.default_rng(seed)
    rows, trees, most = 300, 3, 40
    keys = [rnd.integers(0, 2**sv.HASH_BITS, rows) >> rnd.integers(0, 12, rows) for _ in range(trees)]
    shared = lambda t, i, level: int((keys[t] >> (sv.HASH_BITS - level) == keys[t][i] >> (sv.HASH_BITS - level)).sum())
    places, bits = [], 1
    for t in range(trees):
        for half in (0, 1):  # blocks of the first bit
            mine = np.nonzero(keys[t] >> (sv.HASH_BITS - bits) == half)[0]
            mine = mine[np.argsort(keys[t][mine])]
            counts = sv.run_sizes(keys[t][mine], bits, 10**6)
            assert all(counts[j, c] == shared(t, i, bits + c) for j, i in enumerate(mine) for c in range(0, sv.LEVELS, 3))
            places += [(i, counts[j]) for j, i in enumerate(mine)]
    row, counts = np.array([p[0] for p in places]), np.array([p[1] for p in places])
    base, first = np.zeros(len(row), int), np.full(len(row), bits)
    level = sv.ascend(row, base, first, counts, rows, most)
    for i in range(rows):
        total = lambda x: sum(shared(t, i, max(x, bits)) for t in range(trees))
        assert total(level[i]) >= most and (level[i] >= bits + sv.LEVELS - 1 or total(level[i] + 1) < most)
    assert (sv.ascend(row, base, first, counts, rows, 10**6) == 0).all()  # fewer rows than asked for: all of them


def test_blocks_hold_whole_runs(spark):
    rnd = np.random.default_rng(3)
    keys = [int(x) for x in np.concatenate([rnd.integers(0, 2**40, 500), rnd.integers(2**39, 2**39 + 2**20, 700)])]
    forest = spark.createDataFrame([(i, 0, k) for i, k in enumerate(keys)], "rid long, tree int, key long")
    units = spark.createDataFrame([], "rid long, unit binary")
    got = sv._grow(forest, units, 1200, 16, 1, 60, 1).collect()
    assert len(got) == 1200
    by = {}
    for r in got:
        by.setdefault(r.block, set()).add((r.bits, r.key >> (40 - r.bits)))
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)
    counts = {b: sum(r.block == b for r in got) for b in by}
    assert max(counts.values()) <= 60


def test_batches_of_blocks():
    import pyarrow as pa

    ids = [1, 1, 2, 2, 2, 3, 3, 3, 3, 4]
    cut = [pa.RecordBatch.from_pydict({"block": ids[a:b], "x": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 4), (4, 6), (6, 10))]
    got = [(b.column("block").to_pylist(), b.column("x").to_pylist()) for b in sv._by_block(iter(cut))]
    assert [g[0] for g in got] == [[1, 1], [2, 2, 2], [3, 3, 3, 3], [4]] and sum((g[1] for g in got), []) == list(range(10))


def test_recall_in_a_dense_group_larger_than_a_run(spark):
    rnd = np.random.default_rng(7)
    centre = rnd.standard_normal(16)
    dense = centre / np.linalg.norm(centre) + 0.004 * rnd.standard_normal((3000, 16))
    rows = [(f"g{i:04}", v, T) for i, v in enumerate(dense)] + [(f"r{i:04}", v, T) for i, v in enumerate(rnd.standard_normal((1500, 16)))]
    got = {}
    for r in sv.nearest(frame(spark, rows), 5, dim=16, trees=6, candidates=900, most=300).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    half = {k: np.float16(v / np.linalg.norm(v)).astype(float) for k, v, _ in rows}
    want = brute(half, 5)
    assert len(got) == len(rows) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[k] & want[k]) / 5 for k in want if k.startswith("g")]) >= 0.8
