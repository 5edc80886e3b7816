import math
import random

from chunkweave.llm import source_mix as sm

VOCAB = sm.VOCABULARY


def counts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_tokens_round_trip(spark):
    texts = ["Hello world, it's 3 o'clock.", "", None, "Ünï <|endoftext|> \n\n x" * 50]
    rows = spark.createDataFrame([(i, t, " Civic-Wire", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_tokens int")
    got = {r.doc_id: r for r in sm.with_tokens(rows).collect()}
    enc = sm._encoding(VOCAB)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t) if t else []
        assert enc.decode(ids) == (t or "") and got[i].n_tokens == len(ids) and got[i].source == "civic_wire"


def test_temperature_and_bisection():
    q = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    assert sm.tempered(q, None, 1.0) == q
    flat = sm.tempered(q, None, 0.0)
    assert math.isclose(flat["a"], 1 / 3) and flat["d"] == 0
    want = 1.0
    # entropy falls as the exponent grows: the largest exponent that still has the wanted entropy
    e = sm.bisect_exponent(lambda x: sm.entropy(sm.tempered(q, None, x)) >= want)
    assert math.isclose(sm.entropy(sm.tempered(q, None, e)), want, abs_tol=1e-9)


def test_plan(spark):
    c = counts(spark, [(i, "big", 10) for i in range(90)] + [(100 + i, "small", 10) for i in range(10)] + [(200, None, 7), (201, "other", 5)])
    t = targets(spark, [("big", 0.5, 1), ("Small", 0.4, 2), ("gone", 0.1, 3), (None, 0.2, 1)])
    p = {r.source: r for r in sm.plan_mix(c, t).collect()}
    assert set(p) == {"big", "small", "gone"}
    assert [p[k].falls_short for k in ("big", "small", "gone")] == [False, True, True]
    # what the short sources lack goes to the one that has room
    assert p["big"].quota_tokens == 800 and p["small"].quota_tokens == 200 and p["gone"].quota_tokens == 0
    assert math.isclose(p["small"].share_of_budget, 0.2) and math.isclose(sum(r.share_of_mix for r in p.values()), 1)
    assert 0 <= p["small"].exponent < 1 and p["small"].tempered_share * 1000 <= 200 + 1e-6
    empty = sm.plan_mix(counts(spark, []), t).collect()
    assert all(r.tokens == 0 and r.share_of_mix == 0 for r in empty)


def test_quotas_meet_the_budget_and_the_limits():
    rnd = random.Random(5)
    for _ in range(300):
        names = "abcdef"[: rnd.randint(1, 6)]
        tokens = {k: rnd.choice([0, 1, 10, 100, 1000, 10**6]) * rnd.randint(0, 9) for k in names}
        share = [rnd.random() + 0.01 for _ in names]
        target = {k: x / sum(share) for k, x in zip(names, share)}
        room = {k: v * rnd.randint(1, 4) for k, v in tokens.items()}
        size = sum(tokens.values()) * rnd.choice([0.1, 0.5, 1, 2])
        weight, exponent = sm.quotas(tokens, target, room, size)
        got = {k: w * size for k, w in weight.items()}
        assert set(exponent) == set(names) and all(0 <= got[k] <= room[k] * (1 + 1e-9) for k in names)
        assert math.isclose(sum(got.values()), min(size, sum(room.values())), rel_tol=1e-6, abs_tol=1e-6)
        if all(target[k] * size <= room[k] for k in names):
            assert all(math.isclose(got[k], target[k] * size, rel_tol=1e-9) for k in names)


def test_entropy_as_the_target(spark):
    c = counts(spark, [(i, "big", 10) for i in range(80)] + [(100 + i, "mid", 10) for i in range(15)] + [(200 + i, "small", 10) for i in range(5)])
    t = targets(spark, [(k, 1 / 3, 9) for k in ("big", "mid", "small")])
    p = {r.source: r for r in sm.plan_mix(c, t, entropy_of=0.9).collect()}
    assert math.isclose(sm.entropy({k: r.tempered_share for k, r in p.items()}), 0.9, abs_tol=1e-6)
    assert p["big"].natural_share > p["big"].tempered_share > p["mid"].tempered_share > p["small"].tempered_share > p["small"].natural_share


def test_blocks_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_DOCS", 7)
    c = counts(spark, [(i, "a", 3 + i % 5) for i in range(500)] + [(1000 + i, "b", 4) for i in range(3)])
    plan = sm.plan_mix(c, targets(spark, [("a", 0.5, 2), ("b", 0.5, 2)]), budget=900)
    p = {r.source: r for r in plan.collect()}
    used = sm.realise(c, plan).collect()
    took = {k: sum(r.uses * r.n_tokens for r in used if r.source == k) for k in "ab"}
    assert p["a"].quota_tokens - 8 <= took["a"] <= p["a"].quota_tokens == 876 and took["b"] == p["b"].quota_tokens == 24


def test_realised_uses(spark):
    rows = [(i, "hot", 5 + i % 7) for i in range(3000)] + [(5000 + i, "cold", 9) for i in range(40)] + [(9000, "none", 4), (9001, None, 4)]
    c = counts(spark, rows)
    plan = sm.plan_mix(c, targets(spark, [("hot", 0.6, 3), ("cold", 0.4, 3)]))
    p = {r.source: r for r in plan.collect()}
    used = sm.realise(c, plan).collect()
    assert len(used) == len(rows)
    for k in ("hot", "cold"):
        took = sum(r.uses * r.n_tokens for r in used if r.source == k)
        assert p[k].quota_tokens - 12 <= took <= p[k].quota_tokens
        assert max(r.uses for r in used if r.source == k) <= 3
        assert max(r.uses for r in used if r.source == k) - min(r.uses for r in used if r.source == k) <= 1
    assert all(r.uses == 0 for r in used if r.source not in p)
    assert {(r.doc_id, r.uses) for r in used} == {(r.doc_id, r.uses) for r in sm.realise(c.repartition(7), plan).collect()}
    assert sm.realise(counts(spark, []), plan).count() == 0
