import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkweave.operators import chat, corpus, embed, entities, graph, intent, knn, retrieve
from chunkweave.operators.chunks import chunk_windows, graph_chunks, published
from chunkweave.operators.stats import percentile
from chunkweave.session import shared_dir
from chunkweave.sources import store
from chunkweave.streaming import sync

CHUNK = "chunk_id string, source_nid long, idx long, text string, age_range string, keywords array<string>, entities array<string>, vector array<float>"


def chunks(spark, rows):
    """rows: (chunk_id, nid, vector, entities, keywords, age)"""
    return spark.createDataFrame([(c, n, i, f"text {c}", a, k, e, v) for i, (c, n, v, e, k, a) in enumerate(rows)], CHUNK)


def unit(i, dim=64, lean=0.0, to=1):
    v = np.zeros(dim, np.float32)
    v[i], v[to] = 1, v[to] + lean
    return [float(x) for x in v]


def test_exact_search_against_numpy(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((300, 64))
    x[50] = x[51] = 3 * x[52]  # ties
    rows = spark.createDataFrame([(f"r{i:03}", [float(v) for v in x[i]], "a" if i % 2 else "b") for i in range(300)], "id string, vector array<double>, tag string")
    q = spark.createDataFrame([(f"r{i:03}", [float(v) for v in x[i]], t) for i, t in ((0, None), (50, None), (7, "a"), (8, "none"))], "query string, vector array<double>, tag string")
    got = {}
    for r in knn.exact_search(q, rows.repartition(5), 4).orderBy("rank").collect():
        got.setdefault(r.query, []).append(r.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, keep in ((0, lambda j: True), (50, lambda j: True), (7, lambda j: j % 2)):
        s = sorted((-round(float(u[i] @ u[j]), 9), f"r{j:03}") for j in range(300) if j != i and keep(j))
        assert got[f"r{i:03}"] == [n for _, n in s[:4]]
    assert "r008" not in got and got["r050"][:2] == ["r051", "r052"]


def test_index_recall_and_skew(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 150)
    rnd = np.random.default_rng(2)
    centres = rnd.standard_normal((12, 16))
    x = centres[np.where(rnd.random(3000) < 0.4, 0, rnd.integers(0, 12, 3000))] + 0.4 * rnd.standard_normal((3000, 16))
    rows = spark.createDataFrame([(f"r{i:04}", [float(v) for v in x[i]]) for i in range(3000)], "id string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :10]
    got = {}
    for r in knn.index_search(rows, 10, probes=3, dim=16).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert np.mean([len(got[f"r{i:04}"] & {f"r{j:04}" for j in want[i]}) / 10 for i in range(3000)]) >= 0.9
    assert all(len(v) == 10 and k not in v for k, v in got.items())
    assert knn.index_search(rows.limit(0), 10, dim=16).count() == 0


def test_many_queries_meet_parts_of_the_rows(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((120, 8))
    rows = spark.createDataFrame([(f"r{i:03}", [float(v) for v in x[i]], "ab"[i % 2]) for i in range(120)], "id string, vector array<double>, tag string")
    q = spark.createDataFrame([(f"r{i:03}", [float(v) for v in x[i]], (None, "a")[i % 2]) for i in range(50)], "query string, vector array<double>, tag string")
    key = lambda df: sorted((r.query, r.id, r.rank) for r in df.collect())
    one = key(knn.exact_search(q, rows, 4, dim=8))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 13)
    monkeypatch.setattr(knn, "ROW_PART", 17)
    assert key(knn.exact_search(q, rows, 4, dim=8)) == one and len(one) == 200
    assert knn.exact_search(q.limit(0), rows, 4, dim=8).count() == 0


def test_cells_in_cells(spark, monkeypatch):
    for name, value in {"SPLIT_ROWS": 150, "FAN_CELLS": 6, "CELL_ROWS": 60, "ROW_PART": 200}.items():
        monkeypatch.setattr(knn, name, value)
    rnd = np.random.default_rng(6)
    centres = rnd.standard_normal((30, 16))
    x = centres[np.where(rnd.random(2500) < 0.4, 0, rnd.integers(0, 30, 2500))] + 0.3 * rnd.standard_normal((2500, 16))
    rows = spark.createDataFrame([(f"r{i:04}", [float(v) for v in x[i]]) for i in range(2500)], "id string, vector array<double>")
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    knn.build_index(rows, path, probes=3, dim=16)
    sizes = [r.n for r in knn.cell_sizes(spark, path).collect()]
    assert sum(sizes) == 2500 and max(sizes) <= 150 and len(sizes) > 20
    got = {}
    for r in knn.search_index(spark, path, 5, dim=16).collect():
        got.setdefault(r.query, set()).add(r.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :5]
    assert len(got) == 2500 and np.mean([len(got[f"r{i:04}"] & {f"r{j:04}" for j in want[i]}) / 5 for i in range(2500)]) >= 0.7


@pytest.mark.parametrize("n", [1, 2, 7, 500, 4001])
def test_percentile(spark, monkeypatch, n):
    from chunkweave.operators import stats

    monkeypatch.setattr(stats, "FEW", 20)
    rnd = np.random.default_rng(n)
    x = np.round(rnd.standard_normal(n), rnd.integers(1, 6))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for q in (0.0, 0.5, 0.85, 1.0):
        assert percentile(df, "v", q) == pytest.approx(np.percentile(x, 100 * q), abs=1e-12)
    assert percentile(df.where("v is null"), "v", 0.5) is None


def test_hub_keeps_ten_and_others_still_point_to_it(spark):
    rows = [("hub", 1, unit(0), ["PERSON:Hub"], [], "")] + [(f"s{i:02}", 2 + i, unit(0, lean=0.3, to=i + 1), ["GPE:hub", f"ORG:o{i}"], [], "") for i in range(15)]
    df = chunks(spark, rows)
    c = graph.exact_candidates(df, df).collect()
    out = [r for r in c if r.src == "hub"]
    assert len(out) == 10 and all(r.edge_type == "PERSON" for r in out)
    back = [r for r in c if r.dst == "hub"]
    assert len(back) == 15 and all(r.edge_type == "GPE" for r in back)  # the type is the source's
    assert all(r.src != r.dst for r in c)
    lists = {r.chunk_id: r.neighbors for r in graph.neighbour_lists(graph.exact_candidates(df, df)).collect()}
    assert lists["hub"][0].startswith("PERSON:s") and len(lists["hub"]) == 10


def test_zero_and_short_vectors_take_no_part(spark):
    raw = spark.createDataFrame(
        [("nid_1_c_0", 1, "t", None, ["k", None], [("PERSON", " A "), ("PERSON", "A"), ("WORK", "B"), (None, "C"), ("ORG", None)], unit(0), None, 9), ("nid_1_c_1", 1, None, "5-8", None, None, [0.0] * 64, None, 9),
         ("odd", None, "t", "", [], [], [1.0], None, 9), (None, 2, "t", "", [], [], unit(0), None, 9)],
        "chunk_id string, source_nid long, text string, age_range string, keywords array<string>, entities array<struct<type:string,name:string>>, vector array<float>, synced_at timestamp, idx int",
    )
    got = {r.chunk_id: r for r in graph_chunks(raw).collect()}
    assert set(got) == {"nid_1_c_0", "nid_1_c_1", "odd"}
    assert got["nid_1_c_0"].entities == ["PERSON:A"] and got["nid_1_c_0"].keywords == ["k"] and got["nid_1_c_0"].age_range == ""
    assert got["nid_1_c_1"].vector is None and got["odd"].vector is None and got["odd"].idx is None and got["nid_1_c_1"].entities == []


def test_retrieval_on_a_handmade_graph(spark):
    rows = [
        ("seed", 1, unit(0), ["PERSON:Ann"], [], "5-8"), ("n1", 2, unit(0, lean=0.5), ["ORG:Club"], ["march"], "9-12"), ("n2", 3, unit(0, lean=1.0), [], ["march"], "9-12"),
        ("neg", 4, [-x for x in unit(0)], [], [], ""), ("same", 1, unit(0, lean=0.4), ["PERSON:Ann"], [], ""), ("page", 9, unit(5), ["GPE:Town"], [], ""),
    ]
    df = chunks(spark, rows)
    edge = [("seed", "n1", "GPE"), ("seed", "n1", "PERSON"), ("seed", "gone", "ORG"), ("seed", "neg", "PERSON"), ("n1", "n2", "ORG"), ("n1", "seed", "ORG"), ("n1", "gone", "ORG"), ("seed", "same", "EVENT")]
    edges = retrieve.stored_edges(spark.createDataFrame(edge, "src string, dst string, edge_type string"))
    q = spark.createDataFrame([(7, "who is she", unit(0), "5-8", ["march"], None), (8, "none", None, None, None, None), (9, "x", unit(0), "13-15", [], [])], "query_id long, text string, vector array<float>, age_range string, keyword_hints array<string>, type_hints array<string>")
    none = spark.createDataFrame([], "type string, name string, n long, rank int")
    steps = retrieve.traverse(q, df, edges, none)
    assert [(r.query_id, r.chunk_id) for r in steps["seeds"].collect()] == [(7, "seed")]
    hop1 = {r.chunk_id: r.edge_type for r in steps["hop1"].collect()}
    assert hop1 == {"n1": "PERSON", "gone": "ORG", "neg": "PERSON", "same": "EVENT"}  # the most telling type; a dangling id is still seen
    assert [(r.chunk_id, r.edge_type) for r in steps["hop2"].collect()] == [("n2", "ORG")]  # not the seed, not the dangling id
    best = {r.chunk_id: r for r in steps["best"].collect()}
    assert set(best) == {"n1", "neg", "same", "n2"}
    assert best["n1"].score == pytest.approx(1.0 * 1.4 * 1.3) and best["neg"].score == pytest.approx(-1.4)  # a weight lowers a negative score
    assert best["n2"].score == pytest.approx(0.75)  # hop 2: no keyword boost by default
    both = steps["hop1"].withColumn("hop", F.lit(1)).unionByName(steps["hop2"].withColumn("hop", F.lit(2)))
    boosted = {r.chunk_id: r.score for r in retrieve.rerank(both, q.where("query_id = 7"), df, steps["weights"], boost_hop2=True).collect()}
    assert boosted["n2"] == pytest.approx(0.75 * 1.3)
    nodes = spark.createDataFrame([(1, "One", "topic", 1), (2, None, "topic", 1), (9, "Club", "topic", 1), (10, "Ann", "topic", 0)], "nid long, title string, type string, status int")
    out = retrieve.retrieve(q, df, nodes, edges, none).collect()
    assert [r.query_id for r in out] == [7]
    assert [x.nid for x in out[0].results] == [1, 2, 3, 4, 9] and out[0].result_count == 5  # one row a document, then Club's page
    assert [x.title for x in out[0].results] == ["One", "", "", "", "Club"] and out[0].results[0].url == "/node/1"
    assert out[0].all_entities == ["Ann", "Club", "Town"]
    status = {r.query_id: r.status for r in retrieve.status(q, steps["seeds"]).collect()}
    assert status == {7: "ok", 8: "no query vector", 9: "no seeds"}


def test_lexical_rows_come_after_vector_rows(spark):
    df = chunks(spark, [("v", 1, unit(1), [], [], ""), ("w", 2, None, ["ORG:march"], [], "")])
    q = spark.createDataFrame([(1, "march text", unit(0), None, [], [])], "query_id long, text string, vector array<float>, age_range string, keyword_hints array<string>, type_hints array<string>")
    cand = spark.createDataFrame([(1, "v", "semantic", 1), (1, "w", "semantic", 1)], "query_id long, chunk_id string, edge_type string, hop int")
    none = spark.createDataFrame([], "query_id long, type string, weight double")
    got = retrieve.rerank(cand, q, df, none).orderBy("rank").collect()
    assert [(r.chunk_id, r.has_vector) for r in got] == [("v", True), ("w", False)] and got[1].score > got[0].score


def test_intent(spark):
    q = spark.createDataFrame([(1, "Replace the courthouse", ["NORP", None]), (2, None, None), (3, "tell of Ann", [])], "query_id long, text string, type_hints array<string>")
    sig = spark.createDataFrame([("PERSON", "Ann", 2, 1), ("ORG", "Replace", 1, 1)], "type string, name string, n long, rank int")
    got = {(r.query_id, r.type): r.weight for r in intent.weights(q, sig).collect()}
    assert got == {(1, "GPE"): 1.3, (1, "ORG"): 1.4, (1, "NORP"): 1.2, (3, "PERSON"): 1.4}


def test_numbering_batches_and_balance(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(10**6), 1000)
    df = spark.createDataFrame([(i,) for i in ids], "nid long").repartition(6)
    got = {r.nid: r.i for r in corpus.numbered(df, "nid").collect()}
    assert got == {n: i for i, n in enumerate(sorted(ids))}
    assert {r.batch for r in corpus.batches(df, "nid", 300, 2).collect()} == {1, 2} and corpus.batches(df, "nid", 300).count() == 1000
    terms = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "tid long, label string")
    ten = corpus.assign_balanced(df.limit(10), terms)
    assert sorted(r.n for r in corpus.distribution(ten).collect()) == [3, 3, 4]
    from chunkweave.operators import corpus as c

    rows, c.PART_ROWS = c.PART_ROWS, 90  # ranges are cut where the rows lie, one far id or not
    far = df.unionByName(spark.createDataFrame([(10**15,)], "nid long"))
    assert {r.nid: r.i for r in corpus.numbered(far, "nid").collect()} == {n: i for i, n in enumerate([*sorted(ids), 10**15])}
    c.PART_ROWS = rows
    assert corpus.numbered(df.limit(0), "nid").count() == 0 and corpus.assign_balanced(df, terms.limit(0)).where("tid is null").count() == 1000


def test_corpus_and_chat(spark):
    nodes = spark.createDataFrame([(1, None, "topic"), (2, "", "page"), (3, "x", "topic"), (4, "", "other")], "nid long, body string, type string")
    assert sorted(r.nid for r in corpus.missing_field(nodes, "body", ["topic", "page"]).collect()) == [1, 2]
    saved = corpus.save_collection(spark.createDataFrame([(5, "T", [1, None])], "collection_id long, title string, nids array<long>")).first()
    assert saved.nids == [1, 0] and saved.message == 'Successfully created collection "T" with 2 item(s). Collection URL: /node/5'
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "system", "b"), (1, 3, "assistant", "c"), (1, 4, None, "d")], "conv_id long, turn long, role string, text string")
    assert [r.text for r in chat.history(turns).orderBy("turn").collect()] == ["a", "c"]
    made = corpus.generate_keywords(spark.createDataFrame([(1, "p"), (2, "q")], "nid long, prompt string"), lambda ps: [p.upper() for p in ps]).collect()
    assert {(r.nid, r.raw) for r in made} == {(1, "P"), (2, "Q")}


def test_models(spark):
    text = "The Barford Porters Union met Ann Lee at Kell Hall. ann left"
    assert entities.by_pattern(text) == [("ORG", "Barford Porters Union"), ("PERSON", "Ann Lee"), ("FAC", "Kell Hall")]
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "chunk_id string, text string")
    assert {r.chunk_id: len(r.entities) for r in entities.extract(rows, "chunk_id").collect()} == {"a": 3, "b": 0, "c": 0}
    hashed = embed.hashing()

    def fragile(texts, task):
        if len(texts) > 1 or not texts[0]:
            raise ValueError
        return hashed(texts, task)

    got = {r.chunk_id: r.vector for r in embed.embed_texts(rows, "chunk_id", fragile).collect()}
    assert np.linalg.norm(got["a"]) == pytest.approx(1, abs=1e-6) and not any(got["b"]) and len(got["c"]) == 64
    tries = []

    def third(texts, task):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return hashed(texts, task)

    assert len(embed.with_retry(third, wait=0)(["x"], "query")) == 1 and len(tries) == 3
    assert embed.dimension(spark.createDataFrame([(None,), ([],), ([1.0, 2.0],)], "vector array<float>")) == 2


def test_export_and_windows(spark):
    rows = [
        (1, None, "<b>" + "word " * 130 + "</b>", None, None, "topic", 1, "2024-01-02"), (1, "old", "x", "", [], "topic", 1, "2024-01-01"), (2, "t", "short", "", [], "topic", 1, "2024-01-01"),
        (3, "t", "gone " * 9, "", [], "topic", 0, "2024-01-01"), (4, "t", "page " * 9, "", ["k"], "page", 1, "2024-01-01"), (5, "t", None, "", [], "topic", 1, None),
    ]
    df = spark.createDataFrame(rows, "nid long, title string, body string, age_range string, keywords array<string>, type string, status int, changed string")
    df = df.withColumn("changed_at", F.to_timestamp("changed"))
    out = {r.nid: r for r in published(df).collect()}
    assert set(out) == {1, 2, 5} and out[1].title == "" and out[1].keywords == [] and out[5].body == ""
    assert [r.nid for r in published(df, 4).collect()] == [4] and published(df, 3).count() == 0
    assert sorted(r.chunk_id for r in chunk_windows(published(df)).collect()) == ["nid_1_c_0", "nid_1_c_1"]


def test_store_stages_and_sync(spark):
    base = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    path = base + "/s"
    store.create(spark, path)
    assert store.read(spark, path).count() == 0
    old = chunks(spark, [("nid_1_c_0", 1, unit(0), ["PERSON:A"], [], ""), ("nid_2_c_0", 2, unit(0, lean=0.1), ["PERSON:A"], [], ""), ("odd", None, None, [], [], "")])
    store.insert(old.drop("idx"), path)
    store.create(spark, path)  # what is there stays
    stored = store.read(spark, path)
    assert stored.count() == 3 and [f.split()[0] for f in store.CHUNK.split(", ")] + ["bucket"] == stored.columns
    assert not store.may_rebuild(spark, path, resume=True, has_stages=False) and store.may_rebuild(spark, path, False, False)
    assert store.by_ids(stored, spark.createDataFrame([("nid_1_c_0",), ("no",), ("nid_1_c_0",)], "chunk_id string")).count() == 1
    store.upsert_neighbours(spark, path, spark.createDataFrame([("nid_2_c_0", ["ORG:nid_1_c_0"]), ("gone", ["x"])], "chunk_id string, neighbors array<string>"))
    assert {r.chunk_id: r.neighbors for r in store.read(spark, path).collect()} == {"nid_1_c_0": None, "nid_2_c_0": ["ORG:nid_1_c_0"], "odd": None}
    gone = spark.createDataFrame([(1,), (None,), (77,)], "nid long")
    store.change_nodes(spark, path, gone, chunks(spark, [("nid_77_c_0", 77, unit(1), [], [], ""), ("nid_5_c_0", 5, unit(1), [], [], "")]))
    assert {r.chunk_id for r in store.read(spark, path).collect()} == {"nid_2_c_0", "odd", "nid_77_c_0"}  # only chunks of the named nodes come in
    store.change_nodes(spark, path, spark.createDataFrame([(77,), (2,)], "nid long"))
    assert {r.chunk_id for r in store.read(spark, path).collect()} == {"odd"}
    stages, calls = store.Stages(spark, uuid.uuid4().hex), []

    def make():
        calls.append(1)
        return spark.range(3)

    key = store.fingerprint("v1", {"k": 1})
    assert stages.run("a", key, make).count() == 3 and stages.run("a", key, make).count() == 3 and len(calls) == 1
    assert stages.run("a", store.fingerprint("v2"), make).count() == 3 and len(calls) == 2
    stages.clear()
    stages.run("a", key, make)
    assert len(calls) == 3
    assert store.load_threshold(spark, base + "/none") == 0.55
    store.save_threshold(spark, 0.7, base + "/t")
    assert store.load_threshold(spark, base + "/t") == 0.7

    nodes = spark.createDataFrame([(1, "t", "new words for this node " * 4, "", [], "page", 1), (2, "t", "b", "", [], "topic", 0)], "nid long, title string, body string, age_range string, keywords array<string>, type string, status int")
    nodes = nodes.withColumn("changed_at", F.current_timestamp())

    def enrich(c):
        return c.withColumn("entities", F.array(F.lit("PERSON:A"))).withColumn("vector", F.array(*[F.lit(float(x)) for x in unit(0)]).cast("array<float>"))

    old = old.where("source_nid is not null")
    more = old.unionByName(chunks(spark, [("nid_3_c_0", 3, unit(0, lean=0.2), ["PERSON:A"], [], "")]))
    new = sync.resync(spark.createDataFrame([(1,), (2,), (None,)], "nid long"), nodes, more, enrich).collect()
    assert [(r.chunk_id, r.neighbors) for r in new] == [("nid_1_c_0", ["PERSON:nid_3_c_0"])]  # not to deleted chunks, none for the unpublished node


def test_build_and_synchronise_a_store(spark):
    from chunkweave.operators import build

    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    made = []
    raw = [(i, "t", f"words of node {i} and the rest of it " * (1 + i), "", ["k"], "topic", 1) for i in range(1, 7)]
    schema = "nid long, title string, body string, age_range string, keywords array<string>, type string, status int"
    nodes = spark.createDataFrame(raw, schema).withColumn("changed_at", F.lit("2025-01-01").cast("timestamp"))

    def enrich(c):
        made.append(1)
        v = F.array(*[F.when(F.pmod("source_nid", F.lit(2)) == i % 2, F.lit(1.0)).otherwise(0.1) + F.col("source_nid") * F.lit(0.01 * i) for i in range(64)])
        return c.withColumn("entities", F.array(F.lit("PERSON:A"))).withColumn("vector", v.cast("array<float>"))

    built = build.build_graph(nodes, path, enrich, "m")
    assert {r.source_nid for r in built.collect()} == set(range(1, 7)) and store.load_threshold(spark, path + "/threshold") > 0
    edges = [x for r in built.collect() for x in r.neighbors]
    n = built.count()
    assert edges and all(x.startswith("PERSON:nid_") for x in edges)
    again = build.build_graph(nodes, path, enrich, "m", resume=True)
    assert len(made) == 1 and again.count() == n  # the steps are taken up again
    build.build_graph(nodes, path, enrich, "m")
    assert len(made) == 2  # a full build starts anew
    later = nodes.unionByName(spark.createDataFrame([(2, "t", "one short new text", "", [], "topic", 1), (3, "t", "x", "", [], "topic", 0)], schema).withColumn("changed_at", F.lit("2025-02-01").cast("timestamp")))
    for _ in range(2):  # the same change twice
        sync.apply(spark.createDataFrame([(2,), (3,), (None,)], "nid long"), later, path, enrich)
        now = {r.chunk_id: r for r in store.read(spark, path + "/chunks").collect()}
        assert now["nid_2_c_0"].text == "one short new text" and {r.source_nid for r in now.values()} == {1, 2, 4, 5, 6}
    empty = build.build_graph(nodes.limit(0), path + "-none", enrich, "m")
    assert empty.count() == 0


def test_shared_folder_without_a_setting(monkeypatch):
    from types import SimpleNamespace

    from chunkweave import session

    made = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local[2]", applicationId="app-1"))
    assert session.shared_dir(made) == session.shared_dir(made) and session.shared_dir(made).startswith("file:///")
    made.sparkContext.master = "spark://x"
    with pytest.raises(ValueError):
        session.shared_dir(made)
