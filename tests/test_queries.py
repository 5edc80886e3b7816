import pytest
from oracle import FOLDER, compare

from chunkweave.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def _chunks(spark):
    """The clean chunks, as Python rows by id."""
    from chunkweave.plans import views

    return {r.chunk_id: r for r in views.chunks(spark, FOLDER).collect()}


def _rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_every_query_without_sql_is_tested_here():
    assert set(QUERIES) - set(SQL) <= {
        "build_graph_edges", "build_index", "build_neighbors", "corpus_threshold", "corpus_with_neighbors", "embed_doc", "index_recall", "json_extract_message",
        "llm_keywords", "ner_query", "neighbor_lists", "retrieve_built", "search_index", "seed_balanced_rows", "sync_incremental", "udf_ner", "udf_llm_keywords",
    }


def test_graph_queries_without_sql(spark):
    import numpy as np

    chunks = _chunks(spark)
    with_vector = {k: np.array(c.vector, float) for k, c in chunks.items() if c.vector is not None}
    edges = _rows(spark, "build_neighbors")
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    assert len(edges) > 0.1 * 10 * len(with_vector) and len({(r.src, r.dst) for r in edges}) == len(edges)
    assert all(abs(r.cosine - cos(with_vector[r.src], with_vector[r.dst])) < 1e-4 and r.src != r.dst and 1 <= r.ann_rank <= 10 for r in edges)
    lists = {r.chunk_id: r.neighbors for r in _rows(spark, "neighbor_lists")}
    assert {k: len(x) for k, x in lists.items()} == {k: sum(r.src == k for r in edges) for k in lists}
    assert {x.split(":", 1)[1] for x in lists[edges[0].src]} == {r.dst for r in edges if r.src == edges[0].src}
    recall = _rows(spark, "index_recall")[0]
    assert recall.recall >= 0.9 and recall.n == 10 * sum(c.idx % 20 == 0 and c.vector is not None for c in chunks.values())
    assert sum(r.n for r in _rows(spark, "build_index")) == len(with_vector)
    names = sorted(with_vector)
    unit = np.array([with_vector[n] / np.linalg.norm(with_vector[n]) for n in names])
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    best = dict(zip(names, s.max(axis=1)))
    found = {r.src: r.cosine for r in _rows(spark, "search_index")}
    assert set(found) == set(names) and np.mean([found[n] >= best[n] - 1e-3 for n in names]) >= 0.9


def test_build_and_sync_without_sql(spark):
    built = {r.chunk_id: r for r in _rows(spark, "build_graph")}
    edges = _rows(spark, "build_graph_edges")
    ends = [(r.chunk_id, r.neighbor.split(":", 1)) for r in edges]
    assert edges and all(a in built and b in built and a != b and kind in ("PERSON", "EVENT", "NORP", "ORG", "GPE", "semantic") for a, (kind, b) in ends)
    assert all(0 <= r.place < 10 for r in edges) and len(edges) <= 0.2 * 10 * len(built) + 10
    new = _rows(spark, "sync_incremental")
    assert new and all(0 <= r.n_neighbors <= 10 and r.chunk_id.startswith(f"nid_{r.source_nid}_c_") for r in new)
    vectors = _rows(spark, "embed_doc")[0]
    assert vectors.n == len(_chunks(spark)) and vectors.n_zero <= 2 and 0.98 <= vectors.mean_norm <= 1


def test_other_queries_without_sql(spark):
    terms = _rows(spark, "seed_balanced_rows")
    counts = [sum(r.tid == t for r in terms) for t in {r.tid for r in terms}]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1 and len({r.nid for r in terms}) == len(terms)
    built = {r.query_id: r for r in _rows(spark, "retrieve_built")}
    exact = {r.query_id: r for r in _rows(spark, "retrieve")}
    assert set(built) == set(exact) and all(1 <= r.result_count <= 35 for r in built.values())
    assert all(built[q].nids.split(",")[0] == exact[q].nids.split(",")[0] for q in exact)  # the first seed's document


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_corpus_figures_take_every_chunk(spark):
    import numpy as np

    from chunkweave.plans import views

    rows = [r for r in views.chunks(spark, FOLDER, "vector", "entities", "keywords").collect() if r.vector is not None]
    x = np.array([r.vector for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    ids = np.array([r.chunk_id for r in rows])
    scores = [
        [0.60 * s[i, j] + 0.25 * jaccard(a.entities, rows[j].entities) + 0.15 * jaccard(a.keywords, rows[j].keywords) for j in np.lexsort((ids, -np.round(s[i], 6)))[:10]]
        for i, a in enumerate(rows)
    ]
    t = np.percentile(scores, 85)
    got = QUERIES["corpus_threshold"](spark, FOLDER).first()
    assert got.n == 10 * len(rows) and np.allclose([got.low, got.high, got.threshold], [np.min(scores), np.max(scores), t], atol=1e-4)
    kept = QUERIES["corpus_with_neighbors"](spark, FOLDER).first()
    assert abs(kept.n_edges - np.sum(scores >= t)) <= 0.002 * got.n and abs(kept.n_chunks - np.sum(np.max(scores, axis=1) >= t)) <= 0.01 * len(rows)
