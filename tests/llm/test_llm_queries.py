import pytest
from oracle import FOLDER, compare

from chunkweave.llm import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0 or name in ("p3_found", "p3_quality")  # 22 nodes have too few labels to train on


def test_the_mix_keeps_its_plan(spark):
    rows = QUERIES["p7_shares"](spark, FOLDER).collect()
    assert rows and all(0 <= r.mixed <= r.quota_tokens for r in rows) and abs(sum(r.actual_share for r in rows) - 1) < 1e-9


def test_columns(spark):
    want = {
        "p1_found": ["field", "chunk_id_a", "chunk_id_b"], "p2_found": ["chunk_id_a", "chunk_id_b"], "p3_found": ["nid"], "p4_found": ["name_a", "name_b"],
        "p5_found": ["item_kind", "item_key", "cut_kind"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, FOLDER)
        assert df.columns == columns
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows))
