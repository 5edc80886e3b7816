import random

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkweave.llm import leaks


def brute(doc, passage, run):
    a, b = leaks.words(doc), leaks.words(passage)
    grams = {tuple(b[i : i + run]) for i in range(len(b) - run + 1)}
    return sum(tuple(a[i : i + run]) in grams for i in range(len(a) - run + 1))


@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.integers(3, 6))
@settings(max_examples=300, deadline=None)
def test_search_against_brute_force(doc, passages, run):
    texts = [" ".join(p) for p in passages]
    tables = leaks.Tables(list(enumerate(texts)), run)
    want = {i: n for i, p in enumerate(texts) if (n := brute(" ".join(doc), p, run))}
    assert tables.search(leaks.words(" ".join(doc))) == want


def test_words():
    assert leaks.words("It's ÉTÉ_3x—no!") == ["it", "s", "été", "3x", "no"]


def test_table(spark, monkeypatch):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(50)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passages = [(i, text(30)) for i in range(6)] + [(6, None), (7, "too short"), (8, "")]
    passages.append((9, passages[0][1]))  # two items share a passage
    docs = [(100, text(40) + " " + passages[0][1][:80] + " " + text(5)), (101, passages[3][1].upper().replace(" ", " -- ")), (102, None), (103, ""), (104, text(3000)), (101, "other"), (None, passages[1][1])]
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 150)  # several blocks
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(a, b, "x") for a, b in passages], "item_id long, passage string, doc_id string")
    got = {(r.doc_id, r.item_id): r.n_runs for r in leaks.find_leaks(d, i).collect()}
    want = {}
    for doc, t in docs:
        for item, p in passages:
            if doc is not None and t and p and (n := brute(t, p, 12)):
                want[doc, item] = max(n, want.get((doc, item), 0))
    assert got == want and (101, 3) in got and (100, 9) in got
    assert leaks.find_leaks(d, i.limit(0)).count() == 0 and leaks.find_leaks(d.limit(0), i).count() == 0
