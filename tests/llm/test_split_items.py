from hypothesis import given, settings
from hypothesis import strategies as st

from chunkweave.llm import split_items as si

SCHEMA = "item_kind string, item_key string, text string, max_size int, overlap int, extra string"


def brute_marks(text):
    out = set()
    for i in range(1, len(text)):
        before = text[:i]
        if before.endswith("\n"):
            out.add(i)
        stripped = before.rstrip()
        tail = stripped.rstrip("\"'”’)]")
        ended = len(stripped) < len(before) and not text[i].isspace() and tail.endswith((".", "!", "?"))
        if ended:
            out.add(i)
    return sorted(out)


@given(st.text(alphabet="ab .!?\n\"')”", max_size=60))
@settings(max_examples=300, deadline=None)
def test_boundaries_against_brute_force(text):
    assert si.boundaries(text) == brute_marks(text)


@given(st.integers(1, 300), st.sets(st.integers(1, 299)), st.integers(2, 60), st.data())
@settings(max_examples=300, deadline=None)
def test_pieces_cover_and_fit(size, marks, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    marks = sorted(m for m in marks if m < size)
    pieces = si.cut(size, marks, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == size
    for (a, b, how), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap
        following = min([m for m in [*marks, size] if m > b])
        assert b - c == min(overlap, b - a - 1) or c + limit == following  # the whole overlap, but for a boundary that needs the room
        assert how == "forced" or b in marks
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    if si.longest_stretch(marks, size) <= limit:
        assert all(how != "forced" for *_, how in pieces)


def test_overlap_is_kept_where_no_boundary_lies_in_it():
    assert si.cut(100, [40], 50, 10)[:2] == [(0, 40, "natural"), (30, 80, "forced")]


@given(st.text(alphabet="ab .!?\n\"é", max_size=80), st.integers(2, 9), st.data())
@settings(max_examples=200, deadline=None)
def test_token_pieces(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    ends = si.token_ends()(text)
    if not ends:
        return
    _, pieces = si.cut_tokens(text, limit, overlap, ends)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert 0 < len(text[a:b].split()) <= limit
    for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        assert len(text[c:b].split()) <= overlap


def test_tokens_of_a_vocabulary(spark):
    from chunkweave.llm import source_mix as sm

    text = "Ünïcode — words, and “more” words. " * 60
    rows = spark.createDataFrame([("body", "1", text, 50, 5, ""), ("body", "2", "short text", 50, 5, ""), ("body", "3", None, 50, 5, "")], SCHEMA)
    got = si.split_oversized(rows, tokens=True, vocabulary=sm.VOCABULARY).collect()
    enc = sm._encoding(sm.VOCABULARY)
    assert [r.item_key for r in got] == ["1"] and "".join(text[p.start : p.stop] for p in got[0].pieces[:1]) == got[0].pieces[0].text
    assert all(len(enc.encode_ordinary(p.text)) <= 53 for p in got[0].pieces) and got[0].pieces[-1].stop == len(text)
    assert all(a.stop > b.start > a.start for a, b in zip(got[0].pieces, got[0].pieces[1:]))


def test_rows_of_all_kinds(spark):
    long = "One two three. " * 40
    rows = [
        ("body", "1", long, 100, 20, "x"), ("body", "2", "a" * 250, 100, 20, None), ("body", "3", "short", 100, 20, ""),
        ("body", "4", None, 100, 20, ""), ("body", None, long, 100, 0, ""), ("body", "1", long, 100, 20, "x"), ("body", "5", "", 100, 1, ""),
        ("body", "6", "b" * 100, 100, 1, ""),
    ]
    got = si.split_oversized(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.item_key or "", r.cut_kind) for r in got) == [("", "natural"), ("1", "natural"), ("1", "natural"), ("2", "forced")]
    for r in got:
        text = long if r.item_key != "2" else "a" * 250
        assert all(p.text == text[p.start : p.stop] for p in r.pieces)
    assert si.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
