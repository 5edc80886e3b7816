import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkweave.functions import scoring as sc
from chunkweave.functions import text as tx
from chunkweave.functions.lexicon import STOP_WORDS

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def apply(spark, values, kind, *columns):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + kind)
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_windows(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 100, 101, 120, 121, 250)] + [None, "   ", "a b\tc"]
    got = apply(spark, [(t,) for t in texts], "t string", tx.windows("t"))
    for t, w in zip(texts, got):
        words = (t or "").split()
        assert [(x.offset, x.text) for x in w] == [(i, " ".join(words[i : i + 120])) for i in range(0, len(words), 100)]


def test_strip_tags(spark):
    cases = {
        "a <b>c</b>": "a c", "x<!-- > y -->z": "xz", '<a href="a>b">t</a>': "t", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "<script>s</script>": "s", "open <b": "open <b", "<br/>": "", "<p\nclass='>'>q": "q",
    }
    assert apply(spark, [(k,) for k in cases] + [(None,)], "t string", tx.strip_tags("t")) == [*cases.values(), ""]
    long = "<a " + "x" * 50_000 + " <b>" * 2_000
    assert apply(spark, [(long,)], "t string", F.length(tx.strip_tags("t")))[0] < len(long)


@given(st.lists(st.text(alphabet="ab ,0", max_size=12), min_size=1, max_size=30))
@SLOW
def test_split_keywords(spark, lines):
    got = apply(spark, [(x,) for x in lines], "t string", tx.split_keywords("t"))
    assert got == [[p.strip(" ") for p in x.split(",") if p.strip(" ") not in ("", "0")] for x in lines]


@given(st.lists(st.text(alphabet="aThe xyof9-é\t", max_size=25), min_size=1, max_size=30))
@SLOW
def test_tokenize(spark, lines):
    got = apply(spark, [(x,) for x in lines], "t string", tx.tokenize("t"))
    model = lambda x: [t for t in re.split(r"\s+", re.sub(r"[^a-zA-Z0-9\s]", "", x, flags=re.A).lower(), flags=re.A) if len(t) > 2 and t not in STOP_WORDS]
    assert got == [model(x) for x in lines]


def test_typed(spark):
    rows = apply(spark, [("PERSON:A:b",), ("plain",), (":x",), ("",)], "t string", tx.parse_typed("t"), tx.strip_type("t"))
    assert [((p.type, p.value), s) for p, s in rows] == [(("PERSON", "A:b"), "A:b"), (("semantic", "plain"), "plain"), (("", "x"), "x"), (("semantic", ""), "")]


def test_keyword_lines(spark):
    raw = '1. A\n2) B\r\n- C\n• D\n"E",\n\n* F;\n 7. - G.\nH\nI'
    assert apply(spark, [(raw,), (None,), ("",)], "t string", tx.parse_keyword_lines("t")) == [list("ABCDEFGH"), [], []]


def test_structured(spark):
    j = json.dumps({"response_type": "results", "message": "m", "search_suggestions": ["s"]})
    texts = [j, f"Look:\n```json\n{j}\n```", f"Sure {j}", '{"message":"no type"}', "plain", None, "```\n{bad}\n```"]
    got = apply(spark, [(t,) for t in texts], "t string", tx.parse_structured("t"))
    assert [g and (g.response_type, g.message, g.search_suggestions) for g in got] == [("results", "m", ["s"])] * 3 + [None] * 4


def test_message(spark):
    cases = {
        '{"message":"m","response_type":"r"}': "m", 'before {"response_type":"r","message":"m"}': "before\n\nm", 'x {"response_type": broken': "x",
        'y { "a":1,"response_type":"r"': "y", "plain": "plain", '{"response_type":"r"}': "",
    }
    assert apply(spark, [(k,) for k in cases], "t string", tx.message_of("t")) == list(cases.values())


def test_envelope_and_escapes(spark):
    cases = {
        '["a","b"]': ["a", "b"], '{"Data":{"StringData":{"data":["a"]}}}': ["a"], '"[\\"a\\",\\"b\\"]"': ["a", "b"], "7": [], None: [], "": [], "{bad": [],
    }
    assert apply(spark, [(k,) for k in cases], "t string", tx.array_envelope("t")) == list(cases.values())
    assert apply(spark, [('<a href="x">&',)], "t string", tx.html_escape("t")) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert apply(spark, [("a b&c é!",)], "t string", tx.url_term("t")) == ["a+b%26c+%C3%A9!"]
    assert apply(spark, [("Good. See the suggestions below!  Bye.",)], "t string", tx.strip_cue("t")) == ["Good. Bye."]
    assert apply(spark, [(" q ", "5-8"), ("q", "All"), ("q", None)], "t string, a string", tx.compose_message("t", "a")) == ["q\n\nFilters: Age range: 5-8.", "q", "q"]
    assert apply(spark, [(["ORG", "X", "ORG"],), (None,)], "t array<string>", tx.filter_hints("t")) == [["ORG"], []]


sets = st.lists(st.sampled_from(["PERSON:a", "ORG:a", "GPE:B", "GPE:b", "FAC:c", "LOC:d", "EVENT:e", "NORP:f", "x"]), max_size=6)


@given(st.lists(st.tuples(sets, sets), min_size=1, max_size=40))
@SLOW
def test_jaccard_and_classes(spark, pairs):
    got = apply(spark, pairs, "a array<string>, b array<string>", sc.jaccard(F.col("a"), F.col("b")), sc.classify_edge(F.col("a"), F.col("b")))

    def kind(a, b):
        named = lambda xs: {e.split(":", 1)[1].lower(): e.split(":", 1)[0] for e in xs if ":" in e}
        x, y = named(a), named(b)
        kinds = {x[n] for n in x if n in y}
        return next((k for k in ("PERSON", "EVENT", "NORP", "ORG", "GPE") if k in kinds), "semantic")

    for (a, b), (j, k) in zip(pairs, got):
        want = len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
        assert j == pytest.approx(want) and k == kind(a, b)


def test_boost_dot_and_lexical(spark):
    k = "h array<string>, k array<string>"
    rows = [(["march"], ["The March on"]), (["a", "zz"], ["ba"]), ([], ["x"]), (["x"], []), ([""], ["x"]), (None, ["x"])]
    assert apply(spark, rows, k, sc.keyword_boost(F.col("h"), F.col("k"))) == pytest.approx([1.3, 1.15, 1.0, 1.0, 1.3, 1.0])
    v = [([1.0, 2.0], [3.0, -1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    assert apply(spark, v, "a array<double>, b array<double>", sc.dot(F.col("a"), F.col("b")), sc.cosine(F.col("a"), F.col("b"))) == [(1.0, pytest.approx(1 / 50**0.5)), (None, 0.0), (0.0, 0.0)]
    t = [(["aa", "aa", "b"], "aaaa b word", ["ORG:xaab", "b"]), (["aa"], None, [])]
    got = apply(spark, t, "t array<string>, x string, e array<string>", sc.lexical_score(F.col("t"), F.col("x"), F.col("e")))
    assert got == pytest.approx([(2 + 2 + 1) / 3**0.5 + 0.5 * 4, 0.0])
