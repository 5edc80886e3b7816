import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkweave.llm import name_variants as nv

SCHEMA = "name string, type string, context long, form string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@given(st.lists(st.text(alphabet="abc", max_size=8), min_size=1, max_size=6), st.lists(st.text(alphabet="abc", max_size=8), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_distances_agree_and_are_a_metric(a, b):
    d = nv.distances(a, b)
    assert all(d[i, j] == nv.distance(x, y) for i, x in enumerate(a) for j, y in enumerate(b))
    for x in a:
        for y in b:
            assert (nv.distance(x, y) == 0) == (x == y) and nv.distance(x, y) == nv.distance(y, x)
            for z in a:
                assert nv.distance(x, z) <= nv.distance(x, y) + nv.distance(y, z)


def test_distance_counts_swaps():
    assert nv.distance("abcd", "abdc") == 1 and nv.distance("ca", "abc") == 2 and nv.distance("", "abc") == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_near_forms_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(nv, "FORMS_PER_PIVOT", 20)
    rnd = random.Random(seed)
    forms = {"".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 9))) for _ in range(350)}
    for f in list(forms)[:150]:
        i = rnd.randrange(len(f))
        forms.add(rnd.choice([f[:i] + f[i + 1 :], f[:i] + "z" + f[i:], f[:i] + f[i + 1 : i + 2] + f[i : i + 1] + f[i + 2 :]]))
    forms = sorted(forms)
    got = {(r.a, r.b) for r in nv.near_forms(spark.createDataFrame([(f,) for f in forms], "form string")).collect()}
    assert got == {(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if nv.distance(a, b) <= 1}


def test_plain_forms():
    p = nv.plain
    assert p("Rev. Zoë Q. Hall", "PERSON") == ("zoe hall", "full") == p("HALL, Zoe", "PERSON")
    assert p("Hall, Z.", "PERSON") == ("z hall", "initial") == p("Z. Hall", "PERSON")
    assert p("Porters' Union of Barford", "ORG") == ("barford porters union", "full") == p("The Barford Porters Un., Inc.", "ORG")
    assert p("Barford P.U.", "ORG") == ("barford pu", "initials")
    assert p("Weavers & Dyers Soc.", "ORG") == p("weavers and dyers society", "ORG")
    assert p("Marce1a H0bday", "PERSON")[0] == "marcela hobday" and p("Local 10 Union", "ORG")[0] == "local 10 union"
    assert p("  ", "PERSON")[0] == "" and p("Dr.", "PERSON")[0] == "dr"


def test_bearers(spark):
    full = [("Theodore Marwick", 9), ("Susannah Marwick", 9), ("Theodore Dunster", 9), ("Walter Dunster", 9), ("Walter Hobday", 9), ("Theodore Hobday", 9), ("Susannah Dunster", 9), ("Walter Marwick", 8)]
    rows = [(n, "PERSON", c) for n, k in full for c in range(k)]
    rows += [(n, "PERSON", 1) for n in ("Ted Marwick", "T. Marwick", "THEODORE  MARWICK", "Marwick, Theodore", "Marwick Theodore", "Theodore Q. Marwick", "Theodor Marwick", "Thoedore Marwick", "Theodore Marvick", "Theo Marwick", "Ted Marwik")]
    rows += [(f"Barford Porters {w}", "ORG", c) for w in ("Union", "League") for c in range(5)]
    rows += [(n, "ORG", 2) for n in ("Barford P.U.", "Porters Union of Barford", "barford porters unoin", "The Barford Porters Union, Inc.")]
    rows += [(None, "PERSON", 1), (" ", "ORG", 1), ("Barford", "GPE", 1), ("Theodore Marwick", "PERSON", None)]
    linked = nv.link_names(frame(spark, rows))
    by = {}
    for r in linked.collect():
        by.setdefault(r.bearer, set()).add(r.name)
    assert by["theodore marwick"] == {"Theodore Marwick", "Ted Marwick", "T. Marwick", "THEODORE MARWICK", "Marwick, Theodore", "Marwick Theodore", "Theodore Q. Marwick", "Theodor Marwick", "Thoedore Marwick", "Theodore Marvick", "Theo Marwick", "Ted Marwik"}
    assert by["barford porters union"] == {"Barford Porters Union", "Barford P.U.", "Porters Union of Barford", "barford porters unoin", "The Barford Porters Union, Inc."}
    assert by["walter marwick"] == {"Walter Marwick"} and by["barford porters league"] == {"Barford Porters League"}
    pairs = [tuple(r) for r in nv.name_pairs(linked).collect()]
    assert len(pairs) == len(set(pairs)) == 12 * 11 // 2 + 5 * 4 // 2 and all(a < b for a, b in pairs)


def test_rival_bearers_are_told_apart_by_context_or_left_alone(spark):
    rows = [("Walter Marwick", "PERSON", 1), ("William Marwick", "PERSON", 2), ("W. Marwick", "PERSON", 2), ("Samuel Hobday", "PERSON", 3), ("Stephen Hobday", "PERSON", 4), ("S. Hobday", "PERSON", 9)]
    by = {r.name: r.bearer for r in nv.link_names(frame(spark, rows)).collect()}
    assert by["W. Marwick"] == "william marwick" and by["S. Hobday"] == "s hobday"
    assert nv.link_names(frame(spark, [])).count() == 0


def test_long_chains_and_names_of_both_types(spark):
    steps = [(f"f{i:02}", f"f{i + 1:02}") for i in range(21)] + [("g", "f20")]
    got = {r.form: r.root for r in nv._roots(spark.createDataFrame(steps, "form string, base string")).collect()}
    assert set(got.values()) == {"f21"} and len(got) == 22
    rows = [("Walter Marwick, Jr.", "PERSON", c) for c in range(9)] + [("Walter Marwick, Jr.", "ORG", 99)] + [("Walter Marwick", "PERSON", c) for c in range(9)]
    by = {r.name: r.bearer for r in nv.link_names(frame(spark, rows)).collect()}
    assert by["Walter Marwick, Jr."] == by["Walter Marwick"] == "walter marwick"


def test_cells_in_cells_lose_no_pair(spark, monkeypatch):
    for name, value in {"FORMS_PER_PIVOT": 10, "FAN": 4, "CELL": 25, "PART": 60}.items():
        monkeypatch.setattr(nv, name, value)
    rnd = random.Random(6)
    forms = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 8))) for _ in range(500)})
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    placed = nv.cells(df, 1).collect()
    assert sorted(r.form for r in placed if r.home) == forms and len({r.cell for r in placed}) > 4
    got = {(r.a, r.b) for r in nv.near_forms(df, 1).collect()}
    assert got == {(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if nv.distance(a, b) <= 1}
    assert nv.near_forms(df.limit(0)).count() == 0


def test_two_edit_misreadings_and_two_errors_in_one_name(spark):
    others = ("Walter", "Susannah", "Theodore")
    full = [("Oliver Kinmivik", 9), ("Patricia Vuntequist", 9), ("Cornelius Favzester", 9), ("Dorothy Fumpender", 9), ("Samuel Famgender", 7), ("Samuel Fumpender", 8), ("Harriet Lesvuback", 6), ("Oliver Solgetz", 5)]
    full += [(f"{g} {s}", 3) for g in others for s in ("Kinmivik", "Vuntequist", "Fumpender", "Solgetz")] + [("Rudkemere Voters Council", 5)]
    rows = [(n, "ORG" if "Council" in n else "PERSON", c) for n, k in full for c in range(k)]
    wrong = {
        "Oliver Kinrnivik": "oliver kinmivik", "Patricia Vuntekwist": "patricia vuntequist", "Rudkernere Voters Council": "rudkemere voters council",
        "Comelius Favzester": "cornelius favzester", "Pat Vuntekwist": "patricia vuntequist", "Doorthy Fumpendr": "dorothy fumpender", "Olivr Sogletz": "oliver solgetz",
        "Harriet Lesvubcaak": "harriet lesvuback",
    }
    rows += [(n, "ORG" if "Council" in n else "PERSON", c) for n in wrong for c in (1, 2)]
    by = {r.name: r.bearer for r in nv.link_names(frame(spark, rows)).collect()}
    assert {n: by[n] for n in wrong} == wrong
    assert by["Samuel Famgender"] == "samuel famgender" and by["Samuel Fumpender"] == "samuel fumpender"


def test_near_forms_at_two_edits(spark, monkeypatch):
    monkeypatch.setattr(nv, "FORMS_PER_PIVOT", 20)
    rnd = random.Random(3)
    forms = sorted({"".join(rnd.choice("abcd ") for _ in range(rnd.randint(3, 9))) for _ in range(250)})
    got = {(r.a, r.b, r.d) for r in nv.near_forms(spark.createDataFrame([(f,) for f in forms], "form string"), 2).collect()}
    assert got == {(a, b, d) for i, a in enumerate(forms) for b in forms[i + 1 :] if (d := nv.distance(a, b)) <= 2}


def test_replicas_reach_one_radius_beyond_the_nearest_pivot(spark, monkeypatch):
    monkeypatch.setattr(nv, "FORMS_PER_PIVOT", 20)
    rnd = random.Random(8)
    stem = lambda: "".join(rnd.choice(x) for x in ("bdfghklm", "aeiou", "lmnrst", "bdgkpt", "aiou"))
    forms = sorted({f"{rnd.choice(['robert', 'walter', 'zoë'])} {stem()}{rnd.choice(['ster', 'quist'])}" for _ in range(500)} | {"x" * 70, "x" * 71 + "y", "", "日本", "本日"})
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    reach = {}
    for r in nv.cells(df, 2).collect():
        reach.setdefault(r.form, []).append(r.d)
    assert sorted(reach) == forms and max(map(len, reach.values())) > 1
    assert all(max(d) - min(d) <= 2 for d in reach.values())  # twice the radius before: a crowd was in nearly all cells
    d = nv.distances(forms, forms)
    want = {(a, b, int(d[i, j])) for i, a in enumerate(forms) for j, b in enumerate(forms) if a < b and d[i, j] <= 2}
    assert {tuple(r) for r in nv.near_forms(df, 2).collect()} == want and ("日本", "本日", 1) in want and ("x" * 70, "x" * 71 + "y", 2) in want
