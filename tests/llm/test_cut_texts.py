import random

from chunkweave.llm import cut_texts as ct

SCHEMA = "doc_id long, source string, text string, chars int, word string"


def corpus(seed=1, n=1500):
    """Documents of whole sentences, and what each would be if cut at its source's limit."""
    rnd = random.Random(seed)
    names = [a + b + c for a in ("Bar", "Kel", "Tos", "Vim", "Dul") for b in ("en", "or", "is") for c in ("ford", "dale", "wick", "ham")]
    opens = ["The council of {n} rejected", "Residents of {n} welcomed", "Nobody in {n} remembered", "By spring the workers of {n} had seen"]
    middles = ["the proposed settlement", "a further inquiry", "another delegation", "several unsigned petitions"]
    ends = ["before the winter", "with great reluctance", "despite considerable opposition", "under the old bridge"]
    sentence = lambda: f"{rnd.choice(opens)} {rnd.choice(middles)} {rnd.choice(ends)}.".format(n=rnd.choice(names))
    docs, truth = [], set()
    for i in range(n):
        text = " ".join(sentence() for _ in range(rnd.randint(2, 14)))
        source = rnd.choice(["wire", "wire", "book", None])
        if source == "wire" and len(text) > 600:
            text = text[:600]
            if not text.endswith("."):
                truth.add(i)
        elif source == "book" and rnd.random() < 0.08:
            text = text[: rnd.randint(40, len(text) - 2)]
            if not text.endswith("."):
                truth.add(i)
        elif rnd.random() < 0.1:
            text = text[:-1]  # whole, but without its full stop
        elif rnd.random() < 0.1:
            text += rnd.choice(["\nSigned, ", "\n\nFiled under "]) + rnd.choice(names)
        elif rnd.random() < 0.05:
            text = text[:-1] + "…"
        docs.append((i, source, text))
    return docs, truth


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)


def test_planted_cuts(spark):
    docs, truth = corpus()
    got = {r.doc_id for r in ct.judge(frame(spark, docs)).where("is_cut").collect()}
    assert len(got & truth) / len(truth) >= 0.95 and len(got & truth) / len(got) >= 0.95


def test_limits_are_found(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(4000):
        n = int(rnd.expovariate(1 / 500)) + 30
        source = rnd.choice(["wire", "book", "label", None])
        if source == "label" and n > 800:
            n = rnd.randint(752, 800)  # cut at the last word under a limit
        n = min(n, 600) if source == "wire" else n
        extra = rnd.randint(0, 20)
        rows.append((source, n, min(n + extra, 700) if source is None else n + extra))
    found = {(r.source, r.unit, r.bin) for r in ct.length_tests(spark.createDataFrame(rows, "source string, chars int, bytes int")).collect()}
    assert ("wire", "chars", 600) in found and (None, "bytes", 700) in found and not any(s == "book" for s, _, _ in found)
    assert {b for s, u, b in found if (s, u) == ("label", "bins")} >= {47, 48, 49}


def test_rates_and_odd_rows(spark):
    docs, truth = corpus(seed=2, n=600)
    odd = [(9000, "odd", None), (9001, "odd", ""), (9002, None, "  \n "), (9003, "odd", "…"), (9004, "odd", "word " * 30_000), (0, docs[0][1], docs[0][2])]
    judged = ct.judge(frame(spark, docs + odd))
    rows = judged.collect()
    assert len(rows) == len(docs) + 3  # null and blank texts have no row
    rates = {r.source: r for r in ct.rates(judged).collect()}
    assert set(rates) == {"wire", "book", None, "odd"} and sum(r.n_docs for r in rates.values()) == len(rows)
    assert abs(sum(r.n_cut for r in rates.values()) - len(truth)) <= 0.1 * len(truth) + 2
    assert ct.judge(frame(spark, [])).count() == 0


def test_contexts():
    walk = lambda t: [(" ".join(k), s) for k, s in ct._walk(ct._TOKEN.findall(t), ct._Shapes())]
    assert walk("The Old Mill closed. It was 3 o'clock") == [(" ^ A", False), ("^ A closed", True), (" ^ A", False), ("^ A was", False), ("A was 0", False), ("was 0 o'clock", False)]


def test_marks():
    for mark in ("…", " […]", "... (more)", " Read more", " »", " [ continued ]", "......" * 20, "… (sic) "):
        assert ct._unmarked("Some words" + mark) == "Some words"
    assert ct._unmarked("bread more") == "bread more" and ct._unmarked(" … ") == ""
