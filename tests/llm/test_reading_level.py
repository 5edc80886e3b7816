import random

import numpy as np

from chunkweave.llm import reading_level as rl

EASY = "the dog ran to a big red bus and we sat by it all day so mum had fun".split()
HARD = "notwithstanding jurisprudential considerations, institutional fragmentation substantially reconfigured longstanding administrative mechanisms of proportional representation whereby subsequent interpretations accumulated".split()
SCHEMA = "key long, source string, label int, text string, features string, level int"


def text(rnd, share, n):
    out = []
    for i in range(n):
        out.append(rnd.choice(HARD if rnd.random() < share else EASY))
        if i % (6 + int(12 * share)) == 5:
            out[-1] += "."
    return " ".join(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)


def test_wrong_labels_come_out(spark):
    rnd = random.Random(1)
    rows, wrong, truth = [], set(), {}
    for i in range(1200):
        level = rnd.randrange(4)
        truth[i] = level
        label = level
        if rnd.random() < 0.1:
            label = (level + 2) % 4
            wrong.add(i)
        elif rnd.random() < 0.1:
            label = None
        rows.append((i, rnd.choice(["a", "b", None]), label, text(rnd, (0.05, 0.3, 0.55, 0.85)[level], rnd.randint(60, 300))))
    rows += [(9000, "a", 1, None), (9001, "a", 1, ""), (9002, "a", 2, "12 34 <b></b>"), (9003, None, None, "one word"), (9004, "a", 0, text(rnd, 0.05, 60_000))]
    scored = rl.score_levels(frame(spark, rows), 4)
    got = {r.key: r for r in scored.collect()}
    assert len(got) == len(rows)
    assert sum(got[i].level == truth[i] for i in truth) / len(truth) > 0.93  # held out
    found = {i for i in truth if got[i].label is not None and abs(got[i].level - got[i].label) >= 2}
    assert len(found & wrong) / len(wrong) > 0.95 and len(found & wrong) / len(found) > 0.95
    assert got[9000].score is None and got[9001].n_words == 0 and got[9002].level is None and got[9003].score is not None and got[9004].level == 0
    quality = {r.source: r for r in rl.quality(scored.where("n_words >= 60")).collect()}
    assert set(quality) == {"a", "b", None} and all(r.within_one > 0.8 for r in quality.values())


def test_too_few_labels_and_empty(spark):
    assert [r.level for r in rl.score_levels(frame(spark, [(1, "a", 2, "a b c " * 40)]), 4).collect()] == [None]
    assert rl.score_levels(frame(spark, []), 4).count() == 0


def test_measures_and_cuts():
    texts = ["One&nbsp;two <b>three</b> [cf. fol. 1]. Four!", "", "<b> 12 </b>", "Plain words. More plain words here.\n\nMore."]
    n, f = rl.measures(texts)
    assert n.tolist() == [6, 0, 0, 7] and f.shape == (4, rl.FEATURES) and not f[1:3].any()
    together = rl.Words()
    for i, text in enumerate(texts):  # a text's figures don't depend on its company
        assert np.allclose(rl.measures([text], together)[1][0], f[i])
    assert np.isclose(f[3][19], 7 / 3) and np.isclose(f[3][31], 4 / 7) and np.isclose(f[3][32], 1)  # words a sentence; different ones; long ones that the next shares
    assert rl.measures([])[1].shape == (0, rl.FEATURES)  # words as white space parts them
    cuts = rl.calibrate([(0.0, 0, 9), (0.2, 1, 1), (1.0, 1, 9), (2.0, 2, 5), (2.1, 0, 1)], 3)
    assert 0.0 <= cuts[0] < 0.2 and 1.0 <= cuts[1] < 2.0  # the fewest labels on the wrong side: one each
