"""Reading level of each document: gradient-boosted regression trees over text distributions.

Every text becomes one row of distributions of word length, vocabulary, syntax and cohesion, in Arrow
batches. Trees are trained on the stated levels with cross-fitting: rows are dealt into folds by a
hash of source and key, and a labelled text is scored only by trees that have not seen its label, so a
wrong label cannot vouch for itself. Scores are calibrated to levels by the cuts with the fewest labels
on the wrong side among the held-out rows of the other folds, so that the figures by source are of rows
that neither the trees nor the cuts have seen.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.session import stage

#: At most about this many labelled rows (a hash decides which) are used to fit; all rows are scored.
FIT_ROWS = 30_000
FOLDS, TREES, DEPTH, STEP, LEAF = 3, 25, 3, 0.15, 8
#: Bins of a score between the lowest and highest level, for the calibration.
BINS = 240

_TAG = re.compile(r"<[^<>]*>|\[[^\]]{0,60}\]|\([^)]{0,30}\d[^)]{0,30}\)")
#: A word, or what ends a sentence.
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?]+|\n+")
_VOWELS = re.compile(r"[aeiouyáéíóúäöüàèùâêîôû]+")
# Small closed word classes of English, and endings of learned words.
_SUBORDINATE = frozenset("because although though while whereas which who whom whose that if unless until since insofar whether thereby whereby despite notwithstanding amid".split())
_COORDINATE = frozenset("and but so or then".split())
_PRONOUN = frozenset("i you he she it we they me him her us them my your his our their".split())
_TOGETHER = frozenset("however therefore moreover furthermore consequently thus hence nevertheless meanwhile subsequently also finally later first next".split())
_LEARNED = re.compile(r"(?:tion|tions|ment|ments|ity|ities|ism|ence|ance|ical|ive|ous|ized|izing|ization)$")
FEATURES = 34
#: Characters of the texts that are measured together, about.
TOGETHER = 1_000_000


class Words(dict):
    """word -> its number in ``table``, a row of word facts; 0 is the end of a sentence.

    The facts: length, syllables, in each of the four classes, learned, adverb, article.
    """

    MOST = 200_000

    def __init__(self) -> None:
        self.facts: list[tuple] = [(0,) * 9]
        self.table = np.zeros((1, 9))

    def __missing__(self, word: str) -> int:
        w = word.lower()
        if not w[0].isalpha():
            self[word] = 0
        elif w != word:
            self[word] = self[w]
        else:
            classes = (w in _SUBORDINATE, w in _COORDINATE, w in _PRONOUN, w in _TOGETHER)
            self[w] = len(self.facts)
            self.facts.append((len(w), len(_VOWELS.findall(w)), *classes, _LEARNED.search(w) is not None, w.endswith("ly"), w in ("the", "a", "an")))
        return self[word]

    def tidy(self) -> None:
        """Forget the words if they are many: numbers only have to agree within the texts that are measured together."""
        if len(self) > self.MOST:
            self.clear()
            self.__init__()

    def read(self, text: str) -> np.ndarray:
        """The numbers of the text's words and sentence ends, in order."""
        ids = np.fromiter(map(self.__getitem__, _TOKEN.findall(text)), np.int64)
        if len(self.table) < len(self.facts):
            self.table = np.concatenate([self.table, np.array(self.facts[len(self.table) :], float)])
        return ids


class Parts:
    """Values that lie part after part, ``n`` of them in each, none of which is empty."""

    def __init__(self, n: np.ndarray) -> None:
        self.n, self.first, self.of = n, np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)

    def mean(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(float), self.first) / self.n

    def spread(self, values: np.ndarray) -> np.ndarray:
        return np.sqrt(self.mean((values - self.mean(values)[self.of]) ** 2))

    def quantiles(self, values: np.ndarray, at: tuple[float, ...]) -> list[np.ndarray]:
        values = values[np.lexsort((values, self.of))]
        out = []
        for q in at:
            place = q * (self.n - 1)
            low = place.astype(int)
            high = np.minimum(low + 1, self.n - 1)
            out.append(values[self.first + low] + (values[self.first + high] - values[self.first + low]) * (place - low))
        return out


def _different(values: np.ndarray) -> np.ndarray:
    """The different values, in order (by sorting, which is faster here than hashing)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _measured(ids: list[np.ndarray], commas: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts x features of texts that have a word each, all texts at once."""
    every = np.concatenate(ids)
    text = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    is_word = every > 0
    words = every[is_word]
    t = Parts(np.bincount(text[is_word]))
    facts = table[words]
    size, beats = facts[:, 0], facts[:, 1]
    out = [t.mean(size), t.spread(size), *(t.mean(size >= k) for k in (5, 7, 9, 11, 13)), t.mean(size <= 3), t.mean(beats), t.mean(beats >= 3), t.mean(beats >= 5)]
    out += t.quantiles(size, (0.5, 0.75, 0.9, 0.97))
    # the spread over stretches of 40 words: texts mix levels
    p = Parts(np.maximum(1, t.n // 40))
    begin = t.first[p.of] + ((np.arange(len(p.of)) - p.first[p.of]) * (t.n / p.n)[p.of]).astype(int)
    hard = np.add.reduceat((size >= 9).astype(float), begin) / np.diff(np.append(begin, len(words)))
    out += [*p.quantiles(hard, (0.1, 0.5, 0.9)), p.spread(hard)]
    ended = (np.cumsum(~is_word) + text)[is_word]  # grows where a sentence or a text ends
    sentence = np.concatenate([[0], np.cumsum(ended[1:] != ended[:-1])])
    lengths = np.bincount(sentence)
    owner = t.of[np.cumsum(lengths) - lengths]
    s = Parts(np.bincount(owner))
    out += [s.mean(lengths), *s.quantiles(lengths.astype(float), (0.25, 0.5, 0.9)), s.spread(lengths), 100 * commas / t.n]
    out += [t.mean(facts[:, c]) for c in range(2, 8)]
    # different words of stretches of 60, then long words that a sentence shares with the next, as (place, word) numbers
    wide = len(table)
    r = Parts(-(-t.n // 60))
    stretch = r.first[t.of] + (np.arange(len(words)) - t.first[t.of]) // 60
    out.append(r.mean(np.bincount(_different(stretch * wide + words) // wide) / np.bincount(stretch)))
    long = size > 3
    said = _different(sentence[long] * wide + words[long])
    shared, pairs = np.zeros(len(ids)), np.zeros(len(ids))
    if len(said):
        different = np.bincount(said // wide, minlength=len(lengths))
        next_ = said[np.minimum(np.searchsorted(said, said + wide), len(said) - 1)] == said + wide
        both = np.bincount(said[next_] // wide, minlength=len(lengths))[:-1]
        less = np.minimum(different[:-1], different[1:])
        ok = (less > 0) & (owner[:-1] == owner[1:])
        shared = np.bincount(owner[:-1][ok], both[ok] / less[ok], len(ids))
        pairs = np.bincount(owner[:-1][ok], minlength=len(ids))
    out += [shared / np.maximum(pairs, 1), t.mean(facts[:, 8])]
    return np.stack(out, axis=1)


def measures(texts: list[str], known: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words, features) of each text: words as white space parts them, 0 where no part is a word.

    The features leave out markup, entities and bracketed references. Texts are measured together
    in groups of about ``TOGETHER`` characters.
    """
    known = Words() if known is None else known
    n_words, features = np.zeros(len(texts), np.int64), np.zeros((len(texts), FEATURES))
    at, ids, commas, held = [], [], [], 0
    known.tidy()
    for i, text in enumerate(texts):
        plain = _TAG.sub(" ", html.unescape(text))
        read = known.read(plain)
        if read.any():
            n_words[i] = len(text.split())
            at.append(i), ids.append(read), commas.append(plain.count(","))
            held += len(text)
        if at and (held > TOGETHER or i == len(texts) - 1):
            features[at] = _measured(ids, np.array(commas), known.table)
            at, ids, commas, held = [], [], [], 0
            known.tidy()
    return n_words, features


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Words()
    for pdf in batches:
        n_words, features = measures(list(pdf["text"]), known)
        yield pd.DataFrame({"key": pdf["key"], "source": pdf["source"], "label": pdf["label"], "n_words": n_words, "features": list(features)})


def calibrate(counts: list[tuple[float, int, int]], levels: int) -> list[float]:
    """Cuts between levels from (score, label, n): each where the fewest held-out labels are on the wrong side."""
    cuts = []
    for k in range(1, levels):
        below, above = {}, {}
        for score, label, n in counts:
            side = above if label >= k else below
            side[score] = side.get(score, 0) + n
        # start with everything above the cut, then move the cut up
        wrong = sum(below.values())
        best, spots = wrong, [-1e9]
        for score in sorted({*below, *above}):
            wrong += above.get(score, 0) - below.get(score, 0)
            if wrong < best:
                best, spots = wrong, [score]
            elif wrong == best:
                spots.append(score)
        cuts.append(spots[len(spots) // 2])
    return [max(cuts[: i + 1]) for i in range(len(cuts))]


def score_levels(texts: DataFrame, levels: int, fit_rows: int = FIT_ROWS, least_words: int = 60) -> DataFrame:
    """``key, source, label, n_words, score, level`` for every row of ``texts(key, source, label, text)``.

    ``label`` is a level 0..levels-1 or null; ``source`` groups the folds and may be null. Texts that
    are null or have no word get score and level null; texts under ``least_words`` are scored but do
    not train. Where fewer than 20 rows have labels nothing can be trained: score and level are null.
    Repeated keys are rows of their own, in the same fold if their source is the same. An empty table gives no rows.
    """
    rows = texts.select("key", "source", F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, source string, label int, n_words int, features array<double>"
    table = stage(rows.mapInPandas(_features, schema).withColumn("fold", F.pmod(F.xxhash64("source", "key", F.lit(9)), F.lit(FOLDS)).cast("int")), "features")
    usable = table.where(F.col("label").isNotNull() & (F.col("n_words") >= least_words))
    n = usable.count()
    if n < 20:
        return table.select("key", "source", "label", "n_words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"))
    share = min(1.0, fit_rows / n)
    drawn = usable.where(F.pmod(F.xxhash64("key", F.lit(21)), F.lit(1_000_000)) < share * 1_000_000)
    points = stage(drawn.select("fold", F.col("label").cast("double").alias("label"), "features"), "fit").select("fold", "label", array_to_vector("features").alias("x"))
    scored = table.where("n_words > 0").withColumn("x", array_to_vector("features"))

    def fit(fold: int):
        trees = GBTRegressor(featuresCol="x", labelCol="label", predictionCol=f"s{fold}", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=48, minInstancesPerNode=LEAF, subsamplingRate=0.7, seed=17, lossType="absolute")
        return trees.fit(points.where(F.col("fold") != fold).coalesce(6))

    with ThreadPoolExecutor(FOLDS) as pool:  # the folds' jobs are small and run side by side
        models = list(pool.map(fit, range(FOLDS)))
    for model in models:
        scored = model.transform(scored)
    blind = F.coalesce(*[F.when(F.col("fold") == i, F.col(f"s{i}")) for i in range(FOLDS)])
    mean = sum(F.col(f"s{i}") for i in range(FOLDS)) / FOLDS
    scored = scored.withColumn("score", F.when(F.col("label").isNotNull(), blind).otherwise(mean))
    scored = stage(scored.select("key", "source", "label", "n_words", "score", "fold"), "scores")
    step = (levels - 1) / BINS
    held = scored.where(F.col("label").isNotNull() & (F.col("n_words") >= least_words))
    spot = F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(F.col("score") / step + 0.5)))
    counts = held.groupBy("fold", spot.alias("spot"), "label").agg(F.count("*").alias("n")).collect()  # at most FOLDS * (BINS + 1) * levels rows
    level = None
    for fold in (None, *range(FOLDS)):  # cuts from the other folds; for rows without a label from all
        cuts = calibrate([(r.spot * step, r.label, r.n) for r in counts if r.fold != fold], levels)
        here = sum((F.col("score") > c + step / 2).cast("int") for c in cuts)
        level = here if fold is None else F.when(F.col("label").isNotNull() & (F.col("fold") == fold), here).otherwise(level)
    done = scored.withColumn("level", level).drop("fold")
    none = table.where("n_words = 0").select("key", "source", "label", "n_words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"))
    return done.unionByName(none)


def quality(scored: DataFrame) -> DataFrame:
    """Held-out figures per source: rows, mean absolute error, share at or next to the label."""
    d = F.abs(F.col("level") - F.col("label"))
    return scored.where("label is not null and level is not null").groupBy("source").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("label"))).alias("mean_error"),
        F.avg((d == 0).cast("int")).alias("exact"), F.avg((d <= 1).cast("int")).alias("within_one"),
    )
