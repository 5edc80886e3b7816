"""Mixing sources to target weights.

Token counts per text come from a public tokenizer in Arrow batches; everything after that is
grouping and windows. The weights of a temperature mix interpolate between the natural shares ``q``
and the target shares ``t``: ``w(a) ~ q^(1-a) * t^a``, the exponentiated shares ``q^a`` where no
targets are given. The exponent is found by bisection: the largest one at which no source must
repeat its texts more often than it may (or at which the entropy meets a target). A source that stops
the exponent short of 1 is held at its limit, and the exponent of the others is bisected again for
what is left of the budget, so that what short sources lack goes to the rest. The weights are then
realised as whole passes over a source plus one budgeted prefix of a seeded block permutation.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte-level BPE's pre-tokenisation pattern. Fixed value: it belongs to the vocabulary file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of a block of a source's permutation, about: one block's texts are ordered in one task.
BLOCK_DOCS = 10_000
#: Sources are few (a table of targets); more than this is taken for a wrong column.
MAX_SOURCES = 10_000

_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encoding(vocabulary: str):
    """The tokenizer of a vocabulary file that was sent to the executors."""
    return _encoding(SparkFiles.get(os.path.basename(vocabulary)))


def clean_source(column: str | F.Column) -> F.Column:
    """One spelling per source: lower case, trimmed, blanks and hyphens as underscores."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of each document; a null text has 0 tokens.

    The vocabulary file (any path that Spark reads) is sent to every executor.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "source": pdf["source"],
                "n_tokens": [len(encode(t)) if t else 0 for t in pdf["text"]],
            })

    rows = documents.select("doc_id", clean_source("source").alias("source"), "text")
    return rows.mapInPandas(count, "doc_id long, source string, n_tokens long")


def _normal(weights: dict[str, float]) -> dict[str, float]:
    total = math.fsum(weights.values())
    return {k: w / total for k, w in weights.items()} if total > 0 else weights


def entropy(shares: dict[str, float]) -> float:
    return -math.fsum(p * math.log(p) for p in shares.values() if p > 0)


def tempered(natural: dict[str, float], target: dict[str, float] | None, exponent: float) -> dict[str, float]:
    """Normalised weights ``q^(1-a) t^a``, or ``q^a`` without targets. 0 tokens weigh 0 for a < 1."""
    out = {}
    for k, q in natural.items():
        if target is None:
            out[k] = q**exponent if q > 0 else 0.0
        elif exponent >= 1:
            out[k] = target[k]
        else:
            out[k] = q ** (1 - exponent) * target[k] ** exponent if q > 0 else 0.0
    return _normal(out)


def bisect_exponent(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The end of [low, high] nearest to ``high`` that ``holds``, found by bisection.

    ``holds(low)`` is taken as given (at 0 every text is used once, for which any limit has room).
    """
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def quotas(tokens: dict[str, int], target: dict[str, float] | None, room: dict[str, int], size: float, entropy_of: float | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """(weight of each source, exponent that gave it): weights sum to 1 where the room of all sources allows.

    Without targets the weights are ``q^a`` (a temperature), ``a`` the largest exponent up to 1 whose
    entropy is still ``entropy_of``, or as near as the repetition limits allow. Each round bisects one
    exponent for the sources that aren't held at their limit; it holds at least one more, or ends.
    """
    natural = _normal({k: float(v) for k, v in tokens.items()})
    weight, exponent, free, left = {}, {}, dict.fromkeys(natural), float(size)
    while free:
        q = _normal({k: natural[k] for k in free})
        t = None if target is None else _normal({k: target[k] for k in free})
        fits = lambda w: all(w[k] * left <= room[k] * (1 + 1e-12) for k in free)  # noqa: B023, E731
        if target is None:
            a = bisect_exponent(lambda e: entropy(tempered(q, None, e)) >= (entropy_of or 0.0))  # noqa: B023
        else:
            a = bisect_exponent(lambda e: fits(tempered(q, t, e)))  # noqa: B023
        w = tempered(q, t, a)
        # the limit is met exactly, or passed where even the natural shares are too much
        tight = [k for k in free if w[k] * left >= room[k] * (1 - 1e-9) or room[k] == 0]
        if (target is not None and a >= 1.0 and fits(w)) or (target is None and fits(w)) or not tight:
            tight = list(free)
            for k in tight:
                weight[k] = w[k] * left
        else:
            for k in tight:
                weight[k] = min(float(room[k]), left)
        for k in tight:
            exponent[k] = a
            left = max(0.0, left - weight[k])
            del free[k]
    return {k: weight[k] / size if size else 0.0 for k in natural}, exponent


def plan_mix(counts: DataFrame, targets: DataFrame, budget: int | None = None, entropy_of: float | None = None) -> DataFrame:
    """Per target source: natural and target share, exponent, weight, quota and what is reached.

    ``counts(doc_id, source, n_tokens)`` are grouped by source first; only the rows per listed
    source, whose number the table of targets bounds, reach the driver. The budget is the tokens of
    all documents of the listed sources unless given. Sources without a target are left out;
    targets without documents stay with 0 tokens. Null sources and targets are ignored; a source
    listed twice counts with its greatest share. ``falls_short``: all text taken ``max_repeats``
    times is less than the target share of the budget, which is where exponent 1 breaks the
    repetition limit. ``quota_tokens`` is the tempered weight's share of the budget. With
    ``entropy_of`` (nats) target shares are left aside and the natural ones are tempered to that entropy.
    """
    spark = counts.sparkSession
    listed = (
        targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull())
        .groupBy(clean_source("source").alias("source"))
        .agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    sums = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    rows = (
        listed.join(sums, "source", "left")
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    total = sum(r.tokens for r in rows)
    size = total if budget is None else budget
    natural = {r.source: r.tokens / total if total else 0.0 for r in rows}
    room = {r.source: r.tokens * r.max_repeats for r in rows}
    wanted = None if entropy_of is not None else {r.source: r.target_share for r in rows}
    weight, exponent = quotas({r.source: r.tokens for r in rows}, wanted, room, size, entropy_of)
    quota = {k: min(math.floor(w * size + 1e-6), room[k]) for k, w in weight.items()}
    reached = sum(quota.values())
    out = []
    for r in sorted(rows, key=lambda r: r.source):
        k = r.source
        out.append((
            k, r.n_docs, r.tokens, natural[k], r.target_share, r.max_repeats, exponent[k], weight[k], room[k] < r.target_share * size,
            quota[k], quota[k] / r.tokens if r.tokens else None, quota[k] / size if size else 0.0, quota[k] / reached if reached else 0.0,
        ))
    return spark.createDataFrame(
        out,
        "source string, n_docs long, tokens long, natural_share double, target_share double, max_repeats int, exponent double, "
        "tempered_share double, falls_short boolean, quota_tokens long, repeats double, share_of_budget double, share_of_mix double",
    )


def realise(counts: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, uses``: how often each text enters the mix, by the plan's quotas.

    A source's texts lie in a seeded permutation of blocks of about ``BLOCK_DOCS`` texts, as many as the
    source needs. Whole passes use every text; the last pass takes texts in the order of the
    permutation while they fit wholly in what is left. Prefix sums go over block totals (a row per
    block) and then inside each block, so that no task orders a whole source. Texts of sources without a
    plan are used 0 times; so is a null id's text.
    """
    quotas = plan.select("source", "quota_tokens", "tokens", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK_DOCS)).alias("blocks"))
    rows = counts.where(F.col("doc_id").isNotNull()).join(F.broadcast(quotas), "source", "left")  # at most MAX_SOURCES rows
    unused = rows.where("quota_tokens is null").select("doc_id", "source", "n_tokens", F.lit(0).cast("long").alias("uses"))
    rows = rows.where("quota_tokens is not null").withColumn("_s", F.col("source")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    spans = rows.groupBy("_s", "block").agg(F.sum("n_tokens").alias("size"))
    ahead = Window.partitionBy("_s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_s", "block", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("_s", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(spans, ["_s", "block"])
    passes = F.floor(F.try_divide(F.col("quota_tokens"), F.col("tokens")))
    rest = F.col("quota_tokens") - passes * F.col("tokens")
    uses = F.coalesce(passes + (F.col("before") + F.col("upto") <= rest).cast("long"), F.lit(0))
    return placed.select("doc_id", "source", "n_tokens", uses.alias("uses")).unionByName(unused)
