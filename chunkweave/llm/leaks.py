"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

The alphabet is words, a pattern is every run of ``run`` consecutive words of a passage. For a block
of two words the shift table says how far the window may move when the block ends it: the least
distance from the block to the end of any pattern, and ``run - 1`` for a block that no pattern has.
Where the shift is zero the bucket of patterns with that suffix block is compared word by word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Patterns are searched in blocks of this many characters of passages, so that what is broadcast
#: stays bounded however many test items there are.
BLOCK_CHARS = 4_000_000


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return [w for w in (x.lower() for x in WORD.findall(text))]


class Tables:
    """Shift table and suffix buckets of all runs of ``run`` words of some passages."""

    def __init__(self, passages: list[tuple[int, str]], run: int):
        self.run = run
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[int]]] = {}
        owners: dict[tuple[str, ...], list[int]] = {}
        for item, text in passages:
            ws = words(text)
            for i in range(len(ws) - run + 1):
                mine = owners.setdefault(tuple(ws[i : i + run]), [])
                if not mine or mine[-1] != item:
                    mine.append(item)
        for pattern, items in owners.items():
            for j in range(run - 1):
                block, far = (pattern[j], pattern[j + 1]), run - 2 - j
                if self.shift.get(block, run) > far:
                    self.shift[block] = far
            self.bucket.setdefault(pattern[-2:], {})[pattern] = items

    def search(self, ws: list[str]) -> dict[int, int]:
        """item -> number of window positions of ``ws`` at which one of its runs lies."""
        run, shift, bucket = self.run, self.shift, self.bucket
        found: dict[int, int] = {}
        i, n, skip = run - 1, len(ws), run - 1
        while i < n:
            block = (ws[i - 1], ws[i])
            move = shift.get(block, skip)
            if move:
                i += move
                continue
            items = bucket[block].get(tuple(ws[i - run + 1 : i + 1]))
            if items:
                for item in items:
                    found[item] = found.get(item, 0) + 1
            i += 1
        return found


_built: dict[str, Tables] = {}


def _tables(name: str, block: list[tuple[int, str]], run: int) -> Tables:
    """The tables of a block, built once per worker; only those of the last block are kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Tables(block, run)
    return _built[name]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        block.append((r.item_id, r.passage))
        size += len(r.passage)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """Documents that share a run of at least ``run`` words with the passage of an item.

    Returns ``doc_id, item_id, n_runs`` (window positions that match), one row per pair. The test
    set is read in blocks of a bounded size; the corpus is scanned once per block and never
    shuffled. Null or short passages and texts match nothing; items that share a passage are all
    reported; rows that repeat a doc_id or item_id are merged (the greatest n_runs stays). An empty
    table on either side gives an empty result.
    """
    spark = documents.sparkSession
    if run < 3:
        raise ValueError("run must be 3 or more")
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    known = items.where(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "passage").distinct()
    out = None
    for block in _blocks(known):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], sent=sent, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            tables = _tables(name, sent.value, run)
            for pdf in batches:
                hits = [
                    (doc, item, n) for doc, text in zip(pdf["doc_id"], pdf["text"]) for item, n in tables.search(words(text)).items()
                ]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "n_runs"])

        part = texts.mapInPandas(scan, "doc_id long, item_id long, n_runs long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_runs long")
    return out.groupBy("doc_id", "item_id").agg(F.max("n_runs").alias("n_runs"))
