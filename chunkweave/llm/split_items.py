"""Splitting oversized texts at natural boundaries.

Each text over the limit becomes a sorted array of boundary offsets, counted in code points or, by
the prefix sums of token lengths, in tokens. A piece starts at ``s``; the last boundary within
``s + limit`` is found by binary search, else the piece is cut hard at ``s + limit``; the next piece
starts ``overlap`` before the cut. Every text is one row, so a text is the largest unit a task holds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: After a line feed, or after the white space that follows . ! or ? and any closing quotes or brackets.
BOUNDARY = re.compile("\n|[.!?][\"'”’)\\]]*\\s+")

PIECES = (
    "item_kind string, item_key string, cut_kind string, n_chars int, "
    "pieces array<struct<start:int,stop:int,cut:string,text:string>>"
)


def boundaries(text: str) -> list[int]:
    """Sorted offsets at which ``text`` may be cut naturally, without 0 and its length."""
    found = set()
    for m in BOUNDARY.finditer(text):
        found.add(m.end())
        if "\n" in m.group():  # every line feed inside the white space is a boundary too
            found.update(m.start() + i + 1 for i, ch in enumerate(m.group()) if ch == "\n")
    found.discard(len(text))
    return sorted(found)


def longest_stretch(marks: list[int], size: int) -> int:
    """The longest stretch between neighbouring boundaries, text start and end included."""
    ends = [0, *marks, size]
    return max(b - a for a, b in zip(ends, ends[1:]))


def cut(size: int, marks: list[int], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces (start, stop, how) that cover 0..size, each at most ``limit`` long.

    ``how`` is 'end' for the last piece, 'natural' if it stops at a boundary, else 'forced'.
    Consecutive pieces overlap by ``overlap``; by less only where the next boundary is within the limit
    of the cut but not of the full overlap, and then by as much as that leaves. Every piece ends later
    than the one before.
    """
    out, start, stop = [], 0, 0
    while size - start > limit:
        at = bisect_right(marks, start + limit) - 1
        natural = at >= 0 and marks[at] > stop
        stop = marks[at] if natural else start + limit
        out.append((start, stop, "natural" if natural else "forced"))
        start = max(start + 1, stop - overlap)
        i = bisect_right(marks, stop)
        following = marks[i] if i < len(marks) else size
        if start + limit < following <= stop + limit:
            start = following - limit
    out.append((start, size, "end"))
    return out


def token_ends(vocabulary: str | None = None) -> Callable[[str], list[int]]:
    """A function that gives the offset after each token: words with the white space before them, or a public tokenizer's."""
    if vocabulary is None:
        return lambda text: [m.end() for m in re.finditer(r"\s*\S+", text)]

    def ends(text: str) -> list[int]:
        from chunkweave.llm.source_mix import encoding

        made = encoding(vocabulary)
        tokens = made.encode_ordinary(text)
        return [min(len(text), x) for x in [*made.decode_with_offsets(tokens)[1][1:], len(text)]]

    return ends


def cut_tokens(text: str, limit: int, overlap: int, ends: list[int]) -> tuple[bool, list[tuple[int, int, str]]]:
    """(is a stretch longer than the limit, pieces in code points) where limit and overlap count tokens.

    A boundary inside a token counts at the token's start; ``ends`` may repeat an offset (parts of
    one character), at which nothing is cut.
    """
    edges = [0, *ends]
    if edges[-1] < len(text):  # white space at the end belongs to the last token
        edges[-1] = len(text)
    inner = {bisect_right(edges, m) - 1 for m in boundaries(text)}
    marks = sorted(i for i in inner if 0 < i < len(edges) - 1)
    pieces = cut(len(edges) - 1, marks, limit, overlap)
    return longest_stretch(marks, len(edges) - 1) > limit, [(edges[a], edges[b], how) for a, b, how in pieces if edges[a] < edges[b]]


def _split(ends: Callable[[str], list[int]] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, key, text, limit, overlap in pdf.itertuples(index=False, name=None):
                if ends is None:
                    marks = boundaries(text)
                    forced, found = longest_stretch(marks, len(text)) > limit, cut(len(text), marks, limit, overlap)
                else:
                    at = ends(text)
                    if len(at) <= limit:
                        continue
                    forced, found = cut_tokens(text, limit, overlap, at)
                pieces = [{"start": a, "stop": b, "cut": how, "text": text[a:b]} for a, b, how in found]
                rows.append((kind, key, "forced" if forced else "natural", len(text), pieces))
            yield pd.DataFrame(rows, columns=["item_kind", "item_key", "cut_kind", "n_chars", "pieces"])

    return run


def split_oversized(items: DataFrame, tokens: bool = False, vocabulary: str | None = None) -> DataFrame:
    """Split the oversized rows of ``items(item_kind, item_key, text, max_size, overlap)``.

    Sizes count code points or, with ``tokens``, words or a tokenizer's tokens (``vocabulary`` is the
    path of its file, which is sent to the executors). Only texts that may be longer than ``max_size``
    leave the JVM; a text of exactly the limit, an empty or a null text gives no row. Null keys are
    kept as null keys. Rows that repeat a key are each split. Further columns are ignored. An empty
    input gives an empty result. ``cut_kind`` is 'forced' if some stretch between neighbouring
    boundaries is longer than the limit, else 'natural'. The overlap must be less than the limit.
    """
    size = F.octet_length("text") if tokens else F.length("text")  # no text has more tokens than bytes
    long = items.where(size > F.col("max_size")).select("item_kind", "item_key", "text", "max_size", "overlap")
    if vocabulary is not None:
        items.sparkSession.sparkContext.addFile(vocabulary)
    return long.mapInPandas(_split(token_ends(vocabulary) if tokens else None), PIECES)
