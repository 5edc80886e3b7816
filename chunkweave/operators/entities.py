"""Entity extraction behind one interface: a bounded gazetteer with pattern rules, or any model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave import config

#: Runs of capitalised words, with small words inside a name.
RUN = re.compile(r"\b[^\W\d_a-z][\w'’-]*(?:\s+(?:(?:of|the|and|de|la)\s+)?[^\W\d_a-z][\w'’.-]*)*")
#: Last words that tell a type. Fixed values.
CUES = {
    "ORG": "union league society association committee council alliance brotherhood company court church school press".split(),
    "EVENT": "march boycott strike walkout hearing petition vigil lockout sit-in rally trial".split(),
    "FAC": "hall library chapel courthouse academy depot bridge station".split(),
    "LOC": "river valley ridge marsh flats hills bay".split(),
}
_CUE = {w: kind for kind, ws in CUES.items() for w in ws}
#: Types of a cloud service's labels, where they differ. Fixed values.
CLOUD_TYPES = {"PERSON": "PERSON", "ORGANIZATION": "ORG", "LOCATION": "GPE", "EVENT": "EVENT"}


def by_pattern(text: str) -> list[tuple[str, str]]:
    """(type, name) of capitalised runs whose last word tells a type; two or three other words are a person."""
    out = []
    for m in RUN.finditer(text or ""):
        words = m.group().strip(" .").split()
        if words and words[0] in ("The", "A", "An", "In", "On", "At", "By"):
            words = words[1:]
        if not words:
            continue
        kind = _CUE.get(words[-1].lower().strip(".")) or ("PERSON" if len(words) in (2, 3) else None)
        if kind and len(words) > 1:
            out.append((kind, " ".join(words)))
    return list(dict.fromkeys(out))


def extract(rows: DataFrame, key: str, extractor: Callable[[str], list[tuple[str, str]]] = by_pattern) -> DataFrame:
    """``key, entities`` (packed, distinct by first occurrence, capped) of ``rows(key, text)``.

    The extractor runs on Arrow batches; a failing text gives no entities.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = []
            for text in pdf["text"]:
                try:
                    got = extractor(text or "")
                except Exception:
                    got = []
                packed = dict.fromkeys(f"{t}:{n}"[: config.ENTITY_CHARS] for t, n in got if t in config.ENTITY_TYPES)
                found.append(list(packed)[: config.MOST_ENTITIES])
            yield pd.DataFrame({key: pdf[key], "entities": found})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInPandas(run, f"{key} {kind}, entities array<string>")


def cloud_types(entities: F.Column) -> F.Column:
    """A cloud service's entities as packed ones: its labels mapped, unknown ones dropped, capped before they are made distinct."""
    table = F.create_map(*[F.lit(x) for kv in CLOUD_TYPES.items() for x in kv])
    kept = F.filter(entities, lambda e: F.element_at(table, e["type"]).isNotNull())
    packed = F.transform(kept, lambda e: F.concat(F.element_at(table, e["type"]), F.lit(":"), e["name"]))
    return F.array_distinct(F.slice(packed, 1, config.MOST_ENTITIES))


def type_labels(entities: F.Column) -> F.Column:
    """The distinct type labels of packed entities, in order of first occurrence."""
    return F.array_distinct(F.transform(entities, lambda e: F.substring_index(e, ":", 1)))
