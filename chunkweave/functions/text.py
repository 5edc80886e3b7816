"""Text functions as Spark columns: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave import config
from chunkweave.functions.lexicon import STOP_WORDS

#: Comments first, then tags whose quoted attributes may hold '>'.
TAGS = r"""<!--[\s\S]*?-->|<[!/?a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""

ANSWER = T.StructType([
    T.StructField("response_type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("collection_title_suggestion", T.StringType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("nid", T.LongType()), T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()), T.StructField("summary", T.StringType()),
    ]))),
    T.StructField("search_suggestions", T.ArrayType(T.StringType())),
    T.StructField("collection_url", T.StringType()),
])


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: str | Column) -> Column:
    """White-space separated words (Unicode white space); an empty array for null or blank."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def windows(c: str | Column, size: int = config.CHUNK_WORDS, stride: int = config.CHUNK_STRIDE) -> Column:
    """Array of structs (offset, text): word windows of ``size`` that start every ``stride`` words.

    The words are bound to a variable, so that a body is split once and not again for each window.
    """

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.array_join(F.slice(w, s + 1, size), " ").alias("text")))

    return F.element_at(F.transform(F.array(words(c)), of), 1)


def strip_tags(c: str | Column) -> Column:
    """Without markup; the text inside script and style elements stays. Null becomes ''."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), TAGS, "")


def split_keywords(c: str | Column) -> Column:
    """Comma-separated text to trimmed, non-empty parts ('0' counts as empty)."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "0"))


def encode_typed(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), value)


def parse_typed(c: str | Column) -> Column:
    """Struct (type, value), split at the first colon; without one the type is 'semantic'."""
    c = _c(c)
    at = F.instr(c, ":")
    return F.when(at > 0, F.struct(c.substr(F.lit(1), at - 1).alias("type"), c.substr(at + 1, F.length(c)).alias("value"))).otherwise(
        F.struct(F.lit("semantic").alias("type"), c.alias("value"))
    )


def strip_type(c: str | Column) -> Column:
    """The text after the first colon, or all of it."""
    c = _c(c)
    return F.when(F.instr(c, ":") > 0, c.substr(F.instr(c, ":") + 1, F.length(c))).otherwise(c)


def tokenize(c: str | Column) -> Column:
    """Lower-case terms of letters and digits, longer than 2, no stop words; repeats stay."""
    plain = F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^a-zA-Z0-9\s]", ""))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(plain, r"\s+"), lambda t: (F.length(t) > 2) & ~F.array_contains(stops, t))


def cap(c: str | Column, most: int, chars: int) -> Column:
    """Null members dropped, each member cut to ``chars``, the array to ``most``; null becomes []."""
    kept = F.filter(F.coalesce(_c(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.slice(F.transform(kept, lambda x: F.substring(x, 1, chars)), 1, most)


def parse_keyword_lines(c: str | Column, most: int = config.GENERATED_KEYWORDS) -> Column:
    """Keywords of a model's list: numbers, bullets, quotes and stray punctuation taken off."""
    lines = F.split(F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"^[\s\x00]+|[\s\x00]+$", "")), r"\r?\n")

    def clean(line: Column) -> Column:
        line = F.regexp_replace(line, r"^\s*[0-9]+[.)]\s*", "")
        line = F.regexp_replace(line, r"^\s*[-•*]\s*", "")
        return F.regexp_replace(line, "^[ \t\"',.;:]+|[ \t\"',.;:]+$", "")

    return F.slice(F.filter(F.transform(lines, clean), lambda x: x != ""), 1, most)


def render_prompt(template: str, c: str | Column, slot: str = "{{ context }}") -> Column:
    return F.replace(F.lit(template), F.lit(slot), F.coalesce(_c(c), F.lit("")))


def parse_structured(c: str | Column) -> Column:
    """A model's answer as a struct: the whole text, a fenced block, or from the first brace.

    An attempt counts only if it has a response_type; null if none has.
    """
    c = _c(c)
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    brace = F.when(F.instr(c, "{") > 0, c.substr(F.instr(c, "{"), F.length(c)))
    tries = [F.from_json(x, ANSWER) for x in (c, F.when(fenced != "", fenced), brace)]
    return F.coalesce(*[F.when(t["response_type"].isNotNull(), t) for t in tries])


def message_of(c: str | Column) -> Column:
    """The readable message of an answer that may be, or end in, raw JSON."""
    c = _c(c)
    t = F.trim(c)
    whole = F.when(t.startswith("{"), F.get_json_object(t, "$.message"))
    at = F.instr(t, '{"response_type"')
    before = F.trim(t.substr(F.lit(1), at - 1))
    inner = F.get_json_object(t.substr(at, F.length(t)), "$.message")
    valid = F.get_json_object(t.substr(at, F.length(t)), "$.response_type").isNotNull()
    sep = F.when(before != "", F.concat(before, F.lit("\n\n"))).otherwise(F.lit(""))
    joined = F.when(valid, F.concat(sep, F.coalesce(inner, F.lit("")))).otherwise(F.when(before != "", before).otherwise(c))
    at2 = F.instr(t, '"response_type"')
    head = F.substring(t, F.lit(1), F.greatest(at2 - 1, F.lit(0)))
    open_at = F.when(F.instr(F.reverse(head), "{") > 0, F.length(head) - F.instr(F.reverse(head), "{"))
    outer = F.when(open_at.isNotNull(), F.trim(F.substring(head, F.lit(1), open_at)))
    loose = F.when((outer.isNotNull()) & (outer != ""), outer).otherwise(t)
    return F.when(whole.isNotNull() & (whole != ""), whole).when(at > 0, joined).when(at2 > 0, loose).otherwise(c)


#: Fixed value: sentences that point at the list of suggestions.
CUE = r"(?i)[^\n.!?]*\b(?:search suggestions?|suggested search terms?|suggestions? below|search terms? below)\b[^\n.!?]*[.!?]"


def strip_cue(c: str | Column) -> Column:
    """Without sentences that point at the list of suggestions."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), CUE, ""), r"[ \t]{2,}", " "))


def compose_message(query: str | Column, age: str | Column) -> Column:
    age = _c(age)
    some = age.isNotNull() & (age != "") & (age != "All")
    return F.concat(F.trim(_c(query)), F.when(some, F.concat(F.lit("\n\nFilters: Age range: "), age, F.lit("."))).otherwise(F.lit("")))


def html_escape(c: str | Column) -> Column:
    c = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def url_term(c: str | Column) -> Column:
    """Percent-encoded, blanks as '+', with ! ' ( ) ~ left as they are in a URI component."""
    c = F.url_encode(_c(c))
    for a, b in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def filter_hints(c: str | Column) -> Column:
    """The hints that are known types; repeats stay out."""
    return F.array_intersect(F.coalesce(_c(c), F.array().cast("array<string>")), F.array(*[F.lit(t) for t in config.HINT_TYPES]))


def array_envelope(c: str | Column) -> Column:
    """Array of strings from JSON: a plain list, {"Data":{"StringData":{"data":[...]}}}, or a quoted list; else []."""
    c = _c(c)
    plain = F.from_json(c, "array<string>")
    boxed = F.from_json(F.get_json_object(c, "$.Data.StringData.data"), "array<string>")
    quoted = F.from_json(F.when(c.startswith('"'), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]), "array<string>")
    listed = F.when(F.trim(c).startswith("["), plain)
    return F.coalesce(boxed, listed, quoted, F.array().cast("array<string>"))
