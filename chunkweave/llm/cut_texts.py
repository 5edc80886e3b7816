"""Texts cut off by field limits or broken transfers.

Discrete *length hazards* are counted over all documents: for each source and length (in characters, in
bytes, and in bins of characters), the documents that end there as a share of those that get that far,
tested against the hazards of neighbouring lengths with false-discovery control. That finds field
limits. A broken transfer may stop at any length, so it has hazards of its own: those of open endings,
over stretches of lengths from a few bins up to all of a source's, tested against what whole texts have.
How *open* an ending is, is learned from all texts: how often a sentence ends after its last words.

A text is taken for cut if its ending is incomplete and its length is significant in one of these tests;
at a field limit little is asked of the ending, else more. Marks put after a cut are taken off before
the ending is judged, and prove nothing alone if authors use them too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave.session import stage

#: Trailing marks: those that only say "there was more", and those that authors use as well.
PLAIN_MARK = r"\[\s*(?:…|\.\.\.|continued|cont\.?|truncated|more)\s*\]|\(\s*(?:…|\.\.\.|more|continued|cont\.?)\s*\)|»|>>|(?<!\w)[Rr]ead more"
SOFT_MARK = r"…|\.{3,}|\(sic\)|\[sic\]"
#: Searched from the end, so that only the mark itself is read.
_PLAIN = re.compile(rf"(?r)(?:{PLAIN_MARK})$")
_MARK = re.compile(rf"(?r)(?:{PLAIN_MARK}|{SOFT_MARK})$")
#: word, what stands directly after it, and the white space that follows
_TOKEN = re.compile(r"([^\W_]+(?:['’-][^\W_]+)*)([^\w\s]*)(\s*)")
_STOP = re.compile(r"[.!?…]")
_WHOLE = re.compile(r"^\s?[\"'”’)\]»]*\s?[.!?][\"'”’)\]»\s]*$")
_LEAD = re.compile(r"\w+|[^\w\s]")
#: What counts as a line (a signature, a credit), not a paragraph, is at most this long.
LINE = 90
#: Bin widths of the length tests and, in bins, how far neighbours reach and which are left out.
BIN, NEAR, APART = 16, 40, 5
#: A significant length holds at least this many times the documents that its neighbours lead to expect.
LEAST_RATIO = 4
#: Stretches of lengths over which open endings are tested: this many bins of ``BIN``; 0 is all lengths of a source.
STRETCHES = (16, 128, 0)
CONTEXT, LINE_LEAD, WORD, ENDING = "c", "l", "w", "e"
#: Endings that ask for the same fact, per part of them.
HOT = 20_000


class _Shapes(dict):
    """word -> its shape: A for a capital, 0 for a digit, else itself in lower case."""

    def __missing__(self, word: str) -> str:
        first = word[0]
        self[word] = shape = "A" if first.isupper() else "0" if first.isdigit() else word.lower()
        return shape


def _unmarked(text: str) -> str:
    """The text without trailing marks and white space; one mark is taken off at a time."""
    while True:
        text = text.rstrip()
        m = _MARK.search(text)
        if m is None:
            return text
        text = text[: m.start()]


def _walk(found: list[tuple[str, str, str]], shapes: dict[str, str]) -> list[tuple[tuple[str, str, str], bool]]:
    """(context, does a sentence end here) for each word that ends a run of capitalised words.

    A context is the shapes of the last three words of the sentence, such a run counting as one;
    the last word's flag only says whether punctuation follows it.
    """
    out = []
    add = out.append
    stop_in = _STOP.search
    a, b, c = "", "", "^"
    kinds = [shapes[x[0]] for x in found]
    after_it = [*kinds[1:], ""]
    for k, following, (_, after, gap) in zip(kinds, after_it, found):
        if k == "A":
            if c != "A":
                a, b, c = b, c, k
            if following == "A" and not after:
                continue
        else:
            a, b, c = b, c, k
        stop = stop_in(after) is not None if after else gap.count("\n") > 1
        add(((a, b, c), stop))
        if stop:
            a, b, c = "", "", "^"
    return out


def _lines(body: str) -> list[str]:
    return [x for x in body.split("\n") if x.strip()]


def _lead(line: str) -> str:
    return " ".join(_LEAD.findall(line[:LINE])[:2])


def _tail(body: str) -> str:
    i = len(body)
    while i and not body[i - 1].isalnum():
        i -= 1
    return body[i:]


_READ_SCHEMA = (
    "kind string, key string, n long, hits long, late long, rid long, doc_id long, source string, chars long, bytes long, whole boolean, "
    "marked boolean, loose boolean, context string, word string, lead string, lead2 string, tail string"
)
_READ_COLUMNS = [x.strip().split()[0] for x in _READ_SCHEMA.split(",")]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per text (kind ENDING), and the counts of a batch: contexts (and sentences that end
    after them), words (and how often one ends an open text), line leads (and how often in last place)."""
    shapes = _Shapes()
    for pdf in batches:
        contexts, stops, words, finals, leads, last, late = (Counter() for _ in range(7))
        rows = []
        for rid, doc, source, text in pdf.itertuples(index=False, name=None):
            trimmed, body = text.rstrip(), _unmarked(text)
            tail, found, lines = _tail(body), _TOKEN.findall(body), _lines(body)
            ended = _WHOLE.match(tail) is not None
            steps = _walk(found, shapes)
            ending = [x if len(x) <= LINE else "" for x in lines[-2:]] if len(lines) > 1 else ["", ""]
            rows.append((
                ENDING, None, 0, 0, 0, rid, doc, source, len(text), len(text.encode("utf-8", "surrogatepass")), ended or not found,
                _PLAIN.search(trimmed) is not None, body == trimmed != text, " ".join(steps[-1][0]) if steps else "", found[-1][0] if found else "",
                _lead(ending[1]), _lead(ending[0]), tail,
            ))
            if not found:
                continue
            words.update([x[0] for x in (found if ended else found[:-1])])
            if not ended:
                finals[found[-1][0]] += 1
            steps = steps if ended else steps[:-1]
            contexts.update([x[0] for x in steps])
            stops.update([x[0] for x in steps if x[1]])
            for j, line in enumerate(lines):
                if len(line) <= LINE:
                    lead = _lead(line)
                    leads[lead] += 1
                    last[lead] += not ended and j == len(lines) - 1 and j > 0
                    late[lead] += not ended and j >= len(lines) - 2 and j > 0
        none = (None,) * 13
        counts = [(CONTEXT, " ".join(k), v, stops[k], 0, *none) for k, v in contexts.items()]
        counts += [(WORD, k, words[k], finals[k], 0, *none) for k in words.keys() | finals.keys()]
        counts += [(LINE_LEAD, k, v, last[k], late[k], *none) for k, v in leads.items()]
        yield pd.DataFrame(rows + counts, columns=_READ_COLUMNS).astype({c: "Int64" for c in ("rid", "doc_id", "chars", "bytes")})


def length_tests(lengths: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Lengths at which the texts of ``lengths(source, chars, bytes)`` stop too often.

    Returns ``source, unit, bin, n, risk, expected, p``.

    ``unit`` is 'chars', 'bytes' or 'bins'. The hazard of a length is tested against that of its
    neighbours (``NEAR`` bins on either side without the ``APART`` nearest) by the Chernoff bound of
    the Poisson tail; Benjamini-Hochberg holds the false discoveries of
    each source and unit at ``alpha``. Counts more uneven than chance has it raise p, and a limit must
    also hold ``LEAST_RATIO`` times what is expected. Grouped counts go through the windows, never documents.
    """
    values = F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("bin")),
        F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("bin")),
        F.struct(F.lit("bins").alias("unit"), F.floor(F.col("chars") / BIN).alias("bin")),
    )
    counts = lengths.select("source", F.explode(values).alias("v")).groupBy("source", "v.unit", "v.bin").agg(F.count("*").alias("n"))
    line = Window.partitionBy("source", "unit").orderBy("bin")
    risk = counts.withColumn("risk", F.sum("n").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing)))

    def around(column: str) -> Column:
        wide = F.sum(column).over(line.rangeBetween(-NEAR, NEAR))
        return wide - F.sum(column).over(line.rangeBetween(-APART, APART))

    # Bins without documents have no row: the exposure is the mean risk of the rows there are, times
    # the neighbouring bins between the shortest and the longest text.
    ends = Window.partitionBy("source", "unit")
    low, high = F.min("bin").over(ends), F.max("bin").over(ends)
    width = lambda k: F.least(F.col("bin") + k, high) - F.greatest(F.col("bin") - k, low) + 1
    spans = F.greatest(width(NEAR) - width(APART), F.lit(1)).cast("double")
    mean_risk = F.coalesce(F.try_divide(around("risk").cast("double"), around("one")), F.col("risk").cast("double"))
    near = risk.withColumn("one", F.lit(1)).withColumn("expected", F.col("risk") * (around("n") + 0.5) / (F.greatest(mean_risk, F.lit(1.0)) * spans)).drop("one")
    d, e = F.col("n").cast("double"), F.col("expected")
    group = Window.partitionBy("source", "unit")
    # lengths clump more than chance would have it; the 90th percentile of a squared unit normal is 2.71
    clump = F.greatest(F.lit(1.0), F.percentile_approx((d - e) * (d - e) / e, 0.9).over(group) / 2.71)
    tested = near.withColumn("p", F.when(d > e, F.exp(-(d * F.log(d / e) - d + e) / clump)).otherwise(F.lit(1.0)))
    m = F.count("*").over(group)
    order = Window.partitionBy("source", "unit").orderBy("p", "bin")
    ranked = tested.withColumn("m", m).where(F.col("p") <= alpha).withColumn("rank", F.row_number().over(order))
    passed = F.max(F.when(F.col("p") <= F.col("rank") / F.col("m") * alpha, F.col("rank"))).over(group)
    return ranked.withColumn("upto", passed).where((F.col("rank") <= F.col("upto")) & (F.col("n") >= LEAST_RATIO * F.col("expected"))).select("source", "unit", "bin", "n", "risk", "expected", "p")


def open_tests(ends: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Stretches of lengths in which the texts of ``ends(source, chars, is_open, usual)`` end open too often.

    Returns ``source, width, bin``: ``width`` in bins (0: all lengths). The rows are texts without a mark
    of a sentence's end. In a stretch of lengths, the hazard of an open ending among them is tested
    against ``usual``, the share of all sentence ends that would look as open if their mark were left
    out, by the Chernoff bound of the Poisson tail; Benjamini-Hochberg holds the false discoveries of
    each source at ``alpha``. Grouped counts go through the windows.
    """
    stretches = F.array(*[F.struct(F.lit(w).alias("width"), (F.floor(F.col("chars") / (BIN * w)) if w else F.lit(0).cast("long")).alias("bin")) for w in STRETCHES])
    counts = ends.select("source", "is_open", "usual", F.explode(stretches).alias("v")).groupBy("source", "v.width", "v.bin").agg(F.count("*").alias("risk"), F.sum(F.col("is_open").cast("int")).alias("n"), F.max("usual").alias("usual"))
    d, e = F.col("n").cast("double"), F.col("risk") * F.col("usual") + 0.05
    tested = counts.select("source", "width", "bin", F.when(d > e, F.exp(-(d * F.log(d / e) - d + e))).otherwise(F.lit(1.0)).alias("p"))
    group = Window.partitionBy("source")
    ranked = tested.withColumn("m", F.count("*").over(group)).where(F.col("p") <= alpha).withColumn("rank", F.row_number().over(group.orderBy("p", "width", "bin")))
    passed = F.max(F.when(F.col("p") <= F.col("rank") / F.col("m") * alpha, F.col("rank"))).over(group)
    return ranked.withColumn("upto", passed).where(F.col("rank") <= F.col("upto")).select("source", "width", "bin")


def _facts_of(ends: DataFrame, facts: DataFrame) -> DataFrame:
    """The open endings (by ``rid``) with the counts of their contexts, words and leads.

    Endings ask by (kind, key). Each question is answered once; an answer that many endings wait for is
    repeated in parts. Missing leads ask nothing.
    """
    two, one = F.substring_index("key", " ", -2), F.substring_index("key", " ", -1)
    ctx = facts.where(F.col("kind") == CONTEXT)
    grouped = lambda kind, key: ctx.groupBy(key.alias("key")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.lit(0).cast("long").alias("late")).select(F.lit(kind).alias("kind"), "key", "n", "hits", "late")
    known = facts.where(F.col("kind") != CONTEXT).unionByName(ctx.withColumn("kind", F.lit("c3"))).unionByName(grouped("c2", two)).unionByName(grouped("c1", one))
    asks = {
        "c3": F.col("context"), "c2": F.substring_index("context", " ", -2), "c1": F.substring_index("context", " ", -1), WORD: F.col("word"),
        LINE_LEAD: F.col("lead"), "l2": F.col("lead2"),
    }
    asked = ends.select("rid", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), c.alias("key")) for k, c in asks.items()])).alias("x")).select("rid", "x.*")
    asked = asked.where("not (key = '' and slot in ('l', 'l2'))").withColumn("kind", F.when(F.col("slot") == "l2", F.lit(LINE_LEAD)).otherwise(F.col("slot")))
    parts = asked.groupBy("kind", "key").agg((1 + F.floor(F.count("*") / HOT)).cast("int").alias("parts"))
    answers = stage(parts.join(known, ["kind", "key"]), "answers")
    spread = answers.select("kind", "key", "n", "hits", "late", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    most = answers.where("parts > 1").select("kind", "key", "parts")  # a row per HOT endings at most
    told = asked.join(F.broadcast(most), ["kind", "key"], "left").withColumn("part", F.pmod(F.xxhash64("rid"), F.coalesce("parts", F.lit(1))).cast("int"))
    told = told.join(spread, ["kind", "key", "part"])
    pick = lambda slot, c, name: F.max(F.when(F.col("slot") == slot, F.col(c))).alias(name)
    return told.groupBy("rid").agg(
        *[pick(f"c{i}", c, f"{n}{i}") for i in (3, 2, 1) for c, n in (("n", "n"), ("hits", "h"))], pick(WORD, "n", "nw"), pick(WORD, "hits", "fw"),
        pick(LINE_LEAD, "n", "nl"), pick(LINE_LEAD, "hits", "hl"), pick("l2", "n", "nm"), pick("l2", "late", "hm"), pick("l2", "hits", "hx"),
    )


def judge(documents: DataFrame, alpha: float = 0.01, far: float = 0.1, near: float = 0.5) -> DataFrame:
    """``doc_id, source, chars, at_limit, in_stretch, reason, is_cut`` for every document with a text.

    ``documents(doc_id, source, text)``. Null and blank texts are not cut; a null source is a source
    of its own; rows that repeat a doc_id are each judged. A text that ends a sentence is whole. Else
    its ending is incomplete if its last word is held by no text elsewhere, if sentences end after its last
    words in less than ``far`` of the cases (``near`` at a significant length, after a trailing blank, or
    before a plain mark), or if it ends in a comma or hyphen; a known closing line (signature, credit)
    is whole. It is cut if moreover its length is significant, as a limit or in a stretch of open endings.
    """
    rows = documents.where(F.col("text").rlike(r"\S")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text")
    read = stage(rows.mapInPandas(_read, _READ_SCHEMA), "read")
    facts = read.where(F.col("kind") != ENDING).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("late").alias("late"))
    facts = stage(facts, "facts")
    ends = read.where(F.col("kind") == ENDING).drop("kind", "key", "n", "hits", "late").withColumn("_s", F.coalesce("source", F.lit("\u0000")))

    tests = length_tests(ends.select("source", "chars", "bytes"), alpha)
    limits = tests.groupBy("source").agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("bin"))).alias(u + "_at") for u in ("chars", "bytes", "bins")])
    # one row per source; its arrays hold significant lengths only
    limits = limits.select(F.coalesce("source", F.lit("\u0000")).alias("_s"), "chars_at", "bytes_at", "bins_at")
    at = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    ends = ends.join(F.broadcast(limits), "_s", "left").withColumn(  # sources are few, their significant lengths at most one in LEAST_RATIO
        "at_limit", at("chars_at", F.col("chars")) | at("bytes_at", F.col("bytes")) | at("bins_at", F.floor(F.col("chars") / BIN))
    )
    open_ends = ends.where(~F.col("whole"))
    x = open_ends.join(_facts_of(open_ends, facts), "rid", "left")
    n = {k: F.coalesce(k, F.lit(0)) for k in ("n3", "h3", "n2", "h2", "n1", "h1", "nw", "fw", "nl", "hl", "nm", "hm", "hx")}
    rate = (
        F.when(n["n3"] >= 20, n["h3"] / n["n3"])
        .when(n["n2"] >= 20, F.greatest(n["h2"] / n["n2"], F.try_divide(n["h3"], n["n3"])))
        .when(n["n1"] >= 20, F.greatest(n["h1"] / n["n1"], F.try_divide(n["h2"], n["n2"]), F.try_divide(n["h3"], n["n3"])))
    )
    signed = ((n["nl"] >= 5) & (n["hl"] / n["nl"] >= 0.5)) | ((n["nm"] >= 5) & (n["hm"] / n["nm"] >= 0.8) & (n["hx"] / n["nm"] < 0.3))
    x = x.select("rid", "doc_id", "source", "_s", "chars", "at_limit", "marked", "loose", "word", "tail", rate.alias("rate"), signed.alias("signed"), (n["nw"] == 0).alias("unseen"), (n["fw"] >= 5).alias("closing"))
    small = F.col("word").rlike(r"^\p{Ll}")
    lenient = F.col("at_limit") | F.col("loose") | F.col("marked")
    reason = (
        F.when(F.col("signed") & ~(F.col("at_limit") & F.col("unseen") & ~F.col("closing")), F.lit(None))
        .when(F.col("unseen") & (small | F.col("at_limit")), F.lit("in a word"))
        .when(F.col("tail").rlike(r"^\s?[,\-–—(\[“]\s*$"), F.lit("after a comma or dash"))
        .when(F.coalesce(F.col("rate"), F.lit(0.0)) < F.when(lenient, F.lit(near)).otherwise(F.when(F.col("unseen"), F.lit(1.5 * far)).otherwise(F.lit(far))), F.lit("in a sentence"))
        .otherwise(F.lit(None))
    )
    judged = stage(x.select("rid", "doc_id", "source", "_s", "chars", "at_limit", reason.alias("reason")), "judged")
    # how often a sentence of a whole text ends after words as telling as these
    share = facts.where(F.col("kind") == CONTEXT).agg(F.try_divide(F.sum(F.when(F.col("hits") < far * F.col("n"), F.col("hits")).otherwise(0)), F.sum("hits")).alias("usual"))
    every = judged.select("source", "chars", F.col("reason").isNotNull().alias("is_open")).join(F.broadcast(share.select(F.coalesce("usual", F.lit(0.0)).alias("usual"))))  # one row
    found = open_tests(every, alpha).groupBy(F.coalesce("source", F.lit("\u0000")).alias("_s")).agg(F.collect_set(F.struct("width", "bin")).alias("stretches"))
    inside = F.lit(False)
    for w in STRETCHES:
        b = F.floor(F.col("chars") / (BIN * w)) if w else F.lit(0).cast("long")
        inside = inside | at("stretches", F.struct(F.lit(w).alias("width"), b.alias("bin")))
    judged = judged.join(F.broadcast(found), "_s", "left").withColumn("in_stretch", inside)  # a row per source
    cut = F.when(F.col("at_limit") | F.col("in_stretch"), F.col("reason"))
    judged = judged.select("doc_id", "source", "chars", "at_limit", "in_stretch", cut.alias("reason"))
    whole = ends.where("whole").select("doc_id", "source", "chars", "at_limit", F.lit(False).alias("in_stretch"), F.lit(None).cast("string").alias("reason"))
    return judged.unionByName(whole).withColumn("is_cut", F.col("reason").isNotNull())


def rates(judged: DataFrame) -> DataFrame:
    """Per source: documents, cut documents, their share, and how many lie at significant lengths."""
    cut = F.col("is_cut").cast("int")
    return judged.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(cut).alias("n_cut"), F.avg(cut).alias("cut_rate"),
        F.sum((F.col("is_cut") & F.col("at_limit")).cast("int")).alias("n_cut_at_limit"),
    )
