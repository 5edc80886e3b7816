"""Variant spellings of names: metric-space partitioning under an edit metric.

Names are first read into a plain form (case, accents, titles, order of parts, legal forms, common
abbreviations), so that only spelling is left to compare. The plain forms are points of the metric
space of strings under the Damerau-Levenshtein distance (insertions, deletions, substitutions and
transpositions; the unrestricted form, which is a metric). Pivots are drawn by a hash, every form
goes to the cell of its nearest pivot, and is replicated to each cell whose pivot is at most
``r`` farther: of two forms within ``r``, by the triangle inequality the one farther from its nearest
pivot is met in the cell of the other. A cell with many forms
is partitioned again by pivots drawn inside it, level by level. Cells are cut into rings by length (the
distance to the empty string). In a ring, all forms are compared by the letters they hold, a bound
of the distance that is a product of matrices; distances to the pivot may differ by at most r, and the
distance of what is left is computed exactly. Forms are joined at two edits; letters that are misread
in groups (rn for m, kw for qu) are undone and count as one error, and a second error needs evidence.
Short forms (initials, nicknames, cut given names) are then looked up under the keys that their
bearer's full form would have.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave.session import stage

#: Forms per pivot, and the pivots of one level. A cell with more forms at home than ``CELL`` is partitioned again.
#: A distance to a pivot costs as much as some hundred comparisons by letters, so cells are wide.
FORMS_PER_PIVOT, FAN, CELL = 300, 64, 60_000
#: Levels at most. Larger cells than ``CELL`` only arise below them where forms crowd at one distance;
#: they are joined all the same.
LEVELS = 8
#: Forms of a cell that are placed together, and in one task, about.
PART = 2_000
#: Pairs whose distances are computed together, and pairs of a ring that are compared by letters at once.
BLOCK, TILE = 16_384, 8_000_000
#: Errors in one name that are looked for.
ERRORS = 2

# Titles, legal forms, and usual abbreviations of words for a body of people.
TITLES = "rev reverend capt captain prof professor dr doctor judge mr mrs ms miss sir dame hon honorable sgt col gen lt maj fr sister brother".split()
SUFFIXES = "jr sr ii iii iv esq phd md".split()
LEGAL = "inc incorporated ltd limited llc llp corp corporation co plc gmbh".split()
ABBREVIATIONS = {
    "all": "alliance", "assn": "association", "assoc": "association", "asso": "association", "bhd": "brotherhood", "bd": "board", "cncl": "council",
    "cmte": "committee", "comm": "committee", "cttee": "committee", "dept": "department", "fed": "federation", "fdn": "foundation", "govt": "government",
    "inst": "institute", "intl": "international", "lg": "league", "natl": "national", "org": "organization", "soc": "society", "un": "union", "univ": "university",
}
#: Given names and common short forms of them in English.
NICKNAMES = {
    "abigail": "abby gail", "agustin": "tino gus", "alexander": "alex sandy", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "catherine": "cathy kate kitty", "charles": "charlie chuck", "christopher": "chris kit", "cornelius": "neil con", "daniel": "dan danny",
    "david": "dave davy", "deborah": "deb debbie", "dorothy": "dot dotty dolly", "edward": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betty eliza bess",
    "eugenia": "genie gena", "francis": "frank", "frederick": "fred freddy", "gregory": "greg", "harriet": "hattie", "henry": "harry hank", "isabella": "bella izzy",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "josie jo", "katherine": "kate kathy kitty",
    "lawrence": "larry", "leonard": "len lenny leo", "lucinda": "cindy lucy", "margaret": "peggy maggie meg madge", "mary": "molly polly", "matthew": "matt",
    "michael": "mike mick", "nathaniel": "nat nate", "nicholas": "nick", "oliver": "ollie", "patricia": "trish pat patty tricia", "patrick": "pat paddy",
    "philippa": "pippa", "rebecca": "becky becca", "richard": "dick rick rich", "robert": "bob bobby rob robbie bert", "ronald": "ron", "samuel": "sam sammy",
    "stephen": "steve", "steven": "steve", "susan": "sue susie", "susannah": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim",
    "tobias": "toby", "victoria": "vicky tori", "virginia": "ginny", "walter": "walt wally", "wilhelmina": "mina minnie willa", "william": "bill billy will willy",
    "zachary": "zach zack",
}
_FORMAL: dict[str, list[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL.setdefault(_s, []).append(_full)
#: Digits that stand for letters inside words, as misread characters.
_MISREAD = str.maketrans("01", "ol")
_MIXED = re.compile(r"\b(?=\w*[^\W\d_])\w*[01]\w*")
#: Groups of letters that are misread or misheard as others: two edits, but one error.
GROUPS = (("rn", "m"), ("qu", "kw"))
_INITIALS = re.compile(r"(?:[^\W\d_]\.){2,}$")


def plain(name: str, kind: str) -> tuple[str, str]:
    """(plain form, how): 'full', 'initial' (I. Last) or 'initials' (Place A.B.). May be empty."""
    s = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch)).lower().replace("’", "'").replace("&", " and ")
    s = _MIXED.sub(lambda m: m.group().translate(_MISREAD), s)
    if kind == "ORG":
        raw = s.replace(",", " ").split()
        how = "full"
        words = []
        for w in raw:
            if _INITIALS.match(w):
                words.append(w.replace(".", ""))
                how = "initials" if w == raw[-1] and len(raw) > 1 else how
            elif (w := w.strip(".'\"()")).endswith("'s"):
                words.append(w[:-2] + "s")
            elif w:
                words.append(w)
        while len(words) > 1 and words[-1] in LEGAL:
            words.pop()
        if "of" in words[1:-1]:
            i = words.index("of", 1)
            words = words[i + 1 :] + words[:i]
        words = [w for w in words if w not in ("the", "and", "of")] or words
        if how == "full":
            words = [ABBREVIATIONS.get(w, w) if i else w for i, w in enumerate(words)]
        return " ".join(words), how
    parts = [p.split() for p in s.split(",")]
    parts = [[w.strip(".'\"()") for w in p] for p in parts]
    parts = [[w for w in p if w and w not in SUFFIXES] for p in parts]
    parts = [p for p in parts if p]
    words = [w for p in (parts[1:] + parts[:1]) for w in p]
    kept = [w for w in words if w not in TITLES]
    words = kept if len(kept) > 1 or not words else words
    if len(words) > 1 and len(words[-1]) == 1 and len(words[0]) > 1:
        words = words[-1:] + words[:-1]
    words = [w for i, w in enumerate(words) if len(w) > 1 or i == 0]
    return " ".join(words), "initial" if len(words) > 1 and len(words[0]) == 1 else "full"


def _plain(names: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    rows = [plain(n, k) for n, k in zip(names, kinds)]
    return pd.DataFrame(rows, columns=["form", "how"])


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, position x string (0 beyond the end), and lengths."""
    size = np.array([len(s) for s in strings], np.int32)
    wide = max(1, int(size.max(initial=0)))
    codes = np.array(strings, f"U{wide}").view(np.uint32).reshape(len(strings), wide)
    return np.ascontiguousarray(codes.T.astype(np.min_scalar_type(int(codes.max(initial=0))))), size


def _pair_distances(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Damerau-Levenshtein distances of the columns of ``a`` and ``b``, whose lengths are la and lb.

    A transposition pays only if one of its sides is adjacent (else substitutions are no dearer), so
    only those are tried; this is the unrestricted distance all the same.
    """
    (wide, n), rows = a.shape, int(lb.max(initial=0))
    far = wide + rows + 1
    kind = np.int8 if far <= 56 else np.int16 if far <= 15_000 else np.int32
    at = np.arange(wide + 1, dtype=kind)[:, None]
    before, last = None, np.broadcast_to(at, (wide + 1, n)).copy()
    swaps = np.full((wide, n), far, kind)  # of a[j]: what a swap costs with the last row of its letter, if a[j - 1] is the letter of this one
    found, every = np.zeros(n, kind), np.arange(n)
    found[lb == 0] = la[lb == 0]
    was = None
    for i in range(1, rows + 1):
        same = a == b[i - 1]
        now = np.empty_like(last)
        now[0] = i
        np.minimum(last[1:] + kind(1), last[:-1] + (~same).view(np.int8), out=now[1:])
        if i > 1 and wide > 1:
            np.minimum(now[2:], np.where(same[:-1], swaps[1:] + kind(i), kind(far)), out=now[2:])
            back = np.where(same, before[:-1] - at[1:], kind(far))
            for j in range(1, wide - 1):
                np.minimum(back[j], back[j - 1], out=back[j])
            np.minimum(now[2:], np.where(was[1:], back[:-1] + at[2:], kind(far)), out=now[2:])
        if wide > 1:
            np.copyto(swaps[1:], last[:-2] - kind(i), where=same[1:])
        for j in range(1, wide + 1):
            np.minimum(now[j], now[j - 1] + kind(1), out=now[j])
        before, last, was = last, now, same
        ends = every[lb == i]
        found[ends] = now[la[ends], ends]
    return found


def _distances_at(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the strings at x in ``a`` and at y in ``b``, both as codes and lengths."""
    out = np.zeros(len(x), np.int32)
    for i in range(0, len(x), BLOCK):
        p, q = x[i : i + BLOCK], y[i : i + BLOCK]
        la, lb = a[1][p], b[1][q]
        out[i : i + BLOCK] = _pair_distances(a[0][: max(1, la.max()), p], b[0][: max(1, lb.max()), q], la, lb)
    return out


def distances(names: list[str], pivots: list[str]) -> np.ndarray:
    """Damerau-Levenshtein distances, names x pivots, all pairs at once."""
    n, k = len(names), len(pivots)
    if not n or not k:
        return np.zeros((n, k), np.int32)
    return _distances_at(_codes(names), _codes(pivots), np.repeat(np.arange(n), k), np.tile(np.arange(k), n)).reshape(n, k)


def distance(a: str, b: str) -> int:
    """The same distance for one pair."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, at = [far, i], 0
        for j, y in enumerate(b, 1):
            k = seen.get(y, 0)
            swap = rows[k][at] + (i - k - 1) + 1 + (j - at - 1)
            if x == y:
                at = j
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
        seen[x] = i
        rows.append(row)
    return rows[-1][-1]


def ungrouped(form: str) -> str:
    """The form with each misread group as the letters it may stand for."""
    for group, letters in GROUPS:
        form = form.replace(group, letters)
    return form


def edits(a: str, b: str, errors: int) -> list[tuple[str, str, bool]]:
    """The words in which two forms differ, and whether one error explains each."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return [("", "", errors == 1)]
    return [(p, q, ungrouped(p) == ungrouped(q) or distance(p, q) <= 1) for p, q in zip(x, y) if p != q]


def _nearest(names: pd.DataFrame, pivots: list[str], level: int, radius: int) -> pd.DataFrame:
    """A row of each name for each pivot that may matter to it: ``at`` is the pivot's position, ``near`` the nearest one's distance."""
    names = names.sort_values("size", kind="stable", ignore_index=True)  # a block of like lengths needs the least padding
    step = max(8, 1_000_000 // len(pivots))
    out = []
    for i in range(0, len(names), step):
        block = names[i : i + step]
        d = distances(list(block["form"]), pivots)
        near = d.min(axis=1)
        rows, at = np.nonzero(d <= near[:, None] + radius)
        host = d.argmin(axis=1)[rows] == at
        out.append(pd.DataFrame({
            "form": block["form"].to_numpy()[rows], "at": at, "d": d[rows, at], "near": near[rows], "size": block["size"].to_numpy()[rows],
            "host": host, "guest": block["guest"].to_numpy()[rows] | np.where(host, 0, 1 << level).astype(np.int32),
        }))
    return pd.concat(out)


def _placing(level: int, radius: int):
    """(cell and part, its forms, the cell's pivots) -> the forms in the cells of those pivots."""

    def place(key: tuple, names: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        columns = ["cell", "form", "d", "near", "size", "host", "guest"]
        if not len(names) or not len(near):  # nothing drawn: the cell stays as it is
            return names[columns]
        pivots = sorted(near["pivot"])
        ids = np.array([xxhash.xxh64_intdigest(f"{level} {key[0]} {p}") >> 1 for p in pivots], np.int64)
        found = _nearest(names, pivots, level, radius)
        return found.assign(cell=ids[found["at"]])[columns]

    return place


def cells(forms: DataFrame, radius: int) -> DataFrame:
    """``cell, form, d, near, size, host, guest, home``: each form in the cell of its nearest pivot, and a replica in each that it may be needed in.

    ``d`` is the distance to the cell's pivot, ``near`` that to the nearest one, which is the cell's for a
    ``host``. ``guest`` has a bit for each level at which the form is not a host; a pair of guests of one
    level is met in other cells. A form is at home where it is a host at all levels.

    One level draws at most about ``FAN`` pivots in each cell that is too large, so pivots grow with the
    forms and no form is compared with more than ``FAN`` of them a level. Forms of a cell are placed
    in parts, each beside the cell's pivots.
    """
    schema = "cell long, form string, d int, near int, size int, host boolean, guest int"
    zero = F.lit(0)
    todo = forms.select(zero.cast("long").alias("cell"), "form", zero.alias("d"), zero.alias("near"), F.length("form").alias("size"), F.lit(True).alias("host"), zero.alias("guest"))
    todo = stage(todo, "forms")
    done = None
    for level in range(LEVELS):
        counts = todo.groupBy("cell").agg(F.sum((F.col("guest") == 0).cast("int")).alias("n"), F.count("*").alias("every")).where(F.col("n") > (CELL if level else 0))
        large = stage(counts, "large")
        if large.isEmpty():
            break
        rest = todo.join(large.select("cell"), "cell", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        wide = large.select("cell", "n", F.least(F.lit(FAN), F.greatest(F.lit(1), F.ceil(F.col("n") / FORMS_PER_PIVOT))).alias("want"), F.ceil(F.col("every") / PART).cast("int").alias("parts"))
        inner = todo.join(wide, "cell")
        order = Window.partitionBy("cell").orderBy(F.xxhash64("form", F.lit(5 + level)), "form")
        drawn = inner.where("guest = 0").where(F.pmod(F.xxhash64("form", F.lit(5 + level)), F.lit(1 << 40)) <= F.greatest(F.lit(64.0), 4.0 * F.col("want")) / F.col("n") * (1 << 40))
        few = drawn.withColumn("i", F.row_number().over(order)).where("i <= want")  # some 4 * FAN forms a cell are put in order
        pivots = stage(few.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("form").alias("pivot")), "pivots")
        placed = inner.select("cell", F.pmod(F.xxhash64("form", F.lit(3)), F.col("parts")).cast("int").alias("part"), "form", "d", "near", "size", "host", "guest")

        tasks = max(1, -(-large.agg(F.sum("every")).first()[0] // PART))  # few bytes, but much work a form
        placed, pivots = placed.repartition(tasks, "cell", "part"), pivots.repartition(tasks, "cell", "part")
        todo = placed.groupBy("cell", "part").cogroup(pivots.groupBy("cell", "part")).applyInPandas(_placing(level, radius), schema)
        todo = stage(todo, "cells")
    return (todo if done is None else done.unionByName(todo)).withColumn("home", F.col("guest") == 0)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Letters that each string holds, in 32 classes, up to three of each: string x (class, how many), 0 or 1."""
    count = np.zeros((codes.shape[1], 32), np.int8)
    every = np.arange(codes.shape[1])
    for row in codes:
        count[every, row & 31] += (row > 0) & (count[every, row & 31] < 3)
    return np.concatenate([count > i for i in range(3)], axis=1).astype(np.float32)


def _meeting(radius: int):
    """(cell and ring, its forms) -> pairs within the radius of which the shorter form has the ring's length."""

    def close(x: np.ndarray, y: np.ndarray, held: np.ndarray, size: np.ndarray):
        """Positions in x and y that the letters leave. An edit changes two letters at most, or one and the length; a swap none."""
        n = held.sum(axis=1)
        one = np.ones(len(x), np.float32)
        p = np.column_stack([held[x], n[x], one])
        step = max(1, TILE // len(x))
        for j in range(0, len(y), step):
            z = y[j : j + step]
            most = 2 * radius - (size[z] - size[x[0]])
            q = np.column_stack([-2 * held[z], np.ones(len(z), np.float32), n[z] - most])
            at = np.flatnonzero((p @ q.T.astype(np.float32) <= 0).ravel())
            yield x[at // len(z)], z[at % len(z)]

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forms, size, guest = rows["form"].to_numpy(object), rows["size"].to_numpy(), rows["guest"].to_numpy()
        d, near, host = rows["d"].to_numpy(), rows["near"].to_numpy(), rows["host"].to_numpy()
        codes = _codes(list(forms))
        held = _letters(codes[0])
        held = held[:, held.any(axis=0)]
        level = size == key[1]
        out = []
        for g in np.unique(guest[level]):
            own = np.flatnonzero(level & (guest == g))
            for h in np.unique(guest):
                if g & h:
                    continue
                # of one length, a pair is met from one side
                other = np.flatnonzero((guest == h) & ((size > key[1]) | (h >= g)))
                for i in range(0, len(own) if len(other) else 0, 1_024):
                    for x, y in close(own[i : i + 1_024], other, held, size):
                        fit = (np.abs(d[x] - d[y]) <= radius) & ((x < y) | (size[y] > key[1]) | (h > g))
                        x, y = x[fit], y[fit]
                        # a guest is met by hosts that are nearer to their pivot than it is to its own; ties go by the form
                        a, b = np.where(host[x], x, y), np.where(host[x], y, x)
                        tie = (near[a] == near[b]) & ~host[b]
                        fit = host[b] | (near[a] < near[b])
                        fit[tie] = [forms[p] < forms[q] for p, q in zip(a[tie], b[tie])]
                        x, y = x[fit], y[fit]
                        e = _distances_at(codes, codes, x, y)
                        fit = (e > 0) & (e <= radius)
                        out.append((x[fit], y[fit], e[fit]))
        if not out:
            return pd.DataFrame({"a": [], "b": [], "d": []}).astype({"a": object, "b": object, "d": np.int32})
        x, y, e = (np.concatenate(c) for c in zip(*out))
        swap = np.fromiter((p > q for p, q in zip(forms[x], forms[y])), bool, len(x))
        return pd.DataFrame({"a": forms[np.where(swap, y, x)], "b": forms[np.where(swap, x, y)], "d": e.astype(np.int32)})

    return meet


def near_forms(forms: DataFrame, radius: int = 1) -> DataFrame:
    """Pairs ``a < b`` of distinct strings of ``forms(form)`` at distance ``d`` <= radius."""
    placed = stage(cells(forms.where("form is not null").select("form").distinct(), radius), "placed")
    rings = placed.select("cell", F.explode(F.array(*[F.col("size") - i for i in range(radius + 1)])).alias("ring"), "form", "d", "near", "size", "host", "guest")
    return rings.groupBy("cell", "ring").applyInPandas(_meeting(radius), "a string, b string, d int").distinct()


def near_spellings(forms: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``forms(form)`` with the ``errors`` that part them: 1 or 2.

    Any number of misread groups is one error, beside which there may be one edit.
    """

    @F.pandas_udf("string")
    def undo(s: pd.Series) -> pd.Series:
        return s.map(ungrouped)

    read = stage(forms.select("form", undo("form").alias("undone")), "undone")
    points = read.select("form").unionByName(read.select(F.col("undone").alias("form"))).distinct()
    near = stage(near_forms(points, ERRORS), "points")
    a, b = (read.select(F.col("form").alias(p), F.col("undone").alias(f"u{p}")) for p in ("a", "b"))
    alike = a.join(b.withColumnRenamed("ub", "ua"), "ua").where("a < b").select("a", "b", F.lit(1).alias("errors"))
    apart = near.where("d = 1").select(F.col("a").alias("ua"), F.col("b").alias("ub")).join(a, "ua").join(b, "ub").where("a <> ua or b <> ub")
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(2).alias("errors"))
    plainly = near.join(a.select("a"), "a", "left_semi").join(b.select("b"), "b", "left_semi").select("a", "b", F.col("d").alias("errors"))
    return plainly.unionByName(alike).unionByName(apart).groupBy("a", "b").agg(F.min("errors").alias("errors"))


def link_names(mentions: DataFrame) -> DataFrame:
    """``name, bearer, how``: the names of ``mentions(name, type, context)`` by bearer.

    ``type`` is PERSON or ORG (others are dropped), ``context`` any value that mentions of one
    bearer share (a node id); it breaks ties between possible bearers and may be null. Names are
    trimmed and inner white space is one blank; null and blank names are dropped, repeated mentions
    count once per context. ``bearer`` is the plain form that most contexts back. A short form with
    several possible bearers that no context tells apart stays alone. Empty input gives no rows.
    """
    clean = F.trim(F.regexp_replace("name", r"(?U)\s+", " "))
    said = mentions.where(F.col("type").isin("PERSON", "ORG")).select(clean.alias("name"), "type", "context").where("name <> ''").distinct()

    @F.pandas_udf("form string, how string")
    def read(names: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return _plain(names, kinds)

    by_name = said.groupBy("name", "type").agg(F.count("*").alias("n")).withColumn("p", read("name", "type"))
    by_name = stage(by_name.select("name", "type", "n", F.col("p.form").alias("form"), F.col("p.how").alias("how")).where("form <> ''"), "names")

    # Two words in unknown order: which of them is a given name shows in the other names.
    two = by_name.where((F.col("type") == "PERSON") & (F.col("how") == "full") & (F.size(F.split("form", " ")) == 2))
    words = two.select(F.substring_index("form", " ", 1).alias("w1"), F.substring_index("form", " ", -1).alias("w2")).distinct()
    seats = (
        words.select(F.explode(F.array(F.struct(F.col("w1").alias("w"), F.lit(1).alias("first")), F.struct(F.col("w2").alias("w"), F.lit(0).alias("first")))).alias("x"))
        .groupBy("x.w").agg(F.sum("x.first").alias("first"), F.count("*").alias("n"))
        .select("w", "first", (F.col("n") - F.col("first")).alias("last"))
    )
    s1, s2 = (seats.select(F.col("w").alias(f"w{i}"), F.col("first").alias(f"f{i}"), F.col("last").alias(f"l{i}")) for i in (1, 2))
    turned = (
        words.join(s1, "w1").join(s2, "w2")
        .where((F.col("f2") >= 3 * F.col("l2")) & (F.col("f2") >= 3) & ((F.col("l1") >= F.col("f1")) | (F.col("f1") <= 2)))
        .select(F.concat_ws(" ", "w1", "w2").alias("form"), F.concat_ws(" ", "w2", "w1").alias("turned"))
    )
    by_name = by_name.join(turned, "form", "left").select("name", "type", "n", "how", F.coalesce("turned", "form").alias("form"))
    by_name = stage(by_name, "forms")

    groups = by_name.groupBy("form").agg(F.sum("n").alias("n"), F.min("how").alias("how"), F.max((F.col("type") == "PERSON").cast("int")).alias("person"))
    groups = stage(groups, "groups")
    full = groups.where("how = 'full'")

    # Typing errors: one in one word. Two words that both go with several others are two words.
    # A second error is believed in another word, if that word is as rare or cut; two in the same
    # word part different names as often, so most of the rarer form's contexts must be shared, and
    # it must be much rarer.
    # A nickname may come with an error in the rest of the name: its full given name is tried as well.
    where_ = said.join(by_name.select("name", "type", "form"), ["name", "type"]).select("form", "context").where("context is not null").distinct()
    first, last = F.substring_index("form", " ", 1), F.expr("substring(form, length(substring_index(form, ' ', 1)) + 2)")
    formal = F.create_map(*[F.lit(x) for k, v in _FORMAL.items() for x in (k, " ".join(v))])
    named = full.where("person = 1 and instr(form, ' ') > 0")
    tried = named.select("form", last.alias("last"), F.explode(F.split(F.element_at(formal, first), " ")).alias("f"))
    tried = tried.select("form", F.concat_ws(" ", "f", "last").alias("tried"))
    near = stage(near_spellings(full.select("form").unionByName(tried.select(F.col("tried").alias("form"))).distinct()), "near")
    once = near.where("errors = 1")
    either = once.select("a", "b").unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))

    @F.pandas_udf("boolean")
    def explained(a: pd.Series, b: pd.Series, errors: pd.Series) -> pd.Series:
        return pd.Series([all(one for _, _, one in edits(*x)) for x in zip(a, b, errors)], dtype=bool)

    pairs = near.join(full.select(F.col("form").alias("a")), "a", "left_semi").join(full.select(F.col("form").alias("b")), "b", "left_semi")
    x, y = F.split("a", " "), F.split("b", " ")
    others = F.filter(F.arrays_zip(x.alias("p"), y.alias("q")), lambda w: w["p"] != w["q"])
    none = F.array(F.struct(F.lit("").alias("p"), F.lit("").alias("q")))
    edited = pairs.select("a", "b", "errors", F.explode(F.when(F.size(x) == F.size(y), others).otherwise(none)).alias("w")).select("a", "b", "errors", "w.*")
    uses = full.select(F.explode(F.array_distinct(F.split("form", " "))).alias("word"), "form").groupBy("word").agg(F.count("*").alias("uses"))
    up, uq = (uses.select(F.col("word").alias(p), F.col("uses").alias(f"uses_{p}")) for p in ("p", "q"))
    is_rare = (F.least("uses_p", "uses_q") <= 2) | (F.greatest("uses_p", "uses_q") >= 20 * F.least("uses_p", "uses_q"))
    is_cut = F.col("p").startswith(F.col("q")) | F.col("q").startswith(F.col("p"))
    pairs = (
        edited.join(up, "p", "left").join(uq, "q", "left")
        .fillna(0, ["uses_p", "uses_q"])
        .groupBy("a", "b", "errors")
        .agg(
            F.count("*").alias("words"), F.bool_and(is_rare | is_cut).alias("each"), F.bool_or(is_rare).alias("rare"),
            F.min("uses_p").alias("uses_a"), F.min("uses_q").alias("uses_b"),
        )
        .where("each and rare")
    )
    # few pairs are left for Python
    pairs = stage(pairs.withColumn("one", explained("a", "b", "errors")).where("one or words = 1"), "edited")
    seen = where_.groupBy("form").agg(F.count("*").alias("seen"))
    shared = (
        pairs.where("not one").select("a", "b").join(where_.select(F.col("form").alias("a"), "context"), "a")
        .join(where_.select(F.col("form").alias("b"), "context"), ["b", "context"])
        .groupBy("a", "b").agg(F.count("*").alias("shared"))
        .join(seen.select(F.col("form").alias("a"), F.col("seen").alias("seen_a")), "a").join(seen.select(F.col("form").alias("b"), F.col("seen").alias("seen_b")), "b")
        .where((F.col("shared") >= 2) & (2 * F.col("shared") > F.least("seen_a", "seen_b")) & (F.greatest("seen_a", "seen_b") >= 3 * F.least("seen_a", "seen_b")))
    )
    kept = ["a", "b", "errors", "uses_a", "uses_b"]
    pairs = stage(pairs.where("one").select(kept).unionByName(pairs.join(shared.select("a", "b"), ["a", "b"]).select(kept)), "pairs")
    back = full.select("form", "n")
    both = pairs.select(F.col("a").alias("form"), F.col("b").alias("base"), F.col("uses_a").alias("ul"), F.col("uses_b").alias("ur"), "errors").unionByName(
        pairs.select(F.col("b").alias("form"), F.col("a").alias("base"), F.col("uses_b").alias("ul"), F.col("uses_a").alias("ur"), "errors")
    )
    ranked = both.join(back, "form").join(back.select(F.col("form").alias("base"), F.col("n").alias("n_base")), "base")
    up = F.struct(F.col("ur"), F.col("n_base"), F.col("base"))
    ranked = ranked.where(up > F.struct(F.col("ul"), F.col("n"), F.col("form")))
    typo = stage(ranked.groupBy("form").agg(F.max_by("base", F.struct(-F.col("errors"), up)).alias("base")), "typos")

    rare = uses.where("uses <= 2").select(F.col("word").alias("end"))
    guess = (
        tried.withColumn("end", F.substring_index("form", " ", -1)).join(rare, "end", "left_semi")
        .join(either.select(F.col("a").alias("tried"), F.col("b").alias("base")), "tried")
        .where(F.substring_index("base", " ", 1) == F.substring_index("tried", " ", 1))
        .join(back.select(F.col("form").alias("base"), "n"), "base")
        .groupBy("form").agg(F.max_by("base", F.struct("n", "base")).alias("base"))
    )

    # Short forms, each under the key of the full form it may stand for: nicknames and cut given
    # names first, then initials, for which a nickname is no rival of the name it stands for.
    roots = full.join(typo.select("form"), "form", "left_anti")
    people = roots.where("person = 1 and instr(form, ' ') > 0").select("form")
    bodies = roots.where("person = 0 and instr(form, ' ') > 0").select("form")

    def resolve(asked: DataFrame, keys: DataFrame) -> DataFrame:
        """(form, base): the only candidate, or the one that shares most contexts with the form."""
        begin = F.substring_index("base", " ", 1)
        cut = ~F.col("key").startswith("p ") | (begin.startswith(first) & (F.length(begin) > F.length(first)))
        maybe = asked.join(keys, "key").where((F.col("form") != F.col("base")) & cut).select("form", "base").distinct()
        maybe = maybe.withColumn("rivals", F.count("*").over(Window.partitionBy("form")))
        shared = (
            maybe.where("rivals > 1").join(where_, "form")
            .join(where_.select(F.col("form").alias("base"), "context"), ["base", "context"])
            .groupBy("form", "base").agg(F.count("*").alias("n"))
        )
        best = shared.withColumn("top", F.max("n").over(Window.partitionBy("form"))).where("n = top")
        best = best.withColumn("ties", F.count("*").over(Window.partitionBy("form"))).where("ties = 1").select("form", "base")
        return maybe.where("rivals = 1").select("form", "base").unionByName(best)

    key = lambda kind, *parts: F.concat_ws(" ", F.lit(kind), *parts).alias("key")
    base = F.col("form").alias("base")
    given = people.select(key("n", "form"), base).unionByName(people.select(key("p", F.substring(first, 1, 3), last), base))
    asked = (
        people.where(F.length(first) >= 3).select("form", key("p", F.substring(first, 1, 3), last))
        .unionByName(people.select("form", last.alias("last"), F.explode(F.split(F.element_at(formal, first), " ")).alias("f")).select("form", key("n", "f", "last")))
    )
    nick = resolve(asked, given)
    guess = guess.join(typo.select("form"), "form", "left_anti").join(nick.select("form"), "form", "left_anti")
    nick = stage(nick.unionByName(guess), "nicknames")

    letters = F.concat_ws("", F.transform(F.split(last, " "), lambda w: F.substring(w, 1, 1)))
    whole = people.join(nick.select("form"), "form", "left_anti")
    heads = whole.select(key("i", F.substring(first, 1, 1), last), base).unionByName(bodies.select(key("o", first, letters), base))
    asked = (
        groups.where("how = 'initial'").select("form", key("i", "form"))
        .unionByName(groups.where("how = 'initials'").select("form", key("o", "form")))
    )
    short = nick.unionByName(resolve(asked, heads))

    step = stage(typo.unionByName(short).groupBy("form").agg(F.min("base").alias("base")), "steps")
    root = _roots(step)
    # a name of both types goes with the one that more contexts give it
    placed = by_name.join(root, "form", "left").select("name", "type", "n", "how", F.coalesce("root", "form").alias("bearer"))
    return placed.groupBy("name").agg(F.max_by("bearer", F.struct("n", "type")).alias("bearer"), F.min("how").alias("how"))


def _roots(step: DataFrame) -> DataFrame:
    """``form, root`` of ``step(form, base)``: where the steps from each form end, however many there are.

    Every step gains support, so there are no rings. Each round doubles the steps that are taken.
    """
    left = step.select("form", F.col("base").alias("root"))
    for _ in range(64):
        onward = left.select(F.col("form").alias("root"), F.col("root").alias("next"))
        left = stage(left.join(onward, "root", "left").select("form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if left.where("moved").isEmpty():
            break
        left = left.select("form", "root")
    return left.select("form", "root")


def name_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of different names of one bearer, ``name_a < name_b``."""
    a = linked.select("bearer", F.col("name").alias("name_a"))
    b = linked.select("bearer", F.col("name").alias("name_b"))
    return a.join(b, "bearer").where("name_a < name_b").select("name_a", "name_b")
