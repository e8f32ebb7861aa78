"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Different lines within an edit distance of ``edits`` are found by pigeonhole: a line is split into ``edits`` + 1
segments, and a line within that distance holds one of them unchanged, at a place that the lengths bound. Segments are
indexed under (line length, number, content); a line probes the index of its own and the next shorter lengths. What two
different lines share is verified by a bit-parallel edit distance over the band of ``2 * edits + 1`` diagonals. Short
lines are held to fewer edits, and very short ones to none: two edits make another word of a short one. Linked lines are
one class, equal lines of any length always; the first line of a class stays and the others go. Blank lines stay.

Texts are never shuffled to find candidates: keys are made where the documents are read, and only hashes move. A segment
that many lines share (a template, a byline) isn't used as it is: the edits left for what stands before or behind it
are known, so that part is split again, and its segments are keys together with the shared one. This goes on as long as
a key is shared by many lines and something is left to split, so it loses nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import written
from siltstone.llm.graph import components

#: Edits within which lines are copies, and characters of the shortest line for which all of them count.
EDITS, LEAST_CHARS = 2, 20
#: A line is very common from so many occurrences on, or one of so many parts of all lines if that is more.
COMMON, COMMON_PARTS = 1_000, 100_000
#: One of so many lines shows which keys are shared by many; a key is if so many of them index it.
SHOWN, SHARED = 8, 24
#: Times that a shared key is split further.
LEVELS = 5
#: Rows up to which a set of hashes is sent to all executors; a larger one is joined by key.
BROADCAST_ROWS = 500_000
#: Letters whose counts (modulo 16) are held against each other before a pair is verified; an edit changes two by one at most.
SKETCHED = "etaonirsldhcumwf"
#: What a row of a key is: of a line that probes a shorter length, that probes its own, or that is indexed (and probes).
SHORTER, OWN, INDEXED = 0, 1, 2


def segments(length: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of each segment: nearly equal, the longer ones last."""
    short, longer = F.call_function("div", length, F.lit(parts)).cast("int"), length % parts
    return [(F.lit(i) * short + F.greatest(F.lit(0), i - (parts - longer)), short + F.when(F.lit(i) >= parts - longer, 1).otherwise(0)) for i in range(parts)]


def shifts(i: int, less: int, edits: int) -> range:
    """By how much the start of segment ``i`` may differ in a text that is ``less`` longer."""
    return range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)


def paths(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift) of each key of a line; those with 0 and 0 are indexed too."""
    return [(less, i, s) for less in range(edits + 1) for i in range(edits + 1) for s in shifts(i, less, edits)]


def allowed(length: Column, edits: int, least_chars: int) -> Column:
    """Edits for a line: all from ``least_chars`` characters on, fewer for shorter ones in proportion."""
    return F.least(F.lit(edits), F.floor(length * edits / least_chars)).cast("int") if least_chars > 0 else F.lit(edits)


def sketch(line: Column) -> Column:
    """Counts of 16 letters, four bits each."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(SKETCHED):
        count = F.char_length(line) - F.char_length(F.replace(line, F.lit(c)))
        out = out.bitwiseOR(F.shiftleft((count % 16).cast("long"), 4 * k))
    return out


def sketch_distance(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for k in range(len(SKETCHED)):
        d = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(15) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(15))
        total = total + F.least(d, 16 - d)
    return total


def gray(letters: Column) -> Column:
    """A sketch with each count in Gray code, where counts (modulo 16) that differ by one differ in one bit.

    So two lines' codes differ in no more bits than ``sketch_distance`` says; that is cheap enough for a join's condition.
    """
    return letters.bitwiseXOR(F.shiftrightunsigned(letters, 1).bitwiseAND(F.lit(0x7777777777777777)))


def _named(fields: dict[str, Column], then) -> Column:
    """``then`` of a struct of the fields, each worked out once."""
    return F.element_at(F.transform(F.array(F.struct(*(c.alias(k) for k, c in fields.items()))), then), 1)


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings have in common at the front: by halving steps, so each step compares what the last left open."""
    least = F.least(F.char_length(a), F.char_length(b))
    steps = F.transform(F.sequence(F.ceil(F.log2(least + 1.0)).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= least) & (F.substring(a, at + 1, s) == F.substring(b, at + 1, s)), at + s).otherwise(at))


def _after(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.char_length(text))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else a larger number.

    Equal ends are cut off first, and what the segments of the rest rule out goes no further. Then bit-parallel over the
    band, a step for each character of ``b``: bit i of a state stands for row (column - edits + i). The distance is
    followed down the lowest diagonal of the band to the last row, and along that row from there on.
    """

    def tails(v):
        return _named({"a": v.a, "b": v.b, "p": shared_prefix(v.a, v.b)}, lambda w: F.struct(F.reverse(_after(w.a, w.p)).alias("a"), F.reverse(_after(w.b, w.p)).alias("b")))

    too_far = F.abs(F.char_length(a) - F.char_length(b)) > edits
    return F.when(too_far, F.lit(edits + 1)).otherwise(_named({"t": _named({"t": _named({"a": a, "b": b}, tails)}, lambda r: tails(r.t))}, lambda r: F.when(_possible(r.t.a, r.t.b, edits), _band(r.t.a, r.t.b, edits)).otherwise(F.lit(edits + 1))))


def _possible(a: Column, b: Column, edits: int) -> Column:
    """False only for strings without equal ends that are more than ``edits`` edits apart.

    Both ends differ, so the first and the last step from ``a`` to ``b`` are edits. With at most one edit they are the
    same step, and nothing longer than a character is left. Otherwise all but two edits fall on what stands between the
    first and the last character, so one of its ``edits`` - 1 segments is found unchanged in ``b``.
    """
    if edits < 2:
        return F.greatest(F.char_length(a), F.char_length(b)) <= edits
    inside = F.char_length(a) - 2
    unchanged = (F.contains(b, F.substring(a, start + 2, size)) for start, size in segments(F.greatest(inside, F.lit(0)), edits - 1))
    return reduce(lambda x, y: x | y, unchanged, inside <= 0)


def _band(a: Column, b: Column, edits: int) -> Column:
    band = 2 * edits + 1
    full = (1 << band) - 1
    inside = lambda c: c.bitwiseAND(F.lit(full).cast("long"))
    inverted = lambda c: inside(F.bitwise_not(c))

    def fold(w):
        def step(s: Column, j: Column) -> Column:
            match = reduce(lambda m, i: m.bitwiseOR(F.when(F.get(w.x, j - edits + i) == F.get(w.y, j), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")), range(band), F.lit(0).cast("long"))
            return _named({"m": match}, lambda t: _advance(t.m, s, j))

        def _advance(match: Column, s: Column, j: Column) -> Column:
            vp, vn = s.vp, s.vn
            d0 = inside(((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn))
            return _named({"d0": d0}, lambda t: _named({"d0": t.d0, "hp": vn.bitwiseOR(inverted(t.d0.bitwiseOR(vp))), "hn": t.d0.bitwiseAND(vp)}, lambda u: _settled(u.d0, u.hp, u.hn, s, j)))

        def _settled(d0: Column, hp: Column, hn: Column, s: Column, j: Column) -> Column:
            # Down the diagonal while row column + edits is inside, then along the last row, one bit lower each column.
            bit = F.lit(2 * edits) - F.greatest(F.lit(0), j + edits + 1 - w.n)
            one = lambda c: F.when(bit >= 0, F.call_function("shiftright", c, F.greatest(bit, F.lit(0)).cast("int")).bitwiseAND(1)).otherwise(0).cast("int")
            down = s.dist + 1 - F.shiftright(d0, 2 * edits).bitwiseAND(1).cast("int")
            along = s.dist + one(hp) - one(hn)
            half = F.shiftright(d0, 1)
            return F.struct(hn.bitwiseOR(inverted(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"), F.when(j + edits < w.n, down).otherwise(along).alias("dist"))

        # Values grow down a diagonal and fall by one a column along the last row, over as many columns as the band has beside it.
        live = lambda s, j: F.when(s.dist > 3 * edits, s).otherwise(step(s, j))
        start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(edits), w.n).cast("int").alias("dist"))
        return F.aggregate(F.sequence(F.lit(0), w.m - 1), start, live, lambda s: s.dist)

    n, m = F.char_length(a), F.char_length(b)
    either_empty = (n == 0) | (m == 0)
    return F.when(either_empty, F.greatest(n, m)).otherwise(_named({"x": F.split(a, ""), "y": F.split(b, ""), "n": n, "m": m}, fold))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits."""
    return banded_distance(a, b, edits) <= edits


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, row2 (128 bits of id and text), pos, line, h, g (128 bits of the line) of every line that isn't blank."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.xxhash64(F.lit(1), id_col, text_col).alias("row2"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike("\\S")).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line"), "length": F.char_length("line")})


def _sent(hashes: DataFrame, rows: int) -> DataFrame:
    """A set of hashes for a join: to all executors if its counted size allows."""
    return F.broadcast(hashes) if rows <= BROADCAST_ROWS else hashes


class _Keys:
    """The keys of lines, level after level; what is shared by many at one level is split at the next."""

    def __init__(self, edits: int, least_chars: int):
        self.edits, self.least_chars, self.shared = edits, least_chars, []

    def _paths(self, own: int) -> list[tuple[int, int, int, int]]:
        """(edits, less, segment, shift) of the keys of a line that is allowed ``own`` edits; the shorter line of a pair sets its edits."""
        return [(own, *p) for p in paths(own)] + [(e, *p) for e in range(1, own) for p in paths(e) if p[0] > 0]

    def _first(self, lines: DataFrame) -> DataFrame:
        """line, h, length, key, path (100 times the line's edits and a place in ``_paths``): the keys of the first level."""
        line, length = F.col("line"), F.col("length")
        own = allowed(length, self.edits, self.least_chars)
        cuts = {(e, less): segments(length - less, e + 1) for e in range(1, self.edits + 1) for less in range(e + 1)}
        placed = {f"{name}_{e}_{less}_{i}": c for (e, less), own_cuts in cuts.items() for i, cut in enumerate(own_cuts) for name, c in zip("px", cut, strict=True)}

        def key(e, less, i, shift):
            start, size = F.col(f"p_{e}_{less}_{i}"), F.col(f"x_{e}_{less}_{i}")
            at = start + (shift + 1) if shift >= 0 else F.greatest(F.lit(1), start + (shift + 1))
            return F.xxhash64(length - less, F.lit(i), F.substring(line, at, size))

        # A longer line that is allowed more than the shorter one only probes its index.
        longer = lambda e, p: F.when(allowed(length - p[1], self.edits, self.least_chars) == p[0], key(*p)) if p[0] < e else key(*p)
        sets = F.lit(None)
        for e in range(1, self.edits + 1):
            mine = [longer(e, p) for p in self._paths(e)]
            most = len(paths(e))
            some = F.when(allowed(length - e, self.edits, self.least_chars) < e, F.array(*mine)).otherwise(F.array(*mine[:most])) if len(mine) > most else F.array(*mine)
            sets = F.when(own == e, some).otherwise(sets)
        keys = lines.select("line", "h", "length", (100 * own).cast("int").alias("base"), *(c.cast("int").alias(k) for k, c in placed.items())).select("line", "h", "length", "base", F.posexplode(sets).alias("pos", "key"))
        return keys.where("key is not null").select("line", "h", "length", "key", (F.col("base") + F.col("pos")).alias("path"))

    def _table(self, value) -> Column:
        """A number for each path, by a small literal array."""
        out = F.lit(None)
        for e in range(1, self.edits + 1):
            out = F.when(F.col("path") >= 100 * e, F.get(F.array(*(F.lit(value(*p)) for p in self._paths(e))), F.col("path") - 100 * e)).otherwise(out)
        return out

    def _kind(self) -> Column:
        return self._table(lambda e, less, i, s: SHORTER if less else INDEXED if s == 0 else OWN)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows of the first level with where their segment stands: segment i at p of x characters, in an indexed text of n."""
        number = lambda value: self._table(value).cast("int")
        less, i, n = number(lambda e, less, i, s: less), F.col("i"), F.col("n")
        parts = F.col("budget") + 1
        short, longer = F.floor(n / parts).cast("int"), n % parts
        rows = rows.withColumns({"budget": number(lambda e, less, i, s: e), "n": F.col("length") - less, "i": number(lambda e, less, i, s: i), "shift": number(lambda e, less, i, s: s), "start": F.lit(0), "size": F.col("length")})
        return rows.withColumns({"p": (i * short + F.greatest(F.lit(0), i - (parts - longer))).cast("int"), "x": (short + F.when(i >= parts - longer, 1).otherwise(0)).cast("int")})

    @staticmethod
    def _split(rows: DataFrame, hashes: DataFrame) -> DataFrame:
        """Rows with the keys that are among ``hashes`` split: the longer part beside the segment, or what has edits left.

        What is too short to be split stays under the key that it has, as do all other rows (i is -1 then).
        """
        i, p, x, n, shift, budget, start, size = (F.col(c) for c in ("i", "p", "x", "n", "shift", "budget", "start", "size"))
        marked = rows.join(hashes.withColumn("many", F.lit(True)), "key", "left")
        behind, at = (i == 0) | ((i < budget) & (n - p - x >= p)), F.greatest(F.lit(0), p + shift)
        marked = marked.select(
            "line", "h", "key", "kind", "many",
            F.when(behind, start + at + x).otherwise(start).cast("int").alias("start"), F.when(behind, size - at - x).otherwise(at).cast("int").alias("size"),
            F.when(behind, size - at - (n - p)).otherwise(at - p).cast("int").alias("more"), F.when(behind, budget - i).otherwise(i).cast("int").alias("budget"),
        ).withColumn("n", F.col("size") - F.col("more"))
        more, parts = F.col("more"), budget + 1
        short, longer = F.floor(n / parts).cast("int"), n % parts

        def place(i, s, p, x):
            return F.struct(i.cast("int").alias("i"), s.cast("int").alias("shift"), p.cast("int").alias("p"), x.cast("int").alias("x"))

        def of_segment(i):
            low, high = F.greatest(-i, more - (budget - i)), F.least(i, more + budget - i)
            spread = F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))
            return F.transform(spread, lambda s: place(i, s, i * short + F.greatest(F.lit(0), i - (parts - longer)), short + F.when(i >= parts - longer, 1).otherwise(0)))

        places = F.flatten(F.transform(F.sequence(F.lit(0), budget), of_segment))
        stays = F.array(place(*map(F.lit, (-1, 0, 0, 0))))
        out = marked.withColumn("y", F.explode(F.when(F.col("many") & (n > budget), places).otherwise(stays))).select("line", "h", "key", "kind", "start", "size", "budget", "n", "y.*")
        inner = F.substring(F.col("line"), start + F.greatest(F.lit(0), p + shift) + 1, x)
        return out.withColumns({
            "key": F.when(i >= 0, F.xxhash64("key", "n", "i", inner)).otherwise(F.col("key")),
            "kind": F.when((F.col("kind") == INDEXED) & (shift != 0), OWN).otherwise(F.col("kind")),
        })

    def rows(self, lines: DataFrame) -> DataFrame:
        """key, h, kind of all lines, and i: not negative where the last level has split a key."""
        level = self._first(lines).withColumn("kind", self._kind())
        if not self.shared:
            return level.select("key", "h", "kind", F.lit(0).alias("i"))
        level = self._placed(level)
        for hashes, n in self.shared:
            level = self._split(level, _sent(hashes, n))
        return level.select("key", "h", "kind", "i")

    def settle(self, lines: DataFrame) -> DataFrame:
        """key, h, kind of all lines, after finding which keys are shared by many lines, level by level."""
        shown = lines.where(F.pmod(F.shiftright("h", 20), F.lit(SHOWN)) == 0)
        for _ in range(LEVELS):
            many = written(self.rows(shown).where((F.col("kind") == INDEXED) & (F.col("i") >= 0)).select("key", "h").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("key"), "shared-keys")
            n = many.count()
            if not n:
                break
            self.shared.append((many, n))
        return self.rows(lines).drop("i")


def _common(firsts: DataFrame, lines: int) -> tuple[DataFrame, int]:
    """Lines so common that there are at most COMMON_PARTS of them, or lines / COMMON."""
    out = written(firsts.where(F.col("n") > max(COMMON, lines // COMMON_PARTS)), "common")
    return out, out.count()


def shared_keys(docs_lines: DataFrame, common: DataFrame, *, edits: int, least_chars: int) -> DataFrame:
    """key, line (62-bit hash), kind for the keys that several different lines have."""
    # A very common line gives its keys where it stands first, any other at each place; equal rows of a key count once.
    kept = F.struct("row", "row2", "pos")
    lines = docs_lines.join(F.broadcast(common.select("h", "g", "first")), ["h", "g"], "left").where(F.col("first").isNull() | (kept == F.col("first.at"))).select("line", "h", "length")
    keys = _Keys(edits, least_chars).settle(lines.where(allowed(F.col("length"), edits, least_chars) > 0))
    rows = keys.select("key", F.col("h").bitwiseAND(F.lit(-4)).bitwiseOR(F.col("kind").cast("long")).alias("m"))
    line = F.shiftrightunsigned("m", 2)
    of_key = Window.partitionBy("key")
    several = rows.withColumns({"low": F.min(line).over(of_key), "high": F.max(line).over(of_key)}).where("low <> high").select("key", "m").distinct()
    return written(several, "keys").select("key", line.alias("line"), F.col("m").bitwiseAND(3).alias("kind"))


def _edits(least_chars: int, edits: int, x: str, y: str) -> Column:
    return F.least(*(allowed(F.col(f"{s}_length"), edits, least_chars) for s in (x, y)))


def candidates(keys: DataFrame, texts: DataFrame, *, edits: int, least_chars: int) -> DataFrame:
    """a, b: different lines that share a key and are near by length and letters; a is the shorter one, or one of equal length."""
    codes = texts.select(F.col("c").alias("line"), "length", gray(F.col("letters")).alias("code")).distinct()
    side = lambda s: keys.join(codes, "line").select("key", "kind", *(F.col(c).alias(f"{s}_{c}") for c in ("line", "length", "code")))
    a, b, e = F.col("a_line"), F.col("b_line"), _edits(least_chars, edits, "a", "b")
    # The bounds are part of the join: what they rule out is never a row.
    meets = (F.col("i.key") == F.col("p.key")) & ((a < b) | ((F.col("p.kind") == SHORTER) & (a != b)))
    near = (F.abs(F.col("a_length") - F.col("b_length")) <= e) & (F.bit_count(F.col("a_code").bitwiseXOR(F.col("b_code"))) <= 2 * e)
    return side("a").where(F.col("kind") == INDEXED).alias("i").join(side("b").alias("p"), meets & near).select(a.alias("a"), b.alias("b")).distinct()


def line_links(docs_lines: DataFrame, common: DataFrame, *, edits: int, least_chars: int) -> DataFrame:
    """x, y: nodes (hexadecimal 128-bit hashes) of different lines within the edits that the shorter one is allowed."""
    keys = shared_keys(docs_lines, common, edits=edits, least_chars=least_chars)
    sides = written(keys.select(F.col("line").alias("c")).distinct(), "sides")
    # Equal lines are one row here; of a very common one every task sends one.
    mine = docs_lines.withColumn("c", F.shiftrightunsigned("h", 2)).join(_sent(sides, sides.count()), "c", "left_semi")
    texts = written(mine.groupBy("c", "h", "g").agg(F.first("line").alias("line"), F.first("length").alias("length")).select("c", _node().alias("node"), "line", "length", sketch(F.col("line")).alias("letters")), "texts")
    pairs = written(candidates(keys, texts, edits=edits, least_chars=least_chars), "pairs")
    one = lambda side, name: texts.select(F.col("c").alias(side), *(F.col(x).alias(f"{name}_{x}") for x in ("node", "line", "length", "letters")))
    e = _edits(least_chars, edits, "x", "y")
    met = pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").where((F.col("x_node") != F.col("y_node")) & (F.abs(F.col("x_length") - F.col("y_length")) <= e) & (sketch_distance(F.col("x_letters"), F.col("y_letters")) <= 2 * e))
    return written(met.where(banded_distance(F.col("x_line"), F.col("y_line"), edits) <= e).select(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y")), "links")


def _node() -> Column:
    return F.concat(F.lpad(F.hex("h"), 16, "0"), F.lpad(F.hex("g"), 16, "0"))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """row, row2 (of id and text), links, dropped, kept_ids for documents with a line that repeats or links.

    links: different lines that its lines are linked to, summed over its lines; dropped: positions of the lines to go,
    ascending; kept_ids: for each of them the id of the document that keeps its class's first line.
    """
    lines = _lines(docs, id_col, text_col)
    places = written(lines.select("id", "row", "row2", "pos", "h", "g"), "places")
    first = F.struct("id", F.struct("row", "row2", "pos").alias("at"))
    firsts = written(places.groupBy("h", "g").agg(F.min(first).alias("first"), F.count("*").alias("n")), "firsts")
    common, _ = _common(firsts, places.count())
    if edits > 0:
        links = line_links(lines, common, edits=edits, least_chars=least_chars)
    else:
        links = docs.sparkSession.createDataFrame([], "x string, y string")
    degrees = links.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).join(degrees, "node", "left")

    several = firsts.withColumn("node", _node()).join(linked, "node", "left").where("n > 1 or component is not null").withColumn("class", F.coalesce("component", "node"))
    kept = several.groupBy("class").agg(F.min("first").alias("kept"))
    of_line = written(several.join(kept, "class").select("h", "g", F.coalesce("links", F.lit(0)).alias("links"), "kept"), "classes")
    # The places of very common lines meet a table of bounded size, the others are joined by line.
    usual = places.join(of_line.join(F.broadcast(common.select("h", "g")), ["h", "g"], "left_anti"), ["h", "g"])
    marked = usual.unionByName(places.join(F.broadcast(of_line.join(F.broadcast(common.select("h", "g")), ["h", "g"], "left_semi")), ["h", "g"]))
    goes = F.struct("row", "row2", "pos") != F.col("kept.at")
    by_row = marked.groupBy("row", "row2").agg(F.sum("links").alias("links"), F.array_sort(F.collect_set(F.when(goes, F.struct("pos", F.col("kept.id").alias("id"))))).alias("gone"))
    return by_row.select("row", "row2", "links", F.col("gone.pos").alias("dropped"), F.col("gone.id").alias("kept_ids"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the lines gone that copy an earlier line, and ``__lines``, ``__links``, ``__dropped``, ``__kept_ids``.

    A line is what line feeds part. One of fewer than ``least_chars`` characters is held to fewer edits in proportion (by
    default one from 10 characters, none below), the shorter of two lines counting; blank ones stay. The earlier line is
    that of the smaller id (null first), then of the smaller hash of id and text, then higher up. Null and empty texts
    stay as they are. Rows equal in id and text are treated alike, as one document. Other columns go through.
    ``__dropped`` (positions, ascending) and ``__kept_ids`` (the documents that keep the lines) are null where no line
    goes; ``__links`` counts different lines that the document's lines are linked to.
    """
    dropped = repeated_lines(docs, id_col=id_col, text_col=text_col, edits=edits, least_chars=least_chars).withColumnsRenamed({"row": "__row", "row2": "__row2", "links": "__links"})
    dropped = dropped.select("__row", "__row2", "__links", *(F.when(F.size("dropped") > 0, F.col(c)).alias(f"__{c}") for c in ("dropped", "kept_ids")))
    parts = F.split(F.col(text_col), "\n", -1)
    rows = docs.withColumns({"__row": F.xxhash64(id_col, text_col), "__row2": F.xxhash64(F.lit(1), id_col, text_col), "__lines": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(parts)), F.lit(0))})
    joined = rows.join(dropped, ["__row", "__row2"], "left").drop("__row", "__row2").withColumn("__links", F.coalesce("__links", F.lit(0)))
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__dropped"), i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(kept))
