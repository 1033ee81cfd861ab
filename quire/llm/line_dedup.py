"""Removal of repeated and nearly repeated lines by a segment-partition edit join, with built-in functions only.

Lines within ``edits`` edits of each other share at least one of ``edits + 1`` segments, at a start
that is shifted by a bounded amount. Segments of the shorter line form an index by length; the
longer line probes it with the substrings that a shared segment can be. What meets is verified by
a banded bit-parallel edit distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.staging import stage
from quire.llm.graph import connected_components
from quire.llm.joins import bounded, meet
from quire.session import stored

EDITS = 2
#: Shorter lines are not compared by edits, a few of which would change what they say; their exact copies go on request.
MIN_CHARS = 40
BROADCAST_ROWS = 500_000
#: Letters, and groups of rarer ones, whose counts are compared before verification (fixed values); an edit changes
#: them by 2 in total at most.
COUNTED = [*"aeionrsthdlgcmbu", "wf", "pv", "ky", "jqxz"]


def line_key(line: Column) -> Column:
    """Key of a line; equal lines have equal keys."""
    return F.xxhash64(line, F.length(line))


def lines_of(docs: DataFrame, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """``doc_id, h, line_no, line, size`` of every line that is long enough; ``h`` is a hash of the text.

    With ``exact_chars`` also the shorter lines of so many characters that are not blank.
    """
    cut = stage(docs.select("doc_id", F.hash("text").alias("h"), "text"), _lines=F.split(F.col("text"), "\n")).drop("text")
    rows = cut.select("doc_id", "h", F.posexplode("_lines").alias("line_no", "line"))
    rows = rows.withColumn("size", F.length("line"))
    if exact_chars is None:
        return rows.where(F.col("size") >= min_chars)
    return rows.where((F.col("size") >= min_chars) | (F.col("size") >= exact_chars) & F.col("line").rlike(r"\S"))


def probe_plan(edits: int) -> list[tuple[int, int, int]]:
    """What to cut from a line, as (segment, how much shorter the other line is, shift).

    The first entry of a segment, unshifted in a line of the own length, is the segment itself. The
    shifts are those that leave enough edits on both sides of the segment.
    """
    count = edits + 1
    shifts = lambda i, less: range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
    return [(i, less, shift) for less in range(count) for i in range(count) for shift in shifts(i, less)]


def segment_entries(lines: DataFrame, edits: int) -> DataFrame:
    """``lines(id, size, line)`` with one row for each entry of the plan that fits: plus ``key``, ``probe``.

    Segments are parts of a line of ``size - less`` characters, the last ones take the remainder. The
    plan is exploded before the parts are cut, which keeps the compiled expression small; bytes are
    cut where the line is ASCII, which spares counting characters.
    """
    count = edits + 1
    plan = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for i, less, shift in probe_plan(edits)])
    rows = lines.select("id", "size", "line", F.explode(plan).alias("e"))
    length = F.col("size") - F.col("e.less")
    base, longer = F.floor(length / count).cast("int"), count - length % count
    at = base * F.col("e.i") + F.greatest(F.lit(0), F.col("e.i") - longer) + F.col("e.shift")
    rows = rows.select("id", "size", "line", "e", length.alias("length"), at.alias("at"), (base + (F.col("e.i") >= longer).cast("int")).alias("n"))
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.col("size")))
    cut = lambda text: F.xxhash64(F.substring(text, F.col("at") + 1, F.col("n")), F.col("length"), F.col("e.i"))
    key = F.when(F.octet_length("line") == F.col("size"), cut(F.col("line").cast("binary"))).otherwise(cut(F.col("line")))
    return rows.select(key.alias("key"), ((F.col("e.less") > 0) | (F.col("e.shift") != 0)).alias("probe"), "id", "size", "line")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by blocks of falling powers of two."""
    most = F.least(F.length(a), F.length(b))
    powers = F.transform(F.sequence(F.floor(F.log2(most.cast("double") + 1)).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def step(done, block):
        same = (done + block <= most) & (F.substring(a, done + 1, block) == F.substring(b, done + 1, block))
        return F.when(same, done + block).otherwise(done)
    return F.aggregate(powers, F.lit(0), step)


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters if it is at most ``edits``, else null.

    ``x`` and ``y`` are plain columns: they are read at every step.

    For each number of errors a word of ``2 * edits + 1`` bits holds the diagonals reached so far; one
    step over a character of ``y`` moves all of them: equal characters and substitutions keep a
    diagonal, insertions and deletions shift to a neighbour.
    """
    if not 0 <= edits <= 30:
        raise ValueError("the band must fit a 64-bit word")
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def shift_in(bits: Column, by: int) -> Column:
        return F.shiftleft(bits, by) if by >= 0 else F.shiftright(bits, -by)

    def step(state, j):
        c = F.get(y, j)
        equal = reduce(lambda p, q: p.bitwiseOR(q), [
            F.when((j + (k - edits) >= 0) & (F.get(x, F.greatest(j + (k - edits), F.lit(0))) == c), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
            for k in range(width)])
        fresh: list[Column] = []
        for e in range(edits + 1):
            now = state[f"r{e}"].bitwiseAND(equal)
            if e:
                below = state[f"r{e - 1}"]
                now = now.bitwiseOR(below).bitwiseOR(shift_in(below, -1)).bitwiseOR(shift_in(fresh[e - 1], 1)).bitwiseAND(F.lit(mask).cast("long"))
            fresh.append(now)
        return F.struct(*[v.alias(f"r{e}") for e, v in enumerate(fresh)])

    begin = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits & mask).cast("long").alias(f"r{e}") for e in range(edits + 1)])
    steps = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))
    goal = F.size(x) - F.size(y) + edits

    def least(end):
        return F.coalesce(*[F.when(F.call_function("shiftright", end[f"r{e}"], goal).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(e)) for e in range(edits + 1)])
    # a one-element array, so that the steps run once for all words
    found = F.get(F.transform(F.array(F.aggregate(steps, begin, step)), least), F.lit(0))
    return F.when((goal >= 0) & (goal < width), found)


def near_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All pairs of different lines within ``edits`` edits: ``a``, ``b`` (line keys, a < b), ``distance``.

    The first scan posts the segment and probe keys and keeps those that two lines share; the second
    brings the lines behind them, with their texts only while the shared keys are broadcast. Counts
    of frequent letters are compared inside the join, so variants of one line that differ too much do
    not become rows.
    """
    posted = lines_of(docs, min_chars).select(line_key(F.col("line")).alias("id"), "size", "line")
    entries = segment_entries(posted, edits)
    shared = stored(entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"), "keys")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = stored(entries.join(F.broadcast(shared), "key").groupBy("key", "probe", "id", "size").agg(F.min("line").alias("line")), "met")
        texts = met.groupBy("id").agg(F.min("line").alias("line"))
    else:  # every entry is shuffled: a line has many, so its text comes once, when it is known which lines met
        met = stored(entries.drop("line").join(shared, "key").distinct(), "met")
        texts = (posted.select("id", "line").join(bounded(met.select("id").distinct(), BROADCAST_ROWS), "id", "left_semi")
                 .groupBy("id").agg(F.min("line").alias("line")))
    counts = [(F.length("line") - F.length(F.translate("line", c + c.upper(), ""))).alias(f"n_{c}") for c in COUNTED]
    texts = stored(texts.select("id", "line", *counts), "texts")
    sides = met.select("key", "probe", "id", "size").join(texts.drop("line"), "id")
    left = sides.where("NOT probe").select("key", F.col("id").alias("a"), F.col("size").alias("asize"), *[F.col(f"n_{c}").alias(f"a_{c}") for c in COUNTED])
    right = sides.select("key", F.col("id").alias("b"), "size", *[f"n_{c}" for c in COUNTED])
    differ = reduce(lambda p, q: p + q, [F.abs(F.col(f"a_{c}") - F.col(f"n_{c}")) for c in COUNTED])
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & (F.abs(F.col("size") - F.col("asize")) <= edits) & (differ <= 2 * edits))
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))
    # what the lines share at both ends needs no steps; each stage is evaluated once
    cut = stage(both, p=common_prefix(F.col("x"), F.col("y")))
    cut = stage(cut, u=F.reverse(F.expr("substring(x, p + 1)")), v=F.reverse(F.expr("substring(y, p + 1)")))
    cut = stage(cut, q=common_prefix(F.col("u"), F.col("v")))
    cut = stage(cut, s=F.split(F.expr("substring(u, q + 1)"), ""), t=F.split(F.expr("substring(v, q + 1)"), ""))
    return cut.select("a", "b", banded_distance(F.col("s"), F.col("t"), edits).alias("distance")).where("distance IS NOT NULL")


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """Line keys that repeat: ``id`` and the place ``keep(doc_id, h, line_no)`` whose line stays.

    Lines connected by near pairs are one class; the place of least document id and line number of
    the class stays (a document without an id comes last).
    """
    pairs = stored(near_lines(docs, edits, min_chars), "near")
    parts = connected_components(pairs.select("a", "b"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "line_no")
    firsts = (lines_of(docs, min_chars, exact_chars).select(line_key(F.col("line")).alias("id"), place.alias("place"))
              .groupBy("id").agg(F.min("place").alias("place"), F.count("*").alias("n")))
    firsts = firsts.join(parts.withColumnRenamed("node", "id"), "id", "left").where("n > 1 OR component IS NOT NULL")
    firsts = stored(firsts.select("id", "place", F.coalesce("component", "id").alias("root")), "firsts")
    keep = firsts.groupBy("root").agg(F.min("place").alias("keep"))
    return stored(firsts.join(keep, "root").select("id", "keep"), "repeated")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """The documents with repeated lines removed: all columns, ``text`` renewed, plus ``n_lines`` and ``n_removed``.

    A line of at least ``min_chars`` characters goes if its class stands at an earlier place, and with
    ``exact_chars`` a shorter line of so many that is not blank if an equal line does; the rest of a document keeps its order and line breaks. Null texts stay null with no lines, empty texts have
    one empty line. Equal rows of one id and text are one place and are treated alike. Columns named
    like the results are replaced. An empty table gives an empty result.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed", "_text_hash", "_gone")])
    source = base.select("doc_id", F.col("text").cast("string").alias("text"))
    repeated = bounded(repeated_lines(source, edits, min_chars, exact_chars), BROADCAST_ROWS)
    placed = lines_of(source, min_chars, exact_chars).select(line_key(F.col("line")).alias("id"), "doc_id", "h", "line_no").join(repeated, "id")
    here = F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.h") == F.col("h")) & (F.col("keep.line_no") == F.col("line_no"))
    gone = placed.where(~here).groupBy("doc_id", F.col("h").alias("_text_hash")).agg(F.collect_set("line_no").alias("_gone"))
    gone = bounded(stored(gone, "gone"), BROADCAST_ROWS)
    out = meet(base.withColumn("_text_hash", F.hash("text")), gone, ["doc_id", "_text_hash"], "left")
    parts = F.split(F.col("text"), "\n")
    left = F.array_join(F.filter(parts, lambda line, k: ~F.array_contains(F.col("_gone"), k)), "\n")
    columns = [F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns]
    return out.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
                      F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
