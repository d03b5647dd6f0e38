"""Line dedup by a segment-partition edit join. DataFrame functions only.

Lines within some edits of each other link; linked lines form classes, and a class's first line (by doc_id, then place)
stays. How many edits are allowed depends on the length of the longer line (RULE), so that short lines link with exact copies
only. Lines are compared trimmed, with runs of white space as one space.

A line is cut into one segment more than the edits allowed, of which any line within them holds at least one unchanged.
Segments are indexed under the line's length and their number; a line probes, for each length it can match, the
substrings at the places that edits to their left and right allow. Lines that meet are candidates if counts of
ten letters, packed into one number, differ by no more than edits can explain; letters are counted only of lines with a key that
meets another line's.
Candidates are verified, without the characters they begin and end with in common, by a bit-parallel automaton over the band
of 2 x MOST + 1 diagonals: one word for each number of edits, a bit for each diagonal. The lines of a key are compared in tiles,
within a row, so rows don't grow with the square of a group of near copies unless its lines do link with each other.

The texts are read once, into a table of lines in the shared folder; every later step reads only the columns of it that it
needs, and texts of lines move only where they are candidates. Copies of a line probe like the line itself, unless there
are more than COPIES of it: then its first place alone does. The places of the HOT most frequent lines, a third of all
rows maybe, meet their class by a broadcast of bounded size; only lines that are rarer are shuffled by their hash.

Distinct lines are told apart by a 64-bit hash. Of n distinct lines about n ** 2 / 2 ** 65 pairs would be taken for equal.

Defined cases: a null text has no lines; a blank line is a class of its own and stays; repeated rows hold repeated lines, whose
tie for the first place one row with the smallest hash of its text wins, and rows equal in that too are all first; a null
doc_id comes last; a very long line is a line like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .durable import durable, few, scratch

#: Edits at most, and the length of the longer line from which one or two are allowed.
MOST, RULE = 2, {1: 8, 2: 16}
#: Copies of a line up to which each probes for itself.
COPIES = 16
#: A line is hot if more than one in HOT of all rows are copies of it, so there are fewer than HOT hot lines.
HOT = 20_000
#: Rows of hashes up to which a table is sent to all tasks; a larger one is joined by a shuffle.
FEW = 200_000
#: Lines of a tile, on average: those of one key that a row holds.
TILE = 64
LETTERS = "etaoinsrhd"
WHITE = r"\s+"


def normal(line: Column) -> Column:
    # nearly all lines have single spaces only, which is found out faster without a pattern
    odd = F.lit(False)
    for white in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(white))
    return F.trim(F.when(odd, F.regexp_replace(line, WHITE, " ")).otherwise(line))


def allowed(length: Column, rule: dict[int, int] = RULE) -> Column:
    """Edits allowed between a line of this length and one that isn't longer."""
    out = F.lit(0)
    for edits, least in sorted(rule.items()):
        out = F.when(length >= least, F.lit(edits)).otherwise(out)
    return out


def segment(length: Column, number: Column, edits: Column) -> tuple[Column, Column]:
    """(1-based start, length) of a segment of a line: lengths as even as can be, the longer ones last."""
    n = edits + 1
    short = F.call_function("div", length, n).cast("int")
    shorter_ones = n - (length - short * n)
    start = 1 + short * number + F.greatest(F.lit(0), number - shorter_ones)
    return start.cast("int"), short + F.when(number >= shorter_ones, 1).otherwise(0)


def probes(edits: int) -> list[tuple[int, int, int, int]]:
    """(edits, how much shorter the other line is, segment, shift of its place) of all substrings that a line probes.

    i edits at most are left of segment i and edits - i right of it, as an earlier or later segment matches otherwise.
    """
    return [(edits, d, i, shift) for d in range(edits + 1) for i in range(edits + 1) for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def keyed(lines: DataFrame, given: list[tuple[int, int, int, int]]) -> DataFrame:
    """lines(.., line, n) with a row for each of (edits, shorter, segment, shift): these and the key of that substring.

    The constants are exploded, so that the key is one small expression and not one for each of them. A line of
    one-byte characters is cut as bytes.
    """
    names = ("edits", "shorter", "number", "shift")
    wanted = F.array(*[F.struct(*[F.lit(v).alias(name) for name, v in zip(names, g, strict=True)]) for g in given])
    rows = lines.select("*", F.col("line").cast("binary").alias("bytes"), F.explode(wanted).alias("w")).select("*", "w.*")
    rows = rows.withColumn("other", F.col("n") - F.col("shorter"))
    start, size = segment(F.col("other"), F.col("number"), F.col("edits"))
    rows = rows.withColumn("begin", start + F.col("shift")).withColumn("size", size)
    rows = rows.filter((F.col("begin") >= 1) & (F.col("begin") + F.col("size") - 1 <= F.col("n")))
    begin, size = F.col("begin"), F.col("size")
    cut = F.when(F.octet_length("line") == F.col("n"), F.substring("bytes", begin, size)).otherwise(F.substring("line", begin, size).cast("binary"))
    return rows.withColumn("key", F.xxhash64("edits", "other", "number", cut))


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS modulo 16, four bits each."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(F.lit(15)), 4 * k))
    return out


def counts_within(a: Column, b: Column) -> Column:
    """Whether letter counts differ by at most twice the edits: an edit changes two counts by one at most."""
    total = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        x, y = (F.shiftrightunsigned(v, 4 * k).bitwiseAND(F.lit(15)) for v in (a, b))
        gap = F.abs(x - y)
        total = total + F.least(gap, F.lit(16) - gap)
    return total <= 2 * MOST


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def edit_distance_within(a: Column, b: Column, edits: Column | None = None) -> Column:
    """Whether a becomes b by at most `edits` (up to MOST, which is the default) insertions, deletions and substitutions of characters.

    Byte e of the state holds, as bit d + MOST, whether the characters of a read so far can become the prefix of b that is
    d characters longer, with e edits; insertions are added when the state is read. A character moves all diagonals of the
    band and all numbers of edits at once. Once no bit is left, characters are passed over.
    """
    edits = F.lit(MOST) if edits is None else edits
    field, each = (1 << (2 * MOST + 1)) - 1, range(MOST + 1)
    full, every = sum(field << 8 * e for e in each), sum(1 << 8 * e for e in each)
    start = F.lit(every << MOST)

    def matches(text: Column, i: Column) -> Column:
        out = F.lit(0)
        for k in range(2 * MOST + 1):
            at = i + k - MOST
            out = out.bitwiseOR(F.when((at >= 0) & (F.get(text["ys"], at) == F.get(text["xs"], i)), F.lit(every << k)).otherwise(F.lit(0)))
        return out

    def closed(state: Column) -> Column:
        out = state
        for t in each[1:]:
            out = out.bitwiseOR(F.shiftleft(state, 9 * t).bitwiseAND(F.lit(full & ~((1 << 8 * t) - 1))))
        return out

    def step(state: Column, same: Column) -> Column:
        c = closed(state)
        return c.bitwiseAND(same).bitwiseOR(F.shiftleft(c, 8).bitwiseOR(F.shiftleft(c, 7)).bitwiseAND(F.lit(full)))

    def accepted(text: Column) -> Column:
        n, gap = text["n"], text["m"] - text["n"]
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        last = F.aggregate(places, start, lambda s, i: F.when(s == 0, s).otherwise(step(s, matches(text, i))))
        return (F.abs(gap) <= text["edits"]) & (F.call_function("shiftright", closed(last), (gap + MOST + 8 * text["edits"]).cast("int")).bitwiseAND(F.lit(1)) == 1)

    text = F.struct(F.split(a, "").alias("xs"), F.split(b, "").alias("ys"), F.length(a).alias("n"), F.length(b).alias("m"), edits.alias("edits"))
    return let(text, accepted)


def without_common(pair: Column) -> Column:
    """A struct (a, b) of texts without up to 2 ** 17 - 1 characters that both begin with, the rest reversed."""
    a, b = pair["a"], pair["b"]

    def longer(at: Column, step: Column) -> Column:
        same = (at + step <= F.length(a)) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step))
        return at + F.when(same, step).otherwise(F.lit(0))

    common = F.aggregate(F.array(*[F.lit(1 << k) for k in range(16, -1, -1)]), F.lit(0), longer)
    return let(common, lambda n: F.struct(*[F.reverse(F.substring(x, n + 1, F.length(x))).alias(name) for name, x in (("a", a), ("b", b))]))


def near(a: Column, b: Column, rule: dict[int, int] = RULE) -> Column:
    """Whether lines are within the edits allowed: what is left between common ends is compared."""
    edits = allowed(F.greatest(F.length(a), F.length(b)), rule)

    def inner(pair: Column) -> Column:
        return let(without_common(pair), lambda rest: let(without_common(rest), lambda core: edit_distance_within(core["a"], core["b"], pair["edits"])))

    return let(F.struct(a.alias("a"), b.alias("b"), edits.alias("edits")), inner)


def links(lines: DataFrame, texts: DataFrame | None = None, rule: dict[int, int] = RULE) -> DataFrame:
    """lines(h, line, n), the lines that probe -> (a, b), a < b: the hashes of each pair of linked lines, once.

    The texts of candidates are looked up in `texts`(h, line), which may be a wider table; by default in lines.
    """
    texts = lines if texts is None else texts
    # the rows of each number of edits, by the length of the longer line; an indexed line may be so much shorter
    probing, indexed = F.lit(False), F.lit(False)
    for e, least in rule.items():
        below = F.col("n") < min((n for n in rule.values() if n > least), default=1 << 31)
        probing = probing | ((F.col("edits") == e) & (F.col("n") >= least) & below)
        indexed = indexed | ((F.col("edits") == e) & (F.col("n") >= least - e) & below)
    right = keyed(lines.filter(F.col("n") >= min(n - e for e, n in rule.items())), [(e, 0, i, 0) for e in rule for i in range(e + 1)]).filter(indexed)
    right = stored(right.select("key", F.col("h").alias("b")), "index")
    left = keyed(lines.filter(F.col("n") >= min(rule.values())), [p for e in rule for p in probes(e)]).filter(probing)
    # first which keys meet at all, a row for each probe; then the letters of the few lines that have such keys
    left = durable(left.select("key", F.col("h").alias("a")).join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")), "left_semi"))
    right = durable(right.join(few(durable(left.select("key").distinct()), FEW), "key", "left_semi"))
    ends = durable(left.select(F.col("a").alias("h")).union(right.select("b")).distinct())
    # copies of a line have one hash and text
    known = texts.select("h", "line").join(few(ends, FEW), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    known = durable(known.withColumn("counts", letter_counts(F.col("line"))))
    # the lines of a key in tiles: a row for each pair of tiles, whose lines are compared within it, so that only links are rows
    cuts = durable(right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(left.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key"))

    def tiles(rows: DataFrame, h: str, n: str) -> DataFrame:
        tile = F.pmod(F.xxhash64(h), F.ceil(F.col(n) / F.lit(float(TILE))))
        item = F.struct(F.col(h).alias("h"), F.col("counts"), F.col("line"))
        held = rows.join(few(cuts, FEW), "key").join(known.withColumnRenamed("h", h), h)
        return held.groupBy("key", tile.alias(f"{h}_tile")).agg(F.collect_list(item).alias(f"{h}_items"))

    def linked(x: Column, y: Column) -> Column:
        return (x["h"] != y["h"]) & counts_within(x["counts"], y["counts"]) & near(x["line"], y["line"], rule)

    def links_of(x: Column) -> Column:
        return F.transform(F.filter("b_items", lambda y: linked(x, y)), lambda y: F.struct(F.least(x["h"], y["h"]).alias("a"), F.greatest(x["h"], y["h"]).alias("b")))

    met = tiles(left, "a", "m").join(tiles(right, "b", "n"), "key")
    return met.select(F.explode(F.flatten(F.transform("a_items", links_of))).alias("l")).select("l.*").distinct()


def stored(rows: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """rows, written as a table in the shared folder: later reads take the columns they need."""
    path = scratch(rows.sparkSession, name)
    rows.write.option("compression", codec).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def table_of_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as lines in the shared folder: at (its place), h (null for a blank line), n (characters), line."""
    text = F.col("text")
    exploded = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("place", "raw"))
    exploded = exploded.select("doc_id", "th", F.col("place").cast("long").alias("place"), normal(F.col("raw")).alias("line"))
    out = exploded.select("doc_id", "th", "place", "line", F.length("line").alias("n"), F.xxhash64("line").alias("h"))
    out = stored(out, "lines")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", F.col("place").alias("line"))
    return out.select(at.alias("at"), F.when(F.col("n") > 0, F.col("h")).alias("h"), "n", "line")


def dedup_lines(docs: DataFrame, rule: dict[int, int] = RULE) -> DataFrame:
    """One row a line: doc_id, line (from 0), n_links (other texts linked), first_doc_id and first_line of its class, kept."""
    lines = table_of_lines(docs)
    written = lines.filter("h is not null")
    total = written.count()
    often = durable(written.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COPIES))
    first = F.min("at").alias("first")
    # of frequent lines the first place; copies are combined before the shuffle
    firsts = durable(written.select("h", "at").join(few(often.select("h"), FEW), "h", "left_semi").groupBy("h").agg(first))
    hot = durable(firsts.join(often.filter(F.col("n") * HOT > total), "h", "left_semi"))
    only = F.col("first").isNull() | (F.col("first") == F.col("at"))
    if firsts.limit(FEW + 1).count() <= FEW:
        probing = written.join(F.broadcast(firsts), "h", "left").filter(only)
    else:
        rarer = written.join(F.broadcast(hot.select("h")), "h", "left_anti").join(firsts, "h", "left")
        probing = rarer.unionByName(written.join(F.broadcast(hot), "h")).filter(only)
    found = durable(links(probing.select("h", "line", "n"), written, rule))
    degree = found.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    linked = durable(components(found).select(F.col("node").alias("h"), "root").join(degree, "h"))
    own = written.select("h", "at").join(few(linked.select("h"), FEW), "h", "left_semi").groupBy("h").agg(first)
    best = own.join(linked, "h").groupBy("root").agg(F.min("first").alias("best"))
    known = durable(linked.join(best, "root").select("h", "n_links", "best"))
    hot = durable(hot.join(known, "h", "left"))
    rarer = written.select("h", "at").join(F.broadcast(hot.select("h")), "h", "left_anti")
    rarer = rarer.withColumn("first", F.min("at").over(Window.partitionBy("h"))).join(few(known, FEW), "h", "left")
    out = rarer.unionByName(written.select("h", "at").join(F.broadcast(hot), "h")).select("at", F.coalesce("best", "first").alias("first"), "n_links")
    blank = lines.filter("h is null").select("at", F.col("at").alias("first"), F.lit(0).cast("long").alias("n_links"))
    out = out.unionByName(blank)
    return out.select("at.doc_id", "at.line", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"), (F.col("at") == F.col("first")).alias("kept"))
