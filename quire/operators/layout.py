"""Layout of text: words to lines, lines to pages, both greedily, in groups of any length.

Measures are whole numbers (a base font's widths are thousandths of its size; heights can be given in thousandths of
a point), so running sums are exact and the breaks are those of a loop over the words or lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .jumps import first_at_least, taken
from .ordering import running, running_max

#: pieces of a line, at most
MOST = 200
#: words of a group that is filled by one fold
SHORT = 16_384
#: groups whose names are broadcast, at most
NAMED = 100_000


def fill_lines(words: DataFrame, group: list[str], width: str = "width", space: str = "space", available: str = "available", most: int = MOST, short: int = SHORT) -> DataFrame:
    """words with line (from 0) and x (where the word begins, its space passed): a word goes on the line if it ends before `available`.

    words: group, place (0, 1, ... in the group), width, space (before the word, none at a line's start) and available, the same in a
    group. A word that is too wide has a line of its own; a line has `most` words at most.

    Groups of `short` words at most are shuffled once and folded each in its task, and nothing is written; longer ones are spread by running sums.
    """
    sizes = words.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > short)
    long = settle(sizes.select(*group), "long-groups")
    n = long.count()
    if not n:
        return _folded_lines(words, group, width, space, available, most)
    named = F.broadcast(long) if n <= NAMED else long
    folded = _folded_lines(words.join(named, group, "left_anti").select(*words.columns), group, width, space, available, most)
    return folded.unionByName(_spread_lines(words.join(named, group, "left_semi").select(*words.columns), group, width, space, available, most))


def lines_of(words: Column, available: Column, most: int = MOST) -> Column:
    """The lines of words that stand in one row: an array of first (the place of a line's first word), words (how many) and end (where its last word ends).

    words: an array of structs of width and space, which count as in fill_lines(). Nothing is shuffled or written, so rows should hold SHORT words at most.
    """
    line = "array<struct<first:int,words:int,end:bigint>>"
    a = available.cast("bigint")

    def shut(acc: Column) -> Column:
        """The lines with the one that is being filled."""
        now = F.struct((acc["n"] - acc["k"]).alias("first"), acc["k"].alias("words"), acc["end"].alias("end"))
        return F.when(acc["k"] > 0, F.concat(acc["lines"], F.array(now))).otherwise(acc["lines"])

    def step(acc: Column, x: Column) -> Column:
        end = acc["end"] + x["space"].cast("bigint") + x["width"].cast("bigint")
        begins = (acc["k"] == 0) | (end >= a) | (acc["k"] >= most)
        first = F.struct(x["width"].cast("bigint").alias("end"), F.lit(1).alias("k"), (acc["n"] + 1).alias("n"), shut(acc).alias("lines"))
        return F.when(begins, first).otherwise(F.struct(end.alias("end"), (acc["k"] + 1).alias("k"), (acc["n"] + 1).alias("n"), acc["lines"].alias("lines")))

    none = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("k"), F.lit(0).alias("n"), F.array().cast(line).alias("lines"))
    return F.aggregate(words, none, step, shut)


def _folded_lines(words: DataFrame, group: list[str], width: str, space: str, available: str, most: int) -> DataFrame:
    before = F.sum(F.col("__w") + F.col("__s")).over(W.partitionBy(*group).orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    rows = words.withColumns({"__w": F.col(width).cast("bigint"), "__s": F.col(space).cast("bigint"), "__a": F.col(available).cast("bigint")})
    rows = rows.withColumn("__before", F.coalesce(before, F.lit(0)))
    others = [c for c in words.columns if c not in group and c != "place"]
    cut = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("place", "__w", "__s", "__a", "__before", *others))).alias("__words"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["end"] + x["__s"] + x["__w"]
        begins = (acc["k"] == 0) | (end >= x["__a"]) | (acc["k"] >= most)
        first = F.struct(x["__w"].alias("end"), F.lit(1).alias("k"), F.concat(acc["starts"], F.array(acc["n"])).alias("starts"), (acc["n"] + 1).alias("n"))
        return F.when(begins, first).otherwise(F.struct(end.alias("end"), (acc["k"] + 1).alias("k"), acc["starts"].alias("starts"), (acc["n"] + 1).alias("n")))

    none = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"))
    cut = cut.select(*group, "__words", F.aggregate("__words", none, step, lambda acc: acc["starts"]).alias("__starts"))
    each = F.transform("__starts", lambda at, i: F.slice("__words", at + 1, F.coalesce(F.get("__starts", i + 1), F.size("__words")) - at))
    rows = cut.select(*group, F.posexplode(each).alias("__line", "__words"))
    first = F.get("__words", F.lit(0))
    rows = rows.select(*group, "__line", (first["__before"] + first["__s"]).alias("__origin"), F.explode("__words").alias("__word"))
    x = F.col("__word.__before") + F.col("__word.__s") - F.col("__origin")
    columns = [F.col(c) if c in group else F.col("__word").getField(c).alias(c) for c in words.columns]
    return rows.select(*columns, F.col("__line").cast("bigint").alias("line"), x.alias("x"))


def _spread_lines(words: DataFrame, group: list[str], width: str, space: str, available: str, most: int) -> DataFrame:
    rows = words.withColumns({"__w": F.col(width).cast("bigint"), "__s": F.col(space).cast("bigint")})
    rows = settle(running(rows, group, ["place"], __before=F.col("__w") + F.col("__s")), "words")
    ends = rows.select(*group, "place", (F.col("__before") + F.col("__w") + F.col("__s")).alias("value"))
    limits = rows.select(*group, "place", (F.col("__before") + F.col("__s") + F.col(available).cast("bigint")).alias("value"))
    found = first_at_least(ends, limits, group)
    pointers = found.select(*group, "place", F.least(F.greatest(F.col("first"), F.col("place") + 1), F.col("place") + most).alias("next"))
    starts = settle(taken(pointers, group), "line-starts").withColumn("__first", F.lit(1).cast("bigint"))
    marked = settle(rows.join(starts, [*group, "place"], "left"), "marked")
    begun = running(marked, group, ["place"], __lines=F.coalesce("__first", F.lit(0).cast("bigint")))
    origin = running_max(begun, group, ["place"], __origin=F.when(F.col("__first") == 1, F.col("__before") + F.col("__s")))
    line = F.col("__lines") + F.coalesce("__first", F.lit(0)) - 1
    return origin.select(*words.columns, line.alias("line"), (F.col("__before") + F.col("__s") - F.col("__origin")).alias("x"))


def lines(filled: DataFrame, group: list[str]) -> DataFrame:
    """group, line and words (how many) of filled words."""
    return filled.groupBy(*group, "line").agg(F.count("*").alias("words"))


def fill_pages(rows: DataFrame, group: list[str], top: int, bottom: int, gap: str = "gap", height: str = "height", need: str = "need") -> DataFrame:
    """rows with page (from 0) and y, the base of each line: pages take lines while y - need isn't below the bottom.

    rows: group, place (0, 1, ...), gap (space before, lost where a page begins), height, and need (what must be free below the
    line, so that a block's first line isn't alone). A gap as high as the page forces a new one. height + need is at most a page.
    """
    g, h, n = (F.col(c).cast("bigint") for c in (gap, height, need))
    sums = running(rows.withColumns({"__h": h, "__n": n, "__g": g}), group, ["place"], __c=F.col("__g") + F.col("__h"))
    sums = sums.withColumn("__c", F.col("__c") + F.col("__g") + F.col("__h"))
    sums = settle(running_max(sums, group, ["place"], __most=F.col("__c") + F.col("__n")), "heights")
    keys = sums.select(*group, "place", F.col("__most").alias("value"))
    limits = sums.select(*group, "place", (F.col("__c") - F.col("__h") + (top - bottom)).alias("value"))
    found = first_at_least(keys, limits, group, strict=True)
    starts = settle(taken(found.select(*group, "place", F.greatest(F.col("first"), F.col("place") + 1).alias("next")), group), "page-starts").withColumn("__first", F.lit(1).cast("bigint"))
    marked = settle(sums.join(starts, [*group, "place"], "left"), "marked")
    begun = running(marked, group, ["place"], __pages=F.coalesce("__first", F.lit(0).cast("bigint")))
    origin = running_max(begun, group, ["place"], __origin=F.when(F.col("__first") == 1, F.col("__c") - F.col("__h")))
    page = F.col("__pages") + F.coalesce("__first", F.lit(0)) - 1
    return origin.select(*rows.columns, page.alias("page"), (F.lit(top).cast("bigint") - F.col("__c") + F.col("__origin")).alias("y"))


def runs_within(rows: DataFrame, group: list[str], order: str, values: list[str], tolerance: float, block: int = 16_384) -> DataFrame:
    """group, values, first, last and n: runs of rows whose values differ from the run's first row by `tolerance` at most.

    The values compared with move only where a run begins, so a drift in small steps ends a run once it is too far from the beginning. Neighbours
    with equal values are joined first; then blocks of these go through a fold that carries the values compared with, one block of all
    groups in each round, so there are as many rounds as the longest group has blocks. Missing values count as 0.
    """
    by = W.partitionBy(*group).orderBy(order)
    boxes = rows.select(*group, F.col(order).cast("bigint").alias("__at"), *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values))
    same = F.lit(True)
    for v in values:
        same = same & (F.col(v) == F.lag(v).over(by.orderBy("__at")))
    pieces = boxes.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    pieces = pieces.withColumn("__run", F.sum("__new").over(W.partitionBy(*group).orderBy("__at")))
    pieces = pieces.groupBy(*group, "__run").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("n"), *(F.first(v).alias(v) for v in values))
    item = F.struct("first", "last", "n", F.array(*values).alias("box"))
    blocks = pieces.groupBy(*group, F.floor((F.col("__run") - 1) / block).alias("__block")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    blocks = settle(blocks, "run-blocks")
    kind = "struct<first:bigint,last:bigint,n:bigint,box:array<double>>"

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        far = F.exists(F.zip_with(x["box"], now["box"], lambda a, b: F.abs(a - b)), lambda d: d > tolerance)
        longer = F.struct(now["first"].alias("first"), x["last"].alias("last"), (now["n"] + x["n"]).alias("n"), now["box"].alias("box"))
        begun = F.struct(x.cast(kind).alias("now"), F.when(now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now))).alias("done"))
        return F.when(now.isNull() | far, begun).otherwise(F.struct(longer.alias("now"), acc["done"].alias("done")))

    carried = blocks.select(*group).distinct().withColumn("now", F.lit(None).cast(kind))
    out, k = [], 0
    while True:
        start = F.struct(F.col("now").cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("done"))
        folded = blocks.filter(F.col("__block") == k).join(carried, group).select(*group, F.aggregate("__items", start, step).alias("z"))
        folded = settle(folded.select(*group, "z.now", "z.done"), "folded")
        more = blocks.filter(F.col("__block") == k + 1).select(*group)
        ended = folded.join(more, group, "left_anti")
        out += [folded.select(*group, F.explode("done").alias("r")), ended.select(*group, F.col("now").alias("r"))]
        if more.isEmpty():
            break
        carried, k = folded.join(more, group, "left_semi").select(*group, "now"), k + 1
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select(*group, *(F.get("r.box", F.lit(i)).alias(v) for i, v in enumerate(values)), "r.first", "r.last", "r.n")
