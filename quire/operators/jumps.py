"""Greedy sequences: each place says where the next start would be if it were one; the starts taken from the first on are wanted.

Lines that take words while they fit, and pages that take lines, are such sequences. Places are cut into blocks; in each, a fold from
the right tells where a sequence that enters at a place leaves the block. Groups of one block are then done; in
longer ones, the places where blocks are entered are found by doubling these exits, so a group of n blocks takes log2(n) joins.
A last fold in each block marks the starts. No task holds more than a block of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .ordering import running

#: places of a block
BLOCK = 1024


def taken(pointers: DataFrame, group: list[str], place: str = "place", following: str = "next", block: int = BLOCK) -> DataFrame:
    """group and place of the starts, from place 0 on; pointers: a row for each place 0, 1, ..., whose next is greater than it."""
    rows = pointers.select(*group, F.col(place).cast("bigint").alias("p"), F.col(following).cast("bigint").alias("q"))
    cut = rows.groupBy(*group, F.floor(F.col("p") / block).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("__places"))
    cut = settle(cut, "jump-blocks")
    long = cut.filter("__block > 0").select(*group).distinct()
    entries = cut.filter("__block = 0").select(*group, F.lit(0).cast("bigint").alias("p"))
    if not long.isEmpty():
        end = (F.col("__block") + 1) * block

        def leaves(exits: Column, x: Column) -> Column:
            inside = F.get(exits, (x["q"] - x["p"] - 1).cast("int"))
            return F.concat(F.array(F.when(x["q"] >= end, x["q"]).otherwise(F.coalesce(inside, x["q"]))), exits)

        exits = F.aggregate(F.reverse("__places"), F.array().cast("array<bigint>"), leaves)
        levels = [settle(cut.join(long, group, "left_semi").select(*group, F.explode(F.arrays_zip(F.col("__places.p").alias("p"), exits.alias("q"))).alias("z")).select(*group, "z.p", "z.q"), "exits")]
        while True:
            now = levels[-1]
            further = settle(now.select(*group, "p", F.col("q").alias("m")).join(now.select(*group, F.col("p").alias("m"), "q"), [*group, "m"]).select(*group, "p", "q"), "exits")
            if further.isEmpty():
                break
            levels.append(further)
        for level in reversed(levels):
            more = entries.join(level, [*group, "p"]).select(*group, F.col("q").alias("p"))
            entries = settle(entries.unionByName(more), "entries")
    entered = entries.select(*group, F.floor(F.col("p") / block).alias("__block"), F.col("p").alias("__entry")).groupBy(*group, "__block").agg(F.min("__entry").alias("__entry"))
    start = F.struct(F.col("__entry").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.when(x["p"] == acc["at"], F.struct(x["q"].alias("at"), F.concat(acc["out"], F.array(x["p"])).alias("out"))).otherwise(acc)
    starts = F.aggregate("__places", start, step, lambda acc: acc["out"])
    return cut.join(entered, [*group, "__block"]).select(*group, F.explode(starts).alias(place))


def first_at_least(keys: DataFrame, queries: DataFrame, group: list[str], strict: bool = False) -> DataFrame:
    """group, place and first: for each query (group, place, value) how many keys (group, value) are less (or, strict, not greater), whatever the groups' sizes.

    So if keys don't fall with their place, `first` is the first place whose key is at least (or above) the query's value.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    k = keys.select(*group, "value", F.lit(0 if strict else 1).alias("kind"), F.col("place"), one.alias("__one"))
    q = queries.select(*group, "value", F.lit(1 if strict else 0).alias("kind"), F.col("place"), none.alias("__one"))
    return running(k.unionByName(q), group, ["value", "kind", "place"], first=F.col("__one")).filter("__one = 0").select(*group, "place", "first")

