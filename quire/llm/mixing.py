"""Mixing sources to target weights by drawing packed blocks of words.

The words of a source's documents are laid end to end (documents in the order of a hash
of their ids) and cut into blocks of fixed length. Each output shard draws from a
multinomial over the sources how many of its slots each source gets. A source's slots
are numbered through all shards; slots beyond its quota go to sources short of theirs,
so that every source ends on its quota of blocks exactly. Slot j of a source takes block
perm(j mod blocks), perm being a pseudorandom permutation of the source's blocks, another
for each pass over them: no block repeats before the others have had their turn.

Targets: the sources, in code point order with null last, have the weights 3, 1, 2, 3, ...
and share 150 % of all words; no target is above twice its source's words, and what is
above is shared again by weight among the others.

The running sums are two-level (within a bucket of a source, then over buckets), and the
join is by block, so a source that holds a third of all rows is spread over all tasks.
Only tables with a row for each source are handled in one task; there may be thousands of
sources, not millions.

Defined results: a null or wordless text has size 0 and is never taken; null is a source
of its own; repeated rows are laid out one after the other and each is taken on its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, settle, table, unit

BLOCK = 128
SLOTS = 4096
BUCKETS = 1024
ROUNDS = 20
_ALL = (W.unboundedPreceding, W.unboundedFollowing)


@dataclass
class Mix:
    """layout: a row for each document; sources: a row for each source; slots: a row for each drawn block."""

    layout: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def with_permuted(df: DataFrame, name: str, x: Column, n: Column, *keys: Column) -> DataFrame:
    """Adds x's place in a pseudorandom permutation of 0..n-1 (swap-or-not shuffle), a column for each round, so that all stays in generated code."""
    columns = df.columns
    df = df.withColumns({"__n": n.cast("long"), "__x": x.cast("long")})
    for r in range(ROUNDS):
        df = df.withColumn("__y", F.pmod(F.pmod(F.xxhash64(*keys, F.lit(r)), F.col("__n")) - F.col("__x") + F.col("__n"), F.col("__n")))
        swap = F.xxhash64(*keys, F.lit(r), F.greatest("__x", "__y")).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn("__x", F.when(swap, F.col("__y")).otherwise(F.col("__x")))
    return df.select(*columns, F.col("__x").alias(name))


def _row_digest(docs: DataFrame) -> Column:
    """128 bits of all columns of a row; rows that have the same are equal and stand for each other. Maps, which have no order, count as JSON."""
    cells = [F.to_json(c) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in docs.dtypes]
    marks = [F.col(f"`{c}`").isNull() for c in docs.columns]
    return F.struct(*(F.xxhash64(F.lit(k), *cells, *marks).alias(f"d{k}") for k in (0, 1)))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """For rows (skey, source_size): idx, weight and target. One row a source, so one task."""
    whole = W.partitionBy(F.lit(0))
    rank = F.row_number().over(whole.orderBy("skey")) - 1
    out = sizes.withColumn("idx", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")).cast("double"))
    out = out.withColumn("__ratio", F.col("source_size") * cap / F.col("weight"))
    by_ratio = whole.orderBy("__ratio", "idx")
    # Sources fill up in order of ratio; the level is that of the first which stays below its cap.
    capped = F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(whole.rowsBetween(*_ALL)) * share - capped) / rest
    out = out.withColumn("__level", level)
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "idx", "__level"))).over(whole.rowsBetween(*_ALL))
    return out.withColumn("target", F.least(F.col("source_size") * cap, F.col("weight") * first["__level"])).drop("__ratio", "__level")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, slots: int = SLOTS, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 1) -> Mix:
    """Lay the documents out, draw the slots and map them to blocks."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("__id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("__h"),
        _row_digest(docs).alias("__t"),
    ).withColumn("__bucket", F.pmod(F.col("__h"), F.lit(BUCKETS)))
    rows = settle(rows, "mix-rows")

    buckets = rows.groupBy("skey", "__bucket").agg(F.sum("size").alias("__n"))
    sizes = buckets.groupBy("skey").agg(F.sum("__n").alias("source_size"))
    out = source_targets(sizes, share, cap, weights).withColumn("blocks", F.ceil(F.col("source_size") / block))
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")), F.col("blocks") * F.lit(int(cap)))).otherwise(0)
    out = out.withColumn("quota", quota.cast("long"))
    ordered = W.partitionBy(F.lit(0)).orderBy("idx")
    total = F.sum("quota").over(ordered.rowsBetween(*_ALL))
    out = out.withColumn("total", total).withColumn("upto", F.sum("quota").over(ordered.rowsBetween(W.unboundedPreceding, 0)) / total)
    sources = settle(out, "mix-sources")

    before = W.partitionBy("skey").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("skey", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("skey", "__bucket").orderBy("__h", "__id", "size", "__t").rowsBetween(W.unboundedPreceding, 0)
    layout = rows.withColumn("__end", F.sum("size").over(inside)).join(offsets, ["skey", "__bucket"])
    layout = layout.select("__id", "__t", "skey", "size", (F.col("__offset") + F.col("__end") - F.col("size")).alias("start"))
    layout = settle(layout.join(sources.select("skey", "idx", "source_size", "target"), "skey"), "mix-layout")

    # Each slot of each shard draws its source: together a multinomial draw for each shard.
    bounds = sources.filter("quota > 0").groupBy().agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("upto", "idx"))).alias("bounds"))
    every = sources.filter("quota > 0").agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    shards = spark.range(-(-every // slots)).withColumnRenamed("id", "shard").join(F.broadcast(bounds))  # bounds is one row
    drawn = shards.select("shard", "bounds", F.explode(F.sequence(F.col("shard") * slots, F.least(F.col("shard") * slots + slots, F.col("total")) - 1)).alias("slot"))
    drawn = drawn.withColumn("u", unit(F.lit(seed), F.lit("slot"), F.col("slot")))
    pick = F.filter("bounds", lambda b: b["upto"] > F.col("u"))
    drawn = drawn.select("shard", F.coalesce(F.get(pick, F.lit(0))["idx"], F.element_at("bounds", -1)["idx"]).alias("idx"))
    counts = settle(drawn.groupBy("shard", "idx").agg(F.count("*").alias("n")), "mix-draws")

    # What a source drew above its quota goes to those that drew too little.
    won = sources.join(counts.groupBy("idx").agg(F.sum("n").alias("drawn")), "idx", "left").select("idx", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    won = won.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    upto = W.partitionBy(F.lit(0)).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    won = won.withColumn("over_at", F.sum("over").over(upto) - F.col("over")).withColumn("short_at", F.sum("short").over(upto) - F.col("short"))
    gap = F.when(F.col("short") > 0, F.struct(F.col("short_at").alias("at"), "short", "drawn", "idx"))
    won = won.withColumn("gaps", F.collect_list(gap).over(W.partitionBy(F.lit(0)).orderBy("idx").rowsBetween(*_ALL)))
    offset = F.sum("n").over(W.partitionBy("idx").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    spans = counts.withColumn("at", offset).join(won, "idx").withColumn("kept", F.greatest(F.least(F.col("quota") - F.col("at"), F.col("n")), F.lit(0)))
    own = spans.filter("kept > 0").select("shard", "idx", F.col("at").alias("first"), F.col("kept").alias("n"))
    freed = spans.filter("kept < n").select("shard", (F.col("over_at") + F.greatest(F.col("at") - F.col("quota"), F.lit(0))).alias("lo"), (F.col("n") - F.col("kept")).alias("many"), F.explode("gaps").alias("g"))
    lo, hi = F.greatest("lo", F.col("g.at")), F.least(F.col("lo") + F.col("many"), F.col("g.at") + F.col("g.short"))
    given = freed.filter(lo < hi).select("shard", F.col("g.idx").alias("idx"), (F.col("g.drawn") + lo - F.col("g.at")).alias("first"), (hi - lo).alias("n"))

    # Few rows that make many: dealt out before they are, to a number of tasks that doesn't shrink with their bytes.
    jobs = own.unionByName(given).join(F.broadcast(sources.select("idx", "blocks")), "idx")
    tasks = max(1, min(-(-every // slots), 4 * spark.sparkContext.defaultParallelism))
    jobs = jobs.repartition(tasks, "shard", "idx", "first")
    each = jobs.select("shard", "idx", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    turn = F.floor(F.col("j") / F.col("blocks"))
    placed = with_permuted(each, "block", F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("idx"), turn)
    return Mix(layout, sources, settle(placed.select("shard", "idx", "j", "block"), "mix-slots"), block)


def taken_words(m: Mix) -> DataFrame:
    """The layout with the words the mix takes of each document, repeats counted."""
    last = F.floor((F.col("start") + F.col("size") - 1) / m.block)
    parts = m.layout.filter("size > 0").select("idx", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / m.block), last)).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * m.block) - F.greatest(F.col("start"), F.col("block") * m.block)
    parts = parts.select("idx", "start", "block", overlap.alias("words"))
    times = m.slots.groupBy("idx", "block").agg(F.count("*").alias("times"))
    taken = parts.join(times, ["idx", "block"]).groupBy("idx", "start").agg(F.sum(F.col("words") * F.col("times")).alias("__taken"))
    at = F.when(F.col("size") > 0, F.col("start"))
    out = m.layout.withColumn("__at", at).join(taken.withColumnRenamed("start", "__at"), ["idx", "__at"], "left")
    return out.withColumn("taken", F.coalesce("__taken", F.lit(0))).drop("__taken", "__at")


def mixed_texts(docs: DataFrame, m: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as the mix takes them: for each document a row with the words taken once or more, and one with those taken twice.

    A row's text is its words in their order with the white space after each. Each of several equal rows
    has the words that were taken of it.
    """
    last = F.floor((F.col("start") + F.col("size") - 1) / m.block)
    parts = m.layout.filter("size > 0").select("idx", "start", "size", "__t", F.explode(F.sequence(F.floor(F.col("start") / m.block), last)).alias("block"))
    times = m.slots.groupBy("idx", "block").agg(F.count("*").alias("times"))
    a = F.greatest(F.col("block") * m.block - F.col("start"), F.lit(0))
    b = F.least((F.col("block") + 1) * m.block - F.col("start"), F.col("size"))
    cuts = parts.join(times, ["idx", "block"]).select("idx", "start", "__t", F.struct(a.cast("int").alias("a"), (b - a).cast("int").alias("n")).alias("cut"), "times")
    cuts = cuts.select("idx", "start", "__t", "cut", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
    cuts = cuts.groupBy("idx", "start", "__t", "turn").agg(F.sort_array(F.collect_set("cut")).alias("__cuts")).select("__t", "__cuts")
    digests = docs.select(_row_digest(docs).alias("__t"))
    whole = docs.select(_row_digest(docs).alias("__t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    repeated = not digests.groupBy("__t").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    own = whole.dropDuplicates(["__t"]) if repeated else whole
    own = own.withColumn("__words", F.regexp_extract_all(F.col("__doc")[text], F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))
    taken = F.array_join(F.flatten(F.transform("__cuts", lambda c: F.slice("__words", c["a"] + 1, c["n"]))), "")
    return own.join(cuts, "__t").select(*(taken.alias(c) if c == text else F.col("__doc")[c].alias(c) for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    out = taken_words(mix(table(spark, sf_dir, "documents")))
    return out.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
