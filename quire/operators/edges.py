"""Nested values as an edge table: brackets are matched by windows, so depth has no limit and nothing recurses.

A row is a value: its node (the place of its first token), its parent's node, its key in a dictionary or its
ordinal in an array, its kind and its plain value. A token's level is the running sum of the brackets before it; a value's
parent is the last bracket that opened its level. Values are then found, dereferenced, copied with other
references and written by joins and aggregations.

Of equal keys the first counts: later ones, and what is in them, are marked duplicate. A reference ("12 0 R") is one
value. Closing brackets without an opening one end nothing; a dictionary's last key without a value is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import reader
from ..sources.scratch import settle

OPEN, CLOSE = ("<<", "["), (">>", "]")
#: levels of values that take a window each in paths(); deeper ones are found by rounds
MOST_LEVELS = 16


def body_tokens(every: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """key, pos and token of objects' texts; each text's tokens are dealt as one array, so that windows over keys find them together."""
    cut = every.select(*key, reader.tokens_of(F.encode(body, "ISO-8859-1")).alias("__tokens")).repartition(*key)
    # outer, as a plain explode is taken for a filter on the array, for which the texts would be cut once more before they are dealt
    return cut.select(*key, F.posexplode_outer("__tokens").alias("pos", "token")).filter("pos is not null")


def _kind(t: Column) -> Column:
    kind = F.when(t == "<<", "dict").when(t == "[", "array").when(t.startswith("/"), "name").when(t.startswith("("), "string")
    kind = kind.when(t.rlike(r"^<\s*>$"), "string").when(t.startswith("<"), "binary").when(t.isin("true", "false"), "boolean")
    return kind.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), "number").otherwise("null")


def name_text(token: Column) -> Column:
    """A name without its slash, #xx undone."""
    plain = F.substr(token, F.lit(2))
    parts = F.split(plain, "#(?=[0-9A-Fa-f]{2})")
    undone = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.decode(F.unhex(F.left(p, F.lit(2))), "ISO-8859-1"), F.substr(p, F.lit(3)))))
    return F.when(plain.contains("#"), F.array_join(undone, "")).otherwise(plain)


def edges(tokens: DataFrame, key: list[str]) -> DataFrame:
    """key, node, parent, name (key in a dictionary), ordinal (from 0, in an array), kind, token, num, ref_number, ref_generation, level and duplicate.

    tokens: key, pos and token of one value for each key. The root's parent is null.
    """
    order = W.partitionBy(*key).orderBy("pos")
    t = F.col("token")
    digits = lambda c: F.coalesce(c.rlike(r"^\d+$"), F.lit(False))
    one, two = F.lead("token", 1).over(order), F.lead("token", 2).over(order)
    rows = tokens.withColumn("__ref", digits(t) & digits(one) & F.coalesce(two == "R", F.lit(False))).withColumn("__generation", one)
    before = lambda n: F.coalesce(F.lag("__ref", n).over(order), F.lit(False))
    rows = rows.withColumn("__rest", before(1) | before(2)).filter("not __rest")
    change = F.when(t.isin(*OPEN), 1).when(t.isin(*CLOSE), -1).otherwise(0)
    rows = rows.withColumn("level", F.coalesce(F.sum(change).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.filter(~t.isin(*CLOSE)).select(*key, "pos", "token", "level", "__ref", "__generation")
    # each bracket is also a mark on the level that it opens
    twice = F.when(t.isin(*OPEN), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = rows.withColumn("__mark", F.explode(twice)).withColumn("level", F.col("level") + F.col("__mark").cast("bigint"))
    both = both.withColumn("__opened", F.when(F.col("__mark"), F.col("pos"))).withColumn("__bracket", F.when(F.col("__mark"), t))
    on_level = W.partitionBy(*key, "level").orderBy("pos")
    both = both.withColumn("parent", F.last("__opened", True).over(on_level)).withColumn("__in", F.last("__bracket", True).over(on_level))
    values = both.filter("not __mark")
    among = W.partitionBy(*key, "parent").orderBy("pos")
    values = values.withColumn("__i", F.row_number().over(among) - 1).withColumn("__key", F.lag("token").over(among))
    in_dict = F.coalesce(F.col("__in") == "<<", F.lit(False))
    values = values.filter(F.col("parent").isNotNull() | (F.col("__i") == 0)).filter(~in_dict | (F.col("__i") % 2 == 1))
    kind = F.when(F.col("__ref"), "ref").otherwise(_kind(t))
    name = F.when(in_dict, name_text(F.col("__key")))
    ordinal = F.when(F.col("__in") == "[", F.col("__i"))
    number = F.when(kind == "number", F.expr("try_cast(token as double)"))
    out = values.select(
        *key, F.col("pos").alias("node"), "parent", name.alias("name"), ordinal.alias("ordinal"), kind.alias("kind"), "token", number.alias("num"),
        F.when(F.col("__ref"), F.expr("try_cast(token as bigint)")).alias("ref_number"), F.when(F.col("__ref"), F.expr("try_cast(__generation as int)")).alias("ref_generation"), "level",
    )
    again = W.partitionBy(*key, "parent", "name").orderBy("node")
    return out.withColumn("duplicate", F.col("name").isNotNull() & (F.row_number().over(again) > 1))


def paths(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds node_path: the names and ordinals from the root on, joined by slashes, and shadowed: whether the value or one above it is a duplicate.

    Levels are gone through from the top by windows over the same sorted rows, so an object's values are dealt once; a value without
    the bracket that it names as parent begins anew. Where there are more than MOST_LEVELS, each round of joins looks twice as far up, so a depth d takes log2(d) rounds.
    """
    step = F.when(F.col("parent").isNotNull(), F.coalesce("name", F.col("ordinal").cast("string"), F.lit("")))
    least, most = rows.agg(F.min("level"), F.max("level")).first()
    if least is None or most - least >= MOST_LEVELS:
        return _paths_by_rounds(rows, key, step)
    order = W.partitionBy(*key).orderBy("node").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("__path", step).withColumn("__under", F.col("duplicate"))
    for level in range(int(least) + 1, int(most) + 1):
        out = out.withColumn("__up", F.last(F.when(F.col("level") == level - 1, F.struct("node", "__path", "__under")), True).over(order))
        held = (F.col("level") == level) & F.coalesce(F.col("__up.node") == F.col("parent"), F.lit(False))
        out = out.withColumn("__path", F.when(held, F.concat_ws("/", "__up.__path", "__path")).otherwise(F.col("__path")))
        out = out.withColumn("__under", F.when(held, F.col("__under") | F.col("__up.__under")).otherwise(F.col("__under")))
    return out.select(*rows.columns, F.coalesce("__path", F.lit("")).alias("node_path"), F.col("__under").alias("shadowed"))


def _paths_by_rounds(rows: DataFrame, key: list[str], step: Column) -> DataFrame:
    now = settle(rows.select(*key, "node", F.col("parent").alias("up"), step.alias("p"), F.col("duplicate").alias("d")), "paths")
    while not now.filter("up is not null").isEmpty():
        above = now.select(*key, F.col("node").alias("up"), F.col("up").alias("further"), F.col("p").alias("q"), F.col("d").alias("e"))
        joined = now.join(above, [*key, "up"], "left")
        now = settle(joined.select(*key, "node", F.col("further").alias("up"), F.when(F.col("up").isNull(), F.col("p")).otherwise(F.concat_ws("/", "q", "p")).alias("p"), (F.col("d") | F.coalesce("e", F.lit(False))).alias("d")), "paths")
    return rows.join(now.select(*key, "node", F.coalesce("p", F.lit("")).alias("node_path"), F.col("d").alias("shadowed")), [*key, "node"])


def at(rows: DataFrame, key: list[str], *steps: str | int) -> DataFrame:
    """The values that stand, in each object, at a path of names and ordinals from the root: a join for each step."""
    now = rows.filter("parent is null").select(*key, F.col("node").alias("__at"))
    for s in steps:
        own = F.col("name") == s if isinstance(s, str) else F.col("ordinal") == s
        now = rows.filter(own & ~F.col("duplicate")).select(*key, F.col("parent").alias("__at"), F.col("node").alias("__next")).join(now, [*key, "__at"]).select(*key, F.col("__next").alias("__at"))
    return rows.join(now.select(*key, F.col("__at").alias("node")), [*key, "node"], "left_semi")


def dereferenced(rows: DataFrame, file: str = "path", number: str = "number") -> DataFrame:
    """Values of objects (file, number): each reference with the kind, token and number of the value it leads to (target_kind null: nowhere)."""
    roots = rows.filter("parent is null").select(file, F.col(number).alias("ref_number"), F.col("kind").alias("target_kind"), F.col("token").alias("target_token"), F.col("num").alias("target_num"))
    return rows.filter("kind = 'ref'").join(roots, [file, "ref_number"], "left")


def remapped(tokens: DataFrame, key: list[str], mapping: DataFrame, file: str = "path") -> DataFrame:
    """tokens with other numbers in their references: mapping has file, number and new. A reference that it lacks becomes null.

    Only references are changed: what looks like one in a string is a part of that string's token.
    """
    order = W.partitionBy(*key).orderBy("pos")
    digits = lambda c: F.coalesce(c.rlike(r"^\d+$"), F.lit(False))
    is_ref = digits(F.col("token")) & digits(F.lead("token", 1).over(order)) & F.coalesce(F.lead("token", 2).over(order) == "R", F.lit(False))
    rows = tokens.withColumn("__ref", is_ref)
    before = lambda n: F.coalesce(F.lag("__ref", n).over(order), F.lit(False))
    rows = rows.withColumn("__rest", before(1) | before(2)).filter("not __rest").withColumn("number_", F.when(F.col("__ref"), F.expr("try_cast(token as bigint)")))
    to = mapping.select(F.col(file), F.col("number").alias("number_"), F.col("new").alias("__new"))
    rows = rows.join(to, [file, "number_"], "left")
    new = F.when(F.col("__ref"), F.coalesce(F.concat(F.col("__new").cast("string"), F.lit(" 0 R")), F.lit("null"))).otherwise(F.col("token"))
    return rows.select(*key, "pos", new.alias("token"))


def written(tokens: DataFrame, key: list[str]) -> DataFrame:
    """key and body: the text of the tokens of each object, with a space between two that need it."""
    order = W.partitionBy(*key).orderBy("pos")
    ends = F.lag("token").over(order)
    apart = F.coalesce(~ends.rlike(r"[\])>}]$") & ~F.col("token").rlike(r"^[\[(<{/\])>}]"), F.lit(False)) & ~F.coalesce(ends.isin(*OPEN), F.lit(False))
    rows = tokens.withColumn("__t", F.concat(F.when(apart, " ").otherwise(""), F.col("token")))
    joined = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "__t"))).alias("p"))
    return joined.select(*key, F.array_join(F.transform("p", lambda x: x["__t"]), "").alias("body"))
