"""Inline Markdown as a tree: delimiters paired, pieces nested in them, whitespace kept as a flag.

A block's text is cut into lexemes. A delimiter (two or one * or _, or ~~) may open before, and close after, what isn't white
space; _ does neither within a word. Of one kind at most one pair is open, so what a delimiter does depends on
one bit: one that can only open sets it, one that can only close clears it, one that can do both turns it over. These are
composed by windows: the bit is that of the last delimiter that sets or clears it, and whether the number of those that turn
since is odd. An opener without a closer, and a pair that crosses the end of one opened before it, are plain text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import settle

_LEXEME = r"\\[!-/:-@\[-`{-~]|``(?:(?!``)[\s\S])+``|`[^`]+`|!\[[^\]]*\]\([^)]*\)|\[[ xX]\](?=\s|$)|\[[^\]]*\]\([^)]*\)|<(?:https?|mailto):[^>\s]+>|\*\*|__|~~|\*|_| {2,}\n|\\\n|\s+|[^\s\\`!\[<*_~]+|(?s:.)"
_TARGET = r"^!?\[([^\]]*)\]\(\s*([^)\s]*)[^)]*\)$"
KINDS = {"**": "strong", "__": "strong", "*": "emphasis", "_": "emphasis", "~~": "struck"}


def lexemes(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, pos, t and kind: delimiter, space, break, code, image, link, checkbox, escape or word."""
    each = rows.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(_LEXEME), F.lit(0))).alias("pos", "t"))
    t = F.col("t")
    kind = F.when(t.isin(*KINDS), "delimiter").when(t.rlike(r"^( {2,}\n|\\\n)$"), "break").when(t.rlike(r"^\s+$"), "space").when(t.startswith("`") & (F.length(t) > 1), "code")
    kind = kind.when(t.rlike(r"^!\[[^\]]*\]\("), "image").when((F.col("pos") == 0) & t.rlike(r"^\[[ xX]\]$"), "checkbox").when(t.rlike(r"^\[[^\]]*\]\(|^<\w+:"), "link").when(t.rlike(r"^\\[!-/:-@\[-`{-~]$"), "escape")
    return each.withColumn("kind", kind.otherwise("word"))


def pairs(lexed: DataFrame, key: list[str]) -> DataFrame:
    """key, delimiter, first and last: where each pair's delimiters stand; no two pairs cross."""
    order = W.partitionBy(*key).orderBy("pos")
    near = lambda f, c: f(c).over(order)
    gap = lambda c: F.coalesce(c.isin("space", "break"), F.lit(True))
    before, after = near(F.lag, "kind"), near(F.lead, "kind")
    under = F.col("t").isin("_", "__")
    in_word = F.coalesce(near(F.lag, "t").rlike(r"[\p{L}\p{N}]$"), F.lit(False)), F.coalesce(near(F.lead, "t").rlike(r"^[\p{L}\p{N}]"), F.lit(False))
    rows = lexed.withColumn("opens", ~gap(after) & ~(under & in_word[0])).withColumn("closes", ~gap(before) & ~(under & in_word[1]))
    rows = rows.filter("kind = 'delimiter' and (opens or closes)")
    own = W.partitionBy(*key, "t").orderBy("pos")
    upto = own.rowsBetween(W.unboundedPreceding, -1)
    turn = F.col("opens") & F.col("closes")
    rows = rows.withColumn("turns", F.sum(F.when(turn, 1).otherwise(0)).over(own))
    fixed = F.last(F.when(~turn, F.struct(F.col("opens").cast("int").alias("bit"), "turns")), True).over(upto)
    so_far = F.coalesce(F.lag("turns").over(own), F.lit(0))
    rows = rows.withColumn("bit", (F.coalesce(fixed["bit"], F.lit(0)) + so_far - F.coalesce(fixed["turns"], F.lit(0))) % 2)
    acts = rows.withColumn("act", F.when((F.col("bit") == 1) & F.col("closes"), "close").when((F.col("bit") == 0) & F.col("opens"), "open")).filter("act is not null")
    found = acts.withColumn("first", F.lag("pos").over(own)).filter("act = 'close'").select(*key, F.col("t").alias("delimiter"), "first", F.col("pos").alias("last"))
    now = settle(found, "inline-pairs")
    # a pair that begins in another and ends after it is none, unless the other isn't one itself: those crossed by pairs that stay go, round by round
    while True:
        around = now.select(*key, F.col("first").alias("f"), F.col("last").alias("l"))
        crossing = now.join(around, key).filter("f < first and first < l and l < last").select(*key, "first", "f").distinct()
        doubtful = crossing.select(*key, F.col("first").alias("f")).distinct()
        gone = crossing.join(doubtful, [*key, "f"], "left_anti").select(*key, "first").distinct()
        if gone.isEmpty():
            return now
        now = settle(now.join(gone, [*key, "first"], "left_anti"), "inline-pairs")


def tree(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, node, type, parent, text, url and ws (white space comes before).

    type is strong, emphasis, struck (which have nodes in them and no text), text, code, link, image, checkbox (text x or empty) or break;
    an escaped character, and a delimiter that is in no pair, are text. parent is the node of the nearest pair around (null: the block).
    """
    lexed = settle(lexemes(rows, key, text), "lexemes")
    paired = settle(pairs(lexed, key), "pairs")
    marks = paired.select(*key, F.col("first").alias("pos"), F.lit(1).alias("step"), F.col("delimiter")).unionByName(paired.select(*key, F.col("last").alias("pos"), F.lit(-1).alias("step"), "delimiter"))
    order = W.partitionBy(*key).orderBy("pos")
    rows = lexed.join(marks, [*key, "pos"], "left").withColumn("step", F.coalesce("step", F.lit(0)))
    rows = rows.withColumn("level", F.sum("step").over(order) - F.when(F.col("step") == 1, 1).otherwise(0))
    # each opener is also a mark on the level within it
    opened = rows.filter("step = 1").select(*key, "pos", (F.col("level") + 1).alias("level"), F.col("pos").alias("holder"))
    both = rows.unionByName(opened, allowMissingColumns=True)
    both = both.withColumn("parent", F.last("holder", True).over(W.partitionBy(*key, "level").orderBy("pos"))).withColumn("parent", F.when(F.col("level") > 0, F.col("parent")))
    rows = both.filter("holder is null")
    rows = rows.withColumn("ws", F.coalesce(F.lag("kind").over(order) == "space", F.lit(False))).filter("step >= 0 and kind <> 'space'")
    t = F.col("t")
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    kind = F.when(F.col("step") == 1, F.element_at(names, F.col("delimiter"))).when(F.col("kind").isin("word", "escape", "delimiter"), "text").otherwise(F.col("kind"))
    linked = F.when(t.startswith("<"), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(F.regexp_extract(t, _TARGET, 1))
    url = F.when(F.col("kind").isin("link", "image"), F.when(t.startswith("<"), linked).otherwise(F.regexp_extract(t, _TARGET, 2)))
    shown = F.when((F.col("step") == 1) | (F.col("kind") == "break"), "").when(F.col("kind") == "code", F.regexp_replace(t, "^`+|`+$", "")).when(F.col("kind").isin("link", "image"), linked)
    shown = shown.when(F.col("kind") == "checkbox", F.when(t == "[ ]", "").otherwise("x")).when(F.col("kind") == "escape", F.substr(t, F.lit(2))).otherwise(t)
    return rows.select(*key, F.col("pos").alias("node"), kind.alias("type"), "parent", shown.alias("text"), url.alias("url"), "ws")
