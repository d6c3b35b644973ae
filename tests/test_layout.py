"""Lines, pages and runs against loops over words, lines and pages."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import inlines, jumps, layout, markdown, ordering, trees


def slow_lines(words, available, most=200):
    out, line, x, count = [], 0, 0, 0
    for width, space in words:
        if count and (x + width + space >= available or count == most):
            line, x, count = line + 1, 0, 0
        at = x + (space if count else 0)
        out.append((line, at))
        x, count = at + width, count + 1
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_lines_of_words(spark, monkeypatch, block):
    monkeypatch.setattr(jumps.taken, "__defaults__", ("place", "next", block))
    rng = random.Random(block)
    groups = {g: [(rng.randrange(0, 60), rng.choice([0, 3, 10])) for _ in range(rng.choice([0, 1, 2, 7, 90, 300]))] for g in range(25)}
    rows = [(g, i, w, s, 20 + 10 * (g % 9), "kept") for g, words in groups.items() for i, (w, s) in enumerate(words)]
    rng.shuffle(rows)
    got = {}
    for r in layout.fill_lines(spark.createDataFrame(rows, "g bigint, place bigint, width int, space int, available int, line_ string"), ["g"], most=12).collect():
        got[r.g, r.place] = (r.line, r.x)
    want = {(g, i): x for g, words in groups.items() for i, x in enumerate(slow_lines(words, 20 + 10 * (g % 9), 12))}
    assert got == want


@pytest.mark.parametrize("short", [0, 50])
def test_lines_of_groups_folded_and_spread(spark, short):
    rng = random.Random(short)
    groups = {g: [(rng.randrange(0, 60), rng.choice([0, 3, 10])) for _ in range(rng.choice([1, 2, 7, 49, 50, 51, 130]))] for g in range(20)}
    rows = [(g, i, w, s, 20 + 10 * (g % 9), "kept") for g, words in groups.items() for i, (w, s) in enumerate(words)]
    filled = layout.fill_lines(spark.createDataFrame(rows, "g bigint, place bigint, width int, space int, available int, line_ string"), ["g"], most=12, short=short)
    assert filled.columns == ["g", "place", "width", "space", "available", "line_", "line", "x"]
    got = {(r.g, r.place): (r.line, r.x) for r in filled.collect()}
    assert got == {(g, i): x for g, words in groups.items() for i, x in enumerate(slow_lines(words, 20 + 10 * (g % 9), 12))}


def test_short_groups_are_not_written(spark, monkeypatch):
    written = []
    settle = layout.settle
    monkeypatch.setattr(layout, "settle", lambda df, name: written.append(name) or settle(df, name))
    words = spark.range(2000).select((F.col("id") % 20).alias("g"), F.floor(F.col("id") / 20).alias("place"), F.lit(5).alias("width"), F.lit(1).alias("space"), F.lit(30).alias("available"))
    assert layout.fill_lines(words, ["g"]).filter("x + width >= available").count() == 0 and written == ["long-groups"]


def test_no_words(spark):
    none = spark.createDataFrame([], "g bigint, place bigint, width int, space int, available int")
    assert layout.fill_lines(none, ["g"]).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_pages_of_lines(spark, monkeypatch, block):
    monkeypatch.setattr(jumps.taken, "__defaults__", ("place", "next", block))
    rng, top, bottom = random.Random(block), 700, 100
    groups = {g: [(rng.choice([0, 0, 15, 600]), rng.randrange(5, 120), rng.choice([0, 0, 45, 300])) for _ in range(rng.choice([1, 5, 60, 200]))] for g in range(12)}
    rows = [(g, i, *x) for g, lines in groups.items() for i, x in enumerate(lines)]
    got = {(r.g, r.place): (r.page, r.y) for r in layout.fill_pages(spark.createDataFrame(rows, "g bigint, place bigint, gap int, height int, need int"), ["g"], top, bottom).collect()}
    want = {}
    for g, lines in groups.items():
        page, y = 0, None
        for i, (gap, height, need) in enumerate(lines):
            if y is None:
                y = top - height
            else:
                y -= gap + height
                if y - need < bottom:
                    page, y = page + 1, top - height
            want[g, i] = (page, y)
    assert got == want


@pytest.mark.parametrize("block", [2, 16_384])
def test_runs_with_a_moving_reference(spark, block):
    rng = random.Random(block)
    files = {0: [612.0] * 2 + [595.0] * 2 + [612.0], 1: [600 + 0.004 * i for i in range(40)], 2: [rng.choice([10.0, 10.004, 10.012, None]) for _ in range(60)], 3: [5.0]}
    rows = [(f, i + 1, x, 7.0) for f, boxes in files.items() for i, x in enumerate(boxes)]
    got = sorted((r.f, r.first, r.last, r.n, r.x) for r in layout.runs_within(spark.createDataFrame(rows, "f bigint, page int, x double, y double"), ["f"], "page", ["x", "y"], 0.01, block).collect())
    want = []
    for f, boxes in files.items():
        for i, x in enumerate(boxes):
            x = x or 0.0
            if not i or abs(x - want[-1][4]) > 0.01:
                want.append([f, i + 1, i + 1, 0, x])
            want[-1][2], want[-1][3] = i + 1, want[-1][3] + 1
    assert got == sorted(map(tuple, want))
    assert [r[1:4] for r in got if r[0] == 0] == [(1, 2, 2), (3, 4, 2), (5, 5, 1)]


def test_running_max(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, rng.randrange(99)])) for g in range(4) for i in range(50)]
    got = {(r.g, r.i): r.m for r in ordering.running_max(spark.createDataFrame(rows, "g int, i int, v int"), ["g"], ["i"], m=F.col("v")).collect()}
    want, now = {}, {}
    for g, i, v in rows:
        now[g] = max((x for x in (now.get(g), v) if x is not None), default=None)
        want[g, i] = now[g]
    assert got == want


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_nearest_smaller(spark, following, equal):
    rng = random.Random(7)
    groups = {g: [rng.randrange(8) for _ in range(rng.choice([1, 20, 120]))] for g in range(8)} | {99: list(range(30)) + [5, 0], 98: [4] * 40}
    rows = [(g, 3 * i, v) for g, values in groups.items() for i, v in enumerate(values)]
    got = {(r.g, r.i): r.to for r in trees.nearest_smaller(spark.createDataFrame(rows, "g int, i int, v int"), ["g"], "i", "v", "to", following, equal).collect()}
    for g, values in groups.items():
        for i, v in enumerate(values):
            side = range(i + 1, len(values)) if following else range(i - 1, -1, -1)
            assert got[g, 3 * i] == next((3 * j for j in side if values[j] < v or equal and values[j] == v), None)


def test_an_outline_deeper_than_its_windows(spark):
    items = spark.createDataFrame([(1, i, i if i <= 90 else 2) for i in range(1, 93)], "g int, i bigint, level int")
    got = {r.i: r.parent for r in trees.outline(items, "g", "i").collect()}
    assert got[1] is None and all(got[i] == i - 1 for i in range(2, 91)) and got[91] == got[92] == 1


MARKDOWN = """# Title #
Intro
goes on

- one
  lazy
  - two
    1. three

       para of three

           code of three
           more

  - four
- five

At the margin

> quoted
> - in quote
>   - deeper
>
> end
after
***
    indented code

```python
- not an item

x
```
1) a
- b
"""


def test_nested_containers(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None), (4, "- a\n\n- b\n\n  c\n")], "k bigint, text string")
    got = {}
    for r in markdown.containers(df, "k").orderBy("k", "node").collect():
        got.setdefault(r.k, []).append((r.node, r.type, r.parent, r.text) + ((r.ordered,) if r.type == "item" else ()) + ((r.extra,) if r.extra else ()))
    assert got[1] == [
        (1, "heading", None, "Title"), (2, "paragraph", None, "Intro goes on"), (3, "item", None, "one lazy", False), (4, "item", 3, "two", False), (5, "item", 4, "three", True), (6, "paragraph", 5, "para of three"),
        (7, "code", 5, "code of three\nmore"), (8, "item", 3, "four", False), (9, "item", None, "five", False), (10, "paragraph", None, "At the margin"), (11, "quote", None, ""), (12, "paragraph", 11, "quoted"), (13, "item", 11, "in quote", False),
        (14, "item", 13, "deeper", False), (15, "paragraph", 11, "end"), (16, "paragraph", None, "after"), (17, "rule", None, ""), (18, "code", None, "indented code"), (19, "code", None, "- not an item\n\nx", "python"), (20, "item", None, "a", True), (21, "item", None, "b", False),
    ]
    assert got[4] == [(1, "item", None, "a", False), (2, "item", None, "b", False), (3, "paragraph", 2, "c")] and set(got) == {1, 4}
    whole = trees.subtree_text(trees.depths(markdown.containers(df, "k"), ["k"]), ["k"])
    by = {r.node: (r.depth, r.last, r.all_text) for r in whole.filter("k = 1").collect()}
    assert by[3] == (1, 8, "one lazy two three para of three code of three\nmore four") and by[5] == (3, 7, "three para of three code of three\nmore") and by[11] == (1, 15, "quoted in quote deeper end") and by[21] == (1, 21, "b")


def slow_pairs(lexed):
    """Delimiters of (kind, text) lexemes paired one after the other; crossing pairs as the outer ones leave them."""
    open_, found = {}, []
    for i, (kind, t) in enumerate(lexed):
        if kind != "delimiter":
            continue
        before, after = (lexed[i - 1] if i else ("space", " ")), (lexed[i + 1] if i + 1 < len(lexed) else ("space", " "))
        opens, closes = after[0] not in ("space", "break"), before[0] not in ("space", "break")
        if t in ("_", "__"):
            opens, closes = opens and not before[1][-1:].isalnum(), closes and not after[1][:1].isalnum()
        if t in open_ and closes:
            found.append((open_.pop(t), i))
        elif t not in open_ and opens:
            open_[t] = i
    kept = []
    for a, b in sorted(found):
        if not any(f < a < g < b for f, g in kept):
            kept.append((a, b))
    return sorted(kept)


def test_pairs_of_delimiters(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["**", "*", "_", "__", "~~", " ", " ", "a", "b.", "\\*", "`x`", "é"]) for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    lexed = {}
    for r in inlines.lexemes(df, ["k"]).orderBy("k", "pos").collect():
        lexed.setdefault(r.k, []).append((r.kind, r.t))
    assert all("".join(t for _, t in lexed.get(k, [])) == text for k, text in enumerate(texts))
    got = {}
    for r in inlines.pairs(inlines.lexemes(df, ["k"]), ["k"]).collect():
        got.setdefault(r.k, []).append((r.first, r.last))
    assert {k: sorted(v) for k, v in got.items()} == {k: p for k, own in lexed.items() if (p := slow_pairs(own))}


def test_a_tree_of_pieces(spark):
    df = spark.createDataFrame([(1, "[x] **a *b* c**  \n![p](q.png)[l m](<u> 't') <http://x> ``y`z`` *d"), (2, ""), (3, None)], "k int, text string")
    got = [(r.type, r.parent, r.text, r.url, r.ws) for r in inlines.tree(df, ["k"]).orderBy("k", "node").collect()]
    assert got == [
        ("checkbox", None, "x", None, False), ("strong", None, "", None, True), ("text", 2, "a", None, False), ("emphasis", 2, "", None, True), ("text", 5, "b", None, False), ("text", 2, "c", None, True), ("break", None, "", None, False),
        ("image", None, "p", "q.png", False), ("link", None, "l m", "<u>", False), ("link", None, "http://x", "http://x", True), ("code", None, "y`z", None, True), ("text", None, "*", None, True), ("text", None, "d", None, False),
    ]


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_nearest_smaller_of_few_values_is_that_by_rounds(spark, monkeypatch, following, equal):
    rows = spark.createDataFrame([(g, i, (7 * i + i * i + g) % 5) for g in range(3) for i in range(30)], "g int, i int, v int")
    found = lambda: sorted((r.g, r.i, r.v, -1 if r.to is None else r.to) for r in trees.nearest_smaller(rows, ["g"], "i", "v", "to", following, equal).collect())
    by_windows = found()
    monkeypatch.setattr(trees, "MOST_VALUES", 0)
    assert by_windows == found()
    assert trees.few_values(rows, "v") is None


def test_short_texts_are_filled_in_their_rows(spark, sf):
    """Words of short documents are neither dealt as rows nor sorted, and the lines are those of the spread way."""
    from quire.plans import layouts

    rng = random.Random(4)
    groups = [[(rng.choice([1, 5, 9, 40]), 1) for _ in range(n)] for n in (1, 2, 30, 700)]
    rows = spark.createDataFrame([(g, w) for g, w in enumerate(groups)], "g int, words array<struct<width:int,space:int>>")
    got = dict(rows.select("g", layout.lines_of(F.col("words"), F.lit(30), 5).alias("l")).collect())
    for g, words in enumerate(groups):
        want, end, k = [], 0, 0
        for n, (w, s) in enumerate(words):
            if k == 0 or end + s + w >= 30 or k == 5:
                want.append([n, 0, 0])
                end, k = w, 1
            else:
                end, k = end + s + w, k + 1
            want[-1][1:] = [k, end]
        assert [list(x) for x in got[g]] == want
    whole = layouts.line_filling(spark, sf, short=10**6)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, layouts.line_filling(spark, sf, short=40).collect())) == sorted(map(tuple, whole.collect()))
