"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts: words and one end token for each text are counted over all training texts, and
so are all pairs of adjacent words (the end token stands before a text's first word). A
count c is kept as level q = 1 + floor(log c) to the base BASE, and an n-gram of level q is
put into the filter q times, with 1, ..., q. Asking for 1, 2, ... until the first miss
gives the level back; the filter has no false misses, so a level is never too low.

Pairs are counted where they go: each task hands on a slice's distinct pairs, packed, to
the segments of the filter that their first words hash to, where they are added up, put
in, and summed for each first word. A word with HOT of all tokens or more is spread over
segments by its second words, so that no segment holds much more than another. The filter is sized by the number of tokens, of which
entries can't be more.

Probabilities: words are discounted, P1(w) = (c - D) / sum of c, and what this frees,
D * V / sum of c, is the probability of a word not seen; D = n1 / (n1 + 2 n2). After a
word v that was seen the next word is w with the probability
  (max(c(v, w) - E, 0) + E * T(v) * P1(w)) / S(v),
T(v) being the number of distinct words seen after v and S(v) the sum of c(v, w); after
another it is P1(w). All sums are 1. c is the middle of its level.

The filter is broadcast. Beyond PART bytes it is split by the hash of the last word, and the texts are scored
once for each part, one part being broadcast at a time: the parts' sums add up.

The base score needs exact counts, and the pairs after v need S(v) and T(v). Those of
words with HOT of all tokens or more (at most 1 / HOT) are broadcast; each text's other
words, with the levels of what follows them, are joined with the table of counts. No
count, word or text is left out.

Defined results: a null text counts as empty: one end token; texts with null ids are
learned from and not held out; rows with null or repeated ids each get a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import forget, remainder, settle, small_batches, table
from ._shingles import joined, mixed, sliced, word_hashes, words

BASE = 1.5
LEVELS = 80
HOT = 1e-6
E = 0.75
BITS = 10
HASHES = 4
SEGMENT = 1 << 20  # bits
#: segments that are filled together
GROUP = 8
PART = 256 << 20  # bytes
#: bytes of text whose pairs are packed together
PACK = 12 << 20
END = word_hashes(b"\x20end\x20")[0] ^ np.uint64(1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xD6E8FEB86659FD93)
#: second words are told by the upper 40 bits of their hashes
_NEXT = np.uint64(24)
#: the mean of the whole numbers of each level
_RANGES = [(math.ceil(BASE**q), math.ceil(BASE ** (q + 1))) for q in range(LEVELS)]
VALUES = [0.0] + [(lo + max(hi - 1, lo)) / 2 for lo, hi in _RANGES]


def level(count: Column) -> Column:
    return F.least(F.lit(LEVELS), F.floor(F.log(count.cast("double")) / math.log(BASE) + 1e-9) + 1).cast("int")


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, np.floor(np.log(counts) / math.log(BASE) + 1e-9) + 1).astype(np.int64)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' token hashes, and where each text ends."""
    data, offsets = joined(column)
    h, starts = words(data, offsets)
    n = np.diff(np.searchsorted(starts, offsets))
    ends = np.cumsum(n + 1)
    out = np.empty(len(h) + len(n), np.uint64)
    out[ends - 1] = END
    word = np.ones(len(out), bool)
    word[ends - 1] = False
    out[word] = h
    return out, ends


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 0):
        found, n = np.unique(_tokens(b.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["w", "n"])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each is in the sorted array, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _before(h: np.ndarray) -> np.ndarray:
    """The token before each; the end token before the first of a text."""
    return np.concatenate([[END], h[:-1]])


def _bits(g: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    """The HASHES places in their segment of n-grams g with levels q."""
    key = mixed(g + np.asarray(q, np.uint64) * _LEVEL)
    a, b = key, mixed(key) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(SEGMENT)).astype(np.int64)


def _gram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's hash; w: the upper bits of the second word's."""
    return mixed(v * _PAIR + w)


@dataclass
class Layout:
    """Where n-grams go: parts by their last word, segments by their first; hot: sorted hot words, and over how many segments each is spread."""

    parts: int
    segments: int
    hot: np.ndarray
    fans: np.ndarray

    def segment(self, v: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """Of pairs (w: the upper bits of the second words' hashes), or of words alone."""
        salt = np.zeros(len(v), np.uint64)
        if w is not None:
            at = _among(v, self.hot)
            salt[at >= 0] = mixed(w[at >= 0]) % self.fans[at[at >= 0]]
        return (mixed(mixed(v + salt) ^ _LEVEL) % np.uint64(self.segments)).astype(np.int64)

    def part(self, w: np.ndarray) -> np.ndarray:
        """w: the upper bits of the last words' hashes."""
        return (mixed(w) >> np.uint64(32)).astype(np.int64) % self.parts


def _packed(group: np.ndarray, v: np.ndarray, w: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    """One row for each group: its words v; how many pairs each has (none: v alone counts), and their second words and counts; sorted by group and v."""
    runs = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (group[1:] != group[:-1])])) if len(v) else np.empty(0, np.int64)
    sizes = np.diff(runs, append=len(v)).astype(np.uint32)
    heads = group[runs]
    groups, first = np.unique(heads, return_index=True)
    bounds, at = np.append(first, len(runs)), np.append(runs, len(v))
    columns: list[list] = [[], [], [], [], []]
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        a, b = at[i], at[j]
        columns[0].append(v[runs[i:j]].tobytes())
        columns[1].append(sizes[i:j].tobytes() if w is not None else b"")
        columns[2].append((w[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() if w is not None else b"")
        columns[3].append((w[a:b] >> np.uint64(32)).astype(np.uint8).tobytes() if w is not None else b"")
        columns[4].append(n[a:b].astype(np.int64 if w is None else np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["group", "v", "k", "lo", "hi", "n"])


_PACKED = "group bigint, v binary, k binary, lo binary, hi binary, n binary"


def _groups(layout: Layout) -> int:
    """Groups of segments in each part."""
    return -(-layout.segments // GROUP)


def _pack_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        for b in sliced(batches, 0, PACK):
            h, _ = _tokens(b.column(0))
            v, w = _before(h), h >> _NEXT
            g = _gram(v, w)
            order = np.argsort(g)
            g = g[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            v, w, n = v[order][first], w[order][first], np.diff(first, append=len(g))
            group = layout.part(w) * _groups(layout) + layout.segment(v, w) // GROUP
            order = np.argsort((group.astype(np.uint64) << np.uint64(36)) | (v >> np.uint64(28)))
            yield _packed(group[order], v[order], w[order], n[order])

    return run


def _pack_words(shared):
    """The words that aren't hot (w, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        for b in batches:
            v, c = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            group = layout.part(v >> _NEXT) * _groups(layout) + layout.segment(v) // GROUP
            order = np.argsort(group)
            yield _packed(group[order], v[order], None, c[order])

    return run


def _fill(shared):
    """Rows of one group after another -> the bitmaps of its segments, and for each first word v the sum s and number t of its pairs there."""

    def filled(layout: Layout, group: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        bits, low = np.zeros(GROUP * SEGMENT, np.uint8), group % _groups(layout) * GROUP

        def put(g: np.ndarray, segment: np.ndarray, c: np.ndarray) -> None:
            q = levels_of(c)
            every = np.repeat(np.arange(len(g)), q)
            each = np.arange(len(every)) - np.repeat(np.cumsum(q) - q, q) + 1
            bits[(_bits(g[every], each) + ((segment[every] - low) * SEGMENT)[:, None]).reshape(-1)] = 1

        alone, pairs = [r for r in rows if not r[1]], [r for r in rows if r[1]]
        if alone:
            v, c = np.frombuffer(b"".join(r[0] for r in alone), np.uint64), np.frombuffer(b"".join(r[4] for r in alone), np.int64)
            put(v, layout.segment(v), c)
        if pairs:
            v, k, lo, hi, n = (np.frombuffer(b"".join(r[i] for r in pairs), kind) for i, kind in enumerate((np.uint64, np.uint32, np.uint32, np.uint8, np.uint32)))
            v, w = np.repeat(v, k), lo.astype(np.uint64) | (hi.astype(np.uint64) << np.uint64(32))
            g = _gram(v, w)
            order = np.argsort(g)
            g = g[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            c = np.add.reduceat(n[order].astype(np.int64), first)
            g, v, w = g[first], v[order][first], w[order][first]
            put(g, layout.segment(v, w), c)
            one, at = np.unique(v, return_inverse=True)
            s = np.bincount(at, np.array(VALUES)[levels_of(c)], len(one))
            empty = pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, pa.nulls(len(one), pa.binary()), pa.array(one.view(np.int64)), pa.array(s), pa.array(np.bincount(at, minlength=len(one)))], names)
        here = np.arange(low, min(low + GROUP, layout.segments))
        maps = [np.packbits(bits[(s - low) * SEGMENT : (s - low + 1) * SEGMENT]).tobytes() for s in here]
        nulls = [pa.nulls(len(here), kind) for kind in (pa.int64(), pa.float64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), group // _groups(layout))), pa.array(here), pa.array(maps, pa.binary()), *nulls], names)

    names = ["part", "segment", "bitmap", "v", "s", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, now, rows = shared.value, None, []
        for b in batches:
            for group, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != now and rows:
                    yield from filled(layout, now, rows)
                    rows = []
                now = group
                rows.append(row)
        if rows:
            yield from filled(layout, now, rows)

    return run


class Filter:
    """Bitmaps of segments end to end; levels() asks for 1, 2, ... until the first miss."""

    def __init__(self, bitmap: np.ndarray) -> None:
        self.bitmap = bitmap

    def levels(self, g: np.ndarray, segment: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), np.int64)
        left, base = np.arange(len(g)), segment * SEGMENT
        for q in range(1, LEVELS + 1):
            at = base[left][:, None] + _bits(g[left], q)
            hit = ((self.bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            left = left[hit]
            if not len(left):
                break
            out[left] = q
        return out


@dataclass
class Model:
    counts: DataFrame  # w, c, and of the pairs after w the sum s of the counts as kept and the number t
    bitmaps: DataFrame  # part, segment, bitmap
    layout: Layout
    tokens: int  # N
    distinct: int  # V
    mass: float  # sum of the counts as kept
    discount: float  # D
    hot_counts: np.ndarray  # exact counts of the layout's hot words
    hot_after: np.ndarray  # for each of these S and T

    def bitmap(self, part: int) -> np.ndarray:
        """One part of the filter, at most about PART bytes."""
        out = np.zeros((self.layout.segments, SEGMENT // 8), np.uint8)
        for r in self.bitmaps.filter(F.col("part") == part).select("segment", "bitmap").toLocalIterator():
            out[r.segment] = np.frombuffer(r.bitmap, np.uint8)
        return out.reshape(-1)


def train(texts: DataFrame, part_bytes: int = PART) -> Model:
    """texts: one column of binary."""
    spark = texts.sparkSession
    small_batches(spark)
    single = settle(texts.mapInArrow(_count_words, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("c")), "lm-words")
    values = F.array(*map(F.lit, VALUES))
    one = lambda k: F.count(F.when(F.col("c") == k, 1))
    n, v, mass, entries, n1, n2 = single.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.element_at(values, level(F.col("c")) + 1)), F.lit(0.0)), F.coalesce(F.sum(level(F.col("c"))), F.lit(0)), one(1), one(2)).first()
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    least = max(1.0, n * HOT)
    hot = sorted((r.w & (1 << 64) - 1, r.c) for r in single.filter(F.col("c") >= least).collect())  # at most 1 / HOT
    hot_words, hot_counts = np.array([w for w, _ in hot], np.uint64), np.array([c for _, c in hot], np.int64)

    size = (n + entries) * BITS  # an n-gram's level is at most its count
    parts = max(1, math.ceil(size / 8 / part_bytes))
    layout = Layout(parts, max(1, math.ceil(size / parts / SEGMENT)), hot_words, np.ceil(hot_counts / least).astype(np.uint64))
    shared = spark.sparkContext.broadcast(layout)
    rows = texts.mapInArrow(_pack_pairs(shared), _PACKED).unionByName(single.filter(F.col("c") < least).select("w", "c").mapInArrow(_pack_words(shared), _PACKED))
    rows = rows.repartition("group").sortWithinPartitions("group")
    made = settle(rows.mapInArrow(_fill(shared), "part bigint, segment bigint, bitmap binary, v bigint, s double, t bigint"), "lm-filter")
    after = made.filter("v is not null").groupBy(F.col("v").alias("w")).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    counts = settle(single.join(after, "w"), "lm-after")  # each word or end token stands before another
    forget(single)
    stats = {r.w & (1 << 64) - 1: (r.s, r.t) for r in counts.filter(F.col("c") >= least).select("w", "s", "t").collect()}
    hot_after = np.array([stats[w] for w, _ in hot], np.float64).reshape(-1, 2).T
    return Model(counts, made.filter("bitmap is not null").select("part", "segment", "bitmap"), layout, int(n), int(v), float(mass), discount, hot_counts, hot_after)


def _alone(distinct: int, mass: float, discount: float) -> np.ndarray:
    """P1 of a word by its level."""
    return np.array([discount * distinct / mass if distinct else 1.0] + [(value - discount) / mass for value in VALUES[1:]])


def _score(model: Model, part: int, bitmap, small):
    v, mass, discount = model.distinct, max(model.mass, 1.0), model.discount

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, hot_counts, hot_after = small.value
        filled, values = Filter(bitmap.value), np.array(VALUES)
        alone = _alone(v, mass, discount)
        for b in sliced(batches, -1):
            h, ends = _tokens(b.column(b.num_columns - 1))
            starts = ends - np.diff(ends, prepend=0)
            known, inverse = np.unique(h, return_inverse=True)
            hot = _among(known, layout.hot)
            here = layout.part(known >> _NEXT) == part
            ask = np.flatnonzero(here & (hot < 0))
            levels = np.zeros(len(known), np.int64)
            levels[ask] = filled.levels(known[ask], layout.segment(known[ask]))
            levels[hot >= 0] = levels_of(hot_counts[hot[hot >= 0]])
            # pairs, whose last word is of this part
            mine = np.flatnonzero(here[inverse])
            place = np.concatenate([[np.searchsorted(known, END)], inverse[:-1]])  # of the token before
            _, first, back = np.unique(_gram(known[place], h >> _NEXT)[mine], return_index=True, return_inverse=True)
            last, before = mine[first], place[mine[first]]
            prior, follow = known[before], h[last] >> _NEXT
            pair_levels, word_levels = filled.levels(_gram(prior, follow), layout.segment(prior, follow)), levels[inverse[last]]
            prob, at = alone[word_levels], np.flatnonzero(hot[before] >= 0)
            sums, kinds = hot_after[:, hot[before][at]]
            prob[at] = (np.maximum(values[pair_levels[at]] - E, 0) + E * kinds * prob[at]) / sums
            logs = np.zeros(len(h))
            logs[mine] = np.log10(prob)[back]
            exact = here & (hot >= 0)
            logc = np.zeros(len(known))
            logc[exact] = np.log10(hot_counts[hot[exact]] + 1.0)
            cols = [np.add.reduceat(logs, starts), np.add.reduceat(logc[inverse], starts), np.add.reduceat(exact[inverse].astype(np.int64), starts), np.diff(ends, prepend=0)]
            # the pairs after other words, but those that the filter doesn't know: each word stands before one token
            wanted = (hot[before] < 0) & (~here[before] | (levels[before] > 0))
            rest = np.flatnonzero(wanted[back])
            doc = np.searchsorted(ends, mine[rest], side="right")
            tail, tf = np.unique(doc * max(len(first), 1) + back[rest], return_counts=True)
            cut = np.searchsorted(tail // max(len(first), 1), np.arange(len(ends) + 1)).astype(np.int32)
            tail = tail % max(len(first), 1)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (prior[tail].view(np.int64), pair_levels[tail].astype(np.int8), word_levels[tail].astype(np.int8), tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c) for c in cols), *lists], [*b.schema.names[:-1], "__lm", "__hot", "__known", "n_tokens", "__words", "__pair", "__alone", "__tf"])

    return run


def scored(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The columns named, n_tokens, n_known, base_score and score."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    rows = docs.select(*columns, F.monotonically_increasing_id().alias("__row"), F.col(text).cast("binary").alias("__text"))
    if model.layout.parts > 1:
        rows = settle(rows, "lm-rows")  # so that each pass numbers them alike
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    schema = fields + "__row bigint, __lm double, __hot double, __known bigint, n_tokens bigint, __words array<bigint>, __pair array<tinyint>, __alone array<tinyint>, __tf array<int>"
    small, out = context.broadcast((model.layout, model.hot_counts, model.hot_after)), None
    for p in range(model.layout.parts):
        bitmap = context.broadcast(model.bitmap(p))
        one = settle(rows.mapInArrow(_score(model, p, bitmap, small), schema), "lm-scored")
        bitmap.destroy()
        out = one if out is None else out.unionByName(one)
    lists = ["__words", "__pair", "__alone", "__tf"]
    tail = out.select("__row", F.explode(F.arrays_zip(*lists)).alias("t")).select("__row", *(F.col(f"t.{c}").alias(a) for c, a in zip(lists, ("w", "pair", "alone", "tf"), strict=True)))
    p1 = F.element_at(F.array(*map(F.lit, _alone(model.distinct, max(model.mass, 1.0), model.discount).tolist())), F.col("alone") + 1)
    seen = F.element_at(F.array(*(F.lit(max(x - E, 0.0)) for x in VALUES)), F.col("pair") + 1)
    more = F.log10((seen + E * F.col("t") * p1) / F.col("s")) - F.log10(p1)  # the texts' sums have P1 here
    tail = tail.join(model.counts, "w").groupBy("__row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("__tail"), F.sum("tf").alias("__found"), F.sum(F.col("tf") * more).alias("__more"))
    out = out.drop(*lists)
    if model.layout.parts > 1:
        out = out.groupBy("__row", *columns, "n_tokens").agg(*(F.sum(c).alias(c) for c in ("__lm", "__hot", "__known")))
    out = out.join(tail, "__row", "left")
    floor = math.log10(model.tokens + model.distinct + 1)
    base = F.col("__hot") + F.coalesce("__tail", F.lit(0.0)) - F.col("n_tokens") * floor
    return out.select(*columns, "n_tokens", (F.col("__known") + F.coalesce("__found", F.lit(0))).alias("n_known"), base.alias("base_score"), (F.col("__lm") + F.coalesce("__more", F.lit(0.0))).alias("score"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from those whose remainder by 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    model = train(docs.filter(~held_out).select(F.col("text").cast("binary").alias("text")))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
