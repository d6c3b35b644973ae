"""Near-duplicate documents by a chosen-path set similarity join over MinHash values.

Documents whose shingle sets are equal are one class. Each class has T minwise values
and a sketch of one bit for each. At the root of each of TREES trees a class goes to the
node (coordinate, its minwise value there) of one chosen coordinate, sometimes two, so
that a pair on the threshold shares one child on average. Nodes of up to SMALL classes
are compared exhaustively; larger ones branch again on coordinates chosen by the node,
until a node keeps AGREES of its parent's classes (they agree almost everywhere, so that
branching would only copy them), or for DEPTH levels.

Comparing goes in two rounds, which lose no link between components. In the first, each
node's members are compared with the node's least member: a group of thousands of copies
gives as many pairs, not its square. The members of one side of a hot class are spread
over salted copies of its row. In the second, nodes whose members are still in several
components are compared exhaustively: of these, each member that has a candidate in
another component brings its text to the node, all full sets of a node (or of two blocks
of WIDE members of it) are compared by one matrix product, and only links that join
components come out, at most one for each member. A pair is a candidate if the set sizes
allow the threshold and the sketches are within DEVIATIONS standard deviations of it. Links
are confirmed on the full sets: texts are read again and intersections counted.

Defined results: texts without words (null, empty, blank) have an empty set and link
with nothing; texts of fewer words than a shingle are one shingle; rows with null ids are
returned unlinked; rows with the same id are one vertex; an empty table gives an empty
result; extra columns are ignored. Recall is set by TREES and DEPTH: for one pair on the
threshold about 1 - 6e-6 at depth 3; no wrong link is ever given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import settle, sized, small_batches, table, unit
from ._graph import components
from ._shingles import overlap, shingle_set, shingle_sets, sliced

T = 128
TREES = 10
SMALL = 128
DEPTH = 8
#: from this level on nodes branch more often, so that deep trees miss no more than shallow ones
WIDER = 3
#: standard deviations by which a pair's sketches may differ more than is likely on the threshold
DEVIATIONS = 6
#: a node that keeps this share of its parent agrees almost everywhere: branching stops there
AGREES = 0.7
#: partners of a class that are compared with one copy of its row
SALT = 64
#: members of a node that are compared at once, with as many others
WIDE = 512
#: and shingles of these, so that long texts fit a worker
WIDE_SHINGLES = 1_000_000

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, T, dtype=np.uint64)


def minwise(s: np.ndarray) -> np.ndarray:
    """The T minwise values (32 bits) of a set of hashes."""
    low = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            n, digest, sig, bits = [], [], [], []
            for s in shingle_sets(b.column(1), width):
                m = minwise(s)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(m.view(np.int32))
                bits.append(np.packbits((m & 1).astype(bool)).view(np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * T, pa.int32()), pa.array(np.concatenate(sig) if sig else np.empty(0, np.int32)))
            two = np.array(bits).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), flat, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["id", "n", "digest", "sig", "s0", "s1"])

    return run


def _picks(node, threshold: float, level: int):
    """The coordinates on which a node branches: one, and with probability 1/threshold - 1 another, from level WIDER twice as likely."""
    often = (1 / threshold - 1) * (2 if level >= WIDER else 1)
    first = F.pmod(F.xxhash64(node, F.lit(level), F.lit(0)), F.lit(T)).cast("int")
    second = F.pmod(F.xxhash64(node, F.lit(level), F.lit(1)), F.lit(T)).cast("int")
    more = unit(node, F.lit(level), F.lit(2)) < often
    return F.when(more & (first != second), F.array(first, second)).otherwise(F.array(first))


def recall(threshold: float, similarity: float | None = None, depth: int = DEPTH, trees: int = TREES) -> float:
    """The probability that a pair of a similarity (the threshold's, if none is given) meets in a node of this depth in one of the trees, and that its sketches let it pass.

    One minus this is, on the threshold of 0.85, 7e-6 at depth 3 and 4e-4 at depth 8; on that of 0.8 it is 4e-5 and
    8e-4. For a pair 0.05 above these it is 1e-7 and 7e-6, and 2e-6 and 4e-5. Coordinates are taken to agree
    independently of each other.
    """
    s = threshold if similarity is None else similarity
    lost = 0.0  # that a pair has no common node below a common node
    for level in reversed(range(depth)):
        often = min(1.0, (1 / threshold - 1) * (2 if level >= WIDER else 1)) * (1 - 1 / T)
        one = 1 - s + s * lost
        lost = (1 - often) * one + often * one**2
    bits, p, most = 2 * 64, (1 + s) / 2, _most_apart(threshold)
    kept = sum(math.comb(bits, k) * (1 - p) ** k * p ** (bits - k) for k in range(bits + 1) if k <= most)
    return (1 - lost**trees) * kept


def _most_apart(threshold: float) -> float:
    """The number of bits in which sketches of a pair on the threshold may differ."""
    bits, p = 2 * 64, (1 + threshold) / 2
    return bits * (1 - p) + DEVIATIONS * (bits * p * (1 - p)) ** 0.5


def _branched(rows: DataFrame, threshold: float, level: int, size: str) -> DataFrame:
    """rows: node, id, n, s0, s1, sig and the node's size -> the same without sig at the children, with the parent's size as above."""
    out = rows.select("id", "n", "s0", "s1", "sig", "node", F.col(size).cast("bigint").alias("above"), F.explode(_picks(F.col("node"), threshold, level)).alias("c"))
    return out.select(F.xxhash64("node", "c", F.get("sig", F.col("c"))).alias("node"), "id", "n", "s0", "s1", "above")


def _nodes(classes: DataFrame, threshold: float) -> DataFrame:
    """node, id, n, s0, s1 for all nodes to compare."""
    roots = classes.withColumn("node", F.explode(F.array(*(F.lit(t).cast("bigint") for t in range(TREES)))))
    rows = settle(_branched(roots.withColumn("m", F.lit(None)), threshold, 0, "m"), "paths")
    done = None
    for level in range(1, DEPTH + 1):
        counts = rows.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
        counted = settle(rows.join(counts, "node"), "nodes")
        ends = (F.col("m") <= SMALL) | F.coalesce(F.col("m") >= F.col("above") * AGREES, F.lit(False)) | F.lit(level == DEPTH)
        small = counted.filter(ends).drop("m", "above")
        done = small if done is None else done.unionByName(small)
        large = counted.filter(~ends).drop("above")
        if level == DEPTH or large.isEmpty():
            return done
        here = classes.select("id", "sig").join(sized(large.select("id").distinct()), "id")
        rows = settle(_branched(large.join(here, "id"), threshold, level, "m"), "paths")
    return done


def _alike(a: str, b: str, threshold: float):
    """Whether sizes and sketches leave a pair's similarity at the threshold possible."""
    differ = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))) + F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1")))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (differ <= _most_apart(threshold)) & (small >= large * threshold - 1e-9)


def _confirm(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = mine = None
        for batch in batches:
            a, b = [], []
            for k, salt, member, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "member", "text")), strict=True):
                s = shingle_set(text, width)
                if member == k:
                    key, mine = (k, salt), s
                elif key == (k, salt):
                    common = overlap(mine, s)
                    if den * common >= num * (len(mine) + len(s) - common):
                        a.append(k)
                        b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have den * intersection >= num * union."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    dealt = settle(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")), "pairs")
    own = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("member"))
    rows = own.unionByName(dealt.select("a", "salt", F.col("b").alias("member")))
    members = rows.select(F.col("member").alias("id")).distinct()
    chosen = texts.join(sized(members), "id")
    rows = rows.join(chosen, rows.member == chosen.id).select("a", "salt", "member", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("member") != F.col("a"), "member")
    return settle(rows.mapInArrow(_confirm(width, num, den), "a bigint, b bigint"), "links")


def _compare(width: int, num: int, den: int):
    """Rows (cell, id, comp, text) sorted by cell -> links that join components of a cell."""

    def emit(ids: list[int], comps: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(set(comps)) < 2:
            return
        sets = [shingle_set(t, width) for t in texts]
        n = np.array([len(s) for s in sets])
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        token, who = shared[token][count[token] > 1], who[count[token] > 1]
        order = np.argsort(token)
        token, who = token[order], who[order]
        common = np.zeros((len(sets), len(sets)), np.int64)
        for first in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            i, j = np.searchsorted(token, [first, first + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[who[i:j], token[i:j] - first] = 1
            common += (m @ m.T).astype(np.int64)  # at most 4096, exact in single precision
        linked = den * common >= num * (n[:, None] + n[None] - common)
        top = {c: c for c in comps}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            x, y = find(comps[i]), find(comps[j])
            if x != y:
                top[max(x, y)] = min(x, y)
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "comp", "text")), strict=True):
                if cell != now:
                    yield from emit(*held)
                    now, held = cell, ([], [], [])
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        yield from emit(*held)

    return run


def _joined(active: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between members (node, id, n, comp) of a node in different components, enough to join these."""
    sizes = active.groupBy("node").agg(F.ceil(F.greatest(F.count("*") / WIDE, F.sum("n") / WIDE_SHINGLES)).cast("int").alias("blocks"))
    placed = active.join(sizes, "node").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "id", "comp")
    chosen = settle(texts.join(sized(active.select("id").distinct()), "id"), "active-texts")
    rows = cells.join(chosen, "id").select("cell", "id", "comp", "text").repartition("cell").sortWithinPartitions("cell", "id")
    return settle(rows.mapInArrow(_compare(width, num, den), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and kept for each row; links have den * intersection >= num * union."""
    threshold = num / den
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    signed = settle(texts.mapInArrow(_sign(width), "id bigint, n bigint, digest binary, sig array<int>, s0 bigint, s1 bigint"), "signed")
    usable = signed.filter("n > 0 and id is not null")
    classes = settle(usable.groupBy("digest").agg(F.min(F.struct("id", "n", "s0", "s1", "sig")).alias("c")).select("digest", "c.*"), "classes")

    nodes = settle(_nodes(classes.drop("digest"), threshold), "members")
    heads = nodes.groupBy("node").agg(F.min(F.struct("id", "n", "s0", "s1")).alias("p"))
    stars = nodes.join(heads, "node").select("p", F.struct("id", "n", "s0", "s1").alias("q")).filter("p.id < q.id").filter(_alike("p", "q", threshold))
    first = settle(stars.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct(), "stars")
    links = confirmed(first, texts, width, num, den)
    labels = components(links)

    placed = nodes.join(labels, "id", "left").select("node", "id", "n", "s0", "s1", F.coalesce("comp", "id").alias("comp"))
    mixed = placed.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("node")
    still = settle(placed.join(mixed, "node"), "open")
    x, y = still.alias("x"), still.alias("y")
    active = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _alike("x", "y", threshold), "left_semi")
    active = settle(active.select("node", "id", "n", "comp"), "active")
    if not active.isEmpty():
        links = links.unionByName(_joined(active, texts, width, num, den))
        labels = components(links)

    groups = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("comp", "id").alias("comp"))
    linked = signed.filter("n > 0").select("id", "n", "digest").join(groups, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("comp")).alias("comp"))
    alone = signed.filter("n = 0").select("id", "n", F.col("id").alias("comp"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("id").eqNullSafe(F.col("comp")).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shingles of three words, linked from a Jaccard similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100)
