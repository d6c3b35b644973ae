"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class. The graph of nearest neighbours starts from buckets: in each
a number of tables a class falls by the signs of random projections. There are as many
tables (TABLES at least) as give a pair with a cosine of 0.9 a common bucket with a
probability of HIT, however many bits the code has. Buckets are dealt into blocks of BLOCK
vectors, and each class takes its K nearest in the block. Then, until a round changes less
than SHARE of the edges, the neighbours of neighbours are joined: around each class, its neighbours and
those whose neighbour it is (dealt into blocks of BLOCK, so a hub is spread over tasks)
are compared with each other, and each class keeps the K nearest of all it has met.
Edges with a cosine of the threshold or more, computed in double precision, are links.

A class whose K neighbours are all at the threshold or above is saturated: it may have
more, also outside its component of the links found so far. The saturated classes of a
component fall into cells, each with a centre and a radius. All vectors are compared with
all centres (CENTRES at a time): by the triangle inequality on angles only those within
the radius and the threshold's angle can link with the cell. Those of other components are
compared with the cell's members, and components that link become one. So all links of
saturated classes are found, and their lists are in effect enlarged to all that link with
them; this takes the number of cells times that of vectors. (Lists that are doubled until their last member no
longer links, as NN-descent is usually enlarged, grow to a group's size for each of its members before
they end, and two groups that link may still not meet in them.) A component with a saturated class is then
compared with itself in pairs of blocks. Links are counted, not listed: a component's blocks give each class
its number of links with each block. In other components the lists hold all links.

Recall is audited each time: the vectors whose ids EVERY divides (of fewer than ASKED times
EVERY vectors more, so that the sample is not too small) are compared with all (audited()).
While the share of their links that is found, or the mean share of those with
K links or fewer (which large groups would hide), is below TARGET, new tables and rounds
are added. The audit takes n / EVERY times n products.

Defined results: null, empty and zero vectors and those with null or non-finite
components link with nothing; so do vectors of different dimensions; rows with null ids are
returned unlinked; rows with the same id are one vector; ties are broken by id; an empty
table gives an empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import settle, table
from ._graph import components

K = 10
TABLES = 6
BLOCK = 128
HIT = 0.9
SHARE = 0.01
EVERY = 50
ASKED = 2_000
TARGET = 0.95
WIDE = 512
#: centres of cells that are broadcast at once, and rows compared with them at once
CENTRES = 16_384
ROWS = 256


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision, as bytes; null where a vector can't link."""
    for b in batches:
        out = []
        for x in b.column(1).to_pylist():
            v = np.array([np.nan if c is None else c for c in x], np.float64) if x else np.zeros(1)
            top = np.abs(v).max()
            ok = np.isfinite(v).all() and top > 0
            v = v / top if ok else v  # so that squares neither overflow nor vanish
            out.append((v / math.sqrt(float(v @ v))).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "v"])


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _buckets(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for size in {len(v) for v in vs}:
                mine = [i for i, v in enumerate(vs) if len(v) == size]
                x = _matrix([vs[i] for i in mine])
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
                signs = ((x @ planes) > 0).reshape(len(mine), tables, bits)
                codes = signs @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << 40) + (np.int64(size) << 48)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([ids[i] for i in mine], tables), pa.int64()), pa.array(codes.reshape(-1))], ["id", "bucket"])

    return run


def _nearest(k: int, threshold: float):
    """Rows (block, id, v) sorted by block: for each vector its k nearest in the block, by id and cosine.

    Cosines are rounded, so that they are equal in all blocks, but not across the threshold.
    """
    below = np.nextafter(threshold, -1)

    def emit(ids: list[int], vs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, first = np.unique(np.array(ids, np.int64), return_index=True)
        vs = [vs[i] for i in first]
        for size in {len(v) for v in vs}:
            mine = np.array([i for i, v in enumerate(vs) if len(v) == size])
            if len(mine) < 2:
                continue
            x = _matrix([vs[i] for i in mine])
            exact = x @ x.T
            s = np.round(exact, 12)
            s = np.where(exact >= threshold, np.maximum(s, threshold), np.minimum(s, below))
            np.fill_diagonal(s, -2)
            m = min(k, len(mine) - 1)
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[mine], m)), pa.array(ids[mine][top].reshape(-1)), pa.array(np.take_along_axis(s, top, 1).reshape(-1))], ["u", "w", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vs = None, [], []
        for b in batches:
            for block, i, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if block != now:
                    yield from emit(ids, vs)
                    now, ids, vs = block, [], []
                ids.append(i)
                vs.append(v)
        yield from emit(ids, vs)

    return run


def _blocks(rows: DataFrame, group: str, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """u, w, cos: the k nearest of each id among those in its block; groups are dealt into blocks of about BLOCK."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, group).select(F.xxhash64(group, F.pmod(F.xxhash64("id", group), F.col("blocks"))).alias("block"), "id")
    placed = dealt.join(vectors, "id").select("block", "id", "v").repartition("block").sortWithinPartitions("block", "id")
    return placed.mapInArrow(_nearest(k, threshold), "u bigint, w bigint, cos double")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each u's k nearest of all it has met, old edges (fresh = 0) before the same anew: the lists are cut while they are gathered, in numpy, by u."""
    ordered = edges.select("u", "w", "cos", "fresh").repartition("u").sortWithinPartitions("u", F.col("cos").desc(), "w", "fresh")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_u, last_w, n = None, None, 0  # of the rows before
        for b in batches:
            if not b.num_rows:
                continue
            us, ws = b.column(0).to_numpy(), b.column(1).to_numpy()
            other = np.concatenate([[us[0] != last_u], us[1:] != us[:-1]])
            new = other | np.concatenate([[ws[0] != last_w], ws[1:] != ws[:-1]])
            count = np.cumsum(new)
            start = np.maximum.accumulate(np.where(other, count - 1, -n if not other[0] else 0))
            place = count - start  # 1 for a u's first neighbour
            yield b.filter(pa.array(new & (place <= k)))
            last_u, last_w, n = us[-1], ws[-1], int(place[-1])

    return ordered.mapInArrow(cut, "u bigint, w bigint, cos double, fresh int")


def tables_for(bits: int) -> int:
    """So many that two vectors with a cosine of 0.9 have the same code in one with a probability of HIT."""
    p = (1 - math.acos(0.9) / math.pi) ** bits
    return TABLES if p >= 1 else max(TABLES, math.ceil(math.log(1 - HIT) / math.log(1 - p)))


def neighbours(vectors: DataFrame, n: int, k: int = K, tables: int | None = None, rounds: int | None = None, seed: int = 3, graph: DataFrame | None = None, threshold: float = 0.9) -> DataFrame:
    """u, w, cos, fresh: the graph of the k nearest neighbours of vectors (id, v); a graph given is added to. Without rounds they go on until few edges change."""
    bits = max(0, min(40, round(math.log2(max(n, 1) / (BLOCK / 2)))))
    codes = vectors.mapInArrow(_buckets(bits, tables or tables_for(bits), seed), "id bigint, bucket bigint")
    met = _blocks(codes, "bucket", vectors, k, threshold).withColumn("fresh", F.lit(1))
    old = lambda g: g.withColumn("fresh", F.lit(0))
    graph = settle(_best(met if graph is None else old(graph).unionByName(met), k), "knn")
    done = 0
    while rounds is None or done < rounds:
        around = graph.select(F.col("u").alias("hub"), F.col("w").alias("id"))
        around = around.unionByName(around.select(F.col("id").alias("hub"), F.col("hub").alias("id"))).distinct()
        met = _blocks(around, "hub", vectors, k, threshold).withColumn("fresh", F.lit(1))
        graph = settle(_best(old(graph).unionByName(met), k), "knn")
        done += 1
        edges, fresh = graph.agg(F.count("*"), F.coalesce(F.sum("fresh"), F.lit(0))).first()
        if fresh <= SHARE * edges:
            break
    return graph


def _pairs(threshold: float):
    """Rows (pair, side, id, weight, v) sorted by pair and side: how many vectors each id of side 0 links with on side 1."""

    def emit(sides: list[list]) -> Iterator[pa.RecordBatch]:
        left, right = sides
        ids, counts = [], []
        for size in {len(v) for _, _, v in left} & {len(v) for _, _, v in right}:
            a, b = ([r for r in side if len(r[2]) == size] for side in sides)
            s = _matrix([v for *_, v in a]) @ _matrix([v for *_, v in b]).T >= threshold
            s &= np.array([i for i, *_ in a])[:, None] != np.array([i for i, *_ in b])[None]
            ids += [i for i, *_ in a]
            counts += (s @ np.array([w for _, w, _ in b], np.int64)).tolist()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["id", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, [[], []]
        for b in batches:
            for pair, side, i, weight, v in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if pair != now:
                    yield from emit(sides)
                    now, sides = pair, [[], []]
                sides[side].append((i, weight, v))
        yield from emit(sides)

    return run


def linked_counts(members: DataFrame, threshold: float) -> DataFrame:
    """id, links for members (id, comp, weight, v): each component compared with itself in pairs of blocks of WIDE."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("blocks"))
    placed = members.join(sizes, "comp").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    left = placed.select("comp", "b", other, "id", "weight", "v").select(F.xxhash64("comp", "b", "o").alias("pair"), F.lit(0).alias("side"), "id", "weight", "v")
    right = placed.select("comp", "b", other, "id", "weight", "v").select(F.xxhash64("comp", "o", "b").alias("pair"), F.lit(1).alias("side"), "id", "weight", "v")
    rows = left.unionByName(right).repartition("pair").sortWithinPartitions("pair", "side", "id")
    return rows.mapInArrow(_pairs(threshold), "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def _cells(threshold: float):
    """Rows (block, comp, id, v) sorted by block: each block's vectors in cells around a pivot that links with them; the cell, its centre and the cosine up to which a vector may link with it."""

    def emit(block: int, comp: int, ids: list[int], vs: list[bytes]) -> Iterator[pa.RecordBatch]:
        x, left = _matrix(vs), np.arange(len(vs))
        theta = math.acos(min(1.0, max(-1.0, threshold)))
        while len(left):
            inside = x[left] @ x[left[0]] >= threshold
            inside[0] = True
            mine, left = left[inside], left[~inside]
            centre = x[mine].mean(axis=0)
            size = math.sqrt(float(centre @ centre))
            centre = centre / size if size > 1e-6 else x[mine[0]]
            radius = math.acos(min(1.0, max(-1.0, float((x[mine] @ centre).min()))))
            least = math.cos(min(math.pi, radius + theta)) - 1e-7
            n = len(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.full(n, ids[mine[0]])), pa.array(np.full(n, comp)), pa.array([ids[i] for i in mine], pa.int64()), pa.array([vs[i] for i in mine], pa.binary()), pa.array([centre.tobytes()] * n, pa.binary()), pa.array(np.full(n, least))],
                ["block", "cell", "comp", "id", "v", "centre", "least"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vs = None, [], []
        for b in batches:
            for block, comp, i, v in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if (block, comp) != now:
                    if ids:
                        yield from emit(*now, ids, vs)
                    now, ids, vs = (block, comp), [], []
                ids.append(i)
                vs.append(v)
        if ids:
            yield from emit(*now, ids, vs)

    return run


def _around(shared):
    """Rows (comp, v): those that may link with a cell of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, comps, least, centres = shared.value
        sizes = np.array([len(c) for c in centres])
        kinds = {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes)}
        matrices = {size: _matrix([centres[i] for i in at]).T for size, at in kinds.items()}
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                comp, vs = part.column(0).to_numpy(), part.column(1).to_pylist()
                for size, at in kinds.items():
                    mine = np.array([i for i, v in enumerate(vs) if len(v) == size], np.int64)
                    if not len(mine):
                        continue
                    s = _matrix([vs[i] for i in mine]) @ matrices[size]
                    i, c = np.nonzero((s >= least[at]) & (comp[mine][:, None] != comps[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells[at][c]), pa.array(comp[mine][i]), pa.array([vs[k] for k in mine[i]], pa.binary())], ["cell", "comp", "v"])

    return run


def _touching(threshold: float):
    """Rows (pair, side, comp, v) sorted by pair and side: the components of side 0 and side 1 that have a link."""

    def emit(sides: list[list]) -> Iterator[pa.RecordBatch]:
        left, right = sides
        if left and right:
            s = _matrix([v for _, v in left]) @ _matrix([v for _, v in right]).T >= threshold
            found = {(left[i][0], right[j][0]) for i, j in zip(*np.nonzero(s), strict=True)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, [[], []]
        for b in batches:
            for pair, side, comp, v in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if pair != now:
                    yield from emit(sides)
                    now, sides = pair, [[], []]
                sides[side].append((comp, v))
        yield from emit(sides)

    return run


def joined(vectors: DataFrame, links: DataFrame, labels: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """labels (id, comp) after all links of saturated classes, for those of links (a, b) and of these; vectors: id, v."""
    spark = vectors.sparkSession
    full = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("id")
    sat = full.join(labels, "id").join(vectors, "id")
    sizes = sat.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = sat.join(sizes, "comp").select(F.xxhash64("comp", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"), "comp", "id", "v")
    rows = dealt.repartition("block").sortWithinPartitions("block", "comp", "id")
    cells = settle(rows.mapInArrow(_cells(threshold), "block bigint, cell bigint, comp bigint, id bigint, v binary, centre binary, least double"), "cells")
    heads = settle(cells.filter("id = cell").select("cell", "comp", "centre", "least"), "centres")
    passes = math.ceil(heads.count() / CENTRES)
    if not passes:
        return labels
    placed = settle(vectors.join(labels, "id", "left").select(F.coalesce("comp", "id").alias("comp"), "v"), "placed")
    near = None
    for p in range(passes):
        mine = heads.filter(F.pmod(F.xxhash64("cell"), F.lit(passes)) == p).collect()
        shared = spark.sparkContext.broadcast((np.array([r.cell for r in mine], np.int64), np.array([r.comp for r in mine], np.int64), np.array([r.least for r in mine], np.float64), [bytes(r.centre) for r in mine]))
        one = settle(placed.mapInArrow(_around(shared), "cell bigint, comp bigint, v binary"), "around")
        shared.destroy()
        near = one if near is None else near.unionByName(one)
    blocks = near.groupBy("cell").agg(F.ceil(F.count("*") / WIDE).alias("blocks"))
    right = near.join(blocks, "cell").select(F.xxhash64("cell", F.pmod(F.xxhash64("v"), F.col("blocks"))).alias("pair"), F.lit(1).alias("side"), "comp", "v")
    left = cells.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("o"), "comp", "v")
    left = left.select(F.xxhash64("cell", "o").alias("pair"), F.lit(0).alias("side"), "comp", "v")
    rows = left.unionByName(right).repartition("pair").sortWithinPartitions("pair", "side")
    pairs = settle(rows.mapInArrow(_touching(threshold), "a bigint, b bigint").distinct(), "touching")
    if pairs.isEmpty():
        return labels
    tops = components(pairs).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    every = labels.unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct()
    return settle(every.join(tops, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), "joined")


def _asked_links(shared, threshold: float):
    """Rows (id, weight, v): for each vector asked how many it links with among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vs = shared.value
        sizes, total = np.array([len(v) for v in vs]), np.zeros(len(asked), np.int64)
        kinds = {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes)}
        matrices = {size: _matrix([vs[i] for i in at]).T for size, at in kinds.items()}
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                ids, weights, own = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
                for size, at in kinds.items():
                    mine = np.array([i for i, v in enumerate(own) if len(v) == size], np.int64)
                    if len(mine):
                        near = _matrix([own[i] for i in mine]) @ matrices[size] >= threshold + 1e-9
                        near &= ids[mine][:, None] != asked[at]
                        total[at] += weights[mine] @ near
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(total)], ["id", "sought"])

    return run


def _true_links(asked: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """id, sought: the links of each vector asked (id, v) with all classes but its own, by comparing them all, CENTRES at a time."""
    spark, out = asked.sparkSession, None
    for p in range(passes := max(1, math.ceil(asked.count() / CENTRES))):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).collect()
        shared = spark.sparkContext.broadcast((np.array([r.id for r in mine], np.int64), [bytes(r.v) for r in mine]))
        rows = classes.select("id", "weight", "v").mapInArrow(_asked_links(shared, threshold), "id bigint, sought bigint")
        one = settle(rows.groupBy("id").agg(F.sum("sought").alias("sought")), "asked")
        out = one if out is None else out.unionByName(one)
    return out


def audited(asked: DataFrame, counted: DataFrame, k: int = K) -> float:
    """The share of the links of asked (id, sought) that counted (id, links) has, or the mean share of those with k or fewer if that is less."""
    found = F.least("sought", F.coalesce("links", F.lit(0)))
    few = F.when(F.col("sought") <= k, found / F.col("sought"))
    share, mean = asked.filter("sought > 0").join(counted, "id", "left").agg(F.sum(found) / F.sum("sought"), F.avg(few)).first()
    return min(1.0 if x is None else x for x in (share, mean))


def _counted(graph: DataFrame, vectors: DataFrame, classes: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """id and comp, and id and links, of the classes that link by the graph.

    Where no class of a component is saturated, its lists hold all its links; only the other components are compared with themselves.
    """
    links = settle(graph.filter(F.col("cos") >= threshold).select(F.col("u").alias("a"), F.col("w").alias("b")).distinct(), "links")
    labels = joined(vectors, links, components(links), threshold, k)
    full = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    dense = settle(labels.join(full, "id").select("comp").distinct(), "saturated")
    members = labels.join(dense, "comp").join(classes.select("id", "weight", "v"), "id")
    sparse = labels.join(dense, "comp", "left_anti").select("id")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    listed = both.join(sparse, both.a == sparse.id).select("a", "b").join(classes.select(F.col("id").alias("b"), "weight"), "b")
    listed = listed.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("links"))
    return labels, settle(linked_counts(members, threshold).unionByName(listed), "counted")


def near_duplicates(docs: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """key, n_links, component_id and kept for each row."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_unit, "id bigint, v binary")
    rows = settle(rows.withColumn("digest", F.sha2("v", 256)), "vectors")
    one = rows.filter("v is not null and id is not null").dropDuplicates(["id"])
    classes = settle(one.groupBy("digest").agg(F.min(F.struct("id", "v")).alias("c"), F.count("*").alias("weight")).select("digest", F.col("c.id").alias("id"), "weight", F.col("c.v").alias("v")), "classes")
    vectors = classes.select("id", "v")
    n = classes.count()
    every = max(d for d in range(1, EVERY + 1) if EVERY % d == 0 and (d == 1 or n >= d * ASKED))
    asked = one.filter(F.col("id") % every == 0).select("digest").distinct().join(classes, "digest").select("id", "v")
    asked = settle(asked.join(_true_links(asked, classes, threshold), "id").select("id", "sought"), "audit")
    graph, seed = None, options.pop("seed", 3)
    while True:
        graph = neighbours(vectors, n, seed=seed, graph=graph, threshold=threshold, **options)
        labels, counted = _counted(graph, vectors, classes, threshold, options.get("k", K))
        if audited(asked, counted, options.get("k", K)) >= TARGET:
            break
        seed += 1
    found = classes.select("digest", "id", "weight").join(labels, "id", "left").join(counted, "id", "left")
    found = found.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "id").alias("comp"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(found, "digest", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"), (F.col("id").eqNullSafe(F.coalesce("comp", "id"))).alias("kept"))


def recall(docs: DataFrame, result: DataFrame, threshold: float = 0.9, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> float:
    """The share of the links of every every-th vector that the result has, by comparing these with all in blocks."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_unit, "id bigint, v binary").filter("v is not null")
    blocks = F.pmod(F.xxhash64("id"), F.lit(64))
    asked = rows.filter(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))).alias("pair"), F.lit(0).alias("side"), "id", F.lit(1).cast("bigint").alias("weight"), "v")
    all_rows = rows.select(blocks.alias("pair"), F.lit(1).alias("side"), "id", F.lit(1).cast("bigint").alias("weight"), "v")
    true = asked.unionByName(all_rows).repartition("pair").sortWithinPartitions("pair", "side", "id").mapInArrow(_pairs(threshold), "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("n"))
    got = true.join(result.select(F.col(key).alias("id"), "n_links"), "id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not got[0] else got[1] / got[0]


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked from a cosine of 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
