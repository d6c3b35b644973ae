"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each chunk's
bytes are embedded, windows of WIDTH bytes at every STRIDE-th place go through learned
filters and a rectifier, and each filter's largest response in the chunk is kept. A
chunk's maxima give a logit; a document's probability is the logistic function of the
mean of its chunks' logits, weighted by their bytes. All chunks of a batch go through
one matrix product.

The network is trained on at most LABELLED rows: those whose ids hash lowest, so that
reruns and partitionings agree, and from all chunks of these. The chunks of a document weigh DOC_WEIGHT
together at most, so that long ones don't outweigh the rest. Both classes weigh the same, and the threshold is one half.
Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text is one chunk of padding and gets the score the
network gives that; rows with null ids are neither learned from nor held out; rows with null or repeated ids each get a row; labels that are
null are not learned from (of several labels of an id the least counts, of several texts
the one that hashes lowest), and without labels of both classes every score is 0.5; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import remainder, small_batches, table
from ._shingles import joined

LABELLED = 3000
DOC_WEIGHT = 4
CHUNK = 512
OVERLAP = 64
DIM = 8
WIDTH = 8
STRIDE = 4
FILTERS = 24
EPOCHS = 12
BATCH = 64
#: chunks that go through the network at once when scoring
AT_ONCE = 128
PAD = 256


@dataclass
class Net:
    """embed (257, DIM), filters (WIDTH * DIM, FILTERS), bias, out (FILTERS), shift."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float


def chunks(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The overlapping chunks of a text, padded, and how many bytes each holds."""
    x = np.frombuffer(data or b"", np.uint8)
    starts = range(0, max(len(x) - OVERLAP, 1), CHUNK - OVERLAP)
    out = np.full((len(starts), CHUNK), PAD, np.int16)
    size = np.empty(len(starts), np.float32)
    for i, at in enumerate(starts):
        part = x[at : at + CHUNK]
        out[i, : len(part)] = part
        size[i] = max(len(part), 1)
    return out, size


def _windows(net: Net, x: np.ndarray) -> np.ndarray:
    e = net.embed[x].reshape(len(x), CHUNK * DIM)
    view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
    return np.ascontiguousarray(view).reshape(-1, WIDTH * DIM)


def _pooled(net: Net, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk's maxima after the rectifier, where they are, and the windows."""
    w = _windows(net, x)
    h = (w @ net.filters).reshape(len(x), -1, FILTERS)
    at = h.argmax(axis=1)
    top = np.take_along_axis(h, at[:, None], 1)[:, 0] + net.bias
    return np.maximum(top, 0), at, w


def logits(net: Net, x: np.ndarray) -> np.ndarray:
    """Chunk logits, AT_ONCE chunks at a time."""
    out = []
    for i in range(0, len(x), AT_ONCE):
        part = x[i : i + AT_ONCE]
        h = (_windows(net, part) @ net.filters).reshape(len(part), -1, FILTERS).max(axis=1)
        out.append(np.maximum(h + net.bias, 0) @ net.out + net.shift)
    return np.concatenate(out)


def train(texts: list[bytes | None], labels: np.ndarray, seed: int = 7) -> Net:
    """Fit the network by Adam on chunks of the texts, classes weighted alike."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    net = Net(f32(PAD + 1, DIM) * 0.5, f32(WIDTH * DIM, FILTERS) / np.float32(np.sqrt(WIDTH * DIM)), np.zeros(FILTERS, np.float32), f32(FILTERS) * 0.1, 0.0)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean()).astype(np.float32)
    cut = [chunks(t)[0] for t in texts]
    every = [(i, j) for i, c in enumerate(cut) for j in range(len(c))]
    share = np.array([min(1, DOC_WEIGHT / len(c)) for c in cut], np.float32)
    names = ("embed", "filters", "bias", "out", "shift")
    moments = {n: [0.0, 0.0] for n in names}
    step = 0
    for epoch in range(EPOCHS):
        pick = [every[k] for k in rng.permutation(len(every))]
        rate = 0.01 * (1 - epoch / EPOCHS)
        for b in range(0, len(pick), BATCH):
            part = pick[b : b + BATCH]
            x = np.stack([cut[i][j] for i, j in part])
            who = np.array([i for i, _ in part])
            top, at, w = _pooled(net, x)
            z = np.clip(top @ net.out + net.shift, -30, 30)
            d = ((1 / (1 + np.exp(-z)) - labels[who]) * weight[who] * share[who] / share[who].sum()).astype(np.float32)
            grad = {"out": top.T @ d, "shift": float(d.sum())}
            back = d[:, None] * net.out * (top > 0)
            grad["bias"] = back.sum(axis=0)
            # only the window of each filter's maximum has a gradient
            rows = at + np.arange(len(x))[:, None] * (len(w) // len(x))
            hit = w[rows]
            grad["filters"] = np.einsum("cf,cfk->kf", back, hit)
            into = (back[:, :, None] * net.filters.T).reshape(-1, DIM)
            place = (at[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(len(x), -1)
            bytes_at = np.take_along_axis(x, place, 1).reshape(-1)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], bytes_at, into)
            step += 1
            for n in names:
                m, v = moments[n]
                m, v = 0.9 * m + 0.1 * grad[n], 0.999 * v + 0.001 * grad[n] ** 2
                moments[n] = [m, v]
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, getattr(net, n) - (change if n == "shift" else change.astype(np.float32)))
    return net


def fit(docs: DataFrame, labels: DataFrame, learn_from, limit: int = LABELLED, key: str = "doc_id", text: str = "text", label: str = "quality") -> Net:
    """Train on at most limit labelled rows for whose key the condition holds: those with the lowest hashes."""
    known = labels.filter(F.col(label).isNotNull() & learn_from(F.col(key))).groupBy(key).agg(F.min(label).alias("__label"))
    known = known.withColumn("__h", F.xxhash64(key)).orderBy("__h", key).limit(limit)
    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("__text")).join(F.broadcast(known), key)  # at most limit rows of labels
    one = rows.groupBy("__h", key, "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    got = one.orderBy("__h", key).select("__text", "__label").collect()
    return train([r[0] for r in got], np.array([int(r[1]) for r in got]))


def _score(net: Net, columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = joined(b.column(text).cast(pa.binary()))
            n = np.diff(offsets)
            many = np.maximum(-(-(n - OVERLAP) // (CHUNK - OVERLAP)), 1)
            doc = np.repeat(np.arange(len(n)), many)
            inside = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * (CHUNK - OVERLAP)
            size = np.clip(n[doc] - inside, 1, CHUNK)
            total, starts = np.zeros(len(n)), offsets[doc] + inside
            for i in range(0, len(doc), AT_ONCE):
                at = starts[i : i + AT_ONCE, None] + np.arange(CHUNK)
                there = at < offsets[doc[i : i + AT_ONCE] + 1][:, None]
                x = np.where(there, data[np.minimum(at, len(data) - 1)].astype(np.int16) if len(data) else np.int16(0), np.int16(PAD))
                total += np.bincount(doc[i : i + AT_ONCE], logits(net, x) * size[i : i + AT_ONCE], len(n))
            z = total / np.maximum(np.bincount(doc, size, len(n)), 1)
            out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.float64())], [*columns, "__score"])

    return run


def scored(docs: DataFrame, net: Net, columns: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns named, and the score. Where the text is one of them it is carried once."""
    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    rows = docs.select(*columns) if text in columns else docs.select(*columns, text)
    return rows.mapInArrow(_score(net, columns, text), f"{schema}, __score double").withColumnRenamed("__score", name)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from labelled rows whose remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"), lambda k: remainder(k, 3) != 1)
    out = scored(docs, net, ["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
