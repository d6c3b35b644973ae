"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q, repeated at least `exponent` times, that no
neighbouring word continues. Words are numbered, and for each dyadic scale t a synchronising set is
chosen: a place i belongs to it if, among the hashes of the t words that begin at i .. i+t, the least
is the first or the last. So whether i belongs depends on the 2t words from i alone, and a stretch that
repeats is sampled at the same places each time. Places whose t words have a period of t/3 or less are left
out of the minimum; where nothing but such places is, no place is chosen, and the set stays sparse.

Scale t serves the periods 3t .. 6t-1: a run of three or more repeats holds a place i of the set within
its first q + t words, and i + q has the same 2t words. Pairs of places with equal contexts at such a
distance propose periods; equal contexts are more than t/3 apart, so a place has less than 18 partners.
The periods that a scale leaves out, t/3 and less, are those of runs found at earlier scales, which mark
these regions for it; periods 1 and 2 are read off the words. Each proposal is extended both ways
by a binary search over hashes modulo 2 ** 61 - 1, stretches proposed with multiples of their period
keep the least one, and all runs are compared word by word at the end.

The documents of a batch are laid end to end with a mark of its own between two, so all steps are array
operations whatever the documents' number and length. A document is never divided: a task holds the words of one.

Defined results: null and empty texts, and those of white space alone, have no words, no runs and an empty
collapsed text; rows with equal or null ids each get a row; an empty table gives an empty result; columns
that aren't asked for are ignored, and those asked for may have any names but n_words, runs and collapsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table

#: words whose documents are searched together, or one document
WORDS = 150_000
#: least length and least number of repeats of a run
LENGTH, EXPONENT = 6, 4

_P, _M31, _M30 = np.uint64((1 << 61) - 1), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
_NEVER = np.uint64((1 << 64) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> _31)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x >> _61) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, from products of 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _M31, b >> _31, b & _M31
    mid = a0 * b1 + a1 * b0
    return _mod(a1 * b1 * np.uint64(2) + (mid >> _30) + ((mid & _M30) << _31) + a0 * b0)


class _Equal:
    """Compares stretches of a sequence by their hashes."""

    def __init__(self, t: np.ndarray, seed: int) -> None:
        self.n = len(t)
        power = np.ones(self.n + 1, np.uint64)
        base, done = np.array([0x1D2FA34CB71E5703 + 2 * seed], np.uint64), 1
        while done < len(power):
            m = min(done, len(power) - done)
            power[done : done + m] = _times(power[:m], base)
            base, done = _times(base, base), done * 2
        v = _times(_mod(_mixed(t.astype(np.uint64) + np.uint64(seed))), power[:-1])
        high, low = np.cumsum(v >> _31, dtype=np.uint64), np.cumsum(v & _M31, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), _mod(_times(_mod(high), np.uint64(1) << _31) + _mod(low))])
        self.power = power

    def _same(self, at: np.ndarray, to: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether the words at .. to are those d later."""
        near = _mod(self.sums[to] + _P - self.sums[at])
        far = _mod(self.sums[to + d] + _P - self.sums[at + d])
        return _times(near, self.power[d]) == far

    def _most(self, limit: np.ndarray, good) -> np.ndarray:
        """The greatest length up to the limit that is good; what is longer than a bad one is bad."""
        length, step = np.zeros_like(limit), 1 << max(int(limit.max(initial=0)).bit_length() - 1, 0)
        while step:
            further = np.minimum(length + step, limit)
            length = np.where((further > length) & good(further), further, length)
            step //= 2
        return length

    def extended(self, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch with period d around the words from at on."""
        after = self._most(self.n - at - d, lambda k: self._same(at, at + k, d))
        before = self._most(at.copy(), lambda k: self._same(at - k, at, d))
        return at - before, at + d + after


def _least_of(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span, now = 1, a
    while 2 * span <= width:
        now, span = np.minimum(now[:-span], now[span:]), 2 * span
    rest, n = width - span, len(a) - width + 1
    return np.minimum(now[:n], now[rest : rest + n])


def _stretches(same: np.ndarray, d: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words equal those d later at `least` neighbouring places or more: begin and end of the words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long] + d


def _proposed(places: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods from 3 * scale to 6 * scale - 1 of pairs with equal contexts, one of each chain of places."""
    order = np.argsort(context, kind="stable")
    p, c = places[order], context[order]
    found, k = [], 1
    while k < len(p):
        d = p[k:] - p[:-k]
        near = (c[k:] == c[:-k]) & (d < 6 * scale)
        if not near.any():
            break
        far = near & (d >= 3 * scale)
        found.append((p[:-k][far], d[far]))
        k += 1
    at, d = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*found, strict=True)) or ((), ())))
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    first = np.ones(len(at), bool)
    first[1:] = (d[1:] != d[:-1]) | (at[1:] - at[:-1] > 2 * scale)
    return at[first], d[first]


def _repeats(t: np.ndarray, longest: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all stretches of three or more repeats; no stretch is longer than `longest`."""
    n = len(t)
    runs = [[np.empty(0, np.int64)] * 3]
    for d in (1, 2):
        begin, end = _stretches(t[:-d] == t[d:], d, 2 * d)
        runs.append([begin, end, np.full(len(begin), d)])
    equal, scale, hashes = None, 1, _mixed(t.astype(np.uint64) * _ODD + np.uint64(seed))
    while 9 * scale <= longest and 2 * scale <= n:
        context = _mixed(hashes[: n - 2 * scale + 1] * _ODD + hashes[scale : n - scale + 1])
        key = hashes
        begin, end, period = (np.concatenate(x) for x in zip(*runs, strict=True))
        dense = (3 * period <= scale) & (end - begin >= scale)
        if dense.any():
            depth = np.zeros(n + 1, np.int32)
            np.add.at(depth, begin[dense], 1)
            np.add.at(depth, end[dense] - scale + 1, -1)
            key = np.where(np.cumsum(depth)[: len(hashes)] > 0, _NEVER, hashes)
        least = _least_of(key, scale + 1)
        places = np.flatnonzero((least != _NEVER) & ((key[: len(least)] == least) | (key[scale : scale + len(least)] == least)))
        at, d = _proposed(places, context[places], scale)
        if len(at):
            equal = equal or _Equal(t, seed)
            begin, end = equal.extended(at, d)
            long = end - begin >= 3 * d
            runs.append([begin[long], end[long], d[long]])
        hashes, scale = context, 2 * scale
    begin, end, period = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return begin[first], end[first], period[first]


def find_runs(t: np.ndarray, longest: int, least: int = LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of the runs of a sequence of numbers, by begin, then period; exponent is 3 or more."""
    if exponent < 3:
        raise ValueError("runs of fewer than three repeats aren't looked for")
    if len(t) < 3:
        return (np.empty(0, np.int64),) * 3
    seed = 0
    while True:
        begin, end, period = _repeats(t, longest, seed)
        long = end - begin >= np.maximum(least, exponent * period)
        begin, end, period = begin[long], end[long], period[long]
        order = np.lexsort((period, begin))
        begin, end, period = begin[order], end[order], period[order]
        if all(np.array_equal(t[b : e - p], t[b + p : e]) for b, e, p in zip(begin, end, period, strict=True)):
            return begin, end, period
        seed += 1  # two hashes were equal by chance


def _group(texts: list[list[bytes]], least: int, exponent: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text's words its runs (begin, length, period in rows) and the words without repeats, joined by spaces."""
    sizes = np.array([len(w) for w in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for words in texts for w in words]
    t = np.empty(int(sizes.sum()) + len(texts), np.int64)
    marks = starts + sizes
    plain = np.ones(len(t), bool)
    plain[marks] = False
    t[plain] = pd.factorize(flat)[0] + len(texts)
    t[marks] = np.arange(len(texts))
    begin, end, period = find_runs(t, int(sizes.max(initial=0)), least, exponent)
    depth = np.zeros(len(t) + 1, np.int32)
    np.add.at(depth, begin + period, 1)
    np.add.at(depth, end, -1)
    kept = np.cumsum(depth)[:-1] == 0
    bounds = np.searchsorted(begin, [*starts, len(t)])
    for words, at, i, j in zip(texts, starts, bounds[:-1], bounds[1:], strict=True):
        rows = np.stack([begin[i:j] - at, end[i:j] - begin[i:j], period[i:j]], 1)
        yield rows, b" ".join(words if i == j else compress(words, kept[at : at + len(words)]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            at = 0
            while at < b.num_rows:
                texts, words, begin = [], 0, at
                while at < b.num_rows and (not texts or words < WORDS):
                    texts.append((column[at].as_py() or b"").split())  # bytes are split at ASCII white space
                    words, at = words + len(texts[-1]), at + 1
                found = list(_group(texts, least, exponent))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r, _ in found])]).astype(np.int32)
                rows = np.concatenate([r for r, _ in found])
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], fields=list(_RUN)))
                collapsed = pa.array([c for _, c in found], pa.binary()).cast(pa.string())
                counts = pa.array([len(w) for w in texts], pa.int64())
                part = b.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts, runs, collapsed], [*b.schema.names[:-1], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, columns: list[str], text: Column | str = "text", least: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """The columns named, n_words, runs (start and length in words, period; by start, then period) and collapsed:
    the words that are in no run, or among its first `period`, joined by spaces."""
    small_batches(docs.sparkSession)
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*columns, text.cast("binary").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    return rows.mapInArrow(_search(least, exponent), fields + "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_repeats(text: Column, key: Column) -> Column:
    """The text, but where the key's hash ends in 0 with a tail of words that repeats: a known case in a corpus.

    With h the CRC-32 of the key's decimal text and g = h // 10, from word a = g % n on word i is the text's
    word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null key leaves the text as it is.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    once = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, once).otherwise(text)


def op11_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, some of which get a repeating tail, and digests of them and of the collapsed text."""
    docs = table(spark, sf_dir, "documents")
    out = periodic_runs(docs, ["doc_id"], with_repeats(F.coalesce("text", F.lit("")), F.col("doc_id")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("__best", longest)
    start, length, period = F.col("__best.start"), -F.col("__best.short"), F.col("__best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
