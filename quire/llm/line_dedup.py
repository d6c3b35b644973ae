"""Line dedup: an exact set-similarity join of lines by prefix, position and length.

A line's tokens are its distinct shingles of width words (A-Z lower-cased); width 1 makes
them plain words, and a line of fewer words is one token, its whole sequence. All lines that have
a word take part (min_words = 1). A line is removed if an earlier line (a lesser document
id, or the same and a lesser line number) has a Jaccard similarity of num / den or more
with it, removed itself or not.

Lines with equal token sets are one class, told by a digest; all but its first line are
removed. The tokens of a class are ordered by rarity: those that make up RARE of all
tokens or more (at most 1 / RARE of them, so they may be broadcast) come last, by the
logarithm of their count, and ties go by hash. Any fixed order gives an exact result; the
rare ones first make few candidates. Two sets that are similar enough share a token among
their first n - ceil(n * num / den) + 1; only tokens in the prefixes of two classes go
further. Candidates pass the length filter, by where the
shared token stands in each the positional filter, and by a parity bitmap of each set
(whose bits differ in no more places than the sets have tokens that are not shared) the
bitmap filter; the rest are verified on the lines' full sets. Each token's earliest class
is tried first against all of its list; only classes that this leaves unmatched are tried
against all that are earlier, so that a list of thousands of near copies makes pairs in
proportion to its length.

Defined results: null and empty texts have no line to remove; documents with null ids are
neither compared nor changed; rows with the same id count as one document; repeated lines
within a document are removed after the first; an empty table gives an empty result;
extra columns are ignored, or kept by deduped() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, forget, settle, sized, small_batches, table
from ._shingles import joined, mixed, overlap, runs, shingle_sets, sliced, words

WIDTH = 5
MIN_WORDS = 1
#: the share of all tokens from which a token counts as frequent
RARE = 1e-6
#: tokens (8 bytes each) that may be broadcast to pick postings; beyond, the postings are shuffled once more
BROADCAST_TOKENS = 2_000_000
#: digests (16 bytes each) of repeated lines that may be broadcast; beyond, the lines are shuffled
BROADCAST_DIGESTS = 500_000
#: digests whose prefixes a task remembers to have given
REMEMBER = 50_000


def _read(b: pa.RecordBatch, width: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Shingle hashes, the line of each (numbered through the texts), and each line's text and line number."""
    data, offsets = joined(b.column("text"))
    h, starts = words(data, offsets)
    breaks = np.flatnonzero(data == ord("\n"))
    above, doc = np.searchsorted(breaks, starts), np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.diff(above + doc, prepend=-1))
    n = np.diff(first, append=len(h))
    doc = doc[first]
    number = above[first] - np.searchsorted(breaks, offsets)[doc]
    if min_words > 1:
        long = n >= min_words
        h, n, doc, number = h[np.repeat(long, n)], n[long], doc[long], number[long]
    return *runs(h, n, width), doc, number


def _tally(width: int, min_words: int):
    """A row for each token that makes up RARE or more of a task's, and occurs twice in a slice; and one with null for the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, counts = 0, np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in sliced(batches, 0):
            h = _read(b, width, min_words)[0]
            total += len(h)
            h.sort()
            first = np.flatnonzero(np.concatenate([h[:1] == h[:1], h[1:] != h[:-1]]))
            n = np.diff(first, append=len(h))
            h, n = h[first][n > 1], n[n > 1]
            every = np.concatenate([held, h])
            held, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(held)).astype(np.int64)
        often = counts >= total * RARE
        yield pa.RecordBatch.from_arrays([pa.array([None, *held[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[often].tolist()], pa.int64())], ["token", "n"])

    return run


def frequent(texts: DataFrame, width: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with a share of RARE or more, sorted, and the level (1 to 15) of each; at most 1 / RARE."""
    sums = settle(texts.select("text").mapInArrow(_tally(width, min_words), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "line-tally")
    total = sums.filter("token is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(2.0, total * RARE)
    rows = sums.filter(F.col("token").isNotNull() & (F.col("n") >= least)).collect()
    tokens, n = np.array([r.token for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.float64)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(15, 1 + np.log2(n[order] / least)).astype(np.uint64)


def _levels(h: np.ndarray, tokens: np.ndarray, levels: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each hash's level, 0 where it isn't frequent; known: which low bits frequent tokens have."""
    out = np.zeros(len(h), np.uint64)
    maybe = np.flatnonzero(known[(h & np.uint64(len(known) - 1)).astype(np.int64)])
    if len(maybe):
        at = np.minimum(np.searchsorted(tokens, h[maybe]), len(tokens) - 1)
        out[maybe] = np.where(tokens[at] == h[maybe], levels[at], np.uint64(0))
    return out


def _sign(width: int, min_words: int, num: int, den: int, shared):
    """For each line: its set's digest, size, parity bitmap, whether its document has the set before, and the prefix where this task hasn't given it yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokens, levels), given = shared.value, set()
        known = np.zeros(1 << 22, bool)
        known[(tokens & np.uint64(len(known) - 1)).astype(np.int64)] = True
        for b in sliced(batches, 1):
            h, line, doc, number = _read(b, width, min_words)
            if not len(h):
                continue
            level = _levels(h, tokens, levels, known)
            if len(doc) < 1 << 20:
                order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (level << np.uint64(40)) | (h >> np.uint64(24)))
            else:
                order = np.lexsort((h, level, line))
            h, line = h[order], line[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])
            h, line = h[new], line[new]
            n = np.bincount(line, minlength=len(doc))
            starts = np.cumsum(n) - n
            digests = [np.add.reduceat(mixed(h * np.uint64(c)), starts).view(np.int64) for c in (3, 5)]
            bit, half = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(1)
            parity = [np.bitwise_xor.reduceat(bit * (half == k), starts).view(np.int64) for k in (0, 1)]
            fresh = np.zeros(len(doc), bool)
            for i, key in enumerate(zip(digests[0].tolist(), digests[1].tolist(), strict=True)):
                if key not in given:
                    fresh[i] = True
                    if len(given) < REMEMBER:
                        given.add(key)
            places = np.lexsort((number, doc, digests[1], digests[0]))
            same = np.ones(len(doc) - 1, bool)
            for column in (digests[0], digests[1], doc):
                same &= column[places][1:] == column[places][:-1]
            again = np.zeros(len(doc), bool)
            again[places[1:][same]] = True
            many = np.where(fresh, n - (n * num + den - 1) // den + 1, 0)
            place = np.arange(len(h)) - np.repeat(starts, n)
            prefix = h[place < many[line]].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(doc)), pa.array(number), *map(pa.array, (*digests, n, *parity, again)), pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix))],
                ["doc", "line", "d0", "d1", "n", "p0", "p1", "again", "prefix"],
            )

    return run


def _verify(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for s, t in zip(shingle_sets(b.column("x_text"), width), shingle_sets(b.column("y_text"), width), strict=True):
                common = overlap(s, t)
                good.append(den * common >= num * (len(s) + len(t) - common))
            yield b.select(["y"]).filter(pa.array(good, pa.bool_()))

    return run


def _possible(num: int, den: int) -> Column:
    """The length, positional and bitmap filters for x and y that share a token at their places."""
    xn, yn = F.col("x.n"), F.col("y.n")
    rest = F.least(xn - F.col("x.place"), yn - F.col("y.place"))
    apart = F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))) + F.bit_count(F.col("x.p1").bitwiseXOR(F.col("y.p1")))
    return (F.least(xn, yn) * den >= F.greatest(xn, yn) * num) & (rest * (num + den) >= (xn + yn) * num) & (apart * (num + den) <= (xn + yn) * (den - num))


def removed_lines(docs: DataFrame, width: int = WIDTH, num: int = 80, den: int = 100, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and line (from 0) of each line to remove."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(frequent(texts, width, min_words))
    lines = settle(texts.mapInArrow(_sign(width, min_words, num, den, shared), "doc bigint, line bigint, d0 bigint, d1 bigint, n bigint, p0 bigint, p1 bigint, again boolean, prefix array<bigint>"), "lines")

    # Exact copies: by digest alone.
    once, at = lines.filter("not again"), F.struct("doc", "line")
    many = once.groupBy("d0", "d1").agg(F.count("*").alias("m")).filter("m > 1").select("d0", "d1")
    many = sized(settle(many, "line-many"), BROADCAST_DIGESTS)
    copies = settle(once.select("doc", "line", "d0", "d1").join(many, ["d0", "d1"]), "line-copies")
    firsts = settle(copies.groupBy("d0", "d1").agg(F.min(at).alias("first")), "line-firsts")
    repeated = copies.join(firsts, ["d0", "d1"]).filter(at != F.col("first")).select("doc", "line")
    repeated = repeated.unionByName(lines.filter("again").select("doc", "line"))

    # Similar ones: the classes, once each, that share a token of their prefixes, with the first class of each token.
    given = lines.filter(F.size("prefix") > 0).select("d0", "d1", "doc", "line", "n", "p0", "p1", "prefix")
    each = given.join(many, ["d0", "d1"], "left_anti").unionByName(given.join(many, ["d0", "d1"], "left_semi").dropDuplicates(["d0", "d1"]))
    tokens = settle(each.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token"), "line-tokens")
    postings = each.select("d0", "d1", "doc", "line", "n", "p0", "p1", F.posexplode("prefix").alias("place", "token"))
    lists = settle(postings.join(sized(tokens, BROADCAST_TOKENS), "token"), "line-postings")
    placed = lists.join(sized(firsts), ["d0", "d1"], "left").select("token", F.coalesce("first", at).alias("at"), "n", "place", "p0", "p1")
    heads = placed.groupBy("token").agg(F.max("at").alias("last"), F.min(F.struct("at", "n", "place", "p0", "p1")).alias("x")).filter("x.at < last").drop("last")
    lists = settle(placed.join(heads, "token"), "line-lists")

    tried = lists.alias("y").filter((F.col("x.at") < F.col("y.at")) & _possible(num, den))
    tried = settle(tried.select(F.col("x.at").alias("x"), F.col("y.at").alias("y")).distinct(), "line-pairs")
    matched = settle(_matched(tried, texts, width, num, den), "line-matches")
    lists = lists.drop("x")
    rest = lists.join(sized(matched.withColumnRenamed("y", "at")), "at", "left_anti")
    more = rest.alias("y").join(lists.alias("x"), (F.col("x.token") == F.col("y.token")) & (F.col("x.at") < F.col("y.at")) & _possible(num, den))
    more = settle(more.select(F.col("x.at").alias("x"), F.col("y.at").alias("y")).distinct().join(tried, ["x", "y"], "left_anti"), "line-pairs")
    out = repeated.unionByName(matched.select("y.doc", "y.line"))
    if not more.isEmpty():
        out = out.unionByName(_matched(more, texts, width, num, den).select("y.doc", "y.line"))
    out = settle(out.distinct(), "removed-lines")
    forget(lines, copies)
    shared.destroy()
    return out


def _bodies(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """at and the line's text for the lines wanted."""
    ids = settle(wanted.groupBy("at.doc").agg(F.collect_set("at.line").alias("wanted")), "line-wanted")
    found = texts.join(sized(ids), texts.id == ids.doc).withColumn("parts", F.split(F.col("text").cast("string"), "\n", -1))
    each = found.select("doc", "parts", F.explode("wanted").alias("line"))
    each = each.select(F.struct("doc", "line").alias("at"), F.get("parts", F.col("line").cast("int")).cast("binary").alias("text"))
    return settle(each.dropDuplicates(["at"]), "line-texts")


def _matched(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The y of the pairs whose full sets are similar enough."""
    bodies = _bodies(pairs.select(F.explode(F.array("x", "y")).alias("at")).distinct(), texts)
    rows = pairs.join(bodies.select(F.col("at").alias("x"), F.col("text").alias("x_text")), "x")
    rows = rows.join(bodies.select(F.col("at").alias("y"), F.col("text").alias("y_text")), "y")
    out = rows.select("y", "x_text", "y_text").mapInArrow(_verify(width, num, den), "y struct<doc:bigint,line:bigint>")
    return out.distinct()


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the lines removed, and __removed: how many (0 or more). Other columns stay."""
    gone = removed_lines(docs, key=key, text=text, **options)
    gone = gone.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    keep = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("__gone", i.cast("bigint")))
    columns = [F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n")).alias(text) if c == text else docs[c] for c in docs.columns if c != "__removed"]
    return docs.join(gone, docs[key] == gone["__doc"], "left").select(*columns, F.coalesce(F.size("__gone"), F.lit(0)).alias("__removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all documents: the number of lines, how many go, and which (from 0)."""
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_set("line")).alias("removed_lines"))
    rows = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(gone, "doc_id", "left").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
