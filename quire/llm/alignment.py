"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and which ids go together corpus-wide.

Within a task everything is Arrow: both tokenizers' ids are lists; flattened, with each token's document (parent
index) and its bytes' length from the vocabulary, a cumulative sum less that of the document's beginning gives
where the token ends. (document, end) is one number, the document-end key, and an Acero hash join of both
sides' keys gives the ends they share. These cut each document into groups, whose tokens are lists again. Where a
group has more than one token on a side, a second join pairs them; in large groups ids are counted first, so many equal
tokens make few rows. Texts are
cut at spaces, where both tokenizers always end a token, so the different pieces of a batch are aligned once, as
documents of their own, and each text adds up its pieces. What comes out for each document are its groups and its distinct id
pairs with the number of links of each.

An id pair's count is the number of documents that hold it. Tasks count by Table.group_by over many documents, and Spark adds
up these partial counts. The best count of an id of the first tokenizer is a maximum over a
table with a row for each pair. To give documents their counts, pairs in more than 1/HEAVY of all entries (so fewer than HEAVY of them,
whatever the corpus) are broadcast; all others, each of them rare, are joined by a shuffle.

Memory: a batch is taken in slices of SLICE bytes of text, or one text; partial counts of a task are handed on
at PARTIAL rows. Tokenizers' files are parameters; the ids are those of their libraries.

Defined results: a text that is null or empty, or whose tokens' bytes aren't a space and the text (characters that a
tokenizer replaces, say), has no tokens: counts of 0 and empty groups; each row is a document of its own, whatever
its key; an empty table gives an empty result; columns not asked for are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import settle, small_batches, table
from .bpe import _byte_letters, vocabulary_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: bytes of text that are aligned at once, or one text
SLICE = 1 << 21
#: rows of partial counts that a task keeps
PARTIAL = 400_000
#: pairs that are broadcast at most
HEAVY = 200_000
#: links of a group beyond which its ids are counted before they are joined
FEW = 64
#: an id of the second tokenizer takes fewer bits
BITS = 20
#: a pair, and ends within a document, take fewer bits; the rest are for the documents of a slice
_PAIR_BITS, _END_BITS = 40, 34
_CUT = re.compile(r"(?= )(?<=\S)")


class _Bytes:
    """A byte-level BPE: ids as its library gives them, and each id's bytes."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(_byte_letters())}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in {x["content"] for x in spec["added_tokens"]}}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        #: ids of a merge follow those of earlier ones, so they are its ranks
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        pieces = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for t, i in ranks.items():
            pieces[i] = t
        self.pieces = pa.array(pieces, pa.binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        return list(map(self._one, texts))

    def _one(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # its splitter gives up on some very long stretches of white space by a panic, which isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return self.slow.encode(text, add_special_tokens=False).ids


class _Pieces:
    """A sentencepiece model: ids, and each id's bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        if any("▁" in p.lstrip("▁") for p in map(self.model.id_to_piece, ids)):
            raise ValueError("a piece has a space after another character, so texts can't be cut there")
        self.space = self.model.piece_to_id("▁")
        self.pieces = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(self.model.id_to_piece, ids), strict=True)], pa.binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the model itself puts before a text that isn't empty."""
        return [i if t != " " else [self.space] for t, i in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1), strict=True)]


@functools.lru_cache(maxsize=4)
def load(path: str) -> _Bytes | _Pieces:
    return _Pieces(path) if path.endswith(".model") else _Bytes(path)


def _whole(ids: pa.ListArray, pieces: pa.Array, want: pa.Array) -> pa.Array:
    """Whether the bytes of each document's tokens are those wanted."""
    made = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.take(pieces, ids.values)), b"")
    return pc.equal(made, want)


def _ends(ids: pa.ListArray, sizes: pa.Array, side: str) -> pa.Table:
    """A row for each token: document-end key, and its place."""
    flat, doc = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    upto = pc.cumulative_sum(pc.take(sizes, flat))
    first = pc.if_else(pc.greater(ids.offsets[:-1], 0), pc.take(upto, pc.max_element_wise(pc.subtract(ids.offsets[:-1], 1), 0)), 0) if len(flat) else pa.array([], pa.int64())
    end = pc.subtract(upto, pc.take(first, doc))
    key = pc.add(pc.shift_left(doc, pa.scalar(_END_BITS, pa.int64())), end)
    return pa.table({"key": key, f"{side}_at": _count(len(flat))})


def _count(n: int) -> pa.Array:
    return pa.array(np.arange(n))


def _lists(flat: pa.Array, sizes: pa.Array) -> pa.ListArray:
    ends = pc.cast(pc.cumulative_sum(sizes), pa.int32())
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends]), flat)


def _one_chunk(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def aligned_ids(a: pa.ListArray, b: pa.ListArray, size_a: pa.Array, size_b: pa.Array) -> dict[str, pa.Array]:
    """What two lists of ids for each document have in common: n_a, n_b, n_groups, n_links, groups (text), pairs and links (lists of equal length).

    size_a, size_b: bytes of each id. Both lists of a document are of the same bytes.
    """
    docs = len(a)
    ta, tb = _ends(a, size_a, "a"), _ends(b, size_b, "b")
    shared = ta.join(tb, keys="key", join_type="inner", use_threads=False).sort_by("a_at")
    keys = _one_chunk(shared["key"])
    doc_of = pc.shift_right(keys, pa.scalar(_END_BITS, pa.int64()))
    groups = len(keys)
    before = lambda at: pc.subtract(at, pc.cast(pa.concat_arrays([pa.array([-1], pa.int64())[: min(groups, 1)], at[: max(groups - 1, 0)]]), pa.int64()))
    in_a, in_b = before(_one_chunk(shared["a_at"])), before(_one_chunk(shared["b_at"]))
    per_doc = lambda doc, values, how: _per_document(doc, values, how, docs)
    n_groups, n_links = per_doc(doc_of, in_a, "count"), per_doc(doc_of, pc.multiply(in_a, in_b), "sum")

    flat = [pc.cast(pc.list_flatten(x), pa.int64()) for x in (a, b)]
    inside = [_lists(x, k) for x, k in zip(flat, (in_a, in_b), strict=True)]  # a list for each group
    written = [pc.binary_join(x.cast(pa.list_(pa.string())), ",") for x in inside]
    text = pc.binary_join(_lists(pc.binary_join_element_wise(*written, "|"), n_groups), ";")

    # groups of a token on each side are links as they stand; in the others the sides are joined, and in large ones ids are counted first
    product = pc.multiply(in_a, in_b)
    lone, large = pc.equal(product, 1), pc.greater(product, FEW)
    pair = lambda x, y: pc.add(pc.shift_left(x, pa.scalar(BITS, pa.int64())), y)
    plain = [pc.list_flatten(pc.filter(x, lone)) for x in inside]
    rows = [(pc.filter(doc_of, lone), pair(*plain), pa.repeat(pa.scalar(1, pa.int64()), len(plain[0])))]
    for chosen in (pc.and_not(pc.invert(lone), large), large):
        sides = []
        for x, s in zip(inside, "ab", strict=True):
            few = pc.filter(x, chosen)
            tokens = pa.table({"group": pc.take(pc.filter(_count(groups), chosen), pc.list_parent_indices(few)), f"{s}_id": pc.list_flatten(few)})
            if chosen is large:
                tokens = tokens.group_by(["group", f"{s}_id"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", f"{s}_id", f"{s}_n"])
            sides.append(tokens)
        links = sides[0].join(sides[1], keys="group", join_type="inner", use_threads=False)
        n = pc.multiply(links["a_n"], links["b_n"]) if chosen is large else pa.repeat(pa.scalar(1, pa.int64()), len(links))
        rows.append((pc.take(doc_of, links["group"]), pair(links["a_id"], links["b_id"]), n))
    doc, pairs, counts = (pa.concat_arrays([_one_chunk(x) for x in column]).to_numpy() for column in zip(*rows, strict=True))
    return {
        "n_a": pc.cast(pc.list_value_length(a), pa.int64()), "n_b": pc.cast(pc.list_value_length(b), pa.int64()), "n_groups": n_groups, "n_links": n_links, "groups": text,
    } | _distinct(doc, pairs, counts, docs)


def _per_document(doc: pa.Array, values: pa.Array, how: str, n: int) -> pa.Array:
    """The count or sum of values for each of n documents, 0 where there are none."""
    found = pa.table({"doc": doc, "v": values}).group_by("doc", use_threads=False).aggregate([("v", how)])
    every = pa.table({"doc": pa.concat_arrays([_one_chunk(found["doc"]), _count(n)]), "v": pa.concat_arrays([_one_chunk(found[f"v_{how}"]), pa.array(np.zeros(n, np.int64))])})
    return _one_chunk(every.group_by("doc", use_threads=False).aggregate([("v", "sum")]).sort_by("doc")["v_sum"])


_ADDED = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "pairs": pa.list_(pa.int64()), "links": pa.list_(pa.int64())}


def _pieces_of(texts: list[str]) -> list[list[str]]:
    """A space and the text, cut before each space that follows something else than white space: both tokenizers always end a token there."""
    return [_CUT.split(" " + t) if t else [] for t in texts]


def _sums(values: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """The sum of the values between each two cuts."""
    upto = np.concatenate([[0], np.cumsum(values.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return upto[cuts[1:]] - upto[cuts[:-1]]


def aligned_texts(texts: list[str], first: _Bytes, second: _Pieces) -> dict[str, pa.Array]:
    """The columns of aligned_ids() for whole texts: their different pieces are encoded and aligned once, and each text adds up its pieces."""
    pieces = _pieces_of(texts)
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    coded = pa.array([p for own in pieces for p in own], pa.string()).dictionary_encode()
    known = coded.dictionary.to_pylist()
    want = coded.dictionary.cast(pa.binary())
    ids = [pa.array(x.encode(known), pa.list_(pa.int32())) for x in (first, second)]
    sizes = [pc.cast(pc.binary_length(x.pieces), pa.int64()) for x in (first, second)]
    good = pc.and_(*(_whole(i, x.pieces, want) for i, x in zip(ids, (first, second), strict=True)))
    found = aligned_ids(*(pc.if_else(good, i, pa.scalar([], pa.list_(pa.int32()))) for i in ids), *sizes)

    spoilt = _sums(pc.take(pc.cast(pc.invert(good), pa.int64()), coded.indices), cuts) > 0
    kept = np.repeat(~spoilt, np.diff(cuts))
    used = coded.indices.filter(pa.array(kept))
    cuts = np.concatenate([[0], np.cumsum(np.where(spoilt, 0, np.diff(cuts)))])
    out = {k: pa.array(_sums(pc.take(found[k], used), cuts)) for k in ("n_a", "n_b", "n_groups", "n_links")}
    out["groups"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pc.take(found["groups"], used)), ";")
    pairs, links = pc.take(found["pairs"], used), pc.take(found["links"], used)
    text = np.repeat(np.arange(len(texts)), np.diff(cuts))[pc.list_parent_indices(pairs).to_numpy()]
    return out | _distinct(text, pc.list_flatten(pairs).to_numpy(), pc.list_flatten(links).to_numpy(), len(texts))


def _distinct(doc: np.ndarray, pair: np.ndarray, links: np.ndarray, n: int) -> dict[str, pa.Array]:
    """Lists of each document's different pairs, and the sum of the links of each."""
    keys = (doc << _PAIR_BITS) | pair
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    sums = np.add.reduceat(links[order], first) if len(first) else np.empty(0, np.int64)
    sizes = pa.array(np.bincount(keys[first] >> _PAIR_BITS, minlength=n).astype(np.int64))
    return {"pairs": _lists(pa.array(keys[first] & ((1 << _PAIR_BITS) - 1)), sizes), "links": _lists(pa.array(sums), sizes)}


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = load(path_a), load(path_b)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                begin, size, texts = at, 0, []
                while at < batch.num_rows and (not texts or size < SLICE):
                    texts.append(column[at].as_py() or "")
                    size, at = size + len(texts[-1]), at + 1
                found = aligned_texts(texts, first, second)
                part = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(found[k].cast(t) for k, t in _ADDED.items())], [*batch.schema.names[:-1], *_ADDED])

    return run


def align(docs: DataFrame, columns: list[str], text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The columns named, n_a, n_b, n_groups, n_links, groups (text: "a1,a2|b1;a3|b2"), and lists of the same length: pairs
    (distinct, a << BITS | b) and links (how many of each)."""
    small_batches(docs.sparkSession)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    rows = docs.select(*columns, F.col(text).alias("__text"))
    kinds = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, links array<bigint>"
    return rows.mapInArrow(_align(path_a or vocabulary_path(A), path_b or vocabulary_path(B)), fields + kinds)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of many documents; each document has a pair once."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    kept: list[pa.Table] = []
    rows = 0
    for b in batches:
        flat = pc.list_flatten(b.column(0))
        kept.append(pa.table({"pair": flat, "n": pa.repeat(pa.scalar(1, pa.int64()), len(flat))}, schema))
        rows += len(flat)
        if rows > 4 * PARTIAL:
            kept = [_added(kept)]
            rows = len(kept[0])
            if rows > PARTIAL:
                yield from kept[0].to_batches()
                kept, rows = [], 0
    if kept:
        yield from _added(kept).to_batches()


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of its first id has more)."""
    partial = aligned.select("pairs").mapInArrow(_partial, "pair bigint, n bigint")
    counts = settle(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", BITS)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(most), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(aligned: DataFrame, counts: DataFrame, row: str, heavy: int = HEAVY) -> DataFrame:
    """row, n_best and count_sum: over the links of each row that has any, how many are best, and the sum of their counts."""
    entries = aligned.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
    counts = settle(counts, "pair-best")
    often = counts.filter(F.col("n") >= entries // heavy + 1)  # at most `heavy` pairs
    rarely = counts.filter(F.col("n") < entries // heavy + 1)
    each = aligned.select(row, F.explode(F.arrays_zip("pairs", "links")).alias("z")).select(row, F.col("z.pairs").alias("pair"), F.col("z.links").alias("links"))
    both = each.join(F.broadcast(often), "pair", "left")
    known = both.filter("n is not null").select(row, "links", "n", "best")
    rest = both.filter("n is null").select("pair", row, "links").join(rarely.hint("shuffle_merge"), "pair").select(row, "links", "n", "best")
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    parts = [x.groupBy(row).agg(*sums) for x in (known, rest)]
    return parts[0].unionByName(parts[1]).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of every document under two tokenizers align, and how often its linked ids go together corpus-wide."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = align(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "links")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    sums = linked(rows, pair_counts(rows), "row")
    out = rows.drop("pairs", "links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
