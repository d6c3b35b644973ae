"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The tokenizer file gives the vocabulary and merges of a lower-casing, word-ended byte
BPE; its normaliser (NFC, lower case), its split into words and its special tokens are
followed. An Aho-Corasick automaton over the reversed tokens finds, in one pass over a
word, all tokens that start at each place, longest first. The encoder takes the longest
that is compatible with the token before it, and steps back where none is; no place is
tried twice, so a word takes linear time. Two adjacent tokens are compatible if no merge
across their border would have come before the merges that built them; in a sequence of
compatible tokens no merge is left out, so the ids are those of merging by rank.

Decoding cuts each token's bytes out of one blob by an offset table and joins them with
spaces, as a tokenizer without a decoder does.

Defined results: a null text counts as empty and has no ids; rows with null or repeated
ids each get a row; an empty table gives an empty result; texts are encoded whole,
whatever their length; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table

VOCABULARY = "word_bpe_49k.json"
#: words and token pairs that a worker remembers
REMEMBER = 150_000
#: rows encoded before they are handed on
ROWS = 500
END = "</w>"
_NEVER = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Bpe:
    """A tokenizer read from its file; made once in each worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word_pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.letter_of = dict(enumerate(_byte_letters()))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            self.parts[made] = (*pair, r)
        self.length: dict[int, int] = {}
        self.good: dict[int, bool] = {}
        matcher = ahocorasick.Automaton()
        for token, i in vocab.items():
            key = token[: -len(END)] + " " if token.endswith(END) and token != END else token
            self.length[i] = len(key)
            if self._whole(i):
                matcher.add_word(key[::-1], i)
        matcher.make_automaton()
        self.matcher = matcher
        texts = {i: t for t, i in (vocab | special).items()}
        pieces = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, np.ndarray] = {}

    def _whole(self, token: int) -> bool:
        """Whether merging by rank turns the token's own letters into the token."""
        known = self.good.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                a, b, r = self.parts[token]
                known = self._whole(a) and self._whole(b) and not self._crossed(a, b, r)
            self.good[token] = known
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while the token is built, and the rank of the merge that ends each."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.parts[token][2]
            token = self.parts[token][side]

    def _crossed(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether a merge across the border of a and b comes while both its sides stand there.

        Of equal ranks the leftmost goes first: the one inside a before, the one inside b after.
        """
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until and r < before:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = not self._crossed(a, b)
            if len(self.pairs) < REMEMBER:
                self.pairs[a, b] = known
        return known

    def _encode_word(self, word: str) -> np.ndarray:
        # printable ASCII letters stand for their own bytes
        text = (word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letter_of)) + " "
        n = len(text)
        options: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.matcher.iter(text[::-1]):  # of those that end at one place, the longest comes first
            options[n - 1 - end].append(token)
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        taken: list[int] = []
        at = k = 0
        while at < n:
            for j in range(k, len(options[at])):
                token = options[at][j]
                if alive[at + self.length[token]] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    taken.append(j)
                    at += self.length[token]
                    k = 0
                    break
            else:
                alive[at] = 0
                at -= self.length[out.pop()]
                k = taken.pop() + 1
        return np.array(out, np.int32)

    def _word(self, word: str) -> np.ndarray:
        ids = self.words.get(word)
        if ids is None:
            ids = self._encode_word(word)
            if len(self.words) < REMEMBER:
                self.words[word] = ids
        return ids

    def normalised(self, text: str) -> str:
        """NFC, then lower case letter by letter: a final capital sigma is no exception here."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> np.ndarray:
        parts: list[np.ndarray] = []
        for piece in self.special_pattern.split(text) if self.special_pattern else [text]:
            if piece in self.special:
                parts.append(np.array([self.special[piece]], np.int32))
            elif piece:
                parts.extend(map(self._word, self.word_pattern.findall(self.normalised(piece))))
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with a space between them."""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        if not len(ids):
            return b""
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.blob[np.arange(len(shift)) + shift][:-1].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encode(path: str, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = [bpe.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                made = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))}
                if decoded:
                    made["decoded"] = pa.array([bpe.decode(i) for i in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made.values()], [*b.schema.names[:-1], *made])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                column = b.column(b.num_columns - 1)
                flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in column], np.int64))])
                texts = [bpe.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, "decoded"])

    return run


def _fields(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*columns).schema)


def encode(docs: DataFrame, columns: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """The columns named, and ids: the text's token ids."""
    small_batches(docs.sparkSession)
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(_encode(path or vocabulary_path()), _fields(docs, columns) + "ids array<int>")


def decode(encoded: DataFrame, columns: list[str], path: str | None = None, ids: str = "ids") -> DataFrame:
    """The columns named, ids, and decoded: the text of the ids, special tokens included."""
    return encoded.select(*columns, F.col(ids).alias("ids")).mapInArrow(_decode(path or vocabulary_path()), _fields(encoded, columns) + "ids array<int>, decoded string")


def encode_decode(docs: DataFrame, columns: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """What decode() gives of encode(), in one pass: a core needs one worker with the vocabulary, not two."""
    small_batches(docs.sparkSession)
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(_encode(path or vocabulary_path(), True), _fields(docs, columns) + "ids array<int>, decoded string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    out = encode_decode(table(spark, sf_dir, "documents"), ["doc_id"])
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
