"""Tokens of PDF text of any length: a stream is cut into pieces anywhere, and the pieces are read in parallel.

What a piece's bytes mean depends on where the text before it ends: between tokens, in a comment, a number or name, a hex string, or a
literal string of some depth. So each piece is first read from every such state at once; the result is a
table from the state where it begins to that where it ends. Literal strings need no row for each depth: a piece that closes m
levels has m exits, and deeper strings run through it, their depth changed by one number. Tables of neighbouring pieces
compose to a table of the same kind. Pieces are composed within parts, parts within streams, and then back: each
part, and each piece, gets the state where it begins. With it each piece gives its tokens; those that
span pieces are put together by their first byte. No task holds a stream: one has a piece, the tables of a part (PART pieces), or
those of a stream's parts.

The tokens are those of the sequential reader: brackets, << and >>, names, hex strings, literal strings with balanced
parentheses (to the end of the text if they aren't closed), and runs of other characters; comments are left out. A < whose hex string
isn't one stands alone, and what follows is read as if it stood by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: bytes of a piece, pieces of a part
PIECE, PART = 1 << 16, 1024
#: between tokens; in a comment; a run or name; after < and >; a hex string after white space and after a digit; a literal string, and after its backslash
BETWEEN, COMMENT, RUN, LESS, MORE, HEX_SPACE, HEX_DIGIT, STRING, ESCAPE = range(9)
_CARRIED = -1  # a token that began in an earlier piece

_SPACE, _LINE_END, _RUN_END, _NO_HEX, _INNER = (re.compile(p) for p in (rb"\S", rb"[\r\n]", rb"[\s/<>\[\](){}%]", rb"[^0-9A-Fa-f\s]", rb"[\\()]"))
_WORD = re.compile(rb"\S+")


def _run(data: bytes, at: int) -> tuple[int, int, int]:
    m = _RUN_END.search(data, at)
    return (m.start(), BETWEEN, 0) if m else (len(data), RUN, 0)


def _hex(data: bytes, at: int, state: int) -> tuple[int, int, int]:
    m = _NO_HEX.search(data, at)
    end = m.start() if m else len(data)
    if end > at:
        state = HEX_SPACE if data[end - 1 : end].isspace() else HEX_DIGIT
    if not m:
        return end, state, 0
    if m[0] == b">":
        return end + 1, BETWEEN, 0
    return _run(data, end) if state == HEX_DIGIT else (end, BETWEEN, 0)


def _string(data: bytes, at: int, depth: int) -> tuple[int, int, int]:
    while m := _INNER.search(data, at):
        at = m.end()
        if m[0] == b"\\":
            if at == len(data):
                return at, ESCAPE, depth
            at += 1
        else:
            depth += 1 if m[0] == b"(" else -1
            if not depth:
                return at, BETWEEN, 0
    return len(data), STRING, depth


def _resumed(data: bytes, state: int, depth: int) -> tuple[int, int, int]:
    """Where the token that is open at the beginning ends, and the state there."""
    if state == COMMENT:
        m = _LINE_END.search(data)
        return (m.start(), BETWEEN, 0) if m else (len(data), COMMENT, 0)
    if state == RUN:
        return _run(data, 0)
    if state == LESS:
        return (1, BETWEEN, 0) if data[:1] == b"<" else _hex(data, 0, HEX_SPACE)
    if state == MORE:
        return int(data[:1] == b">"), BETWEEN, 0
    if state in (HEX_SPACE, HEX_DIGIT):
        return _hex(data, 0, state)
    if state in (STRING, ESCAPE):
        return _string(data, int(state == ESCAPE), depth)
    return 0, BETWEEN, 0


def _token(data: bytes, at: int) -> tuple[int, int, int]:
    """Where the token that begins at a place ends, and the state there."""
    c = data[at : at + 1]
    if c == b"(":
        return _string(data, at + 1, 1)
    if c == b"%":
        m = _LINE_END.search(data, at)
        return (m.start(), BETWEEN, 0) if m else (len(data), COMMENT, 0)
    if c in b"<>":
        if at + 1 == len(data):
            return at + 1, LESS if c == b"<" else MORE, 0
        if data[at + 1 : at + 2] == c:
            return at + 2, BETWEEN, 0
        return _hex(data, at + 1, HEX_SPACE) if c == b"<" else (at + 1, BETWEEN, 0)
    return (at + 1, BETWEEN, 0) if c in b"[]{})" else _run(data, at + 1)


def spans(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Begin, end, state and depth of the tokens and comments from a place between tokens on; only the last may be open."""
    while m := _SPACE.search(data, at):
        begin = m.start()
        at, state, depth = _token(data, begin)
        yield begin, at, state, depth


def parts_of(text: bytes, at: int) -> list[tuple[int, bytes]]:
    """A token's place and bytes; a < that begins no hex string, and the words after it, are tokens of their own."""
    if text[:1] != b"<" or text == b"<<" or (text[-1:] == b">" and not _NO_HEX.search(text, 1, len(text) - 1)):
        return [(at, text)]
    return [(at, b"<"), *((at + 1 + m.start(), m[0]) for m in _WORD.finditer(text[1:]))]


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the tokens of a whole text, one after the other."""
    for begin, end, _, _ in spans(data, at):
        if data[begin] != 0x25:
            yield from parts_of(data[begin:end], begin)


# --- tables: 3 numbers (state, depth, begin of the open token or _CARRIED) for each state but strings; then, for
# --- STRING and for ESCAPE, how the depth of deeper strings changes, the state they end in, and 3 numbers for each exit


def _ended(data: bytes, at: int, known: dict[int, tuple[int, int, int]]) -> tuple[int, int, int]:
    """How the piece ends if it is between tokens at a place; known: the same for places of tokens already seen."""
    seen, end = [], (BETWEEN, 0, _CARRIED)
    for begin, _, state, depth in spans(data, at):
        if begin in known:
            end = known[begin]
            break
        seen.append(begin)
        end = (state, depth, begin) if state != BETWEEN else (BETWEEN, 0, _CARRIED)
    known.update(dict.fromkeys(seen, end))
    return end


def _exits(data: bytes, at: int) -> tuple[int, int, list[int]]:
    """Read within a string of any depth: change of depth, state at the end, and where each further level is closed."""
    depth, out = 0, []
    while m := _INNER.search(data, at):
        at = m.end()
        if m[0] == b"\\":
            if at == len(data):
                return depth, ESCAPE, out
            at += 1
        else:
            depth += 1 if m[0] == b"(" else -1
            if depth < -len(out):
                out.append(at)
    return depth, STRING, out


def table_of(data: bytes) -> list[list[int]]:
    """A piece's table: finite states, STRING, ESCAPE."""
    known: dict[int, tuple[int, int, int]] = {}
    finite: list[int] = []
    for state in range(STRING):
        at, then, depth = _resumed(data, state, 0)
        finite += _ended(data, at, known) if then == BETWEEN else (then, depth, _CARRIED)
    out = [finite]
    for at in (0, 1):
        change, then, exits = _exits(data, at)
        out.append([change, then, *(x for e in exits for x in _ended(data, e, known))])
    return out


def step(table: list[list[int]], offset: int, at: tuple[int, int, int]) -> tuple[int, int, int]:
    """State, depth and begin of the open token after a piece or part at an offset."""
    state, depth, begin = at
    if state < STRING:
        to = table[0][3 * state : 3 * state + 3]
    else:
        row = table[state - STRING + 1]
        if 3 * depth + 2 > len(row):
            return row[1], depth + row[0], begin
        to = row[3 * depth - 1 : 3 * depth + 2]
    return to[0], to[1], begin if to[2] == _CARRIED else offset + to[2]


def composed(tables: list[tuple[int, list[list[int]]]]) -> list[list[int]]:
    """The table of pieces (offset, table) that follow each other; offsets count from the first."""
    start = tables[0][0]

    def through(at: tuple[int, int, int]) -> tuple[int, int, int]:
        for offset, table in tables:
            at = step(table, offset - start, at)
        return at

    out = [[x for state in range(STRING) for x in through((state, 0, _CARRIED))]]
    for state in (STRING, ESCAPE):
        change, most, then = 0, 0, state
        for _, table in tables:  # a string so deep that no piece closes it
            row = table[then - STRING + 1]
            most = max(most, (len(row) - 2) // 3 - change)
            change, then = change + row[0], row[1]
        out.append([change, then, *(x for d in range(1, most + 1) for x in through((state, d, _CARRIED)))])
    return out


# --- on Spark

_TABLE = pa.list_(pa.list_(pa.int64()))


def _fields(df: DataFrame, key: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*key).schema)


def cut(streams: DataFrame, key: list[str], data: str = "data", size: int = PIECE) -> DataFrame:
    """key, offset and data of the pieces of streams that fit a row."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(size))
    return streams.filter(F.octet_length(data) > 0).select(*key, data, F.explode(starts).alias("offset")).select(*key, F.col("offset").cast("bigint").alias("offset"), F.substring(F.col(data), F.col("offset") + 1, F.lit(size)).alias("data"))


def _with_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tables = pa.array([table_of(d.as_py()) for d in b.column("data")], _TABLE)
        yield pa.RecordBatch.from_arrays([*b.columns, tables], [*b.schema.names, "table"])


def _folded(rows: pa.Table, begin: tuple[int, int, int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The rows' places in order of offset, and the state where each begins."""
    order, states = np.argsort(rows["offset"].to_numpy(), kind="stable").tolist(), []
    for i in order:
        states.append(begin)
        begin = step(rows["table"][i].as_py(), rows["offset"][i].as_py(), begin)
    return order, states


def _numbers(columns: list[list[int]], names: list[str]) -> dict[str, pa.Array]:
    return {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}


_STATE = ["state", "depth", "begin"]


def states(pieces: DataFrame, key: list[str], part: int = PART) -> DataFrame:
    """key, offset, data and the state, depth and begin of the open token where each piece (with its table) begins; last marks a stream's last piece."""
    longest = pieces.agg(F.coalesce(F.max(F.octet_length("data")), F.lit(1))).first()[0]
    fields = _fields(pieces, key)
    tables = pieces.select(*key, "offset", F.floor(F.col("offset") / (longest * part)).alias("part"), "table")

    def whole(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["offset"].to_numpy(), kind="stable").tolist()
        made = composed([(rows["offset"][i].as_py(), rows["table"][i].as_py()) for i in order])
        return rows.select([*key, "part", "offset"]).take([order[0]]).append_column("table", pa.array([made], _TABLE))

    def of_parts(rows: pa.Table) -> pa.Table:
        order, found = _folded(rows, (BETWEEN, 0, _CARRIED))
        out = rows.select([*key, "part"]).take(order)
        for n, c in _numbers([list(c) for c in zip(*found, strict=True)], _STATE).items():
            out = out.append_column(n, c)
        return out.append_column("last", pa.array([i == len(order) - 1 for i in range(len(order))]))

    def of_pieces(rows: pa.Table) -> pa.Table:
        order, found = _folded(rows, tuple(rows[n][0].as_py() for n in _STATE))
        out = rows.select([*key, "offset"]).take(order)
        for n, c in _numbers([list(c) for c in zip(*found, strict=True)], _STATE).items():
            out = out.append_column(n, c)
        ends = rows["last"][0].as_py()
        return out.append_column("last", pa.array([ends and i == len(order) - 1 for i in range(len(order))]))

    state = "state bigint, depth bigint, begin bigint, last boolean"
    of_part = tables.groupBy(*key, "part").applyInArrow(whole, fields + "part bigint, offset bigint, table array<array<bigint>>")
    begins = of_part.groupBy(*key).applyInArrow(of_parts, fields + "part bigint, " + state)
    each = tables.join(begins, [*key, "part"]).groupBy(*key, "part").applyInArrow(of_pieces, fields + "offset bigint, " + state)
    return pieces.select(*key, "offset", "data").join(each, [*key, "offset"])


def _emit(key: list[str]):
    """Fragments of tokens: at (first byte of the token), offset (of the fragment), token, and whole (nothing of it is elsewhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, offset, token, whole = [], [], [], [], []
            for i, (start, data, state, depth, begin, last) in enumerate(zip(*(b.column(n).to_pylist() for n in ("offset", "data", *_STATE, "last")), strict=True)):
                end, then, _ = _resumed(data, state, depth)
                if end and state not in (BETWEEN, COMMENT):
                    row.append(i), at.append(begin), offset.append(start), token.append(data[:end]), whole.append(False)
                if then != BETWEEN:
                    continue
                for a, z, now, _ in spans(data, end):
                    if data[a] == 0x25:
                        continue
                    closed = now == BETWEEN or last
                    for place, text in parts_of(data[a:z], start + a) if closed else [(start + a, data[a:z])]:
                        row.append(i), at.append(place), offset.append(place), token.append(text), whole.append(closed)
            kept = [b.column(k).take(pa.array(row, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int64()), pa.array(offset, pa.int64()), pa.array(token, pa.binary()), pa.array(whole, pa.bool_())], [*key, "at", "offset", "token", "whole"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(i, *x) for i, (at, text) in enumerate(zip(b.column("at").to_pylist(), b.column("token").to_pylist(), strict=True)) for x in parts_of(text, at)]
        row, at, text = zip(*found, strict=True) if found else ((), (), ())
        kept = [c.take(pa.array(row, pa.int64())) for c in b.columns[:-2]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int64()), pa.array(text, pa.binary())], b.schema.names)


def stream_tokens(pieces: DataFrame, key: list[str], part: int = PART) -> DataFrame:
    """key, at (the byte where it begins) and token (its bytes) of streams given as pieces (key, offset, data) that follow each other without gaps."""
    fields = _fields(pieces, key)
    read = settle(pieces.select(*key, F.col("offset").cast("bigint").alias("offset"), "data").filter(F.octet_length("data") > 0).mapInArrow(_with_tables, fields + "offset bigint, data binary, table array<array<bigint>>"), "pieces")
    found = settle(states(read, key, part).mapInArrow(_emit(key), fields + "at bigint, offset bigint, token binary, whole boolean"), "fragments")
    spread = found.filter("not whole").groupBy(*key, "at").agg(F.array_sort(F.collect_list(F.struct("offset", F.decode("token", "ISO-8859-1").alias("t")))).alias("f"))
    text: Column = F.encode(F.array_join(F.transform("f", lambda x: x["t"]), ""), "ISO-8859-1")
    joined = spread.select(*key, "at", text.alias("token")).mapInArrow(_split, fields + "at bigint, token binary")
    return found.filter("whole").select(*key, "at", "token").unionByName(joined)
