"""PDF objects read by byte ranges: a data source for files of any size.

`read_pdf(spark, folder)` gives the columns of reader.objects(), so pages, streams, text and values are read from either.
Planning lists the files. Of large files it reads the last kilobyte and the heads of their cross-reference sections: where their ranges of numbers
begin, not their entries; small files go to tasks by name, many to a task, which reads these heads itself. A partition of a large file has ranges of about ENTRIES entries; its task reads these entries, leaves out numbers that a
newer section has (their ranges are known), and reads the objects in order of offset, a few kilobytes around each, a stream's
bytes only if they are wanted. So a file is never held whole, and one large file is read by many tasks.

Filters on number are applied to entries, before any object is read, and filters on type before a stream's
bytes are; with data=False streams' bytes aren't read at all. `fetched` tells the bytes read for each row.

Objects in object streams are read with their stream (container, place), which a task unpacks once. A file whose sections can't be followed
has one partition, which looks through it for objects, a window at a time, and takes the last of each number
(repaired is true). What isn't an object of its entry's number is left out; nothing is raised.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import codecs
from . import lexer

#: entries of a partition; bytes read at an object; bytes read at once from a file searched for objects
ENTRIES, HEAD, WINDOW = 20_000, 2048, 1 << 23
#: files whose sections are read at the same time when a read is planned
AT_ONCE = 32
#: bytes of a file for each entry it may have; with no more than ENTRIES by this, tasks plan it
EACH = 64
#: bytes for which a file counts at least where small files share a task, and bytes of such a task for each entry
LEAST, SHARE = 4096, 400
SCHEMA = "path string, number bigint, generation int, offset bigint, type string, body string, data binary, repaired boolean, container bigint, place bigint, fetched bigint"
_OBJECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
_MARK = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")


class Source:
    """Bytes of a file by place, through a buffer that goes forward; `fetched` counts what was read."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(name)
        self.size, self.fetched, self.at, self.held = self.file.size(), 0, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.held):
            kept = self.held[at - self.at :] if self.at <= at < self.at + len(self.held) else b""
            more = self.file.read_at(max(n - len(kept), min(HEAD, self.size - at - len(kept))), at + len(kept))
            self.fetched += len(more)
            self.at, self.held = at, kept + more
        return self.held[at - self.at : at - self.at + n]

    def close(self) -> None:
        self.file.close()


def entry(items: list[bytes], key: bytes) -> list[bytes]:
    """The tokens of a dictionary's value for a key of its own, not of a dictionary within; empty if it has none."""
    depth, i = 0, 0
    while i < len(items):
        if items[i] in (b"<<", b"["):
            depth += 1
        elif items[i] in (b">>", b"]"):
            depth -= 1
        elif depth == 1 and items[i] == b"/" + key:
            out, inner = [], 0
            for t in items[i + 1 :]:
                if not inner and out and (t == b">>" or t[:1] == b"/"):
                    break
                inner += (t in (b"<<", b"[")) - (t in (b">>", b"]"))
                if inner < 0:
                    break
                out.append(t)
            return out
        i += 1
    return []


def number(items: list[bytes], key: bytes) -> int | None:
    """A dictionary's direct whole number."""
    v = entry(items, key)
    return int(v[0]) if len(v) == 1 and v[0].isdigit() else None


def numbers(items: list[bytes], key: bytes) -> list[int]:
    return [int(t) for t in entry(items, key) if t.isdigit()]


@dataclass
class Parsed:
    number: int
    generation: int
    items: list[bytes]
    body: bytes
    data_at: int | None


def parsed(source: Source, at: int) -> Parsed | None:
    """The object that begins at a place: its tokens, its text, and where its stream's bytes begin."""
    size = HEAD
    while True:
        text = source.get(at, size)
        m = _OBJECT.match(text)
        if not m:
            return None
        items: list[bytes] = []
        for begin, token in lexer.tokens(text, m.end()):
            end = begin + len(token)
            if token in (b"endobj", b"stream", b"xref", b"startxref") and (end < len(text) or at + len(text) >= source.size):
                body = text[m.end() : begin].strip()
                if token != b"stream":
                    return Parsed(int(m[1]), int(m[2]), items, body, None)
                if end + 2 <= len(text) or at + len(text) >= source.size:
                    end += 2 if text[end : end + 2] == b"\r\n" else int(text[end : end + 1] in (b"\n", b"\r"))
                    return Parsed(int(m[1]), int(m[2]), items, body, at + end)
                break
            items.append(token)
        else:
            if at + len(text) >= source.size:
                return Parsed(int(m[1]), int(m[2]), items, text[m.end() :].strip(), None)
        size *= 4


def stream_bytes(source: Source, o: Parsed, where) -> bytes:
    """A stream's raw bytes: by its Length, direct or one reference away, or up to "endstream"."""
    length = number(o.items, b"Length")
    if length is None and len(v := entry(o.items, b"Length")) == 3:
        at = where(int(v[0]))
        other = parsed(source, at) if at is not None else None
        length = int(other.body) if other and other.number == int(v[0]) and other.body.isdigit() else None
    if length is not None:
        return source.get(o.data_at, length)
    size = HEAD
    while (end := (data := source.get(o.data_at, size)).find(b"endstream")) < 0 and o.data_at + size < source.size:
        size *= 4
    data = data[:end] if end >= 0 else data
    return data[:-2] if data.endswith(b"\r\n") else data[:-1] if data[-1:] in (b"\n", b"\r") else data


def decoded(data: bytes, items: list[bytes]) -> bytes:
    """A stream's bytes with its filters undone; of cross-reference and object streams."""
    parms = items if b"/DecodeParms" not in items else entry(items, b"DecodeParms")
    parms = parms[1:-1] if parms[:1] == [b"["] else parms
    n = lambda key, empty: number(parms, key) or empty
    for f in [t for t in entry(items, b"Filter") if t[:1] == b"/"]:
        data = {b"/FlateDecode": codecs.inflated, b"/LZWDecode": codecs.from_lzw, b"/ASCII85Decode": codecs.from_ascii85}.get(f, lambda d: d)(data)
    return codecs.unpredicted(data, n(b"Predictor", 1), n(b"Colors", 1), n(b"BitsPerComponent", 8), n(b"Columns", 1))


@dataclass
class Section:
    """A cross-reference section: ranges (first number, count, where its entries are: a place in the file, or a row of its stream)."""

    at: int
    ranges: list[tuple[int, int, int]]
    widths: list[int] = field(default_factory=list)


@dataclass
class Piece(InputPartition):
    """Ranges of entries of one file; newer: the ranges of numbers of the sections before theirs, from and to."""

    path: str
    sections: list[Section]
    newer: list[tuple[int, int]]
    every: list[Section]


@dataclass
class Group(InputPartition):
    pieces: list[Piece]

    def __post_init__(self) -> None:
        self.value = None


class Names(InputPartition):
    """Small files, in order, by names (packed, as they are much alike) below a prefix."""

    def __init__(self, prefix: str, names: list[str]) -> None:
        super().__init__(None)
        self.prefix, self.packed = prefix, zlib.compress("\0".join(names).encode())

    def paths(self) -> list[str]:
        return [self.prefix + n for n in zlib.decompress(self.packed).decode().split("\0")]


def listed(path: str, suffix: str) -> Iterator[tuple[str, str, int]]:
    """Prefix, name and size of a file, or of all files of that suffix below a folder; one folder is listed at a time."""
    from pyarrow import fs

    scheme = path.split("/")[0] if ":" in path.split("/")[0] else ""
    store, root = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)
    prefix = path[: path.index(root)] if scheme and root in path else ""
    info = store.get_file_info(root)
    if info.is_file:
        yield prefix, info.path, info.size
        return
    todo = [root]
    while todo:
        folder = todo.pop()
        found = sorted(((f.path, f.size if f.is_file else None) for f in store.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(".")), reverse=True)
        todo += [f for f, size in found if size is None]
        for f, size in reversed(found):
            if size is not None and f.endswith(suffix):
                yield prefix, f, size


def shared(files: Iterator[tuple[str, str, int]], most: int) -> Iterator[Names]:
    """Files as partitions of so many bytes, a file counting for LEAST at least."""
    held, count, at = [], 0, ""
    for prefix, name, size in files:
        if held and count + max(size, LEAST) > most:
            yield Names(at, held)
            held, count = [], 0
        at = prefix
        held.append(name)
        count += max(size, LEAST)
    if held:
        yield Names(at, held)


def _table(source: Source, at: int) -> tuple[Section, list[bytes]] | None:
    """A cross-reference table's ranges, and its trailer's tokens; entries are passed over."""
    m = re.match(rb"\s*xref\s+", source.get(at, 64))
    if not m:
        return None
    at, ranges, begin = at + m.end(), [], at
    while m := re.match(rb"\s*(\d+)\s+(\d+)[ ]*(\r\n|\n|\r)", source.get(at, 64)):
        ranges.append((int(m[1]), int(m[2]), at + m.end()))
        at += m.end() + 20 * int(m[2])
    size = HEAD
    while True:
        text = source.get(at, size)
        items = [t for _, t in lexer.tokens(text)]
        if b"startxref" in items[:-1] or at + size >= source.size:
            return (Section(begin, ranges), items[1:]) if items[:1] == [b"trailer"] else None
        size *= 4


def _stream(source: Source, at: int) -> tuple[Section, list[bytes]] | None:
    """A cross-reference stream's ranges, by its dictionary alone."""
    o = parsed(source, at)
    if not o or o.data_at is None or entry(o.items, b"Type") != [b"/XRef"]:
        return None
    widths, ends = numbers(o.items, b"W"), numbers(o.items, b"Index") or [0, number(o.items, b"Size") or 0]
    if len(widths) != 3:
        return None
    ranges, row = [], 0
    for first, n in zip(ends[::2], ends[1::2], strict=False):
        ranges.append((first, n, row))
        row += n
    return Section(at, ranges, widths), o.items


def sections(source: Source) -> list[Section]:
    """A file's sections, newest first; none if the chain is broken."""
    tail = source.get(max(0, source.size - 1024), 1024)
    marks = re.findall(rb"startxref\s+(\d+)", tail)
    out: list[Section] = []
    todo, seen = [int(marks[-1])] if marks else [], set()
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        found = (_table(source, at) or _stream(source, at)) if at < source.size else None
        if not found:
            return []
        out.append(found[0])
        todo += [n for k in (b"XRefStm", b"Prev") if (n := number(found[1], k)) is not None]
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def planned(path: str, entries: int) -> list[Piece]:
    """A file's pieces of so many entries; one without ranges for a file without sections."""
    source = Source(path)
    try:
        found = sections(source)
        if not found or not _sound(source, found):
            return [Piece(path, [], [], [])]
    finally:
        source.close()
    out, newer = [], []
    for s in found:
        for first, n, at in s.ranges:
            for k in range(0, n, entries):
                place = at + k if s.widths else at + 20 * k
                out.append(Piece(path, [Section(s.at, [(first + k, min(entries, n - k), place)], s.widths)], newer, found))
        newer = _merged([*newer, *((first, first + n) for first, n, _ in s.ranges)])
    return out


def _sound(source: Source, found: list[Section]) -> bool:
    """Whether the first objects of the newest sections are where they are said to be."""
    files = _Entries(source, found)
    for s in found[:2]:
        for first, n, place in s.ranges[:1]:
            for num, kind, at, gen in files.rows(Section(s.at, [(first, min(n, 8), place)], s.widths)):
                if kind == 1:
                    m = _OBJECT.match(source.get(at, 64)) if at < source.size else None
                    if not m or (int(m[1]), int(m[2])) != (num, gen):
                        return False
    return True


class _Entries:
    """Entries of a file's sections, read when they are asked for."""

    def __init__(self, source: Source, every: list[Section]) -> None:
        self.source, self.every = source, every
        self.streams: dict[int, bytes] = {}

    def _stream(self, s: Section) -> bytes:
        if s.at not in self.streams:
            o = parsed(self.source, s.at)
            self.streams[s.at] = decoded(stream_bytes(self.source, o, lambda _: None), o.items)
        return self.streams[s.at]

    def rows(self, s: Section) -> Iterator[tuple[int, int, int, int]]:
        """number, kind (1 at an offset, 2 in an object stream), offset or stream's number, generation or place."""
        for first, n, at in s.ranges:
            if s.widths:
                w, data = s.widths, self._stream(s)
                size = sum(w)
                for i in range(n):
                    row = data[(at + i) * size : (at + i + 1) * size]
                    if len(row) == size:
                        kind = int.from_bytes(row[: w[0]], "big") if w[0] else 1
                        if kind in (1, 2):
                            yield first + i, kind, int.from_bytes(row[w[0] : w[0] + w[1]], "big"), int.from_bytes(row[w[0] + w[1] :], "big")
            else:
                table = self.source.get(at, 20 * n)
                for i in range(n):
                    row = table[20 * i : 20 * i + 20]
                    if row[17:18] == b"n" and row[:10].isdigit() and row[11:16].isdigit():
                        yield first + i, 1, int(row[:10]), int(row[11:16])

    def where(self, num: int) -> int | None:
        """The offset of an object: its newest entry is found by the ranges, and read alone."""
        for s in self.every:
            for first, n, at in s.ranges:
                if first <= num < first + n:
                    place = at + (num - first) * (1 if s.widths else 20)
                    return next((offset for _, kind, offset, _ in self.rows(Section(s.at, [(num, 1, place)], s.widths)) if kind == 1), None)
        return None


def _pieces(partition: Group | Names | None, entries: int) -> Iterator[Piece]:
    """The pieces of a partition; without files there is one task, and no partition."""
    if isinstance(partition, Names):
        for path in partition.paths():
            yield from planned(path, entries)
    elif partition:
        yield from partition.pieces


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.data = options.get("data", "true").lower() != "false"
        self.numbers: list[Filter] = []
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of number, and type = or in."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column == "number" and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.numbers.append(f)
            elif column == "type" and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.types = wanted if self.types is None else self.types & wanted
            else:
                yield f

    def _wanted(self, n: int) -> bool:
        for f in self.numbers:
            good = n in f.value if isinstance(f, In) else {EqualTo: n == f.value, GreaterThan: n > f.value, GreaterThanOrEqual: n >= f.value, LessThan: n < f.value, LessThanOrEqual: n <= f.value}[type(f)]
            if not good:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        entries = int(self.options.get("entries", ENTRIES))
        large: list[str] = []

        def small() -> Iterator[tuple[str, str, int]]:
            for prefix, name, size in listed(self.options["path"], self.options.get("suffix", ".pdf")):
                if size > EACH * entries:
                    large.append(prefix + name)
                else:
                    yield prefix, name, size

        groups: list[InputPartition] = list(shared(small(), SHARE * entries))
        with ThreadPoolExecutor(AT_ONCE) as pool:
            pieces = [p for found in pool.map(lambda f: planned(f, entries), large) for p in found]
        count, full = 0, True
        for p in pieces:
            n = sum(n for s in p.sections for _, n, _ in s.ranges) or entries
            if full or count + n > entries:
                groups.append(Group([]))
                count, full = 0, False
            groups[-1].pieces.append(p)
            count += n
        return groups

    def read(self, partition: Group | Names | None) -> Iterator[tuple]:
        entries = int(self.options.get("entries", ENTRIES))
        for piece in _pieces(partition, entries):
            source = Source(piece.path)
            try:
                yield from self._repaired(source, piece.path) if not piece.sections else self._read(source, piece)
            finally:
                source.close()

    def _read(self, source: Source, piece: Piece) -> Iterator[tuple]:
        files = _Entries(source, piece.every)
        found = [e for s in piece.sections for e in files.rows(s) if e[0] > 0 and self._wanted(e[0]) and not any(a <= e[0] < b for a, b in piece.newer)]
        yield from self._objects(source, piece.path, [(at, n, gen) for n, kind, at, gen in found if kind == 1], files.where, False)
        inner: dict[int, dict[int, int]] = {}
        for n, kind, container, place in found:
            if kind == 2:
                inner.setdefault(container, {})[place] = n
        for container, places in sorted(inner.items()):
            at = files.where(container)
            o = parsed(source, at) if at is not None else None
            if o and o.data_at is not None:
                for place, n, body in _unpacked(decoded(stream_bytes(source, o, files.where), o.items), o.items):
                    if places.get(place) == n:
                        yield from self._row(source, piece.path, n, 0, at, body, None, False, container, place)

    def _objects(self, source: Source, path: str, found: list[tuple[int, int, int]], where, repaired: bool) -> Iterator[tuple]:
        for at, n, gen in sorted(found):
            o = parsed(source, at) if at < source.size else None
            if not o or (o.number, o.generation) != (n, gen):
                continue
            kind = (entry(o.items, b"Type") or [b""])[0]
            if self.types is not None and kind[1:].decode("latin-1") not in self.types:
                continue
            data = stream_bytes(source, o, where) if self.data and o.data_at is not None else None
            yield from self._row(source, path, n, gen, at, o.body, data, repaired, None, None)

    def _row(self, source: Source, path: str, n: int, gen: int, at: int, body: bytes, data: bytes | None, repaired: bool, container: int | None, place: int | None) -> Iterator[tuple]:
        kind = (entry([t for _, t in lexer.tokens(body)], b"Type") or [b""])[0]
        kind = kind[1:].decode("latin-1") if kind[:1] == b"/" else None
        if self.types is None or kind in self.types:
            fetched, source.fetched = source.fetched, 0
            yield path, n, gen, at, kind, body.decode("latin-1"), data, repaired, container, place, fetched

    def _repaired(self, source: Source, path: str) -> Iterator[tuple]:
        """The last object of each number that the file shows."""
        last: dict[int, tuple[int, int]] = {}
        for at in range(0, source.size, WINDOW):
            for m in _MARK.finditer(source.get(max(0, at - 32), WINDOW + 64)):
                last[int(m[1])] = (max(0, at - 32) + m.start(), int(m[2]))
        where = lambda n: last.get(n, (None, 0))[0]
        for n, (at, _) in sorted(last.items()):
            o = parsed(source, at)
            if o and o.data_at is not None and entry(o.items, b"Type") == [b"/ObjStm"]:
                for place, k, body in _unpacked(decoded(stream_bytes(source, o, where), o.items), o.items):
                    if (k not in last or last[k][0] < at) and self._wanted(k):
                        last.pop(k, None)
                        yield from self._row(source, path, k, 0, at, body, None, True, n, place)
        yield from self._objects(source, path, [(at, n, gen) for n, (at, gen) in last.items() if self._wanted(n)], where, True)


def _unpacked(text: bytes, items: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """place, number and text of the objects of an object stream."""
    first = number(items, b"First") or 0
    head = [int(t) for t in text[:first].split() if t.isdigit()]
    starts = [first + x for x in head[1::2]]
    for place, (n, a, b) in enumerate(zip(head[::2], starts, [*starts[1:], len(text)], strict=False)):
        yield place, n, text[a:b].strip()


class PdfObjects(DataSource):
    """Format "pdf": options path (a folder or file of a store that pyarrow reaches), data, entries, suffix."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _WholeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return list(shared(listed(self.options["path"], self.options.get("suffix", ".pdf")), WINDOW))

    def read(self, partition: Names | None) -> Iterator[tuple]:
        for path in partition.paths() if partition else []:
            source = Source(path)
            try:
                yield path, source.file.read_at(source.size, 0)
            finally:
                source.close()


class WholeFiles(DataSource):
    """Format "whole": options path and suffix."""

    @classmethod
    def name(cls) -> str:
        return "whole"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _WholeReader(dict(self.options))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path and content of PDF files, as reader.read_files() gives them, for very many: the driver keeps packed names only, and a task reads WINDOW bytes of files."""
    spark.dataSource.register(WholeFiles)
    return spark.read.format("whole").option("path", path).load()


def read_pdf(spark: SparkSession, path: str, data: bool = True, **options) -> DataFrame:
    """The objects of the PDF files of a folder, or of one file, by byte ranges; filters on number and type reach the source."""
    spark.dataSource.register(PdfObjects)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("pdf").options(path=path, data=str(data).lower(), **{k: str(v) for k, v in options.items()}).load()
