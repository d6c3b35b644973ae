"""PDF files as tables: cross-reference entries, objects, streams, pages, file facts.

A file's bytes are read as Latin-1 text, where a character is a byte, so that regular
expressions and substrings find what the format's syntax marks. Cross-reference tables and
streams are chains of sections (Prev); the newest entry of a number counts. A file whose chain
can't be followed is repaired: all "N G obj" are found, and the last of a number counts.
Everything that relates objects, pages or files is a join, window or aggregation; only
nested values (values()) and stream filters are small functions on one row.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import codecs
from ..functions.text import parse_pdf_date
from . import lexer
from .scratch import bounded, settle


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path and content of the PDF files below a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "content")


def _text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("bigint")


def headers(files: DataFrame) -> DataFrame:
    """path, version (null where there is no header), startxref, and the file's text."""
    text = _text(F.col("content"))
    version = F.nullif(F.regexp_extract(F.substring(text, 1, 64), r"^%PDF-([12]\.\d)", 1), F.lit(""))
    tail = F.right(text, F.lit(1024))
    start = _number(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(tail, F.lit(r"startxref\s+(\d+)"), F.lit(0))), -1), r"(\d+)")
    return files.select("path", version.alias("version"), start.alias("startxref"), text.alias("text"))


def _cut(texts: DataFrame) -> DataFrame:
    """The section that begins at each row's offset (at): a table with its trailer, or a cross-reference stream's dictionary and data."""
    part = F.substr("text", (F.col("at") + 1).cast("int"))
    table = F.regexp_extract(part, r"(?s)^\s*(xref\s.*?trailer\s*<<.*?)startxref", 1)
    rows = texts.withColumn("part", part).withColumn("table", F.nullif(table, F.lit("")))
    head = F.when(F.col("table").isNull() & F.substring("part", 1, 40).rlike(r"^\s*\d+\s+\d+\s+obj\b"), F.regexp_extract("part", r"(?s)^(\s*\d+\s+\d+\s+obj\s*<<.*?>>\s*stream\r?\n)", 1))
    rows = rows.withColumn("head", F.when(head.rlike(r"/Type\s*/XRef\b"), head))
    data = F.encode(F.substr("part", F.length("head") + 1, entry(F.col("head"), "Length", "int").cast("int")), "ISO-8859-1")
    return rows.withColumn("section", F.coalesce("table", "head")).withColumn("data", data).filter("section is not null").drop("part", "table", "head", "text")


def xref_sections(files: DataFrame) -> DataFrame:
    """path, seq (0 is the newest), section, data: the sections of each file's Prev chain, tables and streams.

    A round follows one Prev of all files; only files that have one are read again. A hybrid file's stream
    (XRefStm) comes right after its table. An offset that was there before ends a chain.
    """
    texts = headers(files)
    now = settle(_cut(texts.select("path", "text", F.col("startxref").alias("at")).filter("at is not null")).withColumn("seen", F.array("at")), "sections")
    out, seq = None, 0
    while not now.isEmpty():
        found = now.select("path", F.lit(seq).alias("seq"), "section", "data")
        out = found if out is None else out.unionByName(found)
        prev = _number(F.col("section"), r"/Prev\s+(\d+)")
        hybrid = now.select("path", _number(F.col("section"), r"/XRefStm\s+(\d+)").alias("at")).filter("at is not null")
        out = out.unionByName(_cut(hybrid.join(texts.select("path", "text"), "path")).select("path", F.lit(seq + 1).alias("seq"), "section", "data"))
        older = now.select("path", prev.alias("at"), "seen").filter("at is not null").filter(~F.array_contains("seen", F.col("at")))
        now = settle(_cut(older.join(texts.select("path", "text"), "path")).withColumn("seen", F.concat("seen", F.array("at"))), "sections")
        seq += 2
    return now.select("path", F.lit(0).alias("seq"), "section", "data") if out is None else out


def _table_entries(sections: DataFrame) -> DataFrame:
    parts = sections.filter("data is null").select("path", "seq", F.explode(F.regexp_extract_all("section", F.lit(r"(\d+\s+\d+\s*\r?\n(?:\d{10} \d{5} [nf][ \r\n]{1,2})+)"), F.lit(1))).alias("part"))
    first = F.regexp_extract("part", r"^(\d+)", 1).cast("bigint")
    rows = parts.select("path", "seq", first.alias("first"), F.posexplode(F.regexp_extract_all("part", F.lit(r"(\d{10} \d{5} [nf])"), F.lit(1))).alias("i", "entry"))
    none = F.lit(None).cast("bigint")
    return rows.select("path", "seq", (F.col("first") + F.col("i")).alias("number"), F.substring("entry", 12, 5).cast("int").alias("generation"), F.substring("entry", 1, 10).cast("bigint").alias("offset"), F.col("entry").endswith("n").alias("used"), none.alias("container"), none.alias("place"))


def _stream_entries(sections: DataFrame) -> DataFrame:
    """Entries of cross-reference streams: three big-endian fields of the widths W for each number of the Index ranges."""
    rows = sections.filter("data is not null").withColumnRenamed("section", "body")
    widths = F.transform(entry(F.col("body"), "W", "numbers"), lambda x: x.cast("int"))
    ranges = F.transform(F.coalesce(entry(F.col("body"), "Index", "numbers"), F.array(F.lit(0.0), entry(F.col("body"), "Size", "int").cast("double"))), lambda x: x.cast("bigint"))
    rows = decoded(rows.withColumn("w", widths).withColumn("ranges", ranges)).filter(F.size("w") == 3)
    halves = F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2).cast("int") - 1), lambda i: F.struct(F.get("ranges", i * 2).alias("first"), F.get("ranges", i * 2 + 1).alias("n"), F.aggregate(F.slice("ranges", 1, i * 2), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("k")), lambda acc, x: F.struct((acc["sum"] + F.when(acc["k"] % 2 == 1, x).otherwise(0)).alias("sum"), (acc["k"] + 1).alias("k")), lambda acc: acc["sum"]).alias("before")))
    rows = rows.select("path", "seq", "w", "decoded", F.explode(halves).alias("r")).filter("r.n > 0")
    rows = rows.select("path", "seq", "w", "decoded", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("r.n") - 1)).alias("i"))
    w = [F.get("w", F.lit(k)) for k in range(3)]
    at = ((F.col("r.before") + F.col("i")) * (w[0] + w[1] + w[2])).cast("int") + 1
    field = lambda start, size: F.coalesce(F.conv(F.hex(F.substr("decoded", start, size)), 16, 10).cast("bigint"), F.lit(0))
    kind = F.when(w[0] == 0, 1).otherwise(field(at, w[0]))
    second, third = field(at + w[0], w[1]), field(at + w[0] + w[1], w[2])
    rows = rows.filter(F.octet_length("decoded") >= at - 1 + w[0] + w[1] + w[2])
    rows = rows.select("path", "seq", (F.col("r.first") + F.col("i")).alias("number"), kind.alias("kind"), second.alias("second"), third.alias("third"))
    packed = F.col("kind") == 2
    return rows.select("path", "seq", "number", F.when(packed, 0).otherwise(F.col("third")).cast("int").alias("generation"), F.when(~packed, F.col("second")).alias("offset"), F.col("kind").isin(1, 2).alias("used"), F.when(packed, F.col("second")).alias("container"), F.when(packed, F.col("third")).alias("place"))


def xref_entries(sections: DataFrame) -> DataFrame:
    """path, number, generation, offset, used, container, place: the newest entry of each number.

    An object in an object stream has the stream's number as container and its place there, and no offset.
    """
    rows = _table_entries(sections).unionByName(_stream_entries(sections))
    newest = F.row_number().over(W.partitionBy("path", "number").orderBy("seq"))
    return rows.withColumn("k", newest).filter("k = 1").drop("k", "seq")


#: characters of an object in which its text is looked through for strings
LONGEST = 1 << 20
_HEAD = r"^\s*(\d+)\s+(\d+)\s+obj\b"


def objects(files: DataFrame) -> DataFrame:
    """path, number, generation, offset, body (text), data (a stream's raw bytes) and repaired, by table or by repair.

    Objects in object streams are among them, with the offset of their stream. A file is repaired if it has
    no table, or if the table's offsets don't all lead to the objects they name.
    """
    bounded(files.sparkSession)
    texts = headers(files).select("path", "text")
    entries = settle(xref_entries(xref_sections(files)).filter("used and number > 0"), "entries")
    listed = entries.filter("container is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "number", "generation"))).alias("e"))

    def named(x: Column) -> Column:
        head = F.substr("text", (x["offset"] + 1).cast("int"), F.lit(48))
        return F.concat_ws(" ", F.regexp_extract(head, _HEAD, 1).cast("bigint"), F.regexp_extract(head, _HEAD, 2).cast("bigint")) == F.concat_ws(" ", x["number"], x["generation"])

    rows = texts.join(listed, "path", "left").withColumn("sound", F.coalesce((F.size("e") > 0) & F.forall("e", named), F.lit(False)))
    each = rows.filter("sound").select("path", "text", "e", F.posexplode("e").alias("i", "x"))
    part = _between("text", F.col("x.offset"), F.get("e", F.col("i") + 1)["offset"])
    by_table = each.select("path", "x.number", "x.generation", "x.offset", F.lit(False).alias("repaired"), part.alias("part"))
    found = _bodies(by_table.unionByName(_repaired(rows.filter("not sound").select("path", "text"))))
    inner = _packed(found)
    placed = entries.filter("container is not null").select("path", "number", "container", "place")
    listed_inner = inner.filter("not repaired").join(placed, ["path", "number", "container", "place"], "left_semi")
    last = F.row_number().over(W.partitionBy("path", "number").orderBy(F.col("offset").desc()))
    columns = found.columns
    mended = found.filter("repaired").unionByName(inner.filter("repaired").select(*columns)).withColumn("k", last).filter("k = 1").drop("k")
    return found.filter("not repaired").unionByName(listed_inner.select(*columns)).unionByName(mended)


def _between(text: str, start: Column, stop: Column) -> Column:
    """The text from one object to the next, or to the end: each part of a file is cut out once."""
    return F.substr(text, (start + 1).cast("int"), (F.coalesce(stop, F.length(text)) - start).cast("int"))


def _repaired(texts: DataFrame) -> DataFrame:
    """Every object that a file's text shows, the last of each number; the text is cut once, at the objects' marks."""
    pattern = r"(?<![0-9])(?:[0-9]+)\s+[0-9]+\s+obj\b"
    marks = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = texts.select("path", F.posexplode(F.arrays_zip(marks.alias("mark"), F.split("text", pattern, -1).alias("rest"))).alias("i", "z"))
    rows = rows.select("path", "i", F.concat("z.mark", "z.rest").alias("part"), F.col("z.mark").alias("mark"))
    before = W.partitionBy("path").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.sum(F.length("part")).over(before)).filter("i > 0")
    rows = rows.select("path", F.regexp_extract("mark", r"^(\d+)", 1).cast("bigint").alias("number"), F.regexp_extract("mark", r"^\d+\s+(\d+)", 1).cast("int").alias("generation"), "offset", F.lit(True).alias("repaired"), "part")
    last = F.row_number().over(W.partitionBy("path", "number").orderBy(F.col("offset").desc()))
    return rows.withColumn("k", last).filter("k = 1").drop("k")


@pandas_udf(IntegerType())
def _text_end(part: pd.Series) -> pd.Series:
    """How many characters an object takes up to its endobj, or to the line end after its stream; 0 where there is neither."""

    def one(text: str | None) -> int | None:
        if text is None:
            return None
        data = text.encode("latin-1", "replace")
        for begin, token in lexer.tokens(data):
            if token == b"endobj":
                return begin + len(token)
            if token == b"stream":
                end = begin + len(token)
                return end + (2 if data[end : end + 2] == b"\r\n" else 1)
        return 0

    return part.map(one).astype("Int32")


def _bodies(rows: DataFrame) -> DataFrame:
    """Cut each object's text from what follows it, and its stream's bytes by its Length, direct or one reference away."""
    plain_mark = F.regexp_extract("part", r"(?s)^(.*?(?:\bstream\r?\n|endobj))", 1)
    rows = rows.withColumn("mark", plain_mark)
    # a string may hold these words: then tokens tell where the object's text ends
    strings = F.col("mark").contains("(")
    rows = rows.withColumn("__end", _text_end(F.when(strings, F.substring("part", 1, LONGEST))))
    rows = rows.withColumn("mark", F.when(strings & (F.col("__end") > 0), F.substr("part", F.lit(1), F.col("__end"))).otherwise(F.col("mark"))).drop("__end")
    body = F.trim(F.regexp_extract(F.regexp_replace("mark", _HEAD, ""), r"(?s)^\s*(.*?)\s*(?:\bstream\r?\n|endobj)$", 1))
    rows = rows.withColumn("body", body)
    direct, ref = _number(F.col("body"), r"/Length\s+(\d+)(?!\s+\d+\s+R)"), _number(F.col("body"), r"/Length\s+(\d+)\s+\d+\s+R")
    rest = F.when(F.col("mark").rlike(r"(?s)\bstream\r?\n$"), F.substr("part", F.length("mark") + 1, F.coalesce("direct", F.length("part")).cast("int")))
    rows = rows.withColumn("direct", direct).withColumn("ref", F.when(F.col("direct").isNull(), ref)).withColumn("rest", rest)
    columns = ["path", "number", "generation", "offset", "body"]
    plain = (F.col("direct").isNotNull() | F.col("rest").isNull())
    data = F.when(plain, F.encode("rest", "ISO-8859-1"))
    cut = settle(rows.select(*columns, data.alias("data"), "repaired", F.when(~plain, F.col("rest")).alias("rest"), "ref"), "cut")
    lengths = cut.select("path", F.col("number").alias("ref"), F.expr("try_cast(body as bigint)").alias("via")).filter("via is not null")
    known = F.encode(F.substr("rest", F.lit(1), F.coalesce("via", F.lit(0)).cast("int")), "ISO-8859-1")
    indirect = cut.filter("rest is not null").drop("data").join(lengths, ["path", "ref"], "left").select(*columns, known.alias("data"), "repaired")
    return cut.filter("rest is null").select(*columns, "data", "repaired").unionByName(indirect)


def _packed(every: DataFrame) -> DataFrame:
    """The objects that stand in object streams, with the stream's number as container and their place there."""
    packed = decoded(every.filter(F.col("body").rlike(r"/Type\s*/ObjStm\b")))
    first = entry(F.col("body"), "First", "int").cast("int")
    rows = packed.select("path", F.col("number").alias("container"), "offset", "repaired", _text(F.col("decoded")).alias("text"), first.alias("first"))
    head = F.substr("text", F.lit(1), F.col("first"))
    rows = rows.withColumn("numbers", F.transform(F.regexp_extract_all(head, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint")))
    each = rows.select("path", "container", "offset", "repaired", "text", "first", "numbers", F.explode(F.sequence(F.lit(0), (F.size("numbers") / 2).cast("int") - 1)).alias("i")).filter("i >= 0 and size(numbers) >= 2")
    start = F.get("numbers", F.col("i") * 2 + 1)
    stop = F.coalesce(F.get("numbers", F.col("i") * 2 + 3), (F.length("text") - F.col("first")).cast("bigint"))
    body = F.trim(F.regexp_replace(F.substr("text", (F.col("first") + start + 1).cast("int"), (stop - start).cast("int")), r"\s+$", ""))
    return each.select("path", F.get("numbers", F.col("i") * 2).alias("number"), F.lit(0).alias("generation"), "offset", body.alias("body"), F.lit(None).cast("binary").alias("data"), "repaired", "container", F.col("i").cast("bigint").alias("place"))


def _own_value(key: str):
    @pandas_udf(StringType())
    def find(body: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            depth, at, end, inside = 0, None, len(text), 0
            for begin, token in lexer.tokens(text.encode("latin-1", "replace")):
                if at is not None and depth == 1 and begin > at and inside and (token[:1] == b"/" or token == b">>"):
                    end = begin
                    break
                depth += (token in (b"<<", b"[")) - (token in (b">>", b"]"))
                if at is None and depth == 1 and token == key:
                    at = begin
                elif at is not None:
                    inside += 1
            return text[at:end] if at is not None else ""

        key = b"/" + name
        return body.map(one)

    name = key.encode("latin-1")
    return find


def entry(body: Column, key: str, what: str) -> Column:
    """A dictionary entry of a plain form: what is name, int, ref, refs, numbers, literal or hex; null where it isn't there.

    Only the dictionary's own keys count: where there are inner dictionaries, names in arrays or strings, the value is cut out by tokens first.
    """
    nested = body.rlike(r"(?s)<<.*<<|\(|\[[^\]]*/")
    body = F.when(nested, _own_value(key)(F.when(nested, body))).otherwise(body)
    forms = {"name": r"/([^\s/<>\[\]()]+)", "int": r"(-?\d+)(?!\s+\d+\s+R)", "ref": r"(\d+)\s+\d+\s+R", "refs": r"\[([^\]]*)\]", "numbers": r"\[([-+.\d\s]*)\]", "literal": r"\(((?:\\.|[^\\)])*)\)", "hex": r"<([0-9A-Fa-f\s]*)>"}
    found = F.regexp_extract(body, rf"/{key}\s*{forms[what]}", 1)
    present = body.rlike(rf"/{key}\s*{forms[what]}")
    if what in ("int", "ref"):
        return F.nullif(found, F.lit("")).cast("bigint")
    if what == "refs":
        return F.when(present, F.transform(F.regexp_extract_all(found, F.lit(r"(\d+)\s+\d+\s+R"), F.lit(1)), lambda x: x.cast("bigint")))
    if what == "numbers":
        return F.when(present, F.transform(F.filter(F.split(found, r"\s+"), lambda x: x != ""), lambda x: x.cast("double")))
    return F.when(present, found)


def string_entry(body: Column, key: str) -> Column:
    """A string entry, literal or hex, as text; UTF-16 where it begins with a byte order mark."""
    raw = F.unhex(F.regexp_replace(entry(body, key, "hex"), r"\s", ""))
    from ..functions.values import decoded_text

    return F.coalesce(decoded_text(raw), F.regexp_replace(entry(body, key, "literal"), r"\\([\\()])", "$1"))


def trailers(files: DataFrame) -> DataFrame:
    """path, root, info, encrypt and id: from the newest trailer, or cross-reference stream, that names a Root."""
    dicts = F.regexp_extract_all("text", F.lit(r"(?s)trailer\s*(<<.*?>>)\s*startxref"), F.lit(1))
    streams = F.regexp_extract_all("text", F.lit(r"(?s)obj\s*(<<(?:(?!endobj).)*?/Type\s*/XRef\b(?:(?!endobj).)*?>>)\s*stream"), F.lit(1))
    streams = F.when(F.col("text").contains("/XRef"), streams).otherwise(F.array().cast("array<string>"))  # a pattern over whole files
    rows = headers(files).select("path", F.element_at(F.concat(F.array(F.lit("")), F.filter(F.concat(streams, dicts), lambda d: d.contains("/Root"))), -1).alias("t"))
    ids = F.transform(F.regexp_extract_all(F.regexp_extract("t", r"/ID\s*\[([^\]]*)\]", 1), F.lit(r"<([0-9A-Fa-f]+)>"), F.lit(1)), lambda h: F.lower(h))
    return rows.select("path", *(entry(F.col("t"), k, "ref").alias(k.lower()) for k in ("Root", "Info", "Encrypt")), ids.alias("id"))


def file_info(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row a file: version, counts, document information, language and whether it was repaired."""
    every = objects(files) if every is None else every
    info = every.select("path", F.col("number").alias("info"), *(string_entry(F.col("body"), k).alias(k.lower()) for k in ("Author", "Title", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")))
    root = every.select("path", F.col("number").alias("root"), string_entry(F.col("body"), "Lang").alias("language"))
    counts = every.groupBy("path").agg(F.count("*").alias("num_objs"), F.bool_or("repaired").alias("repaired"))
    out = headers(files).select("path", "version").join(trailers(files), "path", "left")
    info = info.withColumns({"created": parse_pdf_date(F.col("creationdate")), "modified": parse_pdf_date(F.col("moddate"))})
    return out.join(counts, "path", "left").join(info, ["path", "info"], "left").join(root, ["path", "root"], "left").drop("info", "root", "encrypt")


def pages(every: DataFrame) -> DataFrame:
    """path, page_index, number, ancestors (nearest first): the leaves of each page tree, in order.

    The tree is walked from its roots one level a round, however deep; a node without Kids is a page, and one
    that is its own ancestor is left out. Each round's level is written, so plans stay small.
    """
    bounded(every.sparkSession)
    kids = settle(every.select("path", F.col("number").alias("node"), entry(F.col("body"), "Kids", "refs").alias("kids")), "kids")
    roots = every.filter(F.col("body").rlike(r"/Type\s*/Catalog\b")).select("path", entry(F.col("body"), "Pages", "ref").alias("node"))
    now = roots.select("path", "node", F.array().cast("array<int>").alias("place"), F.array().cast("array<bigint>").alias("above"))
    levels = []
    while not levels or not levels[-1].filter("kids is not null").isEmpty():
        levels.append(settle(now.join(kids, ["path", "node"]).filter(~F.array_contains("above", F.col("node"))), "level"))
        below = levels[-1].filter("kids is not null").select("path", F.col("node").alias("up"), "place", "above", F.posexplode("kids").alias("i", "kid"))
        now = below.select("path", F.col("kid").alias("node"), F.concat("place", F.array("i")).alias("place"), F.concat(F.array("up"), "above").alias("above"))
    leaves = reduce(DataFrame.unionByName, levels).filter("kids is null")
    index = F.row_number().over(W.partitionBy("path").orderBy("place")) - 1
    return settle(leaves.select("path", index.alias("page_index"), F.col("node").alias("number"), F.col("above").alias("ancestors")), "pages")


def page_attribute(leaves: DataFrame, every: DataFrame, key: str, what: str) -> DataFrame:
    """path, page_index and value: the attribute of the page or else of its nearest ancestor that has it."""
    chain = leaves.select("path", "page_index", F.posexplode(F.concat(F.array("number"), "ancestors")).alias("depth", "number"))
    held = every.select("path", "number", entry(F.col("body"), key, what).alias("value")).filter("value is not null")
    near = chain.join(held, ["path", "number"]).groupBy("path", "page_index").agg(F.min_by("value", "depth").alias("value"))
    return leaves.select("path", "page_index").join(near, ["path", "page_index"], "left")


def page_values(leaves: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """path, page_index, and a VARIANT for each key: the value of the page or else of its nearest ancestor that has the key; bodies are parsed, so keys of inner dictionaries don't count."""
    from ..functions import values as v

    chain = leaves.select("path", "page_index", F.posexplode(F.concat(F.array("number"), "ancestors")).alias("depth", "number"))
    parsed = every.join(chain.select("path", "number").distinct(), ["path", "number"], "left_semi").select("path", "number", v.parsed(value_json("body")).alias("v"))
    held = settle(parsed.select("path", "number", *(F.to_json(v.at(F.col("v"), k)).alias(f"v{i}") for i, k in enumerate(keys))), "page-values")
    near = chain.join(held, ["path", "number"]).groupBy("path", "page_index").agg(*(F.min_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.col("depth"))).alias(f"v{i}") for i in range(len(keys))))
    return leaves.select("path", "page_index").join(near, ["path", "page_index"], "left").select("path", "page_index", *(v.parsed(F.col(f"v{i}")).alias(k) for i, k in enumerate(keys)))


def problems(files: DataFrame, every: DataFrame) -> DataFrame:
    """path and errors of all files: an array of messages, empty for a sound file. Nothing is raised: what can be read is in the other tables."""
    body = F.col("body")
    facts = every.groupBy("path").agg(F.bool_or("repaired").alias("repaired"), F.bool_or(body.rlike(r"/Type\s*/Catalog\b")).alias("catalog"), F.bool_or(body.rlike(r"/Type\s*/Page\b")).alias("page"), F.lit(True).alias("any"))
    rows = headers(files).select("path", "version", "startxref").join(trailers(files), "path", "left").join(facts, "path", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = [F.when(F.col("version").isNull(), "no header"), F.when(F.col("startxref").isNull(), "no start of cross-references"), F.when(F.col("root").isNull(), "no trailer"), F.when(~is_("any"), "no objects")]
    found += [F.when(is_("repaired"), "cross-references repaired"), F.when(is_("any") & ~is_("catalog"), "no catalog"), F.when(is_("any") & ~is_("page"), "no pages"), F.when(F.col("encrypt").isNotNull(), "encrypted")]
    return rows.select("path", F.array_compact(F.array(*found)).alias("errors"))


def failed_fast(rows: DataFrame) -> DataFrame:
    """problems() for those who want no damaged files: running it raises an error at the first file that has errors."""
    message = F.concat(F.col("path"), F.lit(": "), F.array_join("errors", ", "))
    return rows.filter(F.when(F.size("errors") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def metadata(every: DataFrame) -> DataFrame:
    """path and xmp: the catalog's metadata stream as text."""
    roots = every.filter(F.col("body").rlike(r"/Type\s*/Catalog\b")).select("path", entry(F.col("body"), "Metadata", "ref").alias("number")).filter("number is not null")
    return roots.join(decoded(every).select("path", "number", "decoded"), ["path", "number"]).select("path", F.decode("decoded", "UTF-8").alias("xmp"))


def images(every: DataFrame) -> DataFrame:
    """path, number, width, height and bytes_per_line of image objects; bits are 8 and colours those of the colour space where nothing is said."""
    from ..functions import content

    body = F.col("body")
    colors = F.coalesce(entry(body, "Colors", "int"), F.when(body.rlike(r"/ColorSpace\s*/DeviceGray"), 1).when(body.rlike(r"/ColorSpace\s*\[\s*/Indexed"), 1).when(body.rlike(r"/ColorSpace\s*/DeviceCMYK"), 4).otherwise(3))
    rows = every.filter(body.rlike(r"/Subtype\s*/Image\b")).select("path", "number", entry(body, "Width", "int").alias("width"), entry(body, "Height", "int").alias("height"), colors.alias("colors"), F.coalesce(entry(body, "BitsPerComponent", "int"), F.lit(8)).alias("bits"))
    return rows.select("path", "number", "width", "height", content.bytes_per_line(F.col("width"), F.col("colors"), F.col("bits")).alias("bytes_per_line"))


def decoded(every: DataFrame) -> DataFrame:
    """Adds filters and decoded: the stream's bytes with its filters undone."""
    filters = F.regexp_extract_all(F.regexp_extract("body", r"/Filter\s*(\[[^\]]*\]|/\w+)", 1), F.lit(r"/(\w+)"), F.lit(1))
    number = lambda key, empty: F.coalesce(entry(F.col("body"), key, "int").cast("int"), F.lit(empty))
    rows = every.filter("data is not null").withColumn("filters", filters)
    return rows.withColumn("decoded", codecs.decode(F.col("data"), F.col("filters"), number("Predictor", 1), number("Colors", 1), number("BitsPerComponent", 8), number("Columns", 1)))


def page_streams(leaves: DataFrame, every: DataFrame) -> DataFrame:
    """path, page_index, stream_index and content: each page's decoded content streams in order."""
    body = every.select("path", "number", "body")
    one, many = entry(F.col("body"), "Contents", "ref"), entry(F.col("body"), "Contents", "refs")
    refs = leaves.join(body, ["path", "number"]).select("path", "page_index", F.posexplode(F.coalesce(many, F.array(one))).alias("stream_index", "number"))
    held = every.filter("data is not null").select("path", "number", "body", "data")  # filters are undone after the join, which deals what it takes
    return decoded(refs.join(held, ["path", "number"])).select("path", "page_index", "stream_index", F.col("decoded").alias("content"))


_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s/<>\[\](){}%]*|<[0-9A-Fa-f\s]*>|\((?:[^()\\]|\\.)*\)|[^\s/<>\[\](){}%]+|[(<>)]", re.S)


def lexemes(data: bytes) -> list[bytes]:
    """The tokens of PDF text; a literal string may hold balanced parentheses."""
    out, at = [], 0
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token == b"(":  # nested parentheses: find the one that closes
            depth, i = 1, at
            while i < len(data) and depth:
                if data[i : i + 1] == b"\\":
                    i += 2  # what follows a backslash doesn't count
                    continue
                depth += {b"(": 1, b")": -1}.get(data[i : i + 1], 0)
                i += 1
            token, at = data[m.start() : i], i
        if not token.startswith(b"%"):
            out.append(token)
    return out


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _plain_escapes(token: str) -> str:
    """A literal string with its escapes undone, but those of parentheses and backslashes."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 8) & 255) if m[1] else _ESCAPES.get(m[2], "" if m[2] in "\r\n" else m[2])
        return "\\" + c if c and c in "()\\" else c

    return re.sub(r"\\(?:([0-7]{1,3})|(.))", one, token, flags=re.S) if token.startswith("(") and "\\" in token else token


@pandas_udf(ArrayType(StringType()))
def tokens_of(data: pd.Series) -> pd.Series:
    return pd.Series([[] if d is None else [_plain_escapes(t.decode("latin-1")) for t in lexemes(d)] for d in data], dtype=object)


def tokens(streams: DataFrame) -> DataFrame:
    """path, page_index, stream_index, pos, kind and token of the content streams."""
    rows = streams.select("path", "page_index", "stream_index", F.posexplode(tokens_of("content")).alias("pos", "token"))
    t = F.col("token")
    kind = F.when(t.startswith("("), "string").when(t.rlike("^<[^<]"), "hex").when(t.startswith("/"), "name").when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), "number").when(t.isin("[", "]", "<<", ">>"), "delimiter").otherwise("keyword")
    return rows.withColumn("kind", kind)


def _unescaped(s: str) -> str:
    return re.sub(r"\\([0-7]{1,3}|\r?\n|.)", lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else _ESCAPES.get(m[1], "" if m[1].endswith("\n") else m[1]), s, flags=re.S)


def literal_bytes(token: str) -> bytes:
    """The bytes of a literal or hex string token."""
    if token.startswith("("):
        return _unescaped(token[1:-1]).encode("latin-1")
    digits = re.sub(r"\s", "", token[1:-1])
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def value_of(items: list[str], at: int = 0, depth: int = 0) -> tuple[object, int]:
    """The value that begins at a token, in the tagged form of functions.values, and where it ends; 32 levels at most."""
    if depth > 32:
        raise ValueError("values are nested too deeply")
    t = items[at]
    if t == "[":
        out, at = [], at + 1
        while at < len(items) and items[at] != "]":
            v, at = value_of(items, at, depth + 1)
            out.append(v)
        return out, at + 1
    if t == "<<":
        pairs: dict[str, object] = {}
        at += 1
        while at < len(items) and items[at] != ">>":
            key = items[at][1:]
            v, at = value_of(items, at + 1, depth + 1)
            pairs.setdefault(key, v)  # of equal keys the first counts
        return pairs, at + 1
    if re.fullmatch(r"\d+", t) and items[at + 2 : at + 3] == ["R"] and items[at + 1].isdigit():
        return {"$ref": [int(t), int(items[at + 1])]}, at + 3
    if t.startswith("("):
        return _unescaped(t[1:-1]), at + 1
    if t.startswith("<"):
        digits = re.sub(r"\s", "", t[1:-1])
        return ({"$bin": digits + "0" * (len(digits) % 2)} if digits else ""), at + 1
    if t.startswith("/"):
        return {"$name": re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), t[1:])}, at + 1
    if t in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[t], at + 1
    try:
        return float(t), at + 1
    except ValueError:
        return None, at + 1


@pandas_udf(StringType())
def value_json(body: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        items = [t.decode("latin-1") for t in lexemes((s or "").encode("latin-1"))]
        return json.dumps(value_of(items)[0], sort_keys=True) if items else None

    return body.map(one)


def values(every: DataFrame) -> DataFrame:
    """path, number, type, subtype and value: each object as a VARIANT of tagged JSON."""
    from ..functions import values as v

    rows = every.select("path", "number", v.parsed(value_json("body")).alias("value"))
    return rows.select("path", "number", v.get_name(F.col("value"), "Type").alias("type"), v.get_name(F.col("value"), "Subtype").alias("subtype"), "value")
