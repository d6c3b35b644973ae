"""PDF files from tables: objects are rows, a file is the ordered sum of its objects.

pdf_objects() lays a table of texts out as pages; written() turns any table of objects
(path, number, body) into files with a cross-reference table. Offsets are running sums
of the objects' lengths, so both are plain aggregations and windows within a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import content
from ..functions.text import pdf_date, pdf_literal, pdf_name, pdf_number, utf16_hex, xml_escape

LINES = 54
#: code units of a shown string, which stays below the text reader's limit
CHUNK = 200
#: objects of an object stream
PACKED = 100
#: objects whose offsets are summed up together
BUCKET = 4096
HEADER = "%PDF-1.4\n%âãÏÓ\n"


def pages_of(texts: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """path, page (from 0) and the page's lines: the text's lines, so many to a page."""
    rows = texts.select(F.concat(F.lit("doc-"), F.col(key), F.lit(".pdf")).alias("path"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("l"))
    page = F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int")))
    rows = rows.select("path", "l", page.alias("page"))
    return rows.select("path", "page", F.slice("l", F.col("page") * lines + 1, F.lit(lines)).alias("lines"))


def shown(line: Column) -> Column:
    """A line's text as show operators of at most CHUNK characters each, and a new line."""
    starts = F.sequence(F.lit(0), F.floor((F.length(line) - 1) / CHUNK).cast("int"))
    chunks = F.transform(starts, lambda i: F.concat(F.lit("<"), utf16_hex(F.substr(line, i * CHUNK + 1, F.lit(CHUNK))), F.lit(">Tj\n")))
    return F.concat(F.when(F.length(line) > 0, F.array_join(chunks, "")).otherwise(""), F.lit("T*\n"))


def page_content(lines: Column) -> Column:
    """Text at 10 points from the top of a letter page."""
    return F.concat(content.text_begin(), content.text_font(F.lit("F1"), 10), content.text_leading(12), content.text_move_to(36, 740), F.array_join(F.transform(lines, shown), ""), content.text_end())


def _dict(*parts) -> Column:
    return F.concat(F.lit("<<"), *(p if isinstance(p, Column) else F.lit(p) for p in parts), F.lit(">>"))


def stream(data: Column, extra: Column | None = None) -> Column:
    """A stream object's body as binary."""
    data = data.cast("binary")
    head = F.concat(F.lit("<<"), *([extra] if extra is not None else []), F.lit("/Length "), F.octet_length(data), F.lit(">>\nstream\n"))
    return F.concat(head.cast("binary"), data, F.lit("\nendstream").cast("binary"))


def pdf_objects(pages: DataFrame, info: DataFrame | None = None, compress: bool = True, metadata: bool = False) -> DataFrame:
    """path, number, body for pages (path, page, lines): 1 catalog, 2 page tree, 3 info, 4 font, then two for each page.

    info: path and any of author, title, subject, keywords, creator, producer, language, created and modified (timestamps).
    metadata: the catalog also has an output intent, and a metadata stream, the last object, that repeats title, author and language.
    """
    from ..functions.codecs import deflate

    number = F.col("page") * 2 + 5
    drawn = pages.select("path", (number + 1).cast("bigint").alias("number"), page_content(F.col("lines")).cast("binary").alias("ops"))
    drawn = drawn.withColumn("ops", deflate("ops")) if compress else drawn
    streams = drawn.select("path", "number", stream(F.col("ops"), F.lit("/Filter/FlateDecode") if compress else None).alias("body"))
    leaves = pages.select("path", number.cast("bigint").alias("number"), F.concat(F.lit("<</Contents "), number + 1, F.lit(" 0 R/Parent 2 0 R/Type/Page>>")).cast("binary").alias("body"))
    files = pages.groupBy("path").agg(F.max("page").alias("last"))
    kids = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda p: F.concat((p * 2 + 5).cast("string"), F.lit(" 0 R"))), " ")
    tree = files.select("path", F.lit(2).cast("bigint").alias("number"), _dict("/Count ", F.col("last") + 1, "/Kids[", kids, "]/MediaBox[0 0 612 792]/Resources<</Font<</F1 4 0 R>>>>/Type/Pages").cast("binary").alias("body"))
    font = files.select("path", F.lit(4).cast("bigint").alias("number"), F.lit("<</BaseFont/Courier/Encoding/WinAnsiEncoding/Subtype/Type1/Type/Font>>").cast("binary").alias("body"))
    about = files.select("path") if info is None else files.join(info, "path", "left")
    entries = [F.coalesce(F.concat(F.lit(f"/{k}"), F.lit("<FEFF"), utf16_hex(F.col(c)), F.lit(">")), F.lit("")) for k, c in (("Author", "author"), ("Creator", "creator"), ("Keywords", "keywords"), ("Producer", "producer"), ("Subject", "subject"), ("Title", "title")) if c in about.columns]
    if "created" in about.columns:
        entries.append(F.coalesce(F.concat(F.lit("/CreationDate"), pdf_literal(pdf_date(F.col("created")))), F.lit("")))
    if "modified" in about.columns:
        entries.append(F.coalesce(F.concat(F.lit("/ModDate"), pdf_literal(pdf_date(F.col("modified")))), F.lit("")))
    lang = F.coalesce(F.concat(F.lit("/Lang"), pdf_literal(F.col("language"))), F.lit("")) if "language" in about.columns else F.lit("")
    described = about.select("path", F.lit(3).cast("bigint").alias("number"), _dict(*entries).cast("binary").alias("body"))
    catalog = about.select("path", F.lit(1).cast("bigint").alias("number"), _dict(lang, "/Pages 2 0 R/Type/Catalog").cast("binary").alias("body"))
    out = tree.unionByName(described).unionByName(font).unionByName(leaves).unionByName(streams)
    if not metadata:
        return out.unionByName(catalog)
    column = lambda c: F.col(c) if c in about.columns else F.lit(None).cast("string")
    number = (F.col("last") * 2 + 7).cast("bigint")
    packet = about.select("path", number.alias("number"), stream(F.encode(xmp_packet(column("title"), column("author"), column("language")), "UTF-8"), F.lit("/Subtype/XML/Type/Metadata")).alias("body"))
    catalog = about.select("path", F.lit(1).cast("bigint").alias("number"), _dict(lang, "/Metadata ", number.cast("string"), " 0 R/OutputIntents[", output_intent("GTS_PDFX", "CMYK", "CGATS TR 001"), "]/Pages 2 0 R/Type/Catalog").cast("binary").alias("body"))
    return out.unionByName(catalog).unionByName(packet)


def output_intent(subtype: str, condition: str, identifier: str, registry: str = "http://www.color.org", profile: Column | None = None) -> Column:
    """An output intent's dictionary; profile: the number of an ICC profile's object."""
    made = [F.lit("/DestOutputProfile "), profile.cast("string"), F.lit(" 0 R")] if profile is not None else []
    return _dict(*made, "/OutputCondition", pdf_literal(F.lit(condition)), "/OutputConditionIdentifier", pdf_literal(F.lit(identifier)), "/RegistryName", pdf_literal(F.lit(registry)), "/S", pdf_name(F.lit(subtype)), "/Type/OutputIntent")


def packed(objects: DataFrame, compress: bool = True, root: int = 1, info: int = 3) -> DataFrame:
    """path and content of files with object streams and a cross-reference stream, for files that fit a row.

    Objects (path, number, body) without a stream go into streams of PACKED objects, which are numbered after
    the last; the cross-reference stream comes last.
    """
    from ..functions.codecs import deflate

    is_stream = F.expr("instr(decode(body, 'ISO-8859-1'), '>>\nstream\n') > 0")
    rows = objects.withColumn("streamed", is_stream)
    last = rows.groupBy("path").agg(F.max("number").alias("last"))
    order = W.partitionBy("path").orderBy("number")
    lone = rows.filter("not streamed").withColumn("i", F.row_number().over(order) - 1).join(last, "path")
    lone = lone.select("path", "number", F.decode("body", "ISO-8859-1").alias("text"), F.floor(F.col("i") / PACKED).alias("group"), F.pmod("i", F.lit(PACKED)).alias("place"), "last")
    groups = lone.groupBy("path", "group", "last").agg(F.array_sort(F.collect_list(F.struct("place", "number", "text"))).alias("o"))
    starts = F.transform("o", lambda x, i: F.concat(x["number"].cast("string"), F.lit(" "), F.aggregate(F.slice("o", F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y["text"]) + 1).cast("string"), F.lit(" ")))
    head = F.array_join(starts, "")
    data = F.encode(F.concat(head, F.array_join(F.transform("o", lambda x: F.concat(x["text"], F.lit("\n"))), "")), "ISO-8859-1")
    flate = F.lit("/Filter/FlateDecode") if compress else F.lit("")
    containers = groups.select("path", (F.col("last") + 1 + F.col("group")).alias("number"), (deflate(data) if compress else data).alias("data"), F.concat(flate, F.lit("/First "), F.length(head), F.lit("/N "), F.size("o"), F.lit("/Type/ObjStm")).alias("extra"))
    placed = numbered(rows.filter("streamed").select("path", "number", "body").unionByName(containers.select("path", "number", stream(F.col("data"), F.col("extra")).alias("body"))))
    direct = placed.select("path", "number", F.lit(1).alias("kind"), F.col("offset").cast("bigint").alias("second"), F.lit(0).cast("bigint").alias("third"))
    inner = lone.select("path", "number", F.lit(2).alias("kind"), (F.col("last") + 1 + F.col("group")).alias("second"), F.col("place").cast("bigint").alias("third"))
    files = placed.groupBy("path").agg(F.max(F.col("offset") + F.octet_length("data")).alias("end"), F.max("number").alias("top"))
    entries = direct.unionByName(inner).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("number", "kind", "second", "third"))).alias("e")).join(files, "path")
    field = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    own = F.concat(F.lit("01"), field(F.col("end"), 8), F.lit("0000"))
    table = F.unhex(F.concat(F.lit("000000000000000000FFFF"), F.array_join(F.transform("e", lambda x: F.concat(field(x["kind"].cast("bigint"), 1), field(x["second"], 8), field(x["third"], 2))), ""), own))
    extra = F.concat(flate, F.lit("/ID[<"), F.md5("path"), F.lit("><"), F.md5("path"), F.lit(f">]/Info {info} 0 R/Root {root} 0 R/Size "), F.col("top") + 2, F.lit("/Type/XRef/W[1 8 2]"))
    body = stream(deflate(table) if compress else table, extra)
    final = entries.select("path", F.col("end").cast("bigint").alias("offset"), F.concat(F.concat(F.col("top") + 1, F.lit(" 0 obj\n")).cast("binary"), body, F.concat(F.lit("\nendobj\nstartxref\n"), F.col("end"), F.lit("\n%%EOF\n")).cast("binary")).alias("data"))
    first = files.select("path", F.lit(0).cast("bigint").alias("offset"), F.lit(HEADER).cast("binary").alias("data"))
    return joined(placed.select("path", F.col("offset").cast("bigint").alias("offset"), "data").unionByName(final).unionByName(first))


def numbered(objects: DataFrame) -> DataFrame:
    """Adds data (the object as it stands in the file) and offset (where it begins), by running sums within buckets of numbers and over buckets."""
    data = F.concat(F.concat("number", F.lit(" 0 obj\n")).cast("binary"), F.col("body"), F.lit("\nendobj\n").cast("binary"))
    rows = objects.withColumn("data", data).withColumn("bucket", F.floor(F.col("number") / BUCKET))
    sums = rows.groupBy("path", "bucket").agg(F.sum(F.octet_length("data")).alias("n"))
    before = W.partitionBy("path").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("path", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("path", "bucket").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("at", F.coalesce(F.sum(F.octet_length("data")).over(inside), F.lit(0))).join(sums, ["path", "bucket"])
    return out.select(*objects.columns, "data", (F.octet_length(F.lit(HEADER)) + F.col("start") + F.col("at")).alias("offset"))


def parts(objects: DataFrame, encrypt: bool = False, root: int = 1, info: int = 3) -> DataFrame:
    """path, offset and data: each file as rows that follow each other, so that files of any size can be written piece by piece.

    Objects are numbered 1, 2, ... without gaps; the cross-reference table has a row for each BUCKET of
    numbers. encrypt: the last object of each file is its Encrypt object.
    """
    rows = numbered(objects)
    table = rows.withColumn("bucket", F.floor(F.col("number") / BUCKET)).groupBy("path", "bucket").agg(F.array_sort(F.collect_list(F.struct("number", "offset"))).alias("e"), F.max(F.col("offset") + F.octet_length("data")).alias("end"))
    files = table.groupBy("path").agg(F.max("end").alias("xref"), F.sum(F.size("e")).alias("n"))
    head = _table_head()
    entries = F.array_join(F.transform("e", lambda x: F.concat(F.lpad(x["offset"].cast("string"), 10, "0"), F.lit(" 00000 n \n"))), "")
    placed = table.join(files, "path").select("path", (F.col("xref") + F.octet_length(head) + 20 * (F.get("e", F.lit(0))["number"] - 1)).alias("offset"), entries.cast("binary").alias("data"))
    trailer = _trailer(encrypt, root, info)
    ends = files.select("path", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("offset"), F.lit(HEADER).cast("binary").alias("data")), F.struct(F.col("xref").alias("offset"), head.cast("binary").alias("data")),
        F.struct((F.col("xref") + F.octet_length(head) + 20 * F.col("n")).alias("offset"), trailer.cast("binary").alias("data")),
    )).alias("x")).select("path", "x.offset", "x.data")
    return rows.select("path", F.col("offset").cast("bigint").alias("offset"), "data").unionByName(placed).unionByName(ends)


def _table_head() -> Column:
    """The beginning of the cross-reference table of n objects."""
    return F.concat(F.lit("xref\n0 "), F.col("n") + 1, F.lit("\n0000000000 65535 f \n"))


def _trailer(encrypt: bool, root: int, info: int) -> Column:
    """The trailer of a file (path) of n objects whose cross-reference table begins at xref."""
    return F.concat(F.lit("trailer\n<</ID[<"), F.md5(F.col("path")), F.lit("><"), F.md5(F.col("path")), *([F.lit(">]/Encrypt "), F.col("n"), F.lit(" 0 R")] if encrypt else [F.lit(">]")]), F.lit(f"/Info {info} 0 R/Root {root} 0 R/Size "), F.col("n") + 1, F.lit(">>\nstartxref\n"), F.col("xref"), F.lit("\n%%EOF\n"))


def written(objects: DataFrame, encrypt: bool = False, root: int = 1, info: int = 3) -> DataFrame:
    """path and content: one file for each path, for files that fit a row; object 1 is the catalog, 3 the info.

    The bytes are those of parts(), but as a file fits a row, its objects are dealt once, by path, as they are.
    """
    head, foot = F.concat("number", F.lit(" 0 obj\n")), "\nendobj\n"
    before = W.partitionBy("path").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    size = F.length(head) + F.octet_length("body") + len(foot)
    rows = objects.filter("path is not null").select("path", "number", "body").withColumn("size", size).withColumn("offset", F.octet_length(F.lit(HEADER)) + F.coalesce(F.sum("size").over(before), F.lit(0)))
    text = F.concat(head, F.decode("body", "ISO-8859-1"), F.lit(foot))
    files = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("number", "offset", text.alias("text")))).alias("o"), F.max(F.col("offset") + F.col("size")).alias("xref"), F.count("*").alias("n"))
    entries = F.array_join(F.transform("o", lambda x: F.concat(F.lpad(x["offset"].cast("string"), 10, "0"), F.lit(" 00000 n \n"))), "")
    whole = F.concat(F.lit(HEADER.encode().decode("latin-1")), F.array_join(F.transform("o", lambda x: x["text"]), ""), _table_head(), entries, _trailer(encrypt, root, info))
    return files.select("path", F.encode(whole, "ISO-8859-1").alias("content"))


def joined(pieces: DataFrame) -> DataFrame:
    """path and content of pieces (path, offset, data), put together in one pass (bytes as Latin-1 text, which is joined in linear time)."""
    whole = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("p"))  # dealt as bytes, of which text takes half as much again
    return whole.select("path", F.encode(F.array_join(F.transform("p", lambda x: F.decode(x["data"], "ISO-8859-1")), ""), "ISO-8859-1").alias("content"))


def xmp_packet(title: Column, author: Column, language: Column) -> Column:
    """An XMP metadata packet; absent parts are left out."""
    part = lambda tag, c: F.coalesce(F.concat(F.lit(f"<dc:{tag}>"), xml_escape(c), F.lit(f"</dc:{tag}>")), F.lit(""))
    return F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/">'), part("title", title), part("creator", author), part("language", language), F.lit("</rdf:Description></x:xmpmeta>"))


def rect_text(*numbers) -> Column:
    """[x1 y1 x2 y2] as an array's text."""
    return F.concat(F.lit("["), F.concat_ws(" ", *(pdf_number(n if isinstance(n, Column) else F.lit(n)) for n in numbers)), F.lit("]"))
