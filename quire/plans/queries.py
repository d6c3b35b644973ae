"""The registered queries and their DuckDB oracles.

Each entry of ORACLES is the same result computed by DuckDB from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs, content, crypt, text, values
from ..operators import markdown, merge, text_extract, trees
from ..sources import reader, writer
from ..sources.scratch import settle, settled_alone
from .files import doc_id, pdf_files, pdf_objects, table

ORACLES: dict[str, str] = {}


def pdf_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each document's PDF: its lines that aren't empty."""
    every = pdf_objects(spark, sf_dir)
    found = text_extract.texts(reader.tokens(reader.page_streams(reader.pages(every), every)))
    rows = every.select("path").distinct().join(found, "path", "left").select(doc_id(), F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_md5"))


ORACLES["pdf_text_roundtrip"] = """
WITH t AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: l <> '') AS l FROM documents),
u AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN '' ELSE array_to_string(l, chr(10)) || chr(10) END AS t FROM t)
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM u
"""


def pdf_info_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document information of each PDF."""
    return reader.file_info(pdf_files(spark, sf_dir)).select(doc_id(), "version", "title", "language", "keywords", "repaired")


ORACLES["pdf_info_roundtrip"] = "SELECT doc_id, '1.4' AS version, source AS title, lang AS language, doc_id::VARCHAR AS keywords, false AS repaired FROM documents"


def pdf_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and pages of each PDF, counted after reading."""
    every = pdf_objects(spark, sf_dir)
    counts = every.groupBy("path").agg(F.count("*").alias("num_objs"))
    return reader.pages(every).groupBy("path").agg(F.count("*").alias("num_pages")).join(counts, "path").select(doc_id(), "num_objs", "num_pages")


ORACLES["pdf_page_count"] = """
SELECT doc_id, (4 + 2 * p)::BIGINT AS num_objs, p::BIGINT AS num_pages
FROM (SELECT doc_id, ceil(len(string_split(coalesce(text, ''), chr(10))) / 54.0) AS p FROM documents)
"""


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("path"), F.concat("source", F.lit(".pdf")).alias("output"), F.col("doc_id").alias("ordinal"))


def pdf_merge_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page stands in the file that all PDFs of a source are merged into."""
    every = pdf_objects(spark, sf_dir)
    return merge.merged_pages(reader.pages(every), _by_source(spark, sf_dir)).select("output", doc_id(), F.col("page_index").cast("bigint").alias("page_index"), F.col("merged_index").cast("bigint").alias("merged_index"))


ORACLES["pdf_merge_page_index"] = """
WITH p AS (SELECT source, doc_id, unnest(range(ceil(len(string_split(coalesce(text, ''), chr(10))) / 54.0)::BIGINT)) AS page_index FROM documents)
SELECT source || '.pdf' AS output, doc_id, page_index, row_number() OVER (PARTITION BY source ORDER BY doc_id, page_index) - 1 AS merged_index FROM p
"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of all PDFs merged by source. A source may hold a third of all rows: its file stays a table of objects."""

    def made() -> DataFrame:
        every = pdf_objects(spark, sf_dir)
        out = merge.merged_objects(every, reader.pages(every), _by_source(spark, sf_dir))
        return out.withColumns({"generation": F.lit(0), "offset": F.lit(0).cast("bigint"), "repaired": F.lit(False)})

    return settled_alone(made, "merged-objects")


def pdf_merge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs merged by source: the text and height of each page of the merged files."""
    again = _merged(spark, sf_dir)
    leaves = reader.pages(again)
    boxes = reader.page_attribute(leaves, again, "MediaBox", "numbers").select("path", "page_index", F.get("value", F.lit(3)).alias("height"))
    found = text_extract.page_texts(reader.tokens(reader.page_streams(leaves, again)))
    rows = boxes.join(found, ["path", "page_index"], "left").withColumn("t", F.coalesce("text", F.lit("")))
    return rows.select(F.col("path").alias("output"), F.col("page_index").cast("bigint").alias("page_index"), "height", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_md5"))


ORACLES["pdf_merge_text"] = """
WITH d AS (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT source, doc_id, l, unnest(range(ceil(len(l) / 54.0)::BIGINT)) AS page FROM d),
k AS (SELECT source, doc_id, page, list_filter(l[54 * page + 1 : 54 * page + 54], lambda x: x <> '') AS l FROM p),
t AS (SELECT source, doc_id, page, CASE WHEN len(l) = 0 THEN '' ELSE array_to_string(l, chr(10)) || chr(10) END AS t FROM k)
SELECT source || '.pdf' AS output, row_number() OVER (PARTITION BY source ORDER BY doc_id, page) - 1 AS page_index, 792.0::DOUBLE AS height, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM t
"""


def pdf_merge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs merged by source: how many objects and pages the merged files have, by their page trees."""
    again = _merged(spark, sf_dir)
    kind = reader.entry(F.col("body"), "Type", "name")
    return again.groupBy(F.col("path").alias("output")).agg(F.count(F.when(kind.isNull() | ~kind.isin("Pages"), 1)).alias("num_objs"), F.count(F.when(kind == "Page", 1)).alias("num_pages"))


ORACLES["pdf_merge_objects"] = """
WITH d AS (SELECT source, ceil(len(string_split(coalesce(text, ''), chr(10))) / 54.0) AS p FROM documents)
SELECT source || '.pdf' AS output, (2 + count(*) + 2 * sum(p))::BIGINT AS num_objs, sum(p)::BIGINT AS num_pages FROM d GROUP BY source
"""


def repair_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose cross-reference start is damaged give the same objects as the sound ones."""
    files = pdf_files(spark, sf_dir)
    damaged = files.select("path", F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("startxref\n"), F.lit("startxref\n9")), "ISO-8859-1").alias("content"))
    sound = settled_alone(lambda: reader.objects(files).select("path", "number", F.md5("body").alias("b"), F.md5("data").alias("d")), "sound")
    mended = settled_alone(lambda: reader.objects(damaged).select("path", "number", F.md5("body").alias("b2"), F.md5("data").alias("d2"), "repaired"), "mended")
    same = F.col("b").eqNullSafe(F.col("b2")) & F.col("d").eqNullSafe(F.col("d2")) & F.col("repaired")
    return sound.join(mended, ["path", "number"], "full").groupBy("path").agg(F.count("*").alias("num_objs"), F.bool_and(F.coalesce(same, F.lit(False))).alias("same")).select(doc_id(), "num_objs", "same")


ORACLES["repair_equivalence"] = "SELECT doc_id, (4 + 2 * ceil(len(string_split(coalesce(text, ''), chr(10))) / 54.0))::BIGINT AS num_objs, true AS same FROM documents"


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each PDF's content streams by kind."""
    every = pdf_objects(spark, sf_dir)
    rows = reader.tokens(reader.page_streams(reader.pages(every), every))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    return rows.groupBy("path").agg(*(count(k) for k in ("hex", "keyword", "number", "name"))).select(doc_id(), "n_hex", "n_keyword", "n_number", "n_name")


ORACLES["token_kinds"] = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
d AS (SELECT doc_id, count(*) AS lines, sum(ceil(length(line) / 200.0))::BIGINT AS chunks FROM l GROUP BY doc_id)
SELECT doc_id, chunks AS n_hex, (chunks + lines + 5 * ceil(lines / 54.0))::BIGINT AS n_keyword, (4 * ceil(lines / 54.0))::BIGINT AS n_number, ceil(lines / 54.0)::BIGINT AS n_name FROM d
"""


def xref_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the objects of each PDF, whose streams are plain, begin by its cross-reference table."""
    entries = reader.xref_entries(reader.xref_sections(pdf_files(spark, sf_dir, compress=False)))
    return entries.filter("used").select(doc_id(), "number", "offset", F.col("generation").cast("bigint").alias("generation"))


ORACLES["xref_offsets"] = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(range(ceil(len(l) / 54.0)::BIGINT)) AS page, l, source, lang FROM d),
line AS (SELECT doc_id, page, unnest(l[54 * page + 1 : 54 * page + 54]) AS x FROM p),
u AS (SELECT doc_id, page, sum(3 + ceil(length(x) / 200.0) * 5 + 4 * (length(x) + length(regexp_replace(x, '[^\U00010000-\U0010FFFF]', '', 'g'))))::BIGINT AS n FROM line GROUP BY doc_id, page),
c AS (SELECT doc_id, page, n + length('BT') + 1 + length('/F1 10 Tf') + 1 + length('12 TL') + 1 + length('36 740 Td') + 1 + length('ET') + 1 AS n FROM u),
h AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, max(page) + 1 AS p FROM p GROUP BY doc_id),
o AS (
  SELECT doc_id, 1 AS number, octet_length(encode('<</Lang(' || lang || ')/Pages 2 0 R/Type/Catalog>>')) AS n FROM h
  UNION ALL SELECT doc_id, 2, length('<</Count ' || p || '/Kids[' || array_to_string(list_transform(range(p), lambda i: (2 * i + 5) || ' 0 R'), ' ') || ']/MediaBox[0 0 612 792]/Resources<</Font<</F1 4 0 R>>>>/Type/Pages>>') FROM h
  UNION ALL SELECT doc_id, 3, length('<</Keywords<FEFF>/Title<FEFF>>>') + 4 * length(doc_id::VARCHAR) + 4 * length(source) FROM h
  UNION ALL SELECT doc_id, 4, length('<</BaseFont/Courier/Encoding/WinAnsiEncoding/Subtype/Type1/Type/Font>>') FROM h
  UNION ALL SELECT doc_id, 5 + 2 * page, length('<</Contents ' || (6 + 2 * page) || ' 0 R/Parent 2 0 R/Type/Page>>') FROM c
  UNION ALL SELECT doc_id, 6 + 2 * page, n + length('<</Length ' || n || '>>') + length('streamendstream') + 3 FROM c)
SELECT doc_id, number::BIGINT AS number, (19 + coalesce(sum(n + length(number || ' 0 obj') + length('endobj') + 3) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", 0::BIGINT AS generation FROM o
"""


def page_attr_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a tree: some customers and nations have an attribute, others inherit it."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r, n, c = F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "c_custkey")
    edges = nation.select(n.alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionByName(customer.select(c.alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))
    attributes = region.select(r.alias("node"), F.col("r_name").alias("value")).unionByName(nation.filter("n_nationkey % 2 = 0").select(n.alias("node"), F.col("n_name").alias("value")))
    attributes = attributes.unionByName(customer.filter("c_custkey % 3 = 0").select(c.alias("node"), F.col("c_name").alias("value")))
    return trees.inherited(customer.select(c.alias("node")), edges, attributes).select(F.substring("node", 2, 20).cast("bigint").alias("c_custkey"), "value")


ORACLES["page_attr_inherited"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def mediabox_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages, boxes by priority: runs of equal boxes."""
    orders = table(spark, sf_dir, "orders")
    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    pages = orders.select("o_custkey", page.cast("bigint").alias("page"), F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "[0 0 612 792]").otherwise("[0 0 595 842]").alias("box"))
    return trees.runs(pages, ["o_custkey"], "page", ["box"]).select("o_custkey", "box", F.col("first").alias("first_page"), F.col("last").alias("last_page"), "n")


ORACLES["mediabox_runs"] = """
WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN '[0 0 612 792]' ELSE '[0 0 595 842]' END AS box FROM orders),
g AS (SELECT *, page - row_number() OVER (PARTITION BY o_custkey, box ORDER BY page) AS k FROM p)
SELECT o_custkey, box, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM g GROUP BY o_custkey, box, k
"""


def dict_typed_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed getters on the events' properties: a key of another type, or none, gives the type's zero."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", values.parsed(F.col("props")).alias("v"))
    v = F.col("v")
    return rows.select("event_id", values.get_number(v, "k").alias("k"), values.get_number(v, "none").alias("missing"), values.get_string(v, "k").alias("as_string"), values.get_boolean(v, "k").alias("as_boolean"), values.kind(values.at(v, "k")).alias("kind"))


ORACLES["dict_typed_get"] = """
SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract(props, '$.k')::DOUBLE ELSE 0 END AS k, 0.0::DOUBLE AS missing,
  CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS as_string, false AS as_boolean,
  CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN json_type(props, '$.k') IS NULL THEN 'none' ELSE 'string' END AS kind FROM events
"""


def dict_keys_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of dictionaries made from the orders, in byte order, after one is set and one removed."""
    orders = table(spark, sf_dir, "orders")
    m = F.create_map(F.lit("Total"), F.col("o_totalprice").cast("string"), F.col("o_orderpriority"), F.lit("x"), F.lit("Status"), F.col("o_orderstatus"))
    rows = orders.select("o_orderkey", values.without_key(values.with_key(m, "Cust", F.col("o_custkey").cast("string")), "Status").alias("m"))
    return rows.select("o_orderkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.size("m").cast("bigint").alias("n"), F.element_at("m", "Cust").alias("cust"))


ORACLES["dict_keys_sorted"] = """
SELECT o_orderkey, array_to_string(list_sort([o_orderpriority, 'Cust', 'Total']), ',') AS keys, 3::BIGINT AS n, o_custkey::VARCHAR AS cust FROM orders
"""


def pdf_date_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written as PDF dates, in UTC and with an offset, and parsed."""
    rows = table(spark, sf_dir, "events").select("event_id", text.pdf_date(F.col("ts")).alias("d"))
    shifted = F.concat(F.regexp_replace("d", "Z$", ""), F.lit("+02'30'"))
    at = lambda c: F.unix_timestamp(text.parse_pdf_date(c))
    return rows.select("event_id", F.col("d").alias("pdf_date"), at(F.col("d")).alias("seconds"), at(shifted).alias("shifted"), at(F.replace("d", F.lit("D:"), F.lit("E:"))).alias("no_date"))


ORACLES["pdf_date_roundtrip"] = """
SELECT event_id, strftime(ts, 'D:%Y%m%d%H%M%SZ') AS pdf_date, epoch(date_trunc('second', ts))::BIGINT AS seconds, (epoch(date_trunc('second', ts)) - 9000)::BIGINT AS shifted, NULL::BIGINT AS no_date FROM events
"""


def code128_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code 128 B of part names: symbols, and the check symbol."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("s"))
    return rows.select("p_partkey", text.code128_checksum(F.col("s")).cast("bigint").alias("checksum"), F.size(text.code128_symbols(F.col("s"))).cast("bigint").alias("n_symbols"))


ORACLES["code128_checksum"] = """
SELECT p_partkey, ((104 + coalesce(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: (ascii(substr(p_name, i, 1)) - 32) * i)), 0)) % 103)::BIGINT AS checksum, (length(p_name) + 3)::BIGINT AS n_symbols FROM part
"""


def text_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of part names in two base fonts."""
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.round(text.text_width(F.col("p_name"), 12.0), 4).alias("helvetica"), F.round(text.text_width(F.col("p_name"), 10.0, "Courier"), 4).alias("courier"))


ORACLES["text_width"] = f"""
SELECT p_partkey, round(coalesce(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: {list(text.HELVETICA)}[ascii(substr(p_name, i, 1)) - 31])), 0) * 12.0 / 1000, 4)::DOUBLE AS helvetica,
  round(length(p_name) * 600 * 10.0 / 1000, 4)::DOUBLE AS courier FROM part
"""


def pdf_string_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as literal strings."""
    s = text.pdf_literal(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(s).alias("literal_md5"), F.length(s).cast("bigint").alias("n"))


ORACLES["pdf_string_escape"] = r"""
WITH e AS (SELECT doc_id, '(' || replace(replace(replace(replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)'), chr(9), '\011'), chr(10), '\012'), chr(13), '\015') || ')' AS s FROM documents)
SELECT doc_id, md5(s) AS literal_md5, length(s)::BIGINT AS n FROM e
"""


def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' HTML escaped for XML, and an XMP packet with it as the title."""
    rows = table(spark, sf_dir, "pages")
    s = text.xml_escape(F.col("html"))
    packet = writer.xmp_packet(F.col("url"), F.lit(None).cast("string"), F.lit("en"))
    return rows.select("page_id", F.md5(s).alias("escaped_md5"), F.length(packet).cast("bigint").alias("packet_length"))


ORACLES["xml_escape"] = """
WITH e AS (SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS s, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS u FROM pages)
SELECT page_id, md5(s) AS escaped_md5, (length('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/">') + coalesce(length('<dc:title></dc:title>') + length(u), 0) + length('<dc:language>en</dc:language></rdf:Description></x:xmpmeta>'))::BIGINT AS packet_length FROM e
"""


def utf16_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as UTF-16 hex strings and back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    h = text.utf16_hex(F.col("t"))
    return rows.select("conv_id", "turn", F.md5(h).alias("hex_md5"), F.md5(text.from_utf16_hex(h)).alias("back_md5"))


# Code units by the definition of UTF-16: characters beyond the basic plane take two.
ORACLES["utf16_hex"] = """
SELECT conv_id, turn, md5(array_to_string(list_transform(range(1, length(text) + 1), lambda i:
  CASE WHEN unicode(substr(text, i, 1)) < 65536 THEN printf('%04X', unicode(substr(text, i, 1)))
  ELSE printf('%04X', 55296 + (unicode(substr(text, i, 1)) - 65536) // 1024) || printf('%04X', 56320 + (unicode(substr(text, i, 1)) - 65536) % 1024) END), '')) AS hex_md5,
  md5(text) AS back_md5 FROM conversations
"""


def target_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets made from documents' first lines."""
    first = F.regexp_extract("text", r"^([^\n]*)", 1)
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(first).alias("slug"))


ORACLES["target_slug"] = "SELECT doc_id, lower(regexp_replace(replace(string_split(text, chr(10))[1], ' ', '-'), '[^A-Za-z0-9.-]', '', 'g')) AS slug FROM documents"


def outline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline of customers (level 1), their orders (2) and order lines (3): parents, siblings, children."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    top = orders.select("o_custkey", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(1).alias("level")).distinct()
    mid = orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(2).alias("level"))
    low = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("o_custkey", F.col("o_orderkey").alias("a"), F.col("l_linenumber").cast("bigint").alias("b"), F.lit(3).alias("level")).distinct()
    rows = top.unionByName(mid).unionByName(low).withColumn("item", F.row_number().over(W.partitionBy("o_custkey").orderBy("a", "b", "level")).cast("bigint"))
    return trees.outline(rows, "o_custkey", "item").select("o_custkey", "item", "level", "parent", "prev", "next", "first", "last", "count")


ORACLES["outline_links"] = """
WITH t AS (SELECT DISTINCT o_custkey, 0::BIGINT AS a, 0::BIGINT AS b, 1 AS level FROM orders UNION ALL SELECT o_custkey, o_orderkey, 0, 2 FROM orders
  UNION ALL (SELECT DISTINCT o_custkey, o_orderkey, l_linenumber::BIGINT, 3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
i AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a, b, level) AS item FROM t),
p AS (SELECT i.*, CASE level WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE max(CASE WHEN level = 2 THEN item END) OVER (PARTITION BY o_custkey, a) END AS parent FROM i),
s AS (SELECT *, lag(item) OVER w AS prev, lead(item) OVER w AS next FROM p WINDOW w AS (PARTITION BY o_custkey, parent, level ORDER BY item)),
c AS (SELECT o_custkey, parent, min(item) AS f, max(item) AS l, count(*) AS n FROM p WHERE parent IS NOT NULL GROUP BY o_custkey, parent)
SELECT s.o_custkey, s.item, s.level, s.parent, s.prev, s.next, c.f AS first, c.l AS last, coalesce(c.n, 0) AS count FROM s LEFT JOIN c ON c.o_custkey = s.o_custkey AND c.parent = s.item
"""


def table_col_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of order lines, one for each supplier, whose columns are the line numbers: column widths on a narrow page."""
    cell = F.concat(F.regexp_replace(F.format_string("%.2f", F.col("l_extendedprice")), "^", ""), F.lit(" "), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("pieces and more"))
    cells = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("bigint").alias("col"), cell.alias("cell"))
    out = trees.column_widths(cells, ["l_suppkey"], "col", text.text_width(F.col("cell"), 10.0, "Courier"), 8.0, 500.0)
    return out.select("l_suppkey", "col", F.round("width", 6).alias("width"))


ORACLES["table_col_widths"] = """
WITH c AS (SELECT l_suppkey, l_linenumber::BIGINT AS col, max(length(printf('%.2f', l_extendedprice) || ' ' || CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE 'pieces and more' END)) * 6.0 + 8 AS need FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, sum(need) OVER w AS total, 500.0 / count(*) OVER w AS fair FROM c WINDOW w AS (PARTITION BY l_suppkey)),
l AS (SELECT *, sum(CASE WHEN need > fair THEN need END) OVER (PARTITION BY l_suppkey) AS large FROM t)
SELECT l_suppkey, col, round((CASE WHEN total > 500 AND need > fair THEN need * (1 - (total - 500) / large) ELSE need END)::DOUBLE, 6)::DOUBLE AS width FROM l
"""


def file_id_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of files: the hash of name, creation date and both ids."""
    rows = reader.trailers(pdf_files(spark, sf_dir))
    return rows.select(doc_id(), F.sha2(F.concat("path", F.lit("0"), F.get("id", F.lit(0)), F.get("id", F.lit(1))), 256).alias("file_id"))


ORACLES["file_id_sha256"] = "SELECT doc_id, sha256('doc-' || doc_id || '.pdf' || '0' || md5('doc-' || doc_id || '.pdf') || md5('doc-' || doc_id || '.pdf')) AS file_id FROM documents"


def permission_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as permission masks."""
    mask = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(values.permits(mask, r).alias(r) for r in values.PERMISSIONS))


ORACLES["permission_bits"] = "SELECT o_orderkey, " + ", ".join(f"(o_orderkey & {b}) <> 0 AS {r}" for r, b in values.PERMISSIONS.items()) + " FROM orders"


def object_map_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each supplier's order lines refer to, copied once each, numbered by first use."""
    out = trees.first_appearance(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], "l_partkey", 4)
    return out.select("l_suppkey", "l_partkey", F.col("number").cast("bigint").alias("number"))


ORACLES["object_map_dedupe"] = """
WITH f AS (SELECT l_suppkey, l_partkey, min((l_orderkey, l_linenumber)) AS seen FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY seen, l_partkey) + 3 AS number FROM f
"""


def cid_width_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values as glyph widths by user: runs of equal width, as a font's width array has them."""
    rows = table(spark, sf_dir, "events")
    cid = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    widths = rows.select("user_id", cid.alias("cid"), (F.floor(F.col("value") / 50) * 50).cast("bigint").alias("width"))
    return trees.runs(widths, ["user_id"], "cid", ["width"]).select("user_id", F.col("first").alias("first_cid"), F.col("last").alias("last_cid"), "width")


ORACLES["cid_width_runs"] = """
WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cid, (floor(value / 50) * 50)::BIGINT AS width FROM events),
g AS (SELECT *, cid - row_number() OVER (PARTITION BY user_id, width ORDER BY cid) AS k FROM w)
SELECT user_id, min(cid) AS first_cid, max(cid) AS last_cid, width FROM g GROUP BY user_id, width, k
"""


def bytes_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of an image line for widths, colours and depths taken from order lines."""
    width, colors, bits = F.col("l_partkey"), F.col("l_linenumber"), F.when(F.col("l_linestatus") == "O", 1).otherwise(8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", content.bytes_per_line(width, colors, bits).alias("n_bytes"))


ORACLES["bytes_per_line"] = "SELECT l_orderkey, l_linenumber, (l_partkey * l_linenumber * (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 8 END) + 7) // 8 AS n_bytes FROM lineitem"


def color_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour matrices whose primaries vary with the parts."""
    d = F.col("p_size") / 10000
    m = content.color_matrix((F.lit(0.3127), F.lit(0.3290)), (d + 0.64, F.lit(0.33)), (d + 0.30, F.lit(0.60)), (F.lit(0.15), d + 0.06))
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(v, 6).alias(k) for k, v in m.items()))


def _oracle_matrix() -> str:
    r, g, b, w = (("(d + 0.64)", "0.33"), ("(d + 0.30)", "0.60"), ("0.15", "(d + 0.06)"), ("0.3127", "0.3290"))
    xyz = lambda p: [f"({p[0]} / {p[1]})", "1.0", f"((1 - {p[0]} - {p[1]}) / {p[1]})"]
    r, g, b, w = map(xyz, (r, g, b, w))
    det = lambda a, b, c: " + ".join(f"{a[i]} * ({b[(i + 1) % 3]} * {c[(i + 2) % 3]} - {b[(i + 2) % 3]} * {c[(i + 1) % 3]})" for i in range(3))
    scale = {"r": det(w, g, b), "g": det(r, w, b), "b": det(r, g, w)}
    cells = [f"round((({scale[c]}) / ({det(r, g, b)}) * {p[i]})::DOUBLE, 6) AS {axis}{c}" for c, p in (("r", r), ("g", g), ("b", b)) for i, axis in enumerate("xyz")]
    return f"SELECT p_partkey, {', '.join(cells)} FROM (SELECT p_partkey, p_size::DOUBLE / 10000 AS d FROM part)"


ORACLES["color_matrix"] = _oracle_matrix()


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts through Flate, ASCII 85 and PNG predictors and back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    rows = rows.withColumn("flat", codecs.ascii85_encode(codecs.deflate("b")))
    four = F.rpad("b", ((F.floor(F.octet_length("b") / 12) + 1) * 12).cast("int"), F.unhex(F.lit("20")))
    rows = rows.withColumn("rows", four).withColumn("up", codecs.deflate(codecs.png_predict("rows", F.lit(2), F.lit(3), F.lit(4)))).withColumn("sub", codecs.deflate(codecs.png_predict("rows", F.lit(1), F.lit(3), F.lit(4))))
    one, eight, flate = F.lit(1), F.lit(8), F.array(F.lit("FlateDecode"))
    back = codecs.decode("flat", F.array(F.lit("ASCII85Decode"), F.lit("FlateDecode")), one, one, eight, one)
    up, sub = (codecs.decode(c, flate, F.lit(12), F.lit(3), eight, F.lit(4)) for c in ("up", "sub"))
    rows = rows.withColumn("back", back).withColumn("up", up).withColumn("sub", sub)
    return rows.select("doc_id", F.md5("back").alias("text_md5"), (F.col("up") == F.col("rows")).alias("up"), (F.col("sub") == F.col("rows")).alias("sub"))


ORACLES["codec_roundtrip"] = "SELECT doc_id, md5(text) AS text_md5, true AS up, true AS sub FROM documents"


def crypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations enciphered with object keys of the standard handler (RC4 and AES) and deciphered."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("b"))
    owner = crypt.owner_digest(F.lit("owner"))
    key = crypt.file_key(F.col("role_key"), F.concat(owner, owner), F.lit(-4), F.unhex(F.md5(F.col("conv_id").cast("string").cast("binary"))))
    rows = rows.withColumn("role_key", F.concat(F.lit("user"), F.col("conv_id"))).withColumn("key", key)
    rows = rows.withColumn("rc4_key", crypt.object_key(F.col("key"), F.col("turn"), F.lit(0), False)).withColumn("aes_key", crypt.object_key(F.col("key"), F.col("turn"), F.lit(0), True))
    rows = rows.withColumn("r", crypt.rc4(F.col("b"), F.col("rc4_key"))).withColumn("a", crypt.aes_encrypted(F.col("b"), F.col("aes_key"), F.unhex(F.md5("b"))))
    rows = rows.withColumn("r2", crypt.rc4(F.col("r"), F.col("rc4_key"))).withColumn("a2", crypt.aes_decrypted(F.col("a"), F.col("aes_key")))
    return rows.select("conv_id", "turn", F.md5("r2").alias("rc4_md5"), F.md5("a2").alias("aes_md5"), (F.octet_length("a") - F.octet_length("b") > 16).alias("padded"), F.octet_length("r").cast("bigint").alias("n"))


ORACLES["crypt_roundtrip"] = "SELECT conv_id, turn, md5(text) AS rc4_md5, md5(text) AS aes_md5, true AS padded, octet_length(encode(text))::BIGINT AS n FROM conversations"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading for each turn, its text quoted, a link and a list."""
    rows = table(spark, sf_dir, "conversations")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9., ]", " ")
    one = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn"), F.lit("\n\n> "), body, F.lit("\n\n- **item** one\n- `two`\n\nSee [turn](#t"), F.col("turn"), F.lit(").\n"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", one.alias("one")))), lambda x: x["one"]), "\n").alias("text"))


def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the conversations' Markdown."""
    rows = markdown.blocks(_markdown(spark, sf_dir), "conv_id").filter("kind = 'heading'")
    return rows.select("conv_id", F.col("text").alias("heading"), F.col("level").cast("bigint").alias("level"), text.slug(F.col("text")).alias("target"))


ORACLES["md_headings"] = "SELECT conv_id, role || ' ' || turn AS heading, 2::BIGINT AS level, lower(role || '-' || turn) AS target FROM conversations"


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, links and inline pieces of the conversations' Markdown, counted."""
    rows = settle(markdown.blocks(_markdown(spark, sf_dir), "conv_id"), "md")
    found = rows.groupBy("conv_id", "kind").agg(F.count("*").alias("n"))
    links = markdown.links(rows, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.lit("link").alias("kind"), "n")
    inline = markdown.inline(rows, "conv_id").groupBy("conv_id", "kind").agg(F.count("*").alias("n"))
    return found.unionByName(links).unionByName(inline)


ORACLES["md_blocks"] = """
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, k.kind, (n * k.f)::BIGINT AS n FROM c, (VALUES ('heading', 1), ('quote', 1), ('bullet', 2), ('paragraph', 1), ('link', 1), ('strong', 1), ('code', 1)) k(kind, f)
"""


def rect_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made from parts; those without four numbers are zero."""
    p = F.col("p_size").cast("double")
    box = F.when(F.col("p_partkey") % 3 == 0, F.array(p, p)).otherwise(F.array(p, p + 1, p + 2, F.col("p_retailprice")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.parse_json(F.to_json(F.struct(box.alias("MediaBox")))).alias("v"))
    return rows.select("p_partkey", values.get_rect(F.col("v"), "MediaBox").alias("r")).select("p_partkey", "r.*")


ORACLES["rect_get"] = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END::DOUBLE AS x1, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size + 1 END::DOUBLE AS y1,
  CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size + 2 END::DOUBLE AS x2, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END::DOUBLE AS y2 FROM part
"""


def content_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines drawn: a filled bar for each, its label, and a dashed rule."""
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    drawn = F.concat(
        content.save(), content.fill_rgb(0.2, 0.4, F.col("l_discount")), content.path_rect(36, F.col("l_linenumber") * 20, q, 10), content.fill(),
        content.text_begin(), content.text_font(F.lit("F1"), 8), content.text_move_to(q + 40, 2.5), content.text_show(F.concat(flag, F.lit("(1)"))), content.text_end(),
        content.dash(0, 3, F.when(flag == "R", 3.0).otherwise(1.5)), content.path_move_to(0, 0), content.path_line_to(q, 0), content.stroke(), content.restore(),
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.md5(drawn).alias("drawn_md5"))


def _oracle_content() -> str:
    num = lambda x: f"CASE WHEN regexp_replace(printf('%.6f', ({x})::DOUBLE), '\\.?0+$', '') IN ('', '-0') THEN '0' ELSE regexp_replace(printf('%.6f', ({x})::DOUBLE), '\\.?0+$', '') END"
    line = lambda op, *xs: " || ".join([*(f"({num(x)}) || ' '" for x in xs), f"'{op}' || chr(10)"])
    parts = [
        line("q"), line("rg", 0.2, 0.4, "l_discount"), line("re", 36, "l_linenumber * 20", "l_quantity", 10), line("f"), line("BT"), "'/F1 8 Tf' || chr(10)", line("Td", "l_quantity + 40", 2.5),
        "'(' || l_returnflag || '\\(1\\))Tj' || chr(10)", line("ET"), "CASE WHEN l_returnflag = 'R' THEN '[3] 0 d' ELSE '[3 1.5] 0 d' END || chr(10)", line("m", 0, 0), line("l", "l_quantity", 0), line("S"), line("Q"),
    ]
    return f"SELECT l_orderkey, l_linenumber, l_partkey, md5({' || '.join(parts)}) AS drawn_md5 FROM lineitem"


ORACLES["content_operators"] = _oracle_content()

QUERIES = {name: globals()[name] for name in ORACLES}
