"""PDF files by hand and by the writer: reading, repair, streams, text, merging."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import merge, secure, text_extract
from quire.sources import reader, writer
from quire.streaming import incoming


def assemble(objects, trailer, start=None, prev=b"", base=b"%PDF-1.3\n"):
    out, offsets = base, {}
    for n, body in objects.items():
        offsets[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    xref = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in offsets.items())
    return out + b"trailer\n<<%s%s>>\nstartxref\n%d\n%%%%EOF\n" % (trailer, prev, xref if start is None else start), xref


PAGE = b"BT /F1 12 Tf 72 700 Td (Hello, \\(World\\)!) Tj T* [(A) -200 (B) 20 (C)] TJ ET"
OBJECTS = {
    1: b"<</Type/Catalog/Pages 2 0 R/Lang(en-CA)>>",
    2: b"<</Type/Pages/Kids[3 0 R 9 0 R]/Count 2/MediaBox[0 0 612 792]>>",
    3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/MediaBox[0 0 200 300]>>",
    4: b"<</Length 5 0 R>>\nstream\n" + PAGE + b"\nendstream",
    5: b"%d" % len(PAGE),
    6: b"<</Title(A \\(nested\\) title)/Author<FEFF00E90041>/CreationDate(D:20200101000000Z)>>",
    7: b"<</Type/Page/Parent 9 0 R/Contents[8 0 R]>>",
    8: b"<</Filter/FlateDecode/Length %d>>\nstream\n" % len(zlib.compress(b"BT (two) ' ET")) + zlib.compress(b"BT (two) ' ET") + b"\nendstream",
    9: b"<</Type/Pages/Parent 2 0 R/Kids[7 0 R]/Count 1>>",
}


@pytest.fixture(scope="module")
def files(spark):
    sound, _ = assemble(OBJECTS, b"/Root 1 0 R/Info 6 0 R")
    newer, _ = assemble({6: b"<</Title(newer)>>"}, b"/Root 1 0 R/Info 6 0 R", prev=b"/Prev %d" % sound.index(b"xref\n"), base=sound)
    broken, _ = assemble(OBJECTS, b"/Root 1 0 R/Info 6 0 R", start=99999)
    cyclic, at = assemble(OBJECTS, b"/Root 1 0 R/Info 6 0 R", prev=b"/Prev %d" % sound.index(b"xref\n"))
    rows = [("a.pdf", sound), ("b.pdf", newer), ("c.pdf", broken), ("d.pdf", cyclic), ("e.pdf", b"no file at all"), ("f.pdf", b"")]
    return spark.createDataFrame(rows, "path string, content binary").cache()


@pytest.fixture(scope="module")
def every(files):
    return reader.objects(files).cache()


def test_objects_of_tables_chains_and_damage(every):
    by = {}
    for r in every.collect():
        by.setdefault(r.path, {})[r.number] = r
    assert set(by) == {"a.pdf", "b.pdf", "c.pdf", "d.pdf"}
    assert all(set(v) == set(OBJECTS) for v in by.values())
    assert not by["a.pdf"][1].repaired and by["c.pdf"][1].repaired
    assert {n: (r.body, r.data) for n, r in by["a.pdf"].items()} == {n: (r.body, r.data) for n, r in by["c.pdf"].items()} == {n: (r.body, r.data) for n, r in by["d.pdf"].items()}
    assert by["b.pdf"][6].body == "<</Title(newer)>>" and bytes(by["a.pdf"][4].data) == PAGE


def test_file_information(files):
    by = {r.path: r for r in reader.file_info(files).collect()}
    assert (by["a.pdf"].version, by["a.pdf"].title, by["a.pdf"].author, by["a.pdf"].language) == ("1.3", "A (nested) title", "éA", "en-CA")
    assert by["b.pdf"].title == "newer" and by["e.pdf"].version is None and len(by) == 6


def test_pages_in_order_with_inherited_boxes(every):
    leaves = reader.pages(every)
    got = {(r.path, r.page_index): r.number for r in leaves.collect()}
    assert got[("a.pdf", 0)] == 3 and got[("a.pdf", 1)] == 7 and len(got) == 8
    boxes = {(r.path, r.page_index): r.value for r in reader.page_attribute(leaves, every, "MediaBox", "numbers").collect()}
    assert boxes[("a.pdf", 0)] == [0, 0, 200, 300] and boxes[("a.pdf", 1)] == [0, 0, 612, 792]


def test_text_rules(every):
    found = {r.path: r.text for r in text_extract.texts(reader.tokens(reader.page_streams(reader.pages(every), every))).collect()}
    assert found["a.pdf"] == "Hello, (World)!\nA BC\ntwo\n" == found["c.pdf"]


def test_values(spark):
    rows = [(1, "<</A[1 -2.5 (x\\)) <4> /N#20m 12 0 R true null]/B<</C<>>>/A 7>>"), (2, "[(a(b)c) (D\\101)]")]
    df = spark.createDataFrame(rows, "number bigint, body string").withColumn("path", F.lit("p"))
    got = {r.number: r.j for r in reader.values(df).select("number", F.to_json("value").alias("j")).collect()}
    assert got[1] == '{"A":[1,-2.5,"x)",{"$bin":"40"},{"$name":"N m"},{"$ref":[12,0]},true,null],"B":{"C":""}}'
    assert got[2] == '["a(b)c","DA"]'
    with pytest.raises(ValueError):
        reader.value_of(["["] * 40)


def test_written_files_read_back_and_merge(spark):
    docs = spark.createDataFrame([(1, "one\n\ntwo (2) \\ é日\n" + "x" * 900), (2, "y\n" * 120), (3, ""), (4, None)], "doc_id bigint, text string")
    info = docs.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("path"), F.lit("Tïtle <&>").alias("title"), F.lit("de").alias("language"))
    files = writer.written(writer.pdf_objects(writer.pages_of(docs), info)).cache()
    every = reader.objects(files).cache()
    assert every.filter("repaired").count() == 0
    leaves = reader.pages(every).cache()
    texts = {r.path: r.text for r in text_extract.texts(reader.tokens(reader.page_streams(leaves, every))).collect()}
    assert texts == {"doc-1.pdf": "one\ntwo (2) \\ é日\n" + "x" * 900 + "\n", "doc-2.pdf": "y\n" * 120}
    assert {r.title for r in reader.file_info(files, every).collect()} == {"Tïtle <&>"}
    inputs = spark.createDataFrame([(f"doc-{i}.pdf", "all.pdf", -i) for i in range(1, 5)], "path string, output string, ordinal int")
    joined = writer.written(merge.merged(every, leaves, inputs)).cache()
    again = reader.objects(joined).cache()
    assert again.filter("repaired").count() == 0
    pages = reader.pages(again)
    assert pages.count() == leaves.count() == 6
    assert text_extract.texts(reader.tokens(reader.page_streams(pages, again))).first().text == texts["doc-2.pdf"] + texts["doc-1.pdf"]
    assert again.filter("body like '%BaseFont%'").count() == 4  # one font for each input file
    boxes = reader.page_attribute(pages, again, "MediaBox", "numbers").collect()
    assert all(r.value == [0, 0, 612, 792] for r in boxes)


def test_files_from_a_folder_and_a_stream(spark, tmp_path):
    sound, _ = assemble(OBJECTS, b"/Root 1 0 R/Info 6 0 R")
    for n in ("x.pdf", "y.pdf", "z.txt"):
        (tmp_path / n).write_bytes(sound)
    assert reader.file_info(reader.read_files(spark, str(tmp_path))).count() == 2
    query = incoming.incoming(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.version, r.num_objs, r.num_pages) for r in spark.table("arrived").collect()] == [("1.3", 9, 2)] * 2
    counts = incoming.arrivals(incoming.incoming(spark, str(tmp_path))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").selectExpr("sum(files)", "sum(pages)").first()[:] == (2, 4)


def test_object_streams_and_cross_reference_streams(spark):
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 9 9]>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", 6: b"<</Title(packed)>>"}
    head, data = b"", b""
    for n, body in inner.items():
        head += b"%d %d " % (n, len(data))
        data += body + b"\n"
    packed = zlib.compress(head + data)
    text = b"BT (in a stream) Tj ET"
    out = b"%PDF-1.5\n4 0 obj\n<</Length " + b"%d" % len(text) + b">>\nstream\n" + text + b"\nendstream\nendobj\n"
    out += b"5 0 obj\n<</Type/ObjStm/N 4/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    at = len(out)
    out += b"7 0 obj\n<</Type/XRef/Size 8/W[1 2 1]/Root 1 0 R/Info 6 0 R/Length 0>>\nstream\n\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    files = spark.createDataFrame([("o.pdf", out)], "path string, content binary")
    every = reader.objects(files).cache()
    assert {r.number for r in every.collect()} == {1, 2, 3, 4, 5, 6, 7}
    assert reader.file_info(files, every).first().title == "packed"
    leaves = reader.pages(every)
    assert text_extract.texts(reader.tokens(reader.page_streams(leaves, every))).first().text == "in a stream\n"


@pytest.mark.parametrize("method", ["rc4-40", "rc4", "aes"])
def test_locked_files_open_with_the_password_only(spark, method):
    body = "<</Length 0>>"
    plain = spark.createDataFrame([("l.pdf", 1, "<</Type/Catalog>>", None), ("l.pdf", 2, body, b"secret words"), ("l.pdf", 3, "<<>>", None)], "path string, number bigint, body string, data binary")
    file_id = F.unhex(F.md5(F.col("path")))
    shut = secure.locked(plain, file_id, method, -4, "owner", "user").cache()
    objects = shut.select("path", "number", F.when(F.col("data").isNull(), F.col("body").cast("binary")).otherwise(writer.stream(F.col("data"))).alias("body"))
    files = writer.written(objects, encrypt=True).cache()
    every = reader.objects(files).cache()
    assert bytes(every.filter("number = 2").first().data) != b"secret words"
    opened = {p: bytes(secure.unlocked(files, every, F.lit(p)).filter("number = 2").first().data) for p in ("user", "owner", "wrong")}
    assert opened["user"] == opened["owner"] == b"secret words" and opened["wrong"] == bytes(every.filter("number = 2").first().data)
    assert secure.handlers(files, every).first().method == method


@pytest.mark.parametrize(
    ("body", "key", "what", "value"),
    [
        ("<</Meta<</Contents 9 0 R>>/Contents 5 0 R/Type/Page>>", "Contents", "ref", 5),
        ("<</T(/Contents 7 0 R)/Kids[1 0 R 2 0 R]>>", "Contents", "ref", None),
        ("<</T(/Contents 7 0 R)/Kids[1 0 R 2 0 R]>>", "Kids", "refs", [1, 2]),
        ("<</A[/Contents 1 0 R]/Contents[4 0 R 5 0 R]>>", "Contents", "ref", None),
        ("<</A[/Contents 1 0 R]/Contents[4 0 R 5 0 R]>>", "Contents", "refs", [4, 5]),
        ("<</In<</Length 3>>>>", "Length", "int", None),
        ("<</Length 12/In<</Length 3>>>>", "Length", "int", 12),
    ],
)
def test_entries_are_the_dictionarys_own(spark, body, key, what, value):
    assert spark.createDataFrame([(body,)], "b string").select(reader.entry(F.col("b"), key, what)).first()[0] == value


def test_words_of_the_syntax_within_strings(spark):
    tricky = OBJECTS | {6: b"<</T(say endobj here 9 0 obj stream\n x)/K 1>>", 10: b"<</N(a stream\n b)/Length 3>>\nstream\nabc\nendstream"}
    data, _ = assemble(tricky, b"/Root 1 0 R")
    got = {r.number: r for r in reader.objects(spark.createDataFrame([("t.pdf", data)], "path string, content binary")).collect()}
    assert got[6].body == tricky[6].decode() and got[10].body == "<</N(a stream\n b)/Length 3>>" and bytes(got[10].data) == b"abc" and len(got) == 10
