"""Files read by byte ranges, tokens read in pieces, values as edges, and saved files."""

import os
import pickle
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_pdf import OBJECTS, PAGE, assemble

from quire.operators import edges, text_extract
from quire.sources import lexer, ranges, reader, sink, writer

ALPHABET = [b"(", b")", b"\\", b"<", b">", b"/", b"%", b"\n", b" ", b"[", b"]", b"a", b"12", b"f", b"g", b"R", b"{", b"\x00", b"<<", b">>", b"(a(b)c)", b"<12 3f>", b"/N", b"\\)"]


def some_text(rng, most):
    return b"".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most)))


# --- tokens


def test_sequential_tokens_are_the_readers():
    rng = random.Random(1)
    for _ in range(8000):
        text = some_text(rng, 25)
        assert [t for _, t in lexer.tokens(text)] == reader.lexemes(text), text


def in_pieces(text, cuts, part):
    """What the tasks do, one after the other: tables, parts, states, tokens."""
    import pyarrow as pa

    pieces = [(a, text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    tables = [(at, lexer.table_of(data)) for at, data in pieces]
    begins, now = [], (lexer.BETWEEN, 0, -1)
    for i in range(0, len(tables), part):
        group, state = tables[i : i + part], now
        for at, table in group:
            begins.append(state)
            state = lexer.step(table, at, state)
        now = lexer.step(lexer.composed(group), group[0][0], now)
        assert now[:2] == state[:2] and (now[0] <= lexer.COMMENT or now[2] == state[2])
    columns = {"k": [0] * len(pieces), "offset": [a for a, _ in pieces], "data": [d for _, d in pieces], **{n: [s[i] for s in begins] for i, n in enumerate(("state", "depth", "begin"))}, "last": [i == len(pieces) - 1 for i in range(len(pieces))]}
    rows = next(iter(lexer._emit(["k"])(iter([pa.RecordBatch.from_pydict(columns)])))).to_pylist()
    found, open_ = [(r["at"], r["token"]) for r in rows if r["whole"]], {}
    for r in sorted((r for r in rows if not r["whole"]), key=lambda r: r["offset"]):
        open_[r["at"]] = open_.get(r["at"], b"") + r["token"]
    return sorted(found + [x for at, t in open_.items() for x in lexer.parts_of(t, at)])


def test_any_cut_gives_the_same_tokens():
    rng = random.Random(2)
    for _ in range(5000):
        text = some_text(rng, 18) + b"."
        cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.choice([1, 2, 3, 99]))))
        assert in_pieces(text, cuts, rng.choice([1, 2, 5, 99])) == sorted(lexer.tokens(text)), (text, cuts)


@pytest.mark.parametrize("text", [PAGE, b"<</A(x(y)\\)z)/B<1 2>/C[1 0 R<<>>]>>%c\n/D", b"((((a))b)c", b"<12 <3> > >>", b"(" * 9 + b")" * 12 + b"(\\"])
def test_a_cut_at_every_byte(text):
    assert in_pieces(text, list(range(1, len(text))), 7) == sorted(lexer.tokens(text))
    for i in range(1, len(text)):
        assert in_pieces(text, [i], 1) == sorted(lexer.tokens(text))


def test_streams_in_pieces_on_spark(spark):
    rng = random.Random(3)
    texts = {i: b"".join(some_text(rng, 30) + b" " for _ in range(40)) for i in range(6)} | {6: b"", 7: b"(" + b"x" * 5000, 8: b" "}
    streams = spark.createDataFrame([(i, bytearray(t), "kept") for i, t in texts.items()], "doc bigint, data binary, n string")
    got = {}
    for r in lexer.stream_tokens(lexer.cut(streams, ["doc"], size=37), ["doc"], part=5).collect():
        got.setdefault(r.doc, []).append((r["at"], bytes(r.token)))
    assert {i: sorted(t) for i, t in got.items()} == {i: sorted(lexer.tokens(t)) for i, t in texts.items() if list(lexer.tokens(t))}


# --- ranges


def stream(head, data):
    return head % len(data) + b"\nstream\n" + data + b"\nendstream"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pdf")
    sound, _ = assemble(OBJECTS, b"/Root 1 0 R/Info 6 0 R")
    newer, _ = assemble({6: b"<</Title(newer)>>"}, b"/Root 1 0 R/Info 6 0 R", prev=b"/Prev %d" % sound.index(b"xref\n"), base=sound)
    broken, _ = assemble(OBJECTS, b"/Root 1 0 R/Info 6 0 R", start=99999)
    shifted = sound.replace(b"%PDF-1.3\n", b"%PDF-1.3\n\n\n\n")
    tricky, _ = assemble(OBJECTS | {6: b"<</T(say endobj here 9 0 obj x)/Meta<</Contents 9 0 R/Type/Page>>/K 1>>", 8: b"<</Filter/FlateDecode/Length 99 0 R>>\nstream\r\nabc\r\nendstream"}, b"/Root 1 0 R")
    inner = b"10 0 11 5 (ab) <</Type/Page/N 1>>"
    packed = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[]>>", 3: stream(b"<</Type/ObjStm/N 2/First 10/Length %d>>", inner)}
    body, offsets = b"%PDF-1.5\n", {}
    for n, o in packed.items():
        offsets[n] = len(body)
        body += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    rows = [(0, 0, 65535), *((1, offsets[n], 0) for n in packed), (1, len(body), 0), (2, 3, 0), (2, 3, 1)]
    table = zlib.compress(b"".join(a.to_bytes(1, "big") + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in rows))
    start = len(body)
    body += b"4 0 obj\n" + stream(b"<</Type/XRef/W[1 4 2]/Index[0 5 10 2]/Size 12/Root 1 0 R/Filter/FlateDecode/Length %d>>", table) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % start
    files = {"a.pdf": sound, "in/b.pdf": newer, "c.pdf": broken, "d.pdf": tricky, "e.pdf": b"no file at all", "f.pdf": b"", "g.pdf": body, "h.pdf": shifted, "note.txt": b"x"}
    for name, data in files.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


@pytest.mark.parametrize("entries", [1, 3, 20_000])
def test_objects_by_ranges(spark, folder, entries):
    by = {}
    for r in ranges.read_pdf(spark, folder, entries=entries).collect():
        by.setdefault(os.path.basename(r.path), {})[r.number] = r
    assert set(by) == {f"{x}.pdf" for x in "abcdgh"}
    plain = {n: (r.body, r.data) for n, r in by["a.pdf"].items()}
    assert set(plain) == set(OBJECTS) and bytes(plain[4][1]) == PAGE and not by["a.pdf"][1].repaired
    assert plain == {n: (r.body, r.data) for n, r in by["c.pdf"].items()} == {n: (r.body, r.data) for n, r in by["h.pdf"].items()}
    assert by["c.pdf"][1].repaired and by["h.pdf"][1].repaired
    assert by["b.pdf"][6].body == "<</Title(newer)>>" and {n: r.body for n, r in by["b.pdf"].items() if n != 6} == {n: b for n, (b, _) in plain.items() if n != 6}
    assert by["d.pdf"][6].body == "<</T(say endobj here 9 0 obj x)/Meta<</Contents 9 0 R/Type/Page>>/K 1>>" and by["d.pdf"][6].type is None
    assert bytes(by["d.pdf"][8].data) == b"abc"
    packed = by["g.pdf"]
    assert (packed[10].body, packed[11].body, packed[11].type, packed[11].container, packed[11].place) == ("(ab)", "<</Type/Page/N 1>>", "Page", 3, 1)


def test_filters_reach_the_source(spark, folder, tmp_path):
    pages = ranges.read_pdf(spark, folder).filter("type = 'Page'").select("path", "number").collect()
    assert sorted((os.path.basename(r.path), r.number) for r in pages) == sorted([(f, n) for f in ("a.pdf", "b.pdf", "c.pdf", "d.pdf", "h.pdf") for n in (3, 7)] + [("g.pdf", 11)])
    assert {r.number for r in ranges.read_pdf(spark, folder).filter("number > 2 and number <= 4 or number = 77").collect()} == {3, 4}
    assert {r.number for r in ranges.read_pdf(spark, folder).filter("number in (6, 8) and number >= 7").collect()} == {8}
    assert "type = 'Page'" not in ranges.read_pdf(spark, folder).filter("type = 'Page'")._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    noise = random.Random(1).randbytes(400_000)
    big = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", **{n: b"<</Length 400000>>\nstream\n" + noise + b"\nendstream" for n in range(4, 24)}}
    (tmp_path / "big.pdf").write_bytes(assemble(big, b"/Root 1 0 R")[0])
    every = ranges.read_pdf(spark, str(tmp_path), data=False)
    assert every.count() == 23 and every.agg(F.sum("fetched")).first()[0] < 200_000
    assert every.filter("type = 'Page'").agg(F.sum("fetched")).first()[0] < 200_000
    whole = ranges.read_pdf(spark, str(tmp_path / "big.pdf"), entries=4)
    assert whole.rdd.getNumPartitions() > 3 and whole.filter("number = 9").select(F.octet_length("data")).first()[0] == 400_000
    assert whole.filter("number = 9").agg(F.sum("fetched")).first()[0] < 450_000


def test_ranges_feed_the_reader(spark, folder):
    every = ranges.read_pdf(spark, folder).filter("number < 100").cache()
    found = {os.path.basename(r.path): r.text for r in text_extract.texts(reader.tokens(reader.page_streams(reader.pages(every), every))).collect()}
    assert found["a.pdf"] == "Hello, (World)!\nA BC\ntwo\n" == found["c.pdf"] == found["b.pdf"]


def test_an_empty_folder(spark, tmp_path):
    assert ranges.read_pdf(spark, str(tmp_path)).count() == 0


# --- saving


def test_files_are_named_by_the_commit(spark, tmp_path):
    pages = spark.createDataFrame([("file:/x/y/a.pdf", 0, ["one"]), ("../b.pdf", 0, ["two"]), ("c d.pdf", 0, [])], "path string, page int, lines array<string>")
    sink.save(writer.parts(writer.pdf_objects(pages)), str(tmp_path / "out"))
    names = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, files in os.walk(tmp_path / "out") for f in files if f.endswith(".pdf"))
    assert names == ["b.pdf", "c d.pdf", "x/y/a.pdf"] and not [f for f in os.listdir(tmp_path / "out") if f.startswith(".saving")]
    bad = writer.parts(writer.pdf_objects(pages)).withColumn("data", F.when(F.col("path") == "c d.pdf", F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="no"):
        sink.save(bad, str(tmp_path / "none"))
    assert not [f for _, _, files in os.walk(tmp_path / "none") for f in files if f.endswith(".pdf")]


def test_many_files_are_saved_and_planned_without_their_names_on_the_driver(spark, tmp_path):
    pages = spark.range(300).select(F.concat(F.lit("d/doc-"), "id", F.lit(".pdf")).alias("path"), F.lit(0).alias("page"), F.array(F.col("id").cast("string")).alias("lines"))
    objects = writer.pdf_objects(pages).cache()
    sink.save(writer.parts(objects), str(tmp_path / "out"), folders=True)
    top = os.listdir(tmp_path / "out")
    assert len(top) <= 4 and not [f for f in top if f.startswith(".")]  # a folder for each task
    planned = ranges._Reader({"path": str(tmp_path / "out"), "entries": "1000"}).partitions()
    assert all(isinstance(p, ranges.Names) for p in planned) and 3 <= len(planned) <= 20  # no file is opened on the driver
    assert sum(len(pickle.dumps(p)) for p in planned) < 300 * 20
    every = ranges.read_pdf(spark, str(tmp_path / "out"), entries=1000)
    assert every.count() == 300 * 6 and every.filter("type = 'Page'").select("path").distinct().count() == 300
    whole = {r.path.split("/")[-1]: bytes(r.content) for r in ranges.read_whole(spark, str(tmp_path / "out")).collect()}
    assert whole == {r.path.split("/")[-1]: bytes(r.content) for r in writer.written(objects).collect()}


# --- edges


BODIES = {
    1: "<</A 1/B[1 2[3]<</C(x)>>]/D<</E<</F/G#20H>>>>/A 2>>",
    2: "[12 0 R 5 <4> <> () true null -.5]",
    3: "/Name",
    4: "(a << b)",
    5: "<</K[]/L<<>>/M 7 0 R/N(1 0 R)>>",
    6: "]] 5",
    7: "[" * 60 + "1" + "]" * 60,
    8: "<</A 1/B>>",
    9: "",
}


@pytest.fixture(scope="module")
def nested(spark):
    rows = spark.createDataFrame([("f", n, b) for n, b in BODIES.items()], "path string, number bigint, body string")
    return rows, edges.edges(edges.body_tokens(rows, ["path", "number"]), ["path", "number"]).cache()


def test_edges_and_paths(nested):
    got = {}
    for r in edges.paths(nested[1], ["path", "number"]).collect():
        got.setdefault(r.number, {})[r.node_path + ("!" if r.shadowed else "")] = (r.kind, r.num if r.num is not None else r.ref_number)
    assert got[1] == {"": ("dict", None), "A": ("number", 1), "B": ("array", None), "B/0": ("number", 1), "B/1": ("number", 2), "B/2": ("array", None), "B/2/0": ("number", 3), "B/3": ("dict", None), "B/3/C": ("string", None), "D": ("dict", None), "D/E": ("dict", None), "D/E/F": ("name", None), "A!": ("number", 2)}
    assert [got[2][str(i)] for i in range(8)] == [("ref", 12), ("number", 5), ("binary", None), ("string", None), ("string", None), ("boolean", None), ("null", None), ("number", -0.5)]
    assert got[3] == {"": ("name", None)} and got[4] == {"": ("string", None)}
    assert got[5] == {"": ("dict", None), "K": ("array", None), "L": ("dict", None), "M": ("ref", 7), "N": ("string", None)}
    assert len(got[7]) == 61 and got[7]["/".join(["0"] * 60)] == ("number", 1)
    assert got[8] == {"": ("dict", None), "A": ("number", 1)} and 9 not in got


def test_edges_by_path_and_reference(nested):
    key = ["path", "number"]
    assert [r.token for r in edges.at(nested[1], key, "B", 3, "C").collect()] == ["(x)"]
    assert [r.num for r in edges.at(nested[1], key, "A").collect() if r.number == 1] == [1.0]
    found = {r.ref_number: (r.target_kind, r.target_num) for r in edges.dereferenced(nested[1]).collect()}
    assert found == {12: (None, None), 7: ("array", None)}
    assert edges.edges(edges.body_tokens(nested[0].limit(0), key), key).count() == 0


def test_copies_with_other_references(spark, nested):
    key = ["path", "number"]
    to = spark.createDataFrame([("f", 7, 70), ("g", 12, 5)], "path string, number bigint, new bigint")
    out = {r.number: r.body for r in edges.written(edges.remapped(edges.body_tokens(nested[0], key), key, to), key).collect()}
    assert out[5] == "<</K[]/L<<>>/M 70 0 R/N(1 0 R)>>" and out[2] == "[null 5<4><>()true null -.5]"
    assert out[1] == BODIES[1] and out[7] == BODIES[7]


def test_paths_by_windows_are_those_by_rounds(spark, monkeypatch):
    key = ["path", "number"]
    bodies = [*(b for n, b in BODIES.items() if n != 7), "<<[1]/A/B[2<</C 3>>]>>", "1][2[3]]", "][2]", "<</A<</B 1>>/A[<</B 2>>]/ 5>>", "[[1]]]/A[2]"]
    rows = spark.createDataFrame([("f", n, b) for n, b in enumerate(bodies)], "path string, number bigint, body string")
    found = edges.edges(edges.body_tokens(rows, key), key).cache()
    by_windows = sorted(map(tuple, edges.paths(found, key).select(*key, "node", "node_path", "shadowed").collect()))
    monkeypatch.setattr(edges, "MOST_LEVELS", 0)
    assert by_windows == sorted(map(tuple, edges.paths(found, key).select(*key, "node", "node_path", "shadowed").collect())) and len(by_windows) > 20


def test_tokens_are_dealt_once(spark):
    key = ["path", "number"]
    rows = spark.createDataFrame([("f", n, b) for n, b in BODIES.items()], "path string, number bigint, body string")
    plan = edges.edges(edges.body_tokens(rows, key), key)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("tokens_of(") == 1
