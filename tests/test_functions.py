"""Scalar functions: text, values, codecs, ciphers, content operators, trees, Markdown."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import codecs, content, crypt, text, values
from quire.operators import markdown, trees


def one(spark, column, **cells):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items())).select(column).first()[0]


def test_lzw_vector():
    assert codecs.from_lzw(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"


def test_rc4_vector():
    assert codecs.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("how", [10, 11, 12, 13, 14])
def test_png_predictors(how):
    """Rows of an RGB image, predicted here by the definition, undone by the codec."""
    y, x = np.mgrid[0:32, 0:32]
    image = np.stack([y, y + x, y - x], axis=2).astype(np.uint8).reshape(32, 96).astype(int)
    out, above = b"", np.zeros(96, int)
    for row in image:
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][how - 10]
        out += bytes([how - 10]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    assert codecs.unpredicted(out, 15, 3, 8, 32) == image.astype(np.uint8).tobytes()


def test_tiff_predictor_and_ascii85():
    rows = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert codecs.unpredicted(np.diff(rows, axis=1, prepend=np.zeros((2, 1, 3), np.uint8)).astype(np.uint8).tobytes(), 2, 3, 8, 4) == rows.tobytes()
    assert codecs.from_ascii85(b"87cU RD]~>") == b"Hello " [:5] + codecs.from_ascii85(b"87cURD]~>")[5:]
    assert codecs.undone(b"x", ["DCTDecode"], 1, 1, 8, 1) is None


@pytest.mark.parametrize("s,seconds", [("D:2011", 1293840000), ("D:20110505091515Z", 1304586915), ("D:20110505091515-05'00'", 1304604915), ("D:201105", 1304208000), ("2011/05/05", None), ("D:201", None), ("D:19600101", None), ("D:20111345", None)])
def test_pdf_dates(spark, s, seconds):
    assert one(spark, F.unix_timestamp(text.parse_pdf_date(F.col("s"))), s=s) == seconds


def test_numbers_names_and_strings(spark):
    for x, want in ((612.5, "612.5"), (100.0, "100"), (0.1, "0.1"), (0.0, "0"), (-0.0000001, "0"), (-2.25, "-2.25")):
        assert one(spark, text.pdf_number(F.col("x")), x=x) == want
    assert one(spark, text.pdf_name(F.col("s")), s="A B#é") == "/A#20B#23#C3#A9"
    assert one(spark, text.pdf_literal(F.col("s")), s="a(b)\\\n") == "(a\\(b\\)\\\\\\012)"
    assert one(spark, text.from_utf16_hex(text.utf16_hex(F.col("s"))), s="é日🎉") == "é日🎉"
    assert one(spark, text.slug(F.col("s")), s="A b.C-d!é") == "a-b.c-d"


def test_code128(spark):
    assert one(spark, text.code128_symbols(F.col("s")), s="PJJ123C") == [104, 48, 42, 42, 17, 18, 19, 35, 55, 106]
    assert one(spark, text.code128_checksum(F.col("s")), s="") == 1


def test_content_operators(spark):
    assert one(spark, content.text_show(F.col("s")), s="a\nb") == "(a)Tj\nT*\n"
    assert one(spark, content.text_new_line_show(F.col("s"), 1, 0), s="a") == '1 0 (a)"\n'
    assert one(spark, content.text_show_justified(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0), F.lit(-20)))) == "[(a)-20(b)]TJ\n"
    assert one(spark, content.dash(0, 0, 0)) == "[] 0 d\n" and one(spark, content.dash(1, 2, 2)) == "[2] 1 d\n"
    assert one(spark, content.matrix_rotate(90)) == "0 1 -1 0 0 0 cm\n"
    assert one(spark, content.draw_image(F.lit("I"), 1, 2, 3, 4)) == "q\n3 0 0 4 1 2 cm\n/I Do\nQ\n"
    assert one(spark, content.begin_marked(F.lit("P"))) == "/P BMC\n" and one(spark, content.color_space(F.lit("C"), True)) == "/C CS\n"
    with pytest.raises(TypeError):
        content.path_move_to(1)
    srgb = content.color_matrix((0.3127, 0.3290), (0.64, 0.33), (0.30, 0.60), (0.15, 0.06))
    assert srgb["xr"] == pytest.approx(0.4124, abs=1e-3) and sum(srgb[f"y{c}"] for c in "rgb") == pytest.approx(1)


def test_typed_getters_never_convert(spark):
    v = values.parsed(F.lit('{"n":1.5,"s":"x","b":true,"z":null,"m":{"$name":"Nm"},"r":{"$ref":[4,0]},"d":{"$date":60},"h":{"$bin":"FEFF00E9"},"a":[1,2,3,4],"k":{"q":1}}'))
    got = lambda c: one(spark, c)
    assert got(values.get_number(v, "n")) == 1.5 and got(values.get_number(v, "s")) == 0.0
    assert got(values.get_boolean(v, "b")) is True and got(values.get_boolean(v, "n")) is False
    assert got(values.get_string(v, "s")) == "x" and got(values.get_string(v, "m")) is None and got(values.get_string(v, "h")) == "é"
    assert got(values.get_name(v, "m")) == "Nm" and got(values.get_ref(v, "r")) == 4 and got(values.get_date(v, "d")) == 60
    assert got(values.get_binary(v, "s")) == b"x"
    assert got(values.get_rect(v, "a"))[:] == (1, 2, 3, 4) and got(values.get_rect(v, "n"))[:] == (0, 0, 0, 0)
    kinds = {"n": "number", "s": "string", "b": "boolean", "z": "null", "m": "name", "r": "ref", "d": "date", "h": "binary", "a": "array", "k": "dict", "gone": "none"}
    assert {k: got(values.kind(values.at(v, k))) for k in kinds} == kinds
    assert got(values.sorted_keys(v))[:3] == ["a", "b", "d"]
    assert got(values.without_index(F.array(*map(F.lit, "abc")), 1)) == ["a", "c"]


def test_cipher_keys(spark):
    """The key of a file without passwords: compared with the definition written out."""
    import hashlib

    pad = bytes.fromhex(crypt.PAD)
    first = hashlib.md5(pad + b"o" * 32 + (0xFFFFFFFC).to_bytes(4, "little") + b"id").digest()
    for _ in range(50):
        first = hashlib.md5(first).digest()
    key = crypt.file_key(F.lit(""), F.lit("o" * 32).cast("binary"), F.lit(-4), F.lit("id").cast("binary"))
    assert bytes(one(spark, key)) == first
    ob = crypt.object_key(F.lit(b"k" * 16), F.lit(258), F.lit(1), True)
    assert bytes(one(spark, ob)) == hashlib.md5(b"k" * 16 + b"\x02\x01\x00\x01\x00sAlT").digest()


def test_trees(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("x",)], "node string")
    edges = spark.createDataFrame([("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")], "node string, parent string")
    have = spark.createDataFrame([("r", 1), ("b", 2)], "node string, value int")
    assert {r.node: r.value for r in trees.inherited(nodes, edges, have).collect()} == {"a": 1, "b": 2, "x": None}
    pages = spark.createDataFrame([(1, i, b) for i, b in enumerate("AABBA", 1)], "f int, page int, box string")
    assert sorted((r.first, r.last, r.box) for r in trees.runs(pages, ["f"], "page", ["box"]).collect()) == [(1, 2, "A"), (3, 4, "B"), (5, 5, "A")]


def test_markdown_blocks(spark):
    md = "---\ntitle: T\n---\n# One #\n\npara\nmore *em* and **st** ~~no~~ `c`\n\nUnder\n---\n\n- a\n- b\n1. c\n\n> q\n> r\n\n```py\n# code\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n***\n\n[x](http://u) [y][R] <http://z>\n\n[r]: http://ref"
    rows = markdown.blocks(spark.createDataFrame([(1, md)], "id int, text string"), "id").cache()
    got = [(r.kind, r.level, r.text) for r in rows.orderBy("line_no").collect()]
    assert got == [
        ("metadata", None, "title: T"), ("heading", 1, "One"), ("paragraph", None, "para more *em* and **st** ~~no~~ `c`"), ("heading", 2, "Under"), ("bullet", None, "a"), ("bullet", None, "b"), ("ordered", None, "c"),
        ("quote", None, "q\nr"), ("code", None, "# code"), ("row", None, "| a | b |"), ("row", None, "| 1 | 2 |"), ("rule", None, "***"), ("paragraph", None, "[x](http://u) [y][R] <http://z>"), ("paragraph", None, "[r]: http://ref"),
    ]
    assert sorted((r.text, r.url) for r in markdown.links(rows, "id").collect()) == [("http://z", "http://z"), ("x", "http://u"), ("y", "http://ref")]
    assert sorted((r.kind, r.text) for r in markdown.inline(rows, "id").collect()) == [("code", "c"), ("emphasis", "em"), ("strong", "st"), ("struck", "no")]


def test_lzw_codes_of_all_widths():
    import random

    from quire.functions.codecs import from_lzw, to_lzw

    assert to_lzw(b"-----A---B") == bytes.fromhex("800B6050220C0C8501")  # the format's own example
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 500, 5000, 60_000):
        for kinds in (1, 2, 5, 256):
            data = bytes(rng.randrange(kinds) for _ in range(n))
            assert from_lzw(to_lzw(data)) == data
    assert len(to_lzw(b"the quick brown fox " * 5000)) < 3000


def test_what_getters_give_can_be_handed_to_python_functions(spark):
    """As font encodings are: Spark failed to run a Python function whose input had an inner lambda that names an outer one's value."""
    from quire.functions import glyphs

    j = '{"n":1.5,"s":"x","d":"D:20110505091515Z","h":{"$bin":"FEFF00E9"},"a":[97,{"$name":"eacute"}],"k":{"q":1}}'
    v = F.col("v")
    rows = spark.createDataFrame([(j,)], "j string").select(values.parsed(F.col("j")).alias("v"))
    text_ = [F.to_json(values.get_array(v, "a")), F.to_json(values.get_dict(v, "k")), values.get_string(v, "s"), values.get_string(v, "h"), values.kind(values.at(v, "d")), values.get_number(v, "n").cast("string"), values.get_date(v, "d").cast("string")]
    passed = rows.select(*(values.value_text(F.to_json(F.array(t))).alias(f"c{i}") for i, t in enumerate(text_))).first()
    assert list(passed) == ['([97,{"$name":"eacute"}])'.replace("(", "[(").replace(")", ")]"), '[({"q":1})]', "[(x)]", "[<FEFF00E9>]", "[(date)]", "[(1.5)]", "[(1304586915)]"]
    assert rows.select(glyphs.encoding_of(F.lit(None).cast("string"), F.to_json(values.get_array(v, "a")))).first()[0][97] == "é"


@pytest.mark.parametrize("seconds,date", [(253402300799, "D:99991231235959Z"), (253402300800, "D:100000101000000Z"), (622080086400, "D:216821207000000Z"), (3155760000000, "D:1019720121000000Z")])
def test_dates_after_the_year_9999(spark, seconds, date):
    """Made of keys of large tables: written, by SQL's %Y as well, with longer years, and read back."""
    tagged = '{"$date":%d}' % seconds
    assert one(spark, values.value_text(F.col("t")), t=tagged) == f"({date})"
    assert one(spark, text.pdf_date(F.timestamp_seconds("n")), n=seconds) == date
    assert one(spark, F.unix_timestamp(text.parse_pdf_date(F.col("s"))), s=date) == seconds
    assert one(spark, F.unix_timestamp(text.parse_pdf_date(F.col("s"))), s=date.replace("Z", "+01'00'")) == seconds - 3600
    assert one(spark, values.kind(values.parsed(F.to_json(F.array("s")))), s=date) == "array"
    assert one(spark, values.get_date(values.parsed(F.to_json(F.struct(F.col("s").alias("d")))), "d"), s=date) == seconds


def test_longer_years_are_for_whole_dates_only(spark):
    for s in ("D:100000101", "D:1000001010000", "D:12345678901234567Z"):
        assert one(spark, text.parse_pdf_date(F.col("s")), s=s) is None
