"""Queries of the content operators: every operator drawn from the parts, with oracles that spell the operators out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content
from .files import table

ORACLES: dict[str, str] = {}


def _num(x) -> str:
    text = f"regexp_replace(printf('%.6f', ({x})::DOUBLE), '\\.?0+$', '')"
    return f"CASE WHEN {text} IN ('', '-0') THEN '0' ELSE {text} END"


def _line(op: str, *xs) -> str:
    return " || ".join([*(f"({_num(x)}) || ' '" for x in xs), f"'{op}' || chr(10)"])


def _drawn(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(F.concat(*parts)).alias("drawn_md5"), F.length(F.concat(*parts)).cast("bigint").alias("n"))


def _oracle(parts: list[str]) -> str:
    return f"SELECT p_partkey, md5(t) AS drawn_md5, length(t)::BIGINT AS n FROM (SELECT p_partkey, {' || '.join(parts)} AS t FROM part)"


def content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text and marked-content operators."""
    s, name = F.col("p_size"), F.col("p_name")
    return _drawn(
        spark, sf_dir, content.begin_marked(F.lit("P")), content.begin_marked(F.lit("Span"), F.lit("<</Lang(en)>>")), content.text_begin(), content.text_character_spacing(s / 10), content.text_word_spacing(1.5),
        content.text_leading(s), content.text_matrix(1, 0, 0, 1, s, F.col("p_retailprice")), content.text_rendering_mode(s % 8), content.text_rise(-2.5), content.text_x_scaling(90), content.text_move_line(s, -12),
        content.text_new_line(), content.text_new_line_show(name), content.text_new_line_show(name, 1.5, 0.5), content.text_show_justified(F.array("p_brand", "p_type"), F.array(F.lit(0), -s)),
        content.text_show(F.concat(name, F.lit("\nmore"))), content.text_show(name, True), content.text_end(), content.end_marked(), content.end_marked(),
    )


ORACLES["content_text"] = _oracle([
    "'/P BMC' || chr(10)", "'/Span<</Lang(en)>> BDC' || chr(10)", _line("BT"), _line("Tc", "p_size / 10.0"), _line("Tw", 1.5), _line("TL", "p_size"), _line("Tm", 1, 0, 0, 1, "p_size", "p_retailprice"), _line("Tr", "p_size % 8"),
    _line("Ts", -2.5), _line("Tz", 90), _line("TD", "p_size", -12), _line("T*"), "'(' || p_name || ')''' || chr(10)", "'1.5 0.5 (' || p_name || ')\"' || chr(10)", f"'[(' || p_brand || ')' || ({_num('-p_size')}) || '(' || p_type || ')]TJ' || chr(10)",
    "'(' || p_name || ')Tj' || chr(10) || 'T*' || chr(10)", "'<' || regexp_replace(hex(encode(p_name)), '(..)', '00\\1', 'g') || '>Tj' || chr(10)", _line("ET"), _line("EMC"), _line("EMC"),
])


def content_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All path, matrix, clipping and painting operators, line attributes and images."""
    s = F.col("p_size")
    return _drawn(
        spark, sf_dir, content.save(), content.matrix_concat(1, 0, 0, 1, s, 2.25), content.matrix_rotate(s), content.matrix_scale(2, s), content.matrix_translate(s, 1), content.path_move_to(s, 1), content.path_curve(1, 2, 3, 4, 5, s),
        content.path_curve_23(s, 2, 3, 4), content.path_curve_13(1, s, 3, 4), content.path_line_to(0, s), content.path_rect(1, 2, s, 4), content.path_close(), content.clip(), content.clip(True), content.path_end(), content.fill(), content.fill(True),
        content.fill_and_stroke(), content.fill_and_stroke(True), content.stroke(), content.flatness(1), content.line_cap(s % 3), content.line_join(s % 2), content.line_width(s / 4), content.miter_limit(10), content.dash(1, 0, 0), content.dash(0, s, 2),
        content.draw_image(F.lit("Im 1"), s, 2, 30, 40), content.restore(),
    )


ORACLES["content_paths"] = _oracle([
    _line("q"), _line("cm", 1, 0, 0, 1, "p_size", 2.25), _line("cm", "cos(radians(p_size))", "sin(radians(p_size))", "-sin(radians(p_size))", "cos(radians(p_size))", 0, 0), _line("cm", 2, 0, 0, "p_size", 0, 0), _line("cm", 1, 0, 0, 1, "p_size", 1),
    _line("m", "p_size", 1), _line("c", 1, 2, 3, 4, 5, "p_size"), _line("v", "p_size", 2, 3, 4), _line("y", 1, "p_size", 3, 4), _line("l", 0, "p_size"), _line("re", 1, 2, "p_size", 4), _line("h"), _line("W"), _line("W*"), _line("n"), _line("f"), _line("f*"),
    _line("B"), _line("B*"), _line("S"), _line("i", 1), _line("J", "p_size % 3"), _line("j", "p_size % 2"), _line("w", "p_size / 4.0"), _line("M", 10), "'[] 1 d' || chr(10)", f"'[' || CASE WHEN p_size = 2 THEN '2' ELSE ({_num('p_size')}) || ' 2' END || '] 0 d' || chr(10)",
    _line("q"), _line("cm", 30, 0, 0, 40, "p_size", 2), "'/Im#201 Do' || chr(10)", _line("Q"), _line("Q"),
])


def content_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All colour operators, and colour spaces as arrays: standard, by matrix, by palette and by profile."""
    s = F.col("p_size") / 50
    return _drawn(
        spark, sf_dir, content.fill_cmyk(s, 0, 1, 0.5), content.fill_gray(s), content.fill_rgb(s, 0.25, 1), content.stroke_cmyk(0, s, 1, 0.5), content.stroke_gray(s), content.stroke_rgb(0, s, 1), content.color_space(F.lit("CS0")), content.color_space(F.lit("CS0"), True),
        content.fill_color_gray(s), content.fill_color_rgb(s, s, 1), content.stroke_color_gray(s), content.stroke_color_rgb(1, s, 0), content.color_from_profile(F.col("p_partkey")), content.color_from_palette(F.unhex(F.md5(F.col("p_name").cast("binary")))),
        content.color_standard("AdobeRGB"), content.color_standard("P3-D65"), content.color_standard("sRGB"), content.color_standard("CMYK"), content.color_from_matrix(1.8, (0.9505, 1.0, 1.089)),
    )


# The colour spaces' primaries and the white point D65.
_WHITE = (0.3127, 0.3290)
_PRIMARIES = (((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)), ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06)), ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)))


def _space(primaries) -> str:
    import numpy as np

    xyz = lambda x, y: np.array([x / y, 1.0, (1 - x - y) / y])
    m = np.stack([xyz(*p) for p in primaries], axis=1)
    m = m * np.linalg.solve(m, xyz(*_WHITE))
    num = lambda v: f"{v + 0.0:.6f}".replace("-0.000000", "0").rstrip("0").rstrip(".") or "0"
    return f"'[/CalRGB<</Gamma[2.2 2.2 2.2]/Matrix[{' '.join(num(v) for v in m.T.reshape(-1))}]/WhitePoint[{' '.join(num(v) for v in xyz(*_WHITE))}]>>]'"


ORACLES["content_colors"] = _oracle([
    _line("k", "p_size / 50.0", 0, 1, 0.5), _line("g", "p_size / 50.0"), _line("rg", "p_size / 50.0", 0.25, 1), _line("K", 0, "p_size / 50.0", 1, 0.5), _line("G", "p_size / 50.0"), _line("RG", 0, "p_size / 50.0", 1), "'/CS0 cs' || chr(10)", "'/CS0 CS' || chr(10)",
    _line("sc", "p_size / 50.0"), _line("sc", "p_size / 50.0", "p_size / 50.0", 1), _line("SC", "p_size / 50.0"), _line("SC", 1, "p_size / 50.0", 0), "'[/ICCBased ' || p_partkey || ' 0 R]'", "'[/Indexed/DeviceRGB 4<' || upper(left(md5(p_name), 30)) || '>]'",
    *map(_space, _PRIMARIES), "'/DeviceCMYK'", "'[/CalGray<</Gamma 1.8/WhitePoint[0.9505 1 1.089]>>]'",
])

QUERIES = {name: globals()[name] for name in ORACLES}
