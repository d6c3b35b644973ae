"""Content-stream operators as Column builders: each gives one operator's text.

Numbers may be Columns or Python numbers. Curves and rotation follow ISO 32000 (v takes
points 2 and 3, y points 1 and 3; a positive angle turns counter-clockwise).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pdf_literal, pdf_name, pdf_number, utf16_hex


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def op(operator: str, *operands) -> Column:
    """Operands (numbers, or Columns of numbers) and an operator, on a line."""
    return F.concat(*(part for x in operands for part in (pdf_number(_col(x)), F.lit(" "))), F.lit(f"{operator}\n"))


def _plain(operator: str, count: int, what: str):
    def build(*operands) -> Column:
        if len(operands) != count:
            raise TypeError(f"{operator} takes {count} operands")
        return op(operator, *operands)

    build.__doc__ = what
    return build


# Names, operators and operand counts of ISO 32000.
save = _plain("q", 0, "Save the graphics state.")
restore = _plain("Q", 0, "Restore the graphics state.")
matrix_concat = _plain("cm", 6, "Multiply the matrix.")
path_move_to = _plain("m", 2, "Begin a subpath.")
path_line_to = _plain("l", 2, "Add a line.")
path_curve = _plain("c", 6, "Add a curve.")
path_curve_23 = _plain("v", 4, "Add a curve whose first control point is the current one.")
path_curve_13 = _plain("y", 4, "Add a curve whose second control point is its end.")
path_rect = _plain("re", 4, "Add a rectangle.")
path_close = _plain("h", 0, "Close the subpath.")
path_end = _plain("n", 0, "Drop the path.")
stroke = _plain("S", 0, "Stroke the path.")
fill_cmyk = _plain("k", 4, "Set the fill colour.")
fill_gray = _plain("g", 1, "Set the fill colour.")
fill_rgb = _plain("rg", 3, "Set the fill colour.")
stroke_cmyk = _plain("K", 4, "Set the stroke colour.")
stroke_gray = _plain("G", 1, "Set the stroke colour.")
stroke_rgb = _plain("RG", 3, "Set the stroke colour.")
fill_color_gray = _plain("sc", 1, "Set the fill colour in its space.")
fill_color_rgb = _plain("sc", 3, "Set the fill colour in its space.")
stroke_color_gray = _plain("SC", 1, "Set the stroke colour in its space.")
stroke_color_rgb = _plain("SC", 3, "Set the stroke colour in its space.")
flatness = _plain("i", 1, "Set the flatness.")
line_cap = _plain("J", 1, "Set the line cap.")
line_join = _plain("j", 1, "Set the line join.")
line_width = _plain("w", 1, "Set the line width.")
miter_limit = _plain("M", 1, "Set the miter limit.")
text_begin = _plain("BT", 0, "Begin text.")
text_end = _plain("ET", 0, "End text.")
text_move_to = _plain("Td", 2, "Move by an offset.")
text_move_line = _plain("TD", 2, "Move by an offset and set the leading.")
text_new_line = _plain("T*", 0, "Move to the next line.")
text_character_spacing = _plain("Tc", 1, "Set character spacing.")
text_word_spacing = _plain("Tw", 1, "Set word spacing.")
text_leading = _plain("TL", 1, "Set the leading.")
text_matrix = _plain("Tm", 6, "Set the text matrix.")
text_rendering_mode = _plain("Tr", 1, "Set the rendering mode, 0 to 7.")
text_rise = _plain("Ts", 1, "Set the rise.")
text_x_scaling = _plain("Tz", 1, "Set horizontal scaling in percent.")
end_marked = _plain("EMC", 0, "End marked content.")


def matrix_rotate(degrees) -> Column:
    a = F.radians(_col(degrees))
    return op("cm", F.cos(a), F.sin(a), -F.sin(a), F.cos(a), 0, 0)


def matrix_scale(x, y) -> Column:
    return op("cm", x, 0, 0, y, 0, 0)


def matrix_translate(x, y) -> Column:
    return op("cm", 1, 0, 0, 1, x, y)


def clip(even_odd: bool = False) -> Column:
    return op("W*" if even_odd else "W")


def fill(even_odd: bool = False) -> Column:
    return op("f*" if even_odd else "f")


def fill_and_stroke(even_odd: bool = False) -> Column:
    return op("B*" if even_odd else "B")


def dash(phase, on, off) -> Column:
    """A dash pattern; solid where neither part is positive, one number where they are equal."""
    on, off = _col(on), _col(off)
    inside = F.when((on <= 0) & (off <= 0), F.lit("")).when(F.abs(on - off) < 0.001, pdf_number(on)).otherwise(F.concat(pdf_number(on), F.lit(" "), pdf_number(off)))
    return F.concat(F.lit("["), inside, F.lit("] "), pdf_number(_col(phase)), F.lit(" d\n"))


def color_space(name: Column, stroked: bool = False) -> Column:
    return F.concat(pdf_name(name), F.lit(" CS\n" if stroked else " cs\n"))


def text_font(name: Column, size) -> Column:
    return F.concat(pdf_name(name), F.lit(" "), pdf_number(_col(size)), F.lit(" Tf\n"))


def text_string(s: Column, unicode: bool = False) -> Column:
    return F.concat(F.lit("<"), utf16_hex(s), F.lit(">")) if unicode else pdf_literal(s)


def text_show(s: Column, unicode: bool = False) -> Column:
    """Show the text up to its first newline; then move to the next line."""
    first = F.regexp_extract(s, r"^([^\n]*)", 1)
    return F.concat(text_string(first, unicode), F.lit("Tj\n"), F.when(F.instr(s, "\n") > 0, "T*\n").otherwise(""))


def text_new_line_show(s: Column, word_spacing=0, character_spacing=0, unicode: bool = False) -> Column:
    w, c = _col(word_spacing), _col(character_spacing)
    return F.when((w > 0) | (c > 0), F.concat(pdf_number(w), F.lit(" "), pdf_number(c), F.lit(" "), text_string(s, unicode), F.lit('"\n'))).otherwise(F.concat(text_string(s, unicode), F.lit("'\n")))


def text_show_justified(fragments: Column, offsets: Column, unicode: bool = False) -> Column:
    """[offset(fragment)...]TJ for arrays of equal length; offsets of 0 are left out."""
    parts = F.zip_with(fragments, offsets, lambda s, n: F.concat(F.when(n != 0, pdf_number(n)).otherwise(""), text_string(s, unicode)))
    return F.concat(F.lit("["), F.array_join(parts, ""), F.lit("]TJ\n"))


def begin_marked(tag: Column, properties: Column | None = None) -> Column:
    return F.concat(pdf_name(tag), F.lit(" BMC\n")) if properties is None else F.concat(pdf_name(tag), properties, F.lit(" BDC\n"))


def draw_image(name: Column, x, y, width, height) -> Column:
    return F.concat(save(), op("cm", width, 0, 0, height, x, y), pdf_name(name), F.lit(" Do\n"), restore())


def color_matrix(white, red, green, blue) -> dict:
    """The RGB to XYZ matrix of a colour space given by chromaticities (x, y), numbers or Columns.

    Keys: axis and colour, as xr; columns are scaled so that white comes out.
    """
    xyz = [(x / y, y / y, (1 - x - y) / y) for x, y in (red, green, blue)]
    w = (white[0] / white[1], white[1] / white[1], (1 - white[0] - white[1]) / white[1])

    def det(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    d = det(*xyz)
    scale = (det(w, xyz[1], xyz[2]) / d, det(xyz[0], w, xyz[2]) / d, det(xyz[0], xyz[1], w) / d)
    return {f"{axis}{c}": s * v for c, p, s in zip("rgb", xyz, scale, strict=True) for axis, v in zip("xyz", p, strict=True)}


def bytes_per_line(width: Column, colors: Column, bits: Column) -> Column:
    """Bytes of an image's line, the last one filled up."""
    return F.floor((width * colors * bits + 7) / 8).cast("bigint")


def _list(*numbers) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" ", *(pdf_number(_col(n)) for n in numbers)), F.lit("]"))


def color_from_profile(number: Column) -> Column:
    """A colour space given by an ICC profile's object."""
    return F.concat(F.lit("[/ICCBased "), number.cast("string"), F.lit(" 0 R]"))


def color_from_palette(colors: Column) -> Column:
    """Indexed colours: three bytes each; what is left over of the bytes is not used."""
    n = F.floor(F.octet_length(colors) / 3).cast("int")
    return F.concat(F.lit("[/Indexed/DeviceRGB "), (n - 1).cast("string"), F.lit("<"), F.hex(F.substr(colors, F.lit(1), n * 3)), F.lit(">]"))


def color_from_matrix(gamma, white, matrix=None) -> Column:
    """A calibrated space: grey without a matrix, else RGB with the rows X, Y, Z of an RGB to XYZ matrix, which the array holds by colour."""
    if matrix is None:
        return F.concat(F.lit("[/CalGray<</Gamma "), pdf_number(_col(gamma)), F.lit("/WhitePoint"), _list(*white), F.lit(">>]"))
    by_color = [matrix[row][column] for column in range(3) for row in range(3)]
    return F.concat(F.lit("[/CalRGB<</Gamma"), _list(gamma, gamma, gamma), F.lit("/Matrix"), _list(*by_color), F.lit("/WhitePoint"), _list(*white), F.lit(">>]"))


def color_from_primaries(gamma, white, red, green, blue) -> Column:
    """A calibrated RGB space given by chromaticities (x, y)."""
    m = color_matrix(white, red, green, blue)
    rows = [[_col(m[f"{axis}{c}"]) for c in "rgb"] for axis in "xyz"]
    return color_from_matrix(gamma, (white[0] / white[1], 1.0, (1 - white[0] - white[1]) / white[1]), rows)


# The primaries of the standard colour spaces; all have the white point D65 and the gamma 2.2.
STANDARD = {
    "AdobeRGB": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)),
    "P3-D65": ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06)),
    "sRGB": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)),
}


def color_standard(name: str) -> Column:
    """A colour space by name; CMYK is the device's."""
    if name == "CMYK":
        return F.lit("/DeviceCMYK")
    return color_from_primaries(2.2, (0.3127, 0.3290), *STANDARD[name])


def with_resource(resources: Column, kind: str, name: Column, value: Column) -> Column:
    """A map of resources by kind (ColorSpace, Font, XObject), each a map of names to texts, with one set."""
    own = F.coalesce(F.get(F.map_values(F.map_filter(resources, lambda k, _: k == kind)), F.lit(0)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    entries = F.map_concat(F.map_filter(own, lambda k, _: k != name), F.create_map(name, value))
    return F.map_concat(F.map_filter(resources, lambda k, _: k != kind), F.create_map(F.lit(kind), entries))


def resources_text(resources: Column) -> Column:
    """A Resources dictionary of such a map, in byte order."""
    inner = lambda e: F.array_join(F.transform(F.array_sort(F.map_entries(e)), lambda x: F.concat(pdf_name(x["key"]), F.lit(" "), x["value"])), "")
    whole = F.transform(F.array_sort(F.map_keys(resources)), lambda k: F.concat(pdf_name(k), F.lit("<<"), inner(F.element_at(resources, k)), F.lit(">>")))
    return F.concat(F.lit("<<"), F.array_join(whole, ""), F.lit(">>"))
