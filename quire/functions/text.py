"""PDF, XML and typographic text as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths of Helvetica's glyphs for the characters from space to tilde, in thousandths.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
#: Every glyph of Courier has this width.
COURIER = 600


def pdf_escape(s: Column) -> Column:
    """A literal string's inside: backslash and parentheses escaped, other bytes below space as octal."""
    out = F.regexp_replace(s, r"([\\()])", r"\\$1")
    for code in (9, 10, 13):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\{code:03o}"))
    return out


def pdf_literal(s: Column) -> Column:
    return F.concat(F.lit("("), pdf_escape(s), F.lit(")"))


def pdf_name(s: Column) -> Column:
    """A name: bytes outside ! to ~, # and delimiters as #HH."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda i: F.hex(F.substr(s.cast("binary"), i, F.lit(1))))
    one = lambda h: F.when(F.unhex(h).cast("string").rlike(r"^[!-~]$") & ~F.unhex(h).cast("string").rlike(r"[#()<>\[\]{}/%]"), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("#"), h))
    return F.concat(F.lit("/"), F.when(F.octet_length(s) > 0, F.array_join(F.transform(bytes_, one), "")).otherwise(""))


def utf16_hex(s: Column) -> Column:
    """A hex string of the text in UTF-16BE."""
    return F.hex(F.encode(s, "UTF-16BE"))


def from_utf16_hex(h: Column) -> Column:
    return F.decode(F.unhex(h), "UTF-16BE")


def xml_escape(s: Column) -> Column:
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def pdf_number(x: Column) -> Column:
    """Six decimals at most, without trailing zeros; no minus zero."""
    out = F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", "")
    return F.when(out.isin("-0", ""), "0").otherwise(out)


#: seconds of 400 years, after which the calendar repeats
CYCLE = 146_097 * 86_400


def pdf_date(ts: Column) -> Column:
    """D:YYYYMMDDhhmmssZ; years after 9999 take more digits, without the sign that Spark puts before them."""
    return F.replace(F.date_format(ts, "'D:'yyyyMMddHHmmss'Z'"), F.lit("+"), F.lit(""))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_pdf_date(s: Column) -> Column:
    """A timestamp of D:YYYY[MM[DD[hh[mm[ss]]]]][Z|±HH'mm[']]; null where it is no date, or before 1970.

    A date of all parts may have a year of five or six digits.
    """
    pattern = r"^D:(\d{5,6}(?=\d{10}(?!\d))|\d{4})(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d))?)?)?)?)?(?:Z|([+-]\d\d)'(\d\d)'?)?$"
    part = lambda i, empty: F.coalesce(F.nullif(F.regexp_extract(s, pattern, i), F.lit("")), F.lit(empty))
    year = part(1, "x")
    cycles = F.when(F.length(year) > 4, F.ceil((year.cast("int") - 9999) / 400)).otherwise(0)  # later years are those of so many cycles before
    year = F.when(cycles > 0, F.lpad((year.cast("int") - 400 * cycles).cast("string"), 4, "0")).otherwise(year)
    local = F.try_to_timestamp(F.concat(year, part(2, "01"), part(3, "01"), part(4, "00"), part(5, "00"), part(6, "00")), F.lit("yyyyMMddHHmmss"))
    hours, minutes = part(7, "+00").cast("int"), part(8, "00").cast("int")
    shift = hours * 3600 + F.when(part(7, "+00").startswith("-"), -minutes * 60).otherwise(minutes * 60)
    at = F.timestamp_seconds(F.unix_timestamp(local) + cycles * CYCLE - shift)
    return F.when(s.rlike(pattern) & (F.unix_timestamp(at) > 0), at)


def slug(s: Column) -> Column:
    """A link target: letters, digits, dot and hyphen in lower case, a hyphen for each space, no more."""
    return F.lower(F.regexp_replace(F.replace(s, F.lit(" "), F.lit("-")), "[^A-Za-z0-9.-]", ""))


def code128_checksum(s: Column) -> Column:
    """The check symbol of a Code 128 B barcode (start symbol 104) of the printable ASCII characters."""
    codes = F.transform(F.split(F.regexp_replace(s, "[^ -~]", ""), ""), lambda c: F.ascii(c) - 32)
    weighted = F.transform(codes, lambda c, i: F.when(c >= 0, c * (i + 1)).otherwise(0))
    return F.aggregate(weighted, F.lit(104), lambda a, x: a + x) % 103


def code128_symbols(s: Column) -> Column:
    """Start, data, check and stop symbols."""
    codes = F.filter(F.transform(F.split(F.regexp_replace(s, "[^ -~]", ""), ""), lambda c: F.ascii(c) - 32), lambda c: c >= 0)
    return F.concat(F.array(F.lit(104)), codes, F.array(code128_checksum(s)), F.array(F.lit(106)))


def text_width(s: Column, size: float, font: str = "Helvetica") -> Column:
    """The width of a line of text; characters that a font lacks count as '?'."""
    if font.startswith("Courier"):
        units = F.length(s) * COURIER
    else:
        widths = F.array(*map(F.lit, HELVETICA))
        index = lambda c: F.when(F.ascii(c).between(32, 126), F.ascii(c) - 31).otherwise(ord("?") - 31)
        units = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.element_at(widths, index(c)))
    return units * F.lit(size) / 1000
