"""Column expressions: splitting, prefixes, escapes, URLs, order-preserving codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_fields(text: Column, delimiter: str, most: int = -1) -> Column:
    """Fields of a line. A blank splits like awk: leading blanks skipped, runs are one; any other delimiter keeps empty fields. ``most``: the last field keeps the rest."""
    return F.split(F.ltrim(F.rtrim(text)), " +", most) if delimiter == " " else F.split(text, re.escape(delimiter), most)


def field(text: Column, delimiter: str, place: int) -> Column:
    """The 0-based field, empty where a line has fewer."""
    return F.coalesce(F.get(split_fields(text, delimiter), F.lit(place)), F.lit(""))


def chomp(text: Column) -> Column:
    """Without line ends."""
    return F.regexp_replace(text, "[\r\n]+$", "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that both texts start with; null if either is."""
    n = F.least(F.char_length(a), F.char_length(b))
    first = F.array_min(F.filter(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(first - 1, n)).cast("long")


def c_escape(text: Column) -> Column:
    """Backslash, quote, tab and line ends as in C."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def c_unescape(text: Column) -> Column:
    """The text that :func:`c_escape` made: parts between double backslashes are read on their own."""

    def read(part: Column) -> Column:
        for plain, escaped in (('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            part = F.replace(part, F.lit(escaped), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), read), "\\")


#: What a word consists of beside ASCII letters and digits: the underscore and everything beyond ASCII.
WORD_CHARS = r"A-Za-z0-9_\x{80}-\x{10FFFF}"


def whole_word_count(text: Column, word: str) -> Column:
    """How often a word stands in a text with no word character beside it."""
    return F.regexp_count(text, F.lit(f"(?<![{WORD_CHARS}]){re.escape(word)}(?![{WORD_CHARS}])")).cast("long")


def hex_decode(text: Column) -> Column:
    """The text whose UTF-8 bytes are given in hexadecimal; null where they are none."""
    return F.decode(F.unhex(text), "UTF-8")


def utf16_hex(text: Column) -> Column:
    """The text's UTF-16 code units, high byte first, in hexadecimal."""
    return F.hex(F.encode(text, "UTF-16BE"))


def url_encode(text: Column) -> Column:
    """Percent encoding that keeps ``-_./`` and letters and digits, and writes a blank as %20."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_decode(text: Column) -> Column:
    """Percent decoding; a plus sign stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_args(url: Column) -> Column:
    """All key=value arguments of a URL as an array of structs, repeated keys kept."""
    args = F.filter(F.split(F.coalesce(F.regexp_extract(url, r"[?]([^#]*)", 1), F.lit("")), "&"), lambda a: a != "")
    return F.transform(args, lambda a: F.struct(F.substring_index(a, "=", 1).alias("key"), F.when(F.instr(a, "=") > 0, url_decode(F.regexp_replace(a, "^[^=]*=", ""))).otherwise("").alias("value")))


def hanzi_count(text: Column) -> Column:
    """Characters, a run of ASCII counting as one."""
    return F.char_length(F.regexp_replace(text, "[\\x00-\\x7F]+", "a")).cast("long")


def byte_ordered(number: Column) -> Column:
    """16 hexadecimal digits in whose text order doubles are ordered as numbers, -0.0 as 0.0, NaN last, infinities at the ends."""
    # A double's bits from its power of two and its part above it; numbers below the least normal one have power 0.
    size, least = F.abs(number), -1022
    power = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(2.0**least)))), F.lit(least))
    power = F.when(F.pow(F.lit(2.0), power) > size, power - 1).when(F.pow(F.lit(2.0), F.least(power + 1, F.lit(1023))) <= size, F.least(power + 1, F.lit(1023))).otherwise(power)
    part = ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(1 << 52))).cast("long")
    normal = F.shiftleft((power + 1023).cast("long"), 52).bitwiseOR(part)
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(F.isnan(size), F.lit(0x7FF8 << 48)).when(size == F.lit(float("inf")), F.lit(0x7FF0 << 48)).when(size < F.lit(2.0**least), tiny).otherwise(normal)
    negative = F.hex(F.bitwise_not(bits.bitwiseOR(F.lit(-(2**63)))))
    return F.lpad(F.when((number < 0) & ~F.isnan(number), negative).otherwise(F.hex(bits.bitwiseOR(F.lit(-(2**63))))), 16, "0")


def zero_free(data: Column) -> Column:
    """Hexadecimal code of bytes, in the same order, without a byte 0 but the end: 00 as 01 00, 01 as 01 01, and 00 at the end."""
    pairs = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    return F.replace(F.concat(F.regexp_replace(pairs, "\\b(00|01) ", "01 $1 "), F.lit("00")), F.lit(" "), F.lit(""))
