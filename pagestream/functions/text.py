"""Text functions."""

from pyspark.sql import functions as F


def decode_utf8(value):
    """Message bytes as text; a malformed byte sequence becomes U+FFFD."""
    return F.make_valid_utf8(value.cast("string"))


def tab_fields(line):
    """Fields of a tab-separated line; empty fields at its end do not count."""
    return F.split(F.rtrim(line, F.lit("\t")), "\t", -1)


def strict_bigint(text):
    """A signed 64-bit integer, or null for blanks, decimals, CR or overflow.

    The cast alone would forgive blanks and control characters at either end.
    """
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    bare = last.between("0", "9") & (first.between("0", "9") | first.isin("+", "-"))
    return F.when(bare, text.try_cast("bigint"))


def leading_int(text):
    """The decimal integer a text starts with, after blanks, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def strip_category_prefix(text):
    """Drop the first `Category:` only."""
    return F.regexp_replace(text, r"(?s)\A(.*?)Category:", "$1")


def all_digits(text):
    """True for a text of number characters of any script."""
    return text.rlike(r"\A\p{N}+\z")


def joined(sep, *columns):
    """Join as text; a null counts as empty, so the field count never changes."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def tab_joined(*columns):
    return joined("\t", *columns)
