"""String functions: message clean-up and display truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space when a message is
# cleaned (the Unicode White_Space set as the wire producer's language defines
# "space"), written as Java/RE2 escapes so that Spark and DuckDB read the same
# class.  U+200B, U+FEFF, U+180E and U+001C are deliberately not in it.
WHITESPACE_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize_message(c) -> Column:
    """Trim and collapse every white-space run to one blank (F1)."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE_CLASS, " "))


def truncate_message(c, n: int = 35) -> Column:
    """Display truncation (F7): over ``n`` bytes → what fits into ``n - 3`` bytes + '...'.

    Bytes are counted as the terminal client does; the cut moves back to the
    start of a character, so none is split (a deliberate difference, equal for
    ASCII text).
    """
    c = _col(c)
    raw = c.cast("binary")
    out = F.lit("")
    for cut in range(max(n - 6, 0), n - 2):  # a character has four bytes at most
        # a cut is clean unless the next byte continues a character
        clean = ~F.hex(F.substring(raw, cut + 1, 1)).between("80", "BF")
        out = F.when(clean, F.substring(raw, 1, cut).cast("string")).otherwise(out)
    return F.when(F.octet_length(c) > n, F.concat(out, F.lit("..."))).otherwise(c)
