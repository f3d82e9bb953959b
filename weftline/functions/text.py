"""Text helpers shared by the cell, lineage and review operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with the line-end and Unicode reading the rules expect.

    ``d``: only ``\\n`` ends a line; ``U``: ``\\w``, ``\\s`` and ``\\b`` cover
    Unicode letters and blanks, not just ASCII.
    """
    return f"(?dU{flags}){pattern}"


# The characters that count as blank at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: ColumnLike) -> Column:
    """Remove blanks and line ends at both sides (``trim`` removes spaces only)."""
    return F.btrim(as_col(c), F.lit(BLANKS))


def extract_all(
    c: ColumnLike, pattern: str, flags: str = "", group: int = 1, hint: str | None = None
) -> Column:
    """All matches of a group. ``hint`` is a text that every match contains.

    Looking for the hint is far cheaper than running the pattern, and most
    texts do not have it.
    """
    found = F.regexp_extract_all(as_col(c), F.lit(rx(pattern, flags)), group)
    if hint is None:
        return found
    return F.when(as_col(c).contains(hint), found).otherwise(F.array().cast("array<string>"))


def source_lines(c: ColumnLike) -> Column:
    """Lines of a text, each keeping its line end except the last."""
    lines = F.split(as_col(c), "\n", -1)
    return F.transform(
        lines, lambda line, i: F.when(i < F.size(lines) - 1, F.concat(line, F.lit("\n"))).otherwise(line)
    )


def decode_utf8_or_keep(c: ColumnLike) -> Column:
    """Base64 text to UTF-8 text; anything that does not decode stays as it is.

    Decoding is lenient, so the result counts only when it is valid UTF-8 and
    the base64 signs of the text form whole groups of four.
    """
    raw = as_col(c)
    text = F.try_to_binary(raw, F.lit("base64")).cast("string")
    signs = F.length(F.regexp_replace(raw, "[^A-Za-z0-9+/=]+", ""))
    return F.when(F.is_valid_utf8(text) & (signs % 4 == 0), text).otherwise(raw)


def utc_text(at: Column, pattern: str) -> Column:
    """An instant written in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), pattern)
