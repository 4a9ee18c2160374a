"""Line and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 25 characters with the Unicode White_Space property, the blanks
# that a regex \s stands for, and the shortest line that makes a file fail.
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = ("\t", "\n", "\f", "\r", " ")
BLANK = r"[\t\n\f\r ]"
MAX_LINE_BYTES = 65536

SPACE = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NOT_SPACE = "[^" + SPACE[1:]
SPACE_IN_LINE = SPACE.replace(r"\n", "")


def trim_space(col: Column) -> Column:
    """Strip Unicode white space; Spark's own ``trim`` strips U+0020 only."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def line_pieces(content: Column) -> Column:
    """Pieces between newlines; none for an empty text, none after a final newline."""
    ended = content.endswith("\n")
    body = F.when(ended, F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content)
    return F.when(content != "", F.split(body, "\n")).otherwise(F.array().cast("array<string>"))


def drop_cr(line: Column) -> Column:
    """A line without its trailing CR; one of several only."""
    cut = F.substring(line, F.lit(1), F.length(line) - 1)
    return F.when(line.endswith("\r"), cut).otherwise(line)


def join_continued(content: Column) -> Column:
    """Replace each line end after a backslash by one blank, the last one included."""
    joined = F.regexp_replace(content, r"\\[ \t]*\r?(?:\n|\z)", " ")
    return F.when(content.contains("\\"), joined).otherwise(content)


def is_oversize(content: Column, max_line_bytes: int = MAX_LINE_BYTES) -> Column:
    """True where a line has at least ``max_line_bytes`` bytes before its newline.

    Decoded as Latin-1 each byte is one character, so a bounded repeat counts bytes. A
    short text is decided by its length alone, without a look at its lines.
    """
    byte_text = F.decode(content.cast("binary"), "ISO-8859-1")
    return (F.octet_length(content) >= max_line_bytes) & byte_text.rlike(
        rf"(?:\A|\n)[^\n]{{{max_line_bytes}}}"
    )


def failure(content: Column, max_line_bytes: int | None = None) -> Column:
    """Why a file cannot be read as lines; NULL if it can. Lines are of any length by default."""
    reason = F.when(content.isNull(), F.lit("unreadable"))
    if max_line_bytes is None:
        return reason
    return reason.when(is_oversize(content, max_line_bytes), F.lit("oversize"))


def is_significant(trimmed: Column) -> Column:
    return (trimmed != "") & ~trimmed.startswith("#")
