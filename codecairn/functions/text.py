"""Text scalars: decoding, trimming, capped text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab

WHITESPACE = " \t\r\n\f\x0b"


def strip(col: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(col, F.lit(WHITESPACE))


def decode_text(content: Column) -> Column:
    """Bytes to text; invalid UTF-8 becomes U+FFFD instead of failing the row."""
    return F.make_valid_utf8(content.cast("string"))


def truncate_text(col: Column, chars: int = vocab.PROMPT_CHARS, note: str = vocab.PROMPT_NOTE) -> Column:
    """The text itself, or its first ``chars`` characters plus ``note`` when it is longer."""
    return F.when(F.length(col) > chars, F.concat(F.substring(col, 1, chars), F.lit(note))).otherwise(col)


def estimate_tokens(col: Column) -> Column:
    return F.floor(F.length(col) / vocab.CHARS_PER_TOKEN).cast("bigint")


def evidence(line: Column) -> Column:
    return F.substring(strip(line), 1, vocab.EVIDENCE_CHARS)


def lines(col: Column) -> Column:
    """Split at every line end Python's universal newlines know."""
    return F.split(col, LINE_END)


LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
