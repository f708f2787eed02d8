"""Column expressions on text that stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls White_Space, as a Java character class.
WHITESPACE = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def strip(c: Column) -> Column:
    """``c`` without outer Unicode whitespace; null stays null."""
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def squash(c: Column) -> Column:
    """Whitespace runs as one space, none outside; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WHITESPACE}+", " "))


def filled(c: Column) -> Column:
    """Whether a text holds more than whitespace; null counts as blank."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def ascii_fold(c: Column) -> Column:
    """Full-width ASCII to ASCII and lower case, for identifiers."""
    return F.lower(F.translate(strip(c), FULL_WIDTH, HALF_WIDTH))


def info_hash(c: Column, digits: int = 40) -> Column:
    """Trimmed lower-case hash of ``digits`` hex digits, null where it is none."""
    value = F.lower(strip(c))
    return F.when(value.rlike(f"^[0-9a-f]{{{digits}}}$"), value)
