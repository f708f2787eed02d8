"""Unicode work that has no built-in: Arrow UDFs with an ASCII fast path inside."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.plans.query import compact, normalize

_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]")


_ASCII_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def _udf(function, of_ascii=None):
    """A string to string Arrow UDF of a Python function; null stays null.

    ``of_ascii`` does the same to a whole array of ASCII texts; then only others reach the function.
    """

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        if of_ascii is None:
            return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())
        odd = pc.invert(pc.fill_null(pc.string_is_ascii(texts), True))
        out = of_ascii(texts)
        if not pc.any(odd).as_py():
            return out
        return pc.replace_with_mask(out, odd, pa.array([function(t) for t in texts.filter(odd).to_pylist()], out.type))

    return run


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.ascii_trim(texts, characters=_ASCII_SPACES))


def bounded(text: str) -> str:
    """Compatibility-composed, controls and bidi controls as spaces, whitespace runs as one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(_CONTROL.sub(" ", text).split())


_normalize = _udf(normalize, _lowered)
_compact = _udf(compact, lambda t: pc.replace_substring_regex(_lowered(t), "[-_. ]", ""))
_bounded = _udf(bounded, lambda t: pc.ascii_trim(pc.replace_substring_regex(t, r"[\x00-\x20\x7f]+", " "), characters=" "))


def search_text(c: Column) -> Column:
    """Search form: trimmed, compatibility-composed, case-folded."""
    return _normalize(c)


def compact_text(c: Column) -> Column:
    """Search form without hyphens, underscores, points and spaces."""
    return _compact(c)


def display_text(c: Column) -> Column:
    """Safe display form of a provider's text."""
    return _bounded(c)


def tokens(c: Column) -> Column:
    """Words of a search text: runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


# terminal-safe text

_STRING_START, _STRING_8BIT = "]PX^_", "\x90\x98\x9d\x9e\x9f"
_BIDI = frozenset("\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069")


def strip_sequences(text: str) -> str:
    """The text without terminal escape sequences, unfinished ones included."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "\x1b" and at + 1 < len(text):
            kind, at = text[at + 1], at + 2
        elif c == "\x1b":
            break
        elif c == "\x9b":
            kind, at = "[", at + 1
        elif c in _STRING_8BIT:
            kind, at = "]", at + 1
        else:
            out.append(c)
            at += 1
            continue
        if kind == "[":  # control sequence: up to its final byte
            while at < len(text) and not "@" <= text[at] <= "~":
                at += 1
            at += 1
        elif kind in _STRING_START:  # string: up to its terminator
            while at < len(text) and text[at] not in "\x07\x9c" and text[at : at + 2] != "\x1b\\":
                at += 1
            at += 2 if text[at : at + 2] == "\x1b\\" else 1
        elif " " <= kind <= "/":  # intermediate bytes and a final one
            while at < len(text) and " " <= text[at] <= "/":
                at += 1
            at += 1
    return "".join(out)


def sanitize(text: str, cap: int = 4096, multiline: bool = False) -> str:
    """Text safe to print: no escape sequences, controls or bidi controls, at most ``cap`` bytes.

    A longer text ends in an ellipsis; where that doesn't fit, in points.
    """
    kept = "".join(c for c in strip_sequences(text) if (multiline and c == "\n") or not (c < " " or "\x7f" <= c <= "\x9f" or c in "\u2028\u2029" or c in _BIDI))
    if len(kept.encode()) <= cap:
        return kept
    if cap < 3:
        return "." * max(0, cap)
    return kept.encode()[: cap - 3].decode(errors="ignore") + "…"


def terminal_text(c: Column, cap: int = 4096) -> Column:
    """Column form of :func:`sanitize`."""
    return _udf(lambda t: sanitize(t, cap))(c)
