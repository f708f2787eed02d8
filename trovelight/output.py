"""Versioned JSON, sequenced NDJSON and terminal-safe tables."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.functions.unicode import sanitize
from trovelight.schema import CELL_BYTES, OUTPUT_VERSION

_ESCAPED = [*map(chr, range(0x7F, 0xA0)), *"\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"]


def terminal_json(text: str) -> str:
    """JSON text with controls and bidi controls as escapes."""
    return text.translate({ord(c): f"\\u{ord(c):04x}" for c in _ESCAPED})


def envelope(kind: str, data) -> str:
    """One JSON document with its version and type, and a newline."""
    return terminal_json(json.dumps({"schema_version": OUTPUT_VERSION, "type": kind, "data": data}, ensure_ascii=False, separators=(",", ":"), default=str)) + "\n"


class Ndjson:
    """A stream of JSON lines, numbered from 1; a line that fails takes no number."""

    def __init__(self, write):
        self.write, self.sequence = write, 0

    def send(self, kind: str, data) -> None:
        line = json.dumps({"schema_version": OUTPUT_VERSION, "type": kind, "sequence": self.sequence + 1, "data": data}, ensure_ascii=False, separators=(",", ":"), default=str)
        self.write(terminal_json(line) + "\n")
        self.sequence += 1

    def done(self) -> None:
        self.send("done", None)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_text(header: Sequence[str], rows: Iterable[Sequence]) -> str:
    """An aligned table of safe cells: columns two spaces apart, the last one ragged."""
    lines = [[sanitize(str("-" if v is None else v), CELL_BYTES) for v in r] for r in (header, *rows)]
    if any(len(r) != len(header) for r in lines):
        raise ValueError("a row has another number of cells than the header")
    widths = [max(_width(r[k]) for r in lines) for k in range(len(header))]
    return "".join("".join(c + " " * (w + 2 - _width(c)) for c, w in zip(r[:-1], widths, strict=False)) + r[-1] + "\n" for r in lines)


def json_lines(df: DataFrame, kind: str, rank: str) -> DataFrame:
    """The sink's NDJSON as a column ``line``: rows numbered by ``rank``, which counts from 1, then the last line."""
    fields = [c for c in df.columns if c != rank]
    head = lambda n: f'{{"schema_version":{OUTPUT_VERSION},"type":"{n}","sequence":'
    lines = df.select(F.col(rank).cast("long").alias("sequence"), F.concat(F.lit(head(kind)), F.col(rank).cast("string"), F.lit(',"data":'), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("}")).alias("line"))
    end = df.agg((F.count("*") + 1).alias("sequence")).select("sequence", F.concat(F.lit(head("done")), F.col("sequence").cast("string"), F.lit(',"data":null}')).alias("line"))
    return lines.unionByName(end)


def known(value) -> str:
    """``-`` for an unknown value."""
    return "-" if value is None else str(value)
