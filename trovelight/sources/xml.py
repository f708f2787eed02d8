"""Strict scan of a provider's XML catalogue: an RSS channel of items of seven fields."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight import schema as S
from trovelight.operators.grouping import first_of

# An item's fields, each once, and their greatest length in bytes.
ITEM_FIELDS = {"title": 1024, "category": 256, "infohash": 40, "guid": 4096, "link": 4096, "description": 65_536, "size": 40}
CHANNEL_FIELDS = {"title", "description", "link"}
ITEM = T.StructType([T.StructField("path", T.StringType()), T.StructField("ordinal", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("title", "category", "infohash", "guid", "link", "description")], T.StructField("size_bytes", T.LongType())])


class CatalogueFormatError(ValueError):
    """A catalogue that breaks the format."""


def size_of(text: str) -> int:
    """Bytes of a decimal size; digits only, at most 63 bits."""
    if not re.fullmatch(r"[0-9]+", text) or int(text) >= 2**63:
        raise CatalogueFormatError("size")
    return int(text)


def parse_items(body: bytes, most_bytes: int = S.CATALOGUE_BYTES, most_records: int = S.CATALOGUE_RECORDS) -> list[dict]:
    """Items in order, duplicates included. Anything beyond the format raises an error."""
    if len(body) > most_bytes:
        raise CatalogueFormatError("too large")
    try:
        body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise CatalogueFormatError("not UTF-8") from e
    path: list[str] = []
    items: list[dict] = []
    text: list[str] = []
    seen_channel = False

    def fail(why: str):
        raise CatalogueFormatError(why)

    def start(name: str, attributes: dict) -> None:
        nonlocal seen_channel
        text.clear()
        match path:
            case []:
                name == "rss" or fail("root")
            case ["rss"]:
                (name == "channel" and not seen_channel) or fail("channel")
                seen_channel = True
            case ["rss", "channel"]:
                if name == "item":
                    len(items) < most_records or fail("too many records")
                    items.append({})
                elif name not in CHANNEL_FIELDS:
                    fail(f"unknown element {name}")
            case ["rss", "channel", "item"]:
                (name in ITEM_FIELDS and name not in items[-1]) or fail(f"field {name}")
            case _:
                fail("nested markup")
        path.append(name)

    def end(name: str) -> None:
        path.pop()
        if path == ["rss", "channel", "item"]:
            value = "".join(text)
            len(value.encode()) <= ITEM_FIELDS[name] or fail(f"{name} too long")
            items[-1][name] = value.strip()
        elif name == "item" and path == ["rss", "channel"]:
            item = items[-1]
            set(item) == set(ITEM_FIELDS) or fail("missing field")
            item["title"] or fail("title")
            re.fullmatch(r"[0-9a-f]{40}", item["infohash"]) or fail("infohash")
            item["size_bytes"] = size_of(item.pop("size"))
        text.clear()

    def data(s: str) -> None:
        if len(path) == 4 or (len(path) == 3 and path[-1] != "item"):
            text.append(s)
        elif s.strip():
            fail("stray text")

    parser = expat.ParserCreate(namespace_separator=" ")  # a name of a namespace is none of ours
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.StartDoctypeDeclHandler = lambda *a: fail("doctype")
    parser.ProcessingInstructionHandler = lambda *a: fail("processing instruction")
    try:
        parser.Parse(body, True)
    except expat.ExpatError as e:
        raise CatalogueFormatError(f"malformed: {e}") from e
    if not items:
        raise CatalogueFormatError("no records")
    return items


def read_catalogues(spark: SparkSession, path: str) -> DataFrame:
    """Items of the XML files at ``path``, with ``path`` and ``ordinal``; of an infohash the first holds.

    First is the lower path, then the lower place. A file that breaks the format or is too large fails
    the read.
    """
    every = spark.read.format("binaryFile").load(path)
    files = every.where(F.col("length") <= S.CATALOGUE_BYTES).select("path", "content")
    large = every.where(F.col("length") > S.CATALOGUE_BYTES).select(F.raise_error(F.concat(F.lit("too large: "), F.col("path"))).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": name, "ordinal": k} | i for k, i in enumerate(parse_items(body))], schema=_ARROW)

    return first_of(files.unionByName(large).mapInArrow(run, ITEM), "infohash", F.struct("path", "ordinal"))


_ARROW = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), *[(n, pa.string()) for n in ("title", "category", "infohash", "guid", "link", "description")], ("size_bytes", pa.int64())])


def item_records(items: DataFrame, provider: str, origin: str) -> DataFrame:
    """Provider rows of items: addresses follow from the hash, a category is kept if it is a facet."""
    facet = F.lower(F.trim("category"))
    h = F.col("infohash")
    return items.select(
        F.lit(provider).alias("provider"), h.alias("source_id"), "title", "description", h.alias("infohash_v1"),
        F.concat(F.lit(f"{origin}/details/"), h).alias("details_url"), F.concat(F.lit("magnet:?xt=urn:btih:"), h).alias("magnet_uri"), F.concat(F.lit(f"{origin}/download/"), h, F.lit(".torrent")).alias("torrent_url"),
        "size_bytes", F.when(facet.rlike("^[a-z0-9_-]{1,64}$"), F.array(facet)).otherwise(F.array().cast("array<string>")).alias("categories"),
    )


def check_item_record(record: dict, provider: str, origin: str) -> dict:
    """A saved provider row of an item, its addresses derived anew; raises for what no item could have given."""
    h, size = record.get("infohash_v1"), record.get("size_bytes")
    given = {k for k, v in record.items() if v not in (None, "", [])}
    sound = (
        record.get("provider") == provider
        and isinstance(h, str)
        and re.fullmatch(r"[0-9a-f]{40}", h) is not None
        and record.get("source_id") == h
        and isinstance(size, int)
        and 0 <= size < 2**63
        and given <= {"provider", "source_id", "title", "description", "infohash_v1", "details_url", "magnet_uri", "torrent_url", "size_bytes", "categories"}
        and isinstance(record.get("title"), str)
        and 0 < len(record["title"].encode()) <= ITEM_FIELDS["title"]
        and len((record.get("description") or "").encode()) <= ITEM_FIELDS["description"]
        and len(record.get("categories") or []) <= 1
        and all(re.fullmatch("[a-z0-9_-]{1,64}", c) for c in record.get("categories") or [])
    )
    if not sound:
        raise CatalogueFormatError("saved record")
    return record | {"details_url": f"{origin}/details/{h}", "magnet_uri": f"magnet:?xt=urn:btih:{h}", "torrent_url": f"{origin}/download/{h}.torrent"}


def items_of(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row per item of the XML bodies in a column, with ``key``, ``ordinal`` and ``error``.

    A body that breaks the format (null too) has one row, which only holds the ``error``. Repeated
    keys are bodies of their own; other columns are ignored.
    """
    fields = [T.StructField("ordinal", T.LongType()), *[f for f in ITEM.fields if f.name not in ("path", "ordinal")], T.StructField("error", T.StringType())]
    schema = T.StructType([df.select(key).schema[0], *fields])
    arrow = pa.schema([("ordinal", pa.int64()), *[f for f in _ARROW if f.name not in ("path", "ordinal")], ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                try:
                    found = [{"ordinal": n} | i for n, i in enumerate(parse_items(body or b""))]
                except CatalogueFormatError as e:
                    found = [{"error": str(e).partition(":")[0]}]
                at += [k] * len(found)
                rows += found
            out = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *out.columns], names=schema.names)

    return df.select(key, content).mapInArrow(run, schema)
