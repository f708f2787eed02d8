"""Torrent metadata: magnets and metainfo files to typed rows, in bulk.

The formats are the published ones (BEP 3, 9, 12, 19, 47 and 52). Nothing is downloaded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.functions.unicode import sanitize
from trovelight.schema import METAINFO_BYTES
from trovelight.sources.http import unsafe_address

# Limits on untrusted metadata.
DEPTH, MEMBERS, VALUES, FILES, COMPONENTS = 64, 100_000, 1_000_000, 100_000, 1_000_000
MAGNET_BYTES, MAGNET_PARAMS, MAGNET_KEY, MAGNET_VALUE, URLS = 4096, 64, 64, 2048, 256
PATH_DEPTH, COMPONENT_BYTES, PATH_BYTES = 64, 255, 4096
# Base names that Windows keeps for devices.
DEVICES = {"con", "prn", "aux", "nul", "conin$", "conout$", *(f"{d}{n}" for d in ("com", "lpt") for n in "123456789¹²³")}

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])
INSPECTION = T.StructType(
    [T.StructField("source_type", T.StringType()), T.StructField("metadata_available", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("name", "format", "infohash_v1", "infohash_v2")]
    + [T.StructField("total_size", T.LongType()), T.StructField("piece_length", T.LongType()), T.StructField("private", T.BooleanType()), T.StructField("files", T.ArrayType(FILE))]
    + [T.StructField("trackers", T.ArrayType(T.StringType())), T.StructField("webseeds", T.ArrayType(T.StringType())), T.StructField("comment", T.StringType()), T.StructField("created_by", T.StringType()), T.StructField("error", T.StringType())]
)
_ARROW = pa.schema(
    [("source_type", pa.string()), ("metadata_available", pa.bool_()), *[(n, pa.string()) for n in ("name", "format", "infohash_v1", "infohash_v2")], ("total_size", pa.int64()), ("piece_length", pa.int64()), ("private", pa.bool_())]
    + [("files", pa.list_(pa.struct([("path", pa.string()), ("size", pa.int64())]))), ("trackers", pa.list_(pa.string())), ("webseeds", pa.list_(pa.string())), ("comment", pa.string()), ("created_by", pa.string()), ("error", pa.string())]
)


class MetainfoError(ValueError):
    """Metadata that breaks the format or a safety rule."""


def fail(why: str):
    raise MetainfoError(why)


# bencode


class _Decoder:
    """Canonical bencode only: shortest numbers, keys in strict order, nothing after the end."""

    def __init__(self, body: bytes):
        self.body, self.at, self.values, self.info = body, 0, 0, None

    def number(self, stop: bytes) -> int:
        end = self.body.find(stop, self.at, self.at + 22)
        text = self.body[self.at : end] if end >= 0 else fail("number")
        re.fullmatch(rb"0|-?[1-9][0-9]*", text) or fail("number is not canonical")
        value = int(text)
        -(2**63) <= value < 2**63 or fail("number out of range")
        self.at = end + 1
        return value

    def value(self, depth: int = 0, top: bool = False):
        self.values += 1
        self.values <= VALUES and depth <= DEPTH or fail("too much nesting or too many values")
        c = self.body[self.at : self.at + 1]
        if c == b"i":
            self.at += 1
            return self.number(b"e")
        if c.isdigit():
            n = self.number(b":")
            self.at + n <= len(self.body) or fail("string beyond the end")
            self.at += n
            return self.body[self.at - n : self.at]
        if c == b"l":
            self.at += 1
            out: list = []
            while self.body[self.at : self.at + 1] != b"e":
                len(out) < MEMBERS or fail("too many members")
                out.append(self.value(depth + 1))
            self.at += 1
            return out
        if c == b"d":
            self.at += 1
            held: dict[bytes, object] = {}
            last = None
            while self.body[self.at : self.at + 1] != b"e":
                len(held) < MEMBERS or fail("too many members")
                self.body[self.at : self.at + 1].isdigit() or fail("key is no string")
                key = self.value(depth + 1)
                last is None or key > last or fail("keys out of order or repeated")
                last, start = key, self.at
                held[key] = self.value(depth + 1)
                if top and key == b"info":
                    self.info = (start, self.at)
            self.at += 1
            return held
        return fail("no value")


def decode(body: bytes) -> tuple[dict, tuple[int, int]]:
    """The dictionary of a metainfo body, and where its info lies."""
    len(body) <= METAINFO_BYTES or fail("too large")
    d = _Decoder(body)
    top = d.value(top=True)
    isinstance(top, dict) or fail("no dictionary")
    d.at == len(body) or fail("bytes after the end")
    d.info or fail("no info")
    isinstance(top[b"info"], dict) or fail("info is no dictionary")
    return top, d.info


# names and addresses


def text_of(raw: bytes, what: str) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return fail(f"{what} is not UTF-8")


def safe_component(raw: bytes) -> str:
    """One path component that no file system misreads."""
    name = text_of(raw, "path")
    if not name or name in (".", "..") or len(raw) > COMPONENT_BYTES or re.search(r"[/\\<>:\"|?*\x00-\x1f\x7f-\x9f]", name) or name[-1] in ". " or sanitize(name, COMPONENT_BYTES) != name:
        fail("unsafe path")
    if unicodedata.normalize("NFC", name).split(".")[0].rstrip().casefold() in DEVICES:
        fail("reserved name")
    return name


def safe_path(parts: list) -> str:
    0 < len(parts) <= PATH_DEPTH or fail("path depth")
    names = [safe_component(p) if isinstance(p, bytes) else fail("path") for p in parts]
    path = "/".join(names)
    len(path.encode()) <= PATH_BYTES or fail("path too long")
    return path


def distinct_paths(paths: list[str]) -> None:
    """Raise where two paths collide, as files or as file and folder, on a caseless file system."""

    def key(path: str) -> tuple[str, ...]:
        return tuple(unicodedata.normalize("NFC", unicodedata.normalize("NFC", p).casefold()) for p in path.split("/"))

    files = [key(p) for p in paths]
    len(set(files)) == len(files) or fail("paths collide")
    folders = {f[:k] for f in files for k in range(1, len(f))}
    folders.isdisjoint(files) or fail("file and folder collide")


def safe_urls(urls: list[str], schemes: tuple[str, ...]) -> list[str]:
    """Valid addresses, sorted, each once."""
    len(urls) <= URLS or fail("too many addresses")
    for u in urls:
        try:
            parts = urlsplit(u)
            host = parts.hostname
            _ = parts.port
        except ValueError:
            fail("address")
        if parts.scheme not in schemes or not host or "@" in parts.netloc or len(u.encode()) > MAGNET_VALUE or sanitize(u, MAGNET_VALUE) != u or re.search(r"\s", u):
            fail("address")
        if host == "localhost" or (re.fullmatch(r"[0-9.]+|[0-9a-f:.]*:[0-9a-f:.]*", host) and unsafe_address(host)):
            fail("address")
    return sorted(set(urls))


TRACKERS, WEBSEEDS = ("http", "https", "udp", "ws", "wss"), ("http", "https")

# layouts


def _v1_files(info: dict) -> list[tuple[str, int, bool]]:
    """(path, size, whether padding) in order."""
    single, many = info.get(b"length"), info.get(b"files")
    (single is None) != (many is None) or fail("length or files")
    if single is not None:
        isinstance(single, int) and single >= 0 or fail("length")
        b"p" not in info.get(b"attr", b"") and b"l" not in info.get(b"attr", b"") or fail("attributes")
        return [(safe_path([info[b"name"]]), single, False)]
    isinstance(many, list) and 0 < len(many) <= FILES or fail("files")
    out = []
    for f in many:
        isinstance(f, dict) and isinstance(f.get(b"length"), int) and f[b"length"] >= 0 and isinstance(f.get(b"path"), list) or fail("file")
        attr = f.get(b"attr", b"")
        isinstance(attr, bytes) and b"l" not in attr and b"symlink path" not in f or fail("symlink")
        out.append((safe_path(f[b"path"]), f[b"length"], b"p" in attr))
    return out


def _check_v1(info: dict, piece: int) -> list[tuple[str, int, bool]]:
    files = _v1_files(info)
    pieces, total = info[b"pieces"], sum(f[1] for f in files)
    isinstance(pieces, bytes) and len(pieces) % 20 == 0 and total < 2**63 or fail("pieces")
    len(pieces) // 20 == -(-total // piece) or fail("piece count")
    return files


def _check_v2(info: dict, piece: int) -> list[tuple[str, int, bytes | None]]:
    """(path, size, root) in the order of the tree."""
    piece >= 16384 and piece & (piece - 1) == 0 or fail("piece length")
    out: list[tuple[str, int, bytes | None]] = []
    sizes: dict[bytes, int] = {}

    def walk(node: dict, above: list[bytes]) -> None:
        isinstance(node, dict) and node or fail("file tree")
        len(above) <= PATH_DEPTH or fail("path depth")
        for name, child in node.items():
            isinstance(child, dict) or fail("file tree")
            if b"" not in child:
                walk(child, [*above, name])
                continue
            leaf = child[b""]
            len(child) == 1 and isinstance(leaf, dict) or fail("file and folder")
            size, root = leaf.get(b"length"), leaf.get(b"pieces root")
            isinstance(size, int) and size >= 0 or fail("length")
            (isinstance(root, bytes) and len(root) == 32) if size else root is None or fail("pieces root")
            if size:
                isinstance(root, bytes) and len(root) == 32 or fail("pieces root")
                sizes.setdefault(root, size) == size or fail("one root, two sizes")
            len(out) < FILES or fail("files")
            out.append((safe_path([*above, name]), size, root))

    walk(info.get(b"file tree"), [])
    sum(f[1] for f in out) < 2**63 or fail("total size")
    return out


def merkle_root(layer: list[bytes], filler: bytes) -> bytes:
    """Root of a layer of hashes, filled up to a power of two."""
    width = 1
    while width < len(layer):
        width *= 2
    layer = layer + [filler] * (width - len(layer))
    while len(layer) > 1:
        layer = [hashlib.sha256(a + b).digest() for a, b in zip(layer[::2], layer[1::2], strict=True)]
    return layer[0]


def _check_layers(top: dict, files: list[tuple[str, int, bytes | None]], piece: int) -> None:
    layers = top.get(b"piece layers", {})
    isinstance(layers, dict) or fail("piece layers")
    needed = {root: size for _, size, root in files if root and size > piece}
    set(layers) == set(needed) or fail("piece layers")
    filler = b"\0" * 32
    for _ in range((piece // 16384).bit_length() - 1):
        filler = hashlib.sha256(filler + filler).digest()
    for root, size in needed.items():
        raw = layers[root]
        isinstance(raw, bytes) and len(raw) == 32 * -(-size // piece) or fail("piece layer size")
        merkle_root([raw[k : k + 32] for k in range(0, len(raw), 32)], filler) == root or fail("piece layer root")


def _check_hybrid(v1: list[tuple[str, int, bool]], v2: list[tuple[str, int, bytes | None]], piece: int) -> None:
    """The same files in the same order, each at a piece's start."""
    [(p, s) for p, s, pad in v1 if not pad] == [(p, s) for p, s, _ in v2] or fail("v1 and v2 files differ")
    at = 0
    for k, (_, size, pad) in enumerate(v1):
        if pad:
            0 < k < len(v1) - 1 and not v1[k - 1][2] and at % piece and size == piece - at % piece or fail("padding")
        elif size:
            at % piece == 0 or fail("a file starts inside a piece")
        at += size


def inspect_metainfo(body: bytes) -> dict:
    """The row of a metainfo body; raises for one that breaks the format."""
    top, (a, z) = decode(body)
    info = top[b"info"]
    piece, name = info.get(b"piece length"), info.get(b"name")
    isinstance(piece, int) and piece > 0 and isinstance(name, bytes) or fail("name or piece length")
    title = safe_component(name)
    private = info.get(b"private", 0)
    private in (0, 1) or fail("private")
    has_v1, version = b"pieces" in info, info.get(b"meta version")
    version in (None, 2) or fail("meta version")
    has_v1 or version or fail("no pieces")
    v1 = _check_v1(info, piece) if has_v1 else []
    v2 = _check_v2(info, piece) if version else []
    if version:
        _check_layers(top, v2, piece)
        if has_v1:
            _check_hybrid(v1, v2, piece)
    files = [(p, s) for p, s, *_ in v2] if version else [(p, s) for p, s, pad in v1 if not pad]
    distinct_paths([p for p, _ in files])
    tiers = top.get(b"announce-list", [])
    isinstance(tiers, list) and all(isinstance(t, list) for t in tiers) or fail("announce-list")
    seeds = top.get(b"url-list", [])
    urls = [u for t in tiers for u in t] + ([top[b"announce"]] if top.get(b"announce") else [])
    seeds = [seeds] if isinstance(seeds, bytes) else seeds
    all(isinstance(u, bytes) for u in (*urls, *seeds)) or fail("address")

    def note(key: bytes) -> str | None:
        raw = top.get(key)
        raw is None or isinstance(raw, bytes) or fail("note")
        return sanitize(text_of(raw, "note")) or None if raw is not None else None

    raw = body[a:z]
    return {
        "source_type": "metainfo", "metadata_available": True, "name": title, "format": "hybrid" if has_v1 and version else "v2" if version else "v1",
        "infohash_v1": hashlib.sha1(raw).hexdigest() if has_v1 else None, "infohash_v2": hashlib.sha256(raw).hexdigest() if version else None,
        "total_size": sum(s for _, s in files), "piece_length": piece, "private": bool(private), "files": [{"path": p, "size": s} for p, s in sorted(files)],
        "trackers": safe_urls([text_of(u, "address") for u in urls if u], TRACKERS), "webseeds": safe_urls([text_of(u, "address") for u in seeds if u], WEBSEEDS), "comment": note(b"comment"), "created_by": note(b"created by"), "error": None,
    }


def inspect_magnet(uri: str) -> dict:
    """The row of a magnet URI."""
    len(uri.encode()) <= MAGNET_BYTES or fail("too long")
    scheme, _, query = uri.partition("?")
    scheme.lower() == "magnet:" and query and "#" not in uri or fail("no magnet")
    try:
        params = parse_qsl(query, keep_blank_values=True, strict_parsing=True, errors="strict", max_num_fields=MAGNET_PARAMS)
    except ValueError:
        fail("query")
    all(len(k.encode()) <= MAGNET_KEY and len(v.encode()) <= MAGNET_VALUE for k, v in params) or fail("parameter too long")
    of = lambda name: [v for k, v in params if k == name]
    hashes: dict[str, str] = {}
    for topic in of("xt"):
        kind, _, value = topic.rpartition(":")
        if kind == "urn:btih" and re.fullmatch(r"[0-9a-fA-F]{40}", value):
            found = ("infohash_v1", value.lower())
        elif kind == "urn:btih" and re.fullmatch(r"[A-Za-z2-7]{32}", value):
            found = ("infohash_v1", base64.b32decode(value.upper()).hex())
        elif kind == "urn:btmh" and re.fullmatch(r"1220[0-9a-fA-F]{64}", value):
            found = ("infohash_v2", value[4:].lower())
        else:
            fail("topic")
        found[0] not in hashes or fail("topic twice")
        hashes[found[0]] = found[1]
    hashes or fail("no topic")
    names = of("dn")
    len(names) <= 1 or fail("name twice")
    return {
        "source_type": "magnet", "metadata_available": False, "name": (sanitize(names[0]) or None) if names else None, "format": "hybrid" if len(hashes) == 2 else "v1" if "infohash_v1" in hashes else "v2",
        "infohash_v1": hashes.get("infohash_v1"), "infohash_v2": hashes.get("infohash_v2"), "total_size": None, "piece_length": None, "private": None, "files": [],
        "trackers": safe_urls(of("tr"), TRACKERS), "webseeds": safe_urls(of("ws"), WEBSEEDS), "comment": None, "created_by": None, "error": None,
    }


# bulk


def _inspect(df: DataFrame, key: str, value: str, one) -> DataFrame:
    schema = T.StructType([df.select(key).schema[0], *INSPECTION.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(1).to_pylist():
                try:
                    rows.append(one(v) if v is not None else fail("nothing to inspect"))
                except MetainfoError as e:
                    rows.append({"error": str(e)})
            out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=schema.names)

    return df.select(key, value).mapInArrow(run, schema)


def inspect_bodies(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row per metainfo body with ``key``; invalid ones (null too) only have an ``error``."""
    return _inspect(df, key, content, inspect_metainfo)


def inspect_magnets(df: DataFrame, key: str, uri: str) -> DataFrame:
    """A row per magnet URI with ``key``; invalid ones (null too) only have an ``error``."""
    return _inspect(df, key, uri, inspect_magnet)


def read_metainfo(spark: SparkSession, path: str) -> DataFrame:
    """Inspections of the ``.torrent`` files at ``path``; of too large ones only an ``error``. Symlinks are refused."""
    if "://" not in path and Path(path).is_symlink():
        raise MetainfoError("symlink")
    every = spark.read.format("binaryFile").option("pathGlobFilter", "*.torrent").load(path)
    small = every.where(F.col("length") <= METAINFO_BYTES)
    large = every.where(F.col("length") > METAINFO_BYTES).select("path", *[(F.lit("too large") if f.name == "error" else F.lit(None)).cast(f.dataType).alias(f.name) for f in INSPECTION.fields])
    return inspect_bodies(small).unionByName(large)


def files_of(inspections: DataFrame, key: str = "path") -> DataFrame:
    """One row per file: ``key``, ``file_index`` from 1, ``file_path`` and ``size``."""
    return inspections.select(key, F.posexplode("files").alias("k", "f")).select(key, (F.col("k") + 1).alias("file_index"), F.col("f.path").alias("file_path"), F.col("f.size").alias("size"))


def source_kind(c: Column) -> Column:
    """What a source text is: ``magnet``, ``https``, ``local`` or null where it is refused."""
    scheme = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z][A-Za-z0-9+.-]+):", 1))
    return F.when(F.trim(c) == "", None).when(scheme == "magnet", "magnet").when(scheme == "https", "https").when((scheme == "") | c.rlike(r"^\s*[A-Za-z]:[\\/]"), "local")
