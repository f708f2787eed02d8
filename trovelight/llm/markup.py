"""Markup in descriptions: conversion to clean text, and removal of a host's boilerplate.

The conversion keeps headings, lists, code blocks and formulas. Boilerplate is found with a suffix
array over the token streams of a host's pages: long substrings repeated across distinct pages go,
unique runs stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trovelight.llm.markup_text import convert
from trovelight.session import cut_lineage

_TOKEN = re.compile(r"\w+|[^\w\s]")


def repeated_cover(tokens: np.ndarray, page: np.ndarray, length: int, pages: int) -> np.ndarray:
    """Which tokens lie in a substring of ``length`` tokens that occurs on at least ``pages`` pages.

    A suffix array sorted to depth ``length`` (a power of two): every longer repeated substring is a
    union of such windows. Windows across two pages don't count.
    """
    n = len(tokens)
    cover = np.zeros(n, bool)
    if n < length:
        return cover
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < length:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ahead[1:] != ahead[:-1]])
        step *= 2
    start = np.flatnonzero(page[: n - length + 1] == page[length - 1 :])
    order = start[np.argsort(rank[start], kind="stable")]  # by rank, then by place and so by page
    first = np.r_[True, rank[order][1:] != rank[order][:-1]]
    fresh = first | np.r_[True, page[order][1:] != page[order][:-1]]
    group = np.cumsum(first) - 1
    often = np.bincount(group, weights=fresh)[group] >= pages if len(order) else np.empty(0, bool)
    edge = np.zeros(n + 1, np.int64)
    hit = order[often]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + length, -1)
    return np.cumsum(edge)[:n] > 0


def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The texts' tokens as numbers, in one array; how many each text has; the tokens by number."""
    number: dict[str, int] = {}
    each = [np.fromiter((number.setdefault(w, len(number)) for w in _TOKEN.findall(t)), np.int64) for t in texts]
    return np.concatenate([np.empty(0, np.int64), *each]), np.array([len(s) for s in each], np.int64), list(number)


def _doubled(h: np.ndarray, length: int, step: int = 1) -> np.ndarray:
    """Hashes of windows of ``length`` tokens from those of ``step`` tokens, both powers of two."""
    while step < length:
        a, b = h[: max(0, len(h) - step)], h[step:]
        h = a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
        step *= 2
    return h


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    m, width = h, 1
    while width < n:
        step = min(width, n - width)
        m = np.minimum(m[: len(m) - step], m[step:])
        width += step
    return m


class Windows:
    """Windows of ``length`` tokens (a power of two) of some texts, none across two texts.

    Of each: ``page``, the text's place; ``at``, its place in the joined stream; ``value``, its 64-bit
    hash; ``anchor``, the least hash of the half as long windows inside it. Equal windows have equal
    anchors and neighbouring ones mostly share theirs, so a page has few distinct ones.
    """

    def __init__(self, texts: list[str], length: int):
        tokens, self.sizes, names = _streams(texts)
        pages = np.repeat(np.arange(len(texts)), self.sizes)
        self.n = len(tokens)
        codes = np.fromiter((_token_hash(w) for w in names), np.uint64, len(names))
        half = _doubled(codes[tokens], length // 2)
        count = max(0, self.n - length + 1)
        self.at = np.flatnonzero(pages[:count] == pages[length - 1 :]) if count else np.empty(0, np.int64)
        self.page = pages[self.at]
        self.value = _doubled(half, length, length // 2).view(np.int64)[self.at]
        self.anchor = _least(half, length // 2 + 1).view(np.int64)[self.at] if count else self.value

    def by_page(self, marked: np.ndarray, length: int) -> list[np.ndarray]:
        """Which tokens of each text lie in a marked window."""
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, self.at[marked], 1)
        np.add.at(edge, self.at[marked] + length, -1)
        return np.split(np.cumsum(edge)[: self.n] > 0, np.cumsum(self.sizes)[:-1])


def _counted(value: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and on how many pages each is."""
    order = np.lexsort((page, value))
    v, p = value[order], page[order]
    fresh = np.r_[True, (v[1:] != v[:-1]) | (p[1:] != p[:-1])] if len(v) else np.empty(0, bool)
    return np.unique(v[fresh], return_counts=True)


def _without(text: str, gone: np.ndarray) -> tuple[str, int]:
    """The text without the covered tokens, and their number."""
    if not gone.any():
        return text, 0
    kept, last = [], 0
    for m, covered in zip(_TOKEN.finditer(text), gone, strict=True):
        if covered:
            kept.append(text[last : m.start()])
            last = m.end()
    kept.append(text[last:])
    return re.sub(r"[ \t]{2,}", " ", "".join(kept)).strip(), int(gone.sum())


def _unique_of_host(texts: list[str], length: int, pages: int) -> list[tuple[str, int]]:
    """(unique text, tokens removed) of each page of a whole host, by a suffix array."""
    tokens, sizes, _ = _streams(texts)
    cover = repeated_cover(tokens, np.repeat(np.arange(len(texts)), sizes), length, pages)
    return [_without(t, c) for t, c in zip(texts, np.split(cover, np.cumsum(sizes)[:-1]) if texts else [], strict=True)]


def _unique_of_part(texts: list[str], length: int, common: np.ndarray) -> list[tuple[str, int]]:
    """The same of part of a host, whose windows on enough pages have the hashes ``common``."""
    if not len(common) or not texts:
        return [(t, 0) for t in texts]
    w = Windows(texts, length)
    return [_without(t, c) for t, c in zip(texts, w.by_page(np.isin(w.value, common), length), strict=True)]


def clean_markup(records: DataFrame, *, id_col: str = "record_id", text_col: str = "description", host_col: str = "details_url", fallback_col: str = "provider", length: int = 32, pages: int = 3, shard_pages: int = 4_000, shard_chars: int = 8_000_000, broadcast_hosts: int = 200_000) -> DataFrame:
    """Clean texts: ``id_col``, ``kinds`` of markup met, ``clean``, ``unique_text`` and ``removed``.

    ``clean`` is the whole text without markup, ``kinds`` what its conversion replaced or kept as
    structure. ``unique_text`` is ``clean`` without the host's boilerplate: tokens covered by
    substrings of ``length`` tokens that at least ``pages`` distinct pages of the host hold;
    ``removed`` counts them. A host is that of ``host_col``, else ``fallback_col``.

    Texts are converted once, before any shuffle, and written to the shared folder. A host of up to
    ``shard_pages`` pages and ``shard_chars`` characters then has a suffix array. A larger one is
    split by a hash of the page, so it never gathers in one task, and the same windows are found by
    counts over the whole host: first of the pages' anchors, which are few (see
    :class:`Windows`), then of the windows whose anchor is on enough pages. Sums are combined
    map-side. So the result depends neither on the split nor on a host's size. The sizes of up to
    ``broadcast_hosts`` split hosts are broadcast, of more joined by shuffle.

    Null texts come out as null with no kinds, empty ones as empty; repeated ids and equal rows are
    pages of their own; other columns are ignored; an empty table gives an empty result.
    """
    if length < 2 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = records.select(id_col).schema[0]
    kinds = T.StructField("kinds", T.ArrayType(T.StringType()))
    clean = T.StructField("clean", T.StringType())
    schema = T.StructType([kind, kinds, clean, T.StructField("unique_text", T.StringType()), T.StructField("removed", T.IntegerType())])
    host = F.coalesce(F.nullif(F.regexp_extract(F.col(host_col), "^[a-z]+://([^/?#]+)", 1), F.lit("")), F.col(fallback_col), F.lit("")) if host_col in records.columns else F.coalesce(F.col(fallback_col), F.lit(""))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [convert(t) if t is not None else ([], None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.list_(pa.string())), pa.array([d[1] for d in done], pa.string()), batch.column(2)], names=[id_col, "kinds", "clean", "host"])

    converted = cut_lineage(records.select(F.col(id_col), F.col(text_col).alias("t"), F.xxhash64(host).alias("host")).mapInArrow(plain, T.StructType([kind, kinds, clean, T.StructField("host", T.LongType())])))
    sizes = converted.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("clean")).alias("chars"))
    hot = cut_lineage(sizes.select("host", F.ceil(F.greatest(F.col("n") / shard_pages, F.col("chars") / shard_chars)).alias("parts")).where("parts > 1"))
    n_hot = hot.limit(broadcast_hosts + 1).count()
    if n_hot <= broadcast_hosts:
        hot = F.broadcast(hot)
    placed = converted.join(hot, "host", "left")
    id_type = pa.int64() if isinstance(kind.dataType, T.LongType) else pa.int32() if isinstance(kind.dataType, T.IntegerType) else pa.string()
    types = [id_type, pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]

    def columns(ids: list, met: list, texts: list, done: Iterator[tuple[str, int]]) -> list[pa.Array]:
        out = [(i, k, t, *(next(done) if t is not None else (None, 0))) for i, k, t in zip(ids, met, texts, strict=True)]
        return [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, group in groupby(rows(), key=lambda r: r[3]):
            ids, met, texts, _ = zip(*group, strict=True)
            yield pa.RecordBatch.from_arrays(columns(ids, met, texts, iter(_unique_of_host([t for t in texts if t is not None], length, pages))), names=schema.names)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(batch.column(0).to_pylist(), length)
            host, shard = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            part = np.unique(np.stack([host, shard]), axis=1, return_inverse=True)[1].ravel()
            for k in np.unique(part[w.page]):
                here = part[w.page] == k
                found, n = _counted(w.anchor[here], w.page[here])
                first = int(np.argmax(part == k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), host[first])), pa.array(np.full(len(found), shard[first])), pa.array(found), pa.array(n)], names=["host", "shard", "value", "n"])

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("value").to_numpy()
        texts = [t for t in left.column("clean").to_pylist() if t is not None] if len(known) else []
        w = Windows(texts, length)
        hit = np.isin(w.anchor, known)
        found, n = _counted(w.value[hit], w.page[hit])
        key = [left.column(c)[0].as_py() if left.num_rows else 0 for c in ("host", "shard")]
        return pa.table([pa.array(np.full(len(found), key[0], np.int64)), pa.array(np.full(len(found), key[1], np.int64)), pa.array(found), pa.array(n)], names=["host", "shard", "value", "n"])

    def marked(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("clean").to_pylist()
        done = iter(_unique_of_part([t for t in texts if t is not None], length, right.column("value").to_numpy()))
        return pa.Table.from_arrays(columns(left.column(id_col).to_pylist(), left.column("kinds").to_pylist(), texts, done), names=schema.names)

    def often(counts: DataFrame) -> DataFrame:
        """Values on enough pages of the host, for each shard that holds them."""
        summed = counts.groupBy("host", "shard", "value").agg(F.sum("n").alias("n"))
        return summed.withColumn("n", F.sum("n").over(Window.partitionBy("host", "value"))).where(F.col("n") >= pages)

    cold = placed.where("parts IS NULL").select(id_col, "kinds", "clean", "host")
    out = cold.repartition("host").sortWithinPartitions("host").mapInArrow(whole, schema)
    if not n_hot:
        return out
    parted = placed.where("parts IS NOT NULL").select(id_col, "kinds", "clean", "host", F.pmod(F.xxhash64(id_col, "clean"), F.col("parts")).alias("shard"))
    counts = "host long, shard long, value long, n long"
    shared = often(parted.where("clean IS NOT NULL").select("clean", "host", "shard").mapInArrow(anchors, counts))
    common = often(parted.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard")).applyInArrow(windows, counts))
    return out.unionAll(parted.groupBy("host", "shard").cogroup(common.groupBy("host", "shard")).applyInArrow(marked, schema))
