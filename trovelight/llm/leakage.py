"""Evaluation passages inside a corpus, found with an FM-index per training shard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.session import written

_WORD = re.compile(r"[^\W_]+")
_END, _DOC, _OTHER, _FIRST = 0, 1, 2, 3


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of an int sequence, by prefix doubling over sorted rank pairs."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, ahead[1:] != ahead[:-1]])
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Backward search over a sequence of small ints; every operation takes arrays of queries.

    The sequence must end in its only 0, the lowest symbol.
    """

    def __init__(self, s: np.ndarray, sample: int = 32):
        sa = suffix_array(s)
        self.n, self.sample = len(s), sample
        self.bwt = s[sa - 1]
        self.starts = np.searchsorted(s[sa], np.arange(int(s.max()) + 2))
        self.levels = max(1, int(s.max()).bit_length())
        self.ones, self.zeros, rest = [], [], self.bwt
        for level in range(self.levels - 1, -1, -1):  # the wavelet tree, stored level by level
            bit = (rest >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.kept = sa % sample == 0
        self.place = np.cumsum(self.kept) - 1
        self.position = sa[self.kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol ``c`` occurs before place ``i`` of the transform."""
        first = np.zeros_like(i)
        for k in range(self.levels):
            bit = (c >> (self.levels - 1 - k)) & 1
            a, b = self.ones[k][i], self.ones[k][first]
            i = np.where(bit == 1, self.zeros[k] + a, i - a)
            first = np.where(bit == 1, self.zeros[k] + b, first - b)
        return i - first

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each row of ``phrases``; empty where low >= high."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            live = np.flatnonzero((low < high) & (c < len(self.starts) - 1))
            c = c[live]
            new_low, new_high = self.starts[c] + self.rank(c, low[live]), self.starts[c] + self.rank(c, high[live])
            low, high = np.ones_like(low), np.zeros_like(high)
            low[live], high[live] = new_low, new_high
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the sequence of places of the suffix array, by walking to sampled ones."""
        at, steps, out = at.copy(), np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        while len(todo):
            here = at[todo]
            done = self.kept[here]
            out[todo[done]] = self.position[self.place[here[done]]] + steps[todo[done]]
            todo, here = todo[~done], here[~done]
            c = self.bwt[here]
            at[todo] = self.starts[c] + self.rank(c, here)
            steps[todo] += 1
        return out


class Phrases:
    """The distinct ``width``-word windows of a block of test items, and the items that hold each."""

    def __init__(self, items: list[tuple[int, str | None]], width: int):
        number: dict[str, int] = {}
        held: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [number.setdefault(w, len(number)) for w in words(text)]
            for k in range(len(ids) - width + 1):
                held.setdefault(tuple(ids[k : k + width]), set()).add(item)
        self.words = list(number)
        self.rows = np.array(list(held), np.int64).reshape(len(held), width)
        owners = [sorted(v) for v in held.values()]
        self.first = np.r_[0, np.cumsum([len(v) for v in owners])].astype(np.int64)
        self.owners = np.array([x for v in owners for x in v], np.int64)


class Items:
    """The written table of test items, read by the tasks in blocks of bounded size."""

    def __init__(self, folder: str, width: int, block_chars: int, kept_blocks: int = 4):
        self.folder, self.width, self.block_chars, self.kept_blocks = folder, width, block_chars, kept_blocks
        self.kept: list[Phrases] | None = None

    def blocks(self) -> Iterator[Phrases]:
        """All blocks; few ones are kept for the next shard."""
        if self.kept is not None:
            yield from self.kept
            return
        kept: list[Phrases] | None = []
        for block in self._read():
            yield block
            if kept is not None:
                kept.append(block)
                kept = kept if len(kept) <= self.kept_blocks else None
        self.kept = kept

    def _read(self) -> Iterator[Phrases]:
        system, path = fs.FileSystem.from_uri(self.folder)
        held: list[tuple[int, str]] = []
        size = 0
        for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
            if info.base_name.endswith(".parquet"):
                with system.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(256):
                        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                            held.append((item, text))
                            size += len(text)
                            if size >= self.block_chars:
                                yield Phrases(held, self.width)
                                held, size = [], 0
        if held:
            yield Phrases(held, self.width)


class _Shard:
    """Documents of one task until they are many enough for an index."""

    def __init__(self, width: int):
        self.width, self.number, self.symbols, self.doc, self.ids, self.size = width, {}, [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        number = self.number
        got = np.fromiter((number.setdefault(w, len(number)) for w in words(text)), np.int64)
        if len(got) >= self.width:
            self.symbols.append(got)
            self.ids.append(doc_id)
            self.size += len(got) + 1

    def spans(self, items: Items) -> Iterator[tuple]:
        """(document, item, starts, ends): word spans of each item in each document, merged.

        One index serves all blocks of items. A run of words that no item holds matches nothing, so
        one symbol stands for it, and only the words of items have symbols of their own.
        """
        if not self.ids:
            return
        known = np.zeros(len(self.number), bool)
        for block in items.blocks():
            known[[k for w in block.words if (k := self.number.get(w)) is not None]] = True
        if not known.any():
            return
        symbol = np.where(known, _FIRST + np.cumsum(known) - 1, _OTHER)
        parts, origin, doc = [], [], []
        for d, ids in enumerate(self.symbols):
            got = symbol[ids]
            at = np.flatnonzero(np.r_[True, (got[1:] != _OTHER) | (got[:-1] != _OTHER)])
            parts += [got[at], np.array([_DOC])]
            origin += [at, np.array([-1])]
            doc.append(np.full(len(at) + 1, d, np.int64))
        index = FmIndex(np.concatenate([*parts, np.array([_END])]))
        place, owner = np.concatenate(origin), np.concatenate(doc)
        for block in items.blocks():
            own = np.array([symbol[self.number[w]] if w in self.number else -1 for w in block.words], np.int64)
            rows = own[block.rows] if len(block.rows) else block.rows
            possible = np.flatnonzero((rows >= 0).all(1))
            low, high = index.search(rows[possible])
            hit = np.flatnonzero(low < high)
            if len(hit):
                yield from self._merged(block, index, place, owner, possible[hit], low[hit], high[hit])

    def _merged(self, p: Phrases, index: FmIndex, place: np.ndarray, owner: np.ndarray, hit: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        count = high - low
        phrase = np.repeat(hit, count)
        position = index.locate(np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()))
        doc, start = owner[position], place[position]
        owned = p.first[phrase + 1] - p.first[phrase]
        item = p.owners[np.repeat(p.first[phrase] - np.r_[0, np.cumsum(owned)[:-1]], owned) + np.arange(owned.sum())]
        doc, start = np.repeat(doc, owned), np.repeat(start, owned)
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        pair = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(pair, np.r_[pair[1:], len(doc)], strict=True):
            s = start[a:b]
            cut = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + self.width])
            ends = np.r_[s[cut[1:] - 1], s[-1]] + self.width
            yield self.ids[doc[a]], int(item[a]), s[cut].tolist(), ends.tolist()


def leaked_spans(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, shard_words: int = 300_000, block_chars: int = 4_000_000) -> DataFrame:
    """Documents that hold at least ``width`` consecutive words of a test item.

    Returns ``id_col``, ``item_col``, ``starts`` and ``ends``: the word spans to remove, merged,
    ends exclusive. Words are runs of letters and digits in lower case, so case, punctuation and
    spacing don't matter. Every document of every shard is indexed whole, in one pass over the
    corpus. Items shorter than ``width`` words and null or empty texts match nothing. A row is one
    document: repeated ids give repeated rows; an item's rows in different blocks too, so an item id
    should have one row. The items are written to the shared folder and read by the tasks in blocks of
    about ``block_chars`` characters, all of which are searched on each shard's index; they never
    pass through the driver. No shuffle.
    """
    schema = T.StructType([docs.select(id_col).schema[0], T.StructField(item_col, T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])
    folder = written(items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text <> ''"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Items(folder, width, block_chars)

        def emit(shard: _Shard) -> Iterator[pa.RecordBatch]:
            if rows := list(shard.spans(held)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (id_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=schema.names)

        shard = _Shard(width)
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if shard.size >= shard_words:
                    yield from emit(shard)
                    shard = _Shard(width)
        yield from emit(shard)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def removal_spans(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Of each document that leaks, the spans to remove: ``starts``, ``ends``, over all items, and ``n_words`` in them.

    Overlapping and adjoining spans are merged. Only a document's own distinct spans are gathered.
    """
    pairs = spans.select(id_col, F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    held = pairs.groupBy(id_col).agg(F.array_sort(F.collect_set("s")).alias("s"))

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], s["ends"]).alias("ends"))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["starts"] <= F.get(done, F.size(done) - 1)["ends"], grown).otherwise(F.concat(done, F.array(s)))

    merged = held.select(id_col, F.aggregate("s", F.slice("s", 1, 0), join).alias("s"))
    return merged.select(id_col, F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"]).alias("n_words"))


def leaked_items(spans: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Of each test item, the number of documents and of words that leaked; 0 where none did."""
    words_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    found = spans.groupBy(item_col).agg(F.countDistinct(id_col).alias("n_docs"), F.max(words_hit).alias("most_words"))
    return items.select(F.col(item_col).cast("long").alias(item_col)).distinct().join(found, item_col, "left").select(item_col, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_words", F.lit(0)).alias("most_words"))
