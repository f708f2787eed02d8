"""Encoding of a corpus with a public byte-pair tokenizer, and its decoding."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter of every operator here.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: No token of the pattern spans the place between a non-space and a space.
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def _encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int) -> Iterator[str]:
    """Pieces of a long text, cut at safe boundaries so that their ids joined are the text's ids.

    A piece ends at the first safe boundary after ``size`` characters; a run without one stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _id_lists(texts: list[str | None], rank_file: str, pattern: str, size: int) -> pa.ListArray:
    encoding = _encoding(rank_file, pattern)
    parts: list[list[int]] = []
    lengths = np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        for piece in pieces(text or "", size):
            ids = encoding.encode_ordinary(piece)
            lengths[k + 1] += len(ids)
            parts.append(np.asarray(ids, np.int32))
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(values, pa.int32()))


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE, pattern: str = PATTERN, piece_chars: int = 20_000, slice_rows: int = 1_000) -> DataFrame:
    """Token ids of every text: ``id_col`` and ``ids``, an array of ints.

    A null and an empty text give an empty array. Text that spells a special token is ordinary
    text. Texts over ``piece_chars`` are encoded in pieces cut at safe boundaries, with the same
    ids. One row out per row in, repeated ids included; other columns are ignored. Narrow: no
    shuffle; a slice of ``slice_rows`` texts is held at a time.
    """
    schema = T.StructType([docs.select(id_col).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(part.column(1).to_pylist(), rank_file, pattern, piece_chars)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """Texts of id lists: ``id_col`` and ``text``, by joining the tokens' raw bytes.

    Ids are joined as bytes before they become text, so characters split over tokens survive.
    A null or empty list gives the empty text; bytes that are no UTF-8 become U+FFFD; an unknown
    id raises an error.
    """
    schema = T.StructType([encoded.select(id_col).schema[0], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoding = _encoding(rank_file, pattern)
            texts = [encoding.decode_bytes(ids or []).decode("utf-8", errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
