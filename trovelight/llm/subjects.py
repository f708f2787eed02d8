"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

The labelled sample lies in a fixed number of blocks; each step every block computes its gradient and
sends the rows of the buckets it touches, the driver adds them up and moves the parameters, which
are small and bounded. Neither depends on the cores or the corpus. Then every document is scored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.operators.sampling import hash_sample
from trovelight.session import cut_lineage

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str, buckets: int) -> np.ndarray:
    """Buckets of a word, which counts twice, and of its subwords of four characters."""
    marked = f"<{word}>"
    parts = [word, word, *(marked[i : i + 4] for i in range(len(marked) - 3))]
    return np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) % buckets for p in parts], np.int32)


@dataclass
class Model:
    """Embedding, output weights, biases and the thresholds of the subjects."""

    subjects: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray

    def word_scores(self) -> np.ndarray:
        """What each bucket adds to each subject's score."""
        return self.embedding @ self.weights


class Sums:
    """Sums of rows by key; the order of the keys is found once."""

    def __init__(self, key: np.ndarray):
        self.order = None if (key[1:] >= key[:-1]).all() else np.argsort(key, kind="stable").astype(np.int32)
        sorted_keys = key if self.order is None else key[self.order]
        self.first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(key) else np.empty(0, np.int64)
        self.keys = sorted_keys[self.first]

    def rows(self, value: np.ndarray) -> np.ndarray:
        """One row for each of ``keys``."""
        if not len(self.keys):
            return np.zeros((0, value.shape[1]), np.float32)
        return np.add.reduceat(value if self.order is None else value[self.order], self.first, axis=0)

    def spread(self, value: np.ndarray, n: int) -> np.ndarray:
        """``n`` rows by key."""
        out = np.zeros((n, value.shape[1]), np.float32)
        out[self.keys] = self.rows(value)
        return out


class Block:
    """Labelled documents as sparse counts: documents by words, and words by buckets."""

    def __init__(self, texts: list[str], labels: np.ndarray, buckets: int):
        number: dict[str, int] = {}
        rows, columns, counts = [], [], []
        for k, text in enumerate(texts):
            seen: dict[int, int] = {}
            for w in _WORD.findall(text.lower()):
                i = number.setdefault(w, len(number))
                seen[i] = seen.get(i, 0) + 1
            rows += [k] * len(seen)
            columns += seen
            counts += seen.values()
        self.labels, self.n, self.n_words = labels.astype(np.float32), len(texts), len(number)
        self.row, self.column = np.array(rows, np.int32), np.array(columns, np.int32)
        total = np.maximum(np.bincount(self.row, counts, len(texts)), 1)
        self.share = (np.array(counts) / total[self.row]).astype(np.float32) if rows else np.empty(0, np.float32)
        parts = [features(w, buckets) for w in number]
        self.part_word = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        self.part = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.part_share = np.repeat(np.array([1 / len(p) for p in parts], np.float32), [len(p) for p in parts]) if parts else np.empty(0, np.float32)

        self.by_row, self.by_column, self.by_part, self.by_word = Sums(self.row), Sums(self.column), Sums(self.part), Sums(self.part_word)

    @property
    def buckets(self) -> np.ndarray:
        """The buckets that the block's words touch; gradients come in their order."""
        return self.by_part.keys

    def gradient(self, embedding: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
        """Gradients of the summed logistic loss (of the touched buckets only), the loss, and the scores."""
        word = self.by_word.spread(embedding[self.part] * self.part_share[:, None], self.n_words)
        doc = self.by_row.spread(word[self.column] * self.share[:, None], self.n)
        score = doc @ weights + bias
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        off = p - self.labels
        loss = -np.log(np.where(self.labels > 0, p, 1 - p) + 1e-9).sum()
        to_doc = off @ weights.T
        to_word = self.by_column.spread(to_doc[self.row] * self.share[:, None], self.n_words)
        to_bucket = self.by_part.rows(to_word[self.part_word] * self.part_share[:, None])
        return to_bucket, doc.T @ off, off.sum(0), float(loss), score


def _best_thresholds(score: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each subject the score that separates its labelled documents best, by F1."""
    out = np.zeros(label.shape[1])
    for s in range(label.shape[1]):
        order = np.argsort(-score[:, s], kind="stable")
        got = np.cumsum(label[order, s])
        f1 = 2 * got / (np.arange(1, len(order) + 1) + max(label[:, s].sum(), 1))
        k = int(np.argmax(f1)) if len(order) and label[:, s].any() else -1
        if k >= 0:
            below = score[order[k + 1], s] if k + 1 < len(order) else score[order[k], s] - 1
            out[s] = (score[order[k], s] + below) / 2
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    subjects: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    subject_col: str = "subject",
    sample: int = 20_000,
    buckets: int = 32_768,
    size: int = 16,
    steps: int = 60,
    rate: float = 0.2,
    decay: float = 1e-4,
    seed: int = 7,
    blocks: int = 8,
    most_subjects: int = 10_000,
) -> Model:
    """Fit the model on at most ``sample`` labelled documents, about those of lowest id hash.

    A document's row in ``labels`` with a null subject says it has none; subjects that the subject
    table lacks are ignored; more than ``most_subjects`` raise an error. Every step is one job over
    the ``blocks`` blocks: their gradients are added, then Adam moves the parameters (``buckets`` by
    ``size`` floats, whatever the corpus). No labels give a model that assigns nothing.
    """
    spark = docs.sparkSession
    names = sorted(r[0] for r in subjects.select(subject_col).where(F.col(subject_col) != "").distinct().limit(most_subjects + 1).collect())
    if len(names) > most_subjects:
        raise ValueError(f"over {most_subjects} subjects")
    place = {s: k for k, s in enumerate(names)}
    wanted = hash_sample(labels.groupBy(id_col).agg(F.collect_set(subject_col).alias("_s")), id_col, rows=sample)
    text = docs.select(id_col, F.col(text_col).alias("_t")).where("_t IS NOT NULL")
    held = text.join(F.broadcast(wanted), id_col).repartition(blocks, F.xxhash64(id_col))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, given = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            given += batch.column(2).to_pylist()
        if texts:
            y = np.zeros((len(texts), len(names)), np.float32)
            for k, found in enumerate(given):
                y[k, [place[s] for s in found if s in place]] = 1
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block(texts, y, buckets))], pa.binary())], names=["block"])

    packed = cut_lineage(held.mapInArrow(pack, "block binary"))
    random = np.random.default_rng(seed)
    values = [random.uniform(-1, 1, (buckets, size)).astype(np.float32) / size, np.zeros((size, len(names)), np.float32), np.full(len(names), -2, np.float32)]
    values[1] += random.normal(0, 0.1, values[1].shape).astype(np.float32)
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    gradients = T.StructType([T.StructField("g", T.BinaryType())])

    def step_over(sent, with_scores: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    block = pickle.loads(raw)
                    *g, loss, score = block.gradient(*sent.value)
                    out = (block.n, loss, score, block.labels) if with_scores else (block.n, block.buckets, *g)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], names=["g"])

        return packed.mapInArrow(run, gradients)

    for step in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(values)
        total, n = [np.zeros_like(v) for v in values], 0
        for row in step_over(sent, False).collect():
            m, touched, rows, *rest = pickle.loads(row[0])
            n += m
            total[0][touched] += rows
            for a, b in zip(total[1:], rest, strict=True):
                a += b
        sent.destroy()
        if not n:
            break
        for k, g in enumerate(total):
            g = g / n + decay * values[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            values[k] = values[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    sent = spark.sparkContext.broadcast(values)
    ends = [pickle.loads(r[0]) for r in step_over(sent, True).collect()]
    sent.destroy()
    if not ends:
        return Model(names, *values, np.full(len(names), np.inf))
    threshold = _best_thresholds(np.concatenate([e[2] for e in ends]), np.concatenate([e[3] for e in ends]))
    return Model(names, *values, np.where(np.concatenate([e[3] for e in ends]).any(0), threshold, np.inf))


def assign(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", every: bool = False, cache_words: int = 200_000) -> DataFrame:
    """Subjects of every document: ``id_col``, ``subject`` and ``probability``.

    A document has a row for each subject whose score exceeds the subject's threshold, all subjects
    with ``every``; null texts and texts without words have none. Whole texts are scored. Repeated
    ids are scored as separate rows; other columns are ignored. No shuffle; the model is broadcast
    and its size is fixed by its parameters.
    """
    kind = docs.select(id_col).schema[0]
    schema = T.StructType([kind, T.StructField("subject", T.StringType()), T.StructField("probability", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.subjects, model.word_scores(), model.bias, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, bias, threshold = sent.value
        number: dict[str, int] = {}
        vectors = np.empty((1024, len(names)), np.float32)
        for batch in batches:
            where, which, chance = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = _WORD.findall(text.lower()) if text else []
                if not found:
                    continue
                if len(number) > cache_words:
                    number.clear()
                for w in found:
                    if w not in number:
                        if len(number) == len(vectors):
                            vectors = np.concatenate([vectors, np.empty_like(vectors)])
                        vectors[len(number)] = table[features(w, len(table))].mean(0)
                        number[w] = len(number)
                score = vectors[[number[w] for w in found]].mean(0) + bias
                for s in range(len(names)) if every else np.flatnonzero(score > threshold):
                    where.append(k)
                    which.append(names[s])
                    chance.append(1 / (1 + np.exp(-float(score[s]))))
            ids = batch.column(0).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(which, pa.string()), pa.array(chance, pa.float64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def composition(assigned: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """How many documents of each source treat each subject: the make-up of the corpus."""
    return assigned.join(docs.select(id_col, F.coalesce(source_col, F.lit("")).alias("source")), id_col).groupBy("source", "subject").agg(F.countDistinct(id_col).alias("n_docs"))
