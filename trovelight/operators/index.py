"""The inverted index of a catalogue, as ordinary tables.

A document is one provider's share of a group: terms of a query never match across providers.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelight.functions.unicode import search_text, tokens
from trovelight.operators.grouping import build_records
from trovelight.operators.records import structured_text
from trovelight.session import cut_lineage

DOCUMENT = ("group", "provider")


@dataclass
class Index:
    """Tables of one generation.

    ``records``: grouped records. ``postings``: term, field, document, its words in the field, text
    and position. ``lengths``: words per document and field. ``terms``: documents per field and term.
    """

    records: DataFrame
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    n_documents: int | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "n_documents"}

    def documents(self) -> int:
        """The number of documents, counted once where the generation doesn't tell it."""
        if self.n_documents is None:
            self.n_documents = self.lengths.select(*DOCUMENT).distinct().count()
        return self.n_documents


def document_texts(records: DataFrame) -> DataFrame:
    """Distinct search texts of each document and field; the records of a hot group shrink to them.

    Records are placed by document once, before their texts are taken apart but after Python has folded them, as
    Spark forgets the placing there; what follows by document needs no further shuffle.
    """
    texts = {"title": F.col("title"), "description": F.col("description"), "structured": structured_text(records)}
    placed = records.select(*DOCUMENT, *[search_text(c).alias(f) for f, c in texts.items()]).repartition(*DOCUMENT)
    each = placed.select(*DOCUMENT, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in texts])).alias("x"))
    normal = each.select(*DOCUMENT, "x.field", "x.text").where("text <> ''")
    return normal.distinct().withColumn("text_id", F.xxhash64("text"))


def document_words(records: DataFrame) -> DataFrame:
    """The texts as lists of words, with ``n``, the words of the document's field, ``nth`` of the field's texts, and ``texts``, their number."""
    field = Window.partitionBy(*DOCUMENT, "field")
    words = document_texts(records).select(*DOCUMENT, "field", "text_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    return words.withColumns({"nth": F.row_number().over(field.orderBy("text_id")), "n": F.sum(F.size("words")).over(field), "texts": F.count("*").over(field)})


def build_index(records: DataFrame, words: DataFrame | None = None) -> Index:
    """The index of grouped records (see :func:`build_records`). Positions of structured texts aren't used.

    ``words``: the records' :func:`document_words`, where they are stored. Of them no posting moves, and of the fields
    of one text, most by far, only counts of terms do.
    """
    words = document_words(records) if words is None else words
    lengths = words.where("nth = 1").select(*DOCUMENT, "field", "n")
    postings = words.select(*DOCUMENT, "field", F.col("n").alias("words"), "text_id", F.posexplode("words").alias("pos", "term"))
    once = words.select("texts", *DOCUMENT, "field", F.explode(F.array_distinct("words")).alias("term"))
    held = once.where("texts = 1").select("field", "term").unionByName(once.where("texts > 1").select(*DOCUMENT, "field", "term").distinct().select("field", "term"))
    terms = held.groupBy("field", "term").agg(F.count("*").alias("df"))
    return Index(records, postings, lengths, terms)


def build(valid: DataFrame) -> Index:
    """Index of valid records, from merging and grouping on, its tables written to the shared folder in no layout."""
    records = cut_lineage(build_records(valid))
    index = build_index(records, cut_lineage(document_words(records)))
    return Index(index.records, *[cut_lineage(df) for n, df in index.tables().items() if n != "records"])


def arranged(name: str, df: DataFrame) -> DataFrame:
    """A table laid out for its readers, so scans skip row groups and pages: terms by term, records by group.

    Postings stay in the parts of their documents, each sorted by term: to place them all by term would move many
    times the records' bytes.
    """
    if name == "postings":
        return df.sortWithinPartitions("term", "group")
    keys = {"terms": ["term", "field"], "records": ["group", "provider"]}.get(name)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
