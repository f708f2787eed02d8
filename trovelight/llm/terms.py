"""How distinctive each term is for a record: positive pointwise mutual information.

Only group-bys and joins. Term counts are combined map-side; the most frequent terms, a bounded
number, are joined by broadcast, so no frequent term is ever shuffled row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.session import cut_lineage


def _rows(records: DataFrame, id_col: str, entry_cols: Sequence[str], text_cols: Sequence[str], list_cols: Sequence[str], keep: str) -> DataFrame:
    """One row per record: its sorted terms, their number, and the hash of its entry."""
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols], *[F.array_join(c, " ") for c in list_cols])
    terms = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{keep})(?![\p{{L}}\p{{N}}])"), F.lit(0))
    return (
        records.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_e{k}") for k, c in enumerate(entry_cols)], _entry(entry_cols).alias("_entry"), F.sort_array(terms).alias("_all"))
        .withColumn("_n", F.size("_all"))
        .where(F.col("_n") > 0)
    )


def _entry(entry_cols: Sequence[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in entry_cols])


def _pairs(rows: DataFrame, *extra: str) -> DataFrame:
    """One row per record and term, with the term's count in the record (``tf``)."""
    starts = F.filter(F.transform("_all", lambda x, i: F.struct(i.alias("i"), x.alias("t"))), lambda z: (z["i"] == 0) | (F.get("_all", z["i"] - 1) != z["t"]))
    counted = rows.withColumn("_s", starts)
    runs = F.transform("_s", lambda z, k: F.struct(z["t"].alias("term"), (F.coalesce(F.get("_s", k + 1)["i"], F.col("_n")) - z["i"]).alias("tf")))
    return counted.select("_id", "_n", *extra, F.explode(runs).alias("x")).select("_id", "_n", *extra, "x.term", "x.tf")


def term_scores(
    records: DataFrame,
    *,
    id_col: str = "record_id",
    entry_cols: Sequence[str] = ("provider", "source_id"),
    text_cols: Sequence[str] = ("title", "description"),
    list_cols: Sequence[str] = ("categories",),
    keep: str = "[a-z]{4,}+",
    exponent: float = 0.75,
    frequent: int = 65_536,
    broadcast_entries: int = 100_000,
) -> DataFrame:
    """Every term of every record: ``id_col``, ``term``, ``tf``, ``entries`` and ``ppmi``.

    Terms are the pieces of the lower-cased texts between characters that are neither letters nor
    digits, of them those that are a ``keep`` (possessive). ``entries`` is the number of distinct entries (by
    ``entry_cols``) that hold the term; an entry delivered again counts once. The score is
    ``max(0, ln(p(term, record) / (p(term) * q(record))))`` where ``q`` is the record's share of
    the term counts raised to ``exponent``, which damps the bonus of short records.

    Null and empty texts and lists hold no terms; a record without terms gives no row; repeated
    ids are scored as separate rows; null entry columns are values of their own. Other columns are
    ignored. Empty tables give an empty result.
    """
    rows = _rows(records, id_col, entry_cols, text_cols, list_cols, keep)
    keys = [f"_e{k}" for k in range(len(entry_cols))]

    # an entry of one row adds 1 to each of its terms; only entries of several rows need a distinct
    again = cut_lineage(records.groupBy(_entry(entry_cols).alias("_entry")).count().where("count > 1").select("_entry", F.lit(True).alias("_again")))
    if again.limit(broadcast_entries + 1).count() <= broadcast_entries:
        again = F.broadcast(again)
    owner = F.when(F.col("_again"), F.struct(*keys))
    owned = _pairs(rows.join(again, "_entry", "left").withColumn("_owner", owner), "_owner").groupBy("term", "_owner").agg(F.sum("tf").alias("n"), F.count("*").alias("rows"))
    held = F.when(F.col("_owner").isNull(), F.col("rows")).otherwise(1)
    counts = cut_lineage(owned.groupBy("term").agg(F.sum("n").alias("n"), F.sum(held).alias("entries")))
    all_q = rows.agg(F.sum(F.pow(F.col("_n").cast("double"), F.lit(exponent)))).scalar()

    # of terms that each hold a share of 1/frequent of all pairs there can't be more than frequent
    pairs_in_all = counts.agg(F.sum("entries")).first()[0] or 0
    common = F.broadcast(counts.where(F.col("entries") > pairs_in_all // frequent))
    pairs = _pairs(rows).join(common.withColumnsRenamed({"n": "_cn", "entries": "_ce"}), "term", "left")
    near = pairs.where("_ce IS NOT NULL").withColumnsRenamed({"_cn": "n", "_ce": "entries"})
    far = pairs.where("_ce IS NULL").drop("_cn", "_ce").join(counts, "term")
    scored = near.unionByName(far)
    ratio = (F.col("tf") * all_q) / (F.col("n") * F.pow(F.col("_n").cast("double"), F.lit(exponent)))
    return scored.select(F.col("_id").alias(id_col), "term", F.col("tf").cast("long").alias("tf"), "entries", F.greatest(F.lit(0.0), F.log(ratio)).alias("ppmi"))


def rarest_shared_term(scores: DataFrame, *, id_col: str = "record_id", least: int = 2) -> DataFrame:
    """Of each record the term that fewest entries hold, of those at least ``least`` hold.

    Of equals the one most frequent in the record, then the first in byte order. Records without
    such a term give no row; repeated ids give one row.
    """
    best = F.min(F.struct("entries", (-F.col("tf")).alias("less"), "term"))
    return scores.where(F.col("entries") >= least).groupBy(id_col).agg(best.alias("best")).select(id_col, "best.term")
