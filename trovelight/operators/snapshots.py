"""What changed between consecutive full snapshots of a table.

Keys and rows are reduced to 128-bit hashes on the JVM; the set differences run
over sorted numpy arrays, one hash bucket per task; full values are fetched only
for the keys that differ.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trovelight.functions.text import squash, strip
from trovelight.operators.membership import among
from trovelight.session import cut_lineage

KINDS = ("added", "removed", "changed")
_FOUND = T.StructType([T.StructField("chain", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("kind", T.ByteType())])


def http_date(c: Column) -> Column:
    """Timestamp of an HTTP date such as ``Mon, 13 Jan 2025 17:11:35 GMT``, null where it is none."""
    parts = F.regexp_extract(c, r"(\d{1,2}) +([A-Za-z]{3}) +(\d{4}) +(\d{2}:\d{2}:\d{2})", 0)
    return F.try_to_timestamp(F.regexp_replace(parts, " +", " "), F.lit("d MMM yyyy HH:mm:ss"))


def chain_snapshots(states: DataFrame, chain_col: str = "provider", id_col: str = "snapshot_id", modified_col: str = "last_modified", delivered_col: str = "delivered_at") -> DataFrame:
    """Place of each snapshot in its chain, from 1, and the snapshot before it.

    The order is by modification date; an unreadable date falls back to the delivery, and
    the lower id goes first of equals. One row per snapshot, so this is metadata-sized.
    """
    order = Window.partitionBy("chain").orderBy(F.coalesce(http_date(F.col(modified_col)), F.col(delivered_col).cast("timestamp")).asc_nulls_first(), F.col(id_col))
    return (
        states.where(F.col(id_col).isNotNull())
        .withColumn("chain", F.xxhash64(F.coalesce(F.col(chain_col), F.lit("")), F.lit("chain")))
        .select("chain", F.col(id_col).alias("snapshot_id"), F.row_number().over(order).alias("seq"), F.lag(id_col).over(order).alias("before_id"), F.count("*").over(Window.partitionBy("chain")).cast("int").alias("n_seq"))
    )


def _text(name: str, hashes: Sequence[str], sets: Sequence[str], kind: str, c: Column | None = None) -> Column:
    c = F.col(name) if c is None else c
    if name in sets:
        values = F.filter(F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: squash(x.cast("string"))), lambda x: x != "")
        return F.array_join(F.array_sort(F.array_distinct(values)), "\x1f")
    value = squash(c.cast("string"))
    return F.lower(value) if name in hashes else value


def _differences(chain: np.ndarray, seq: np.ndarray, last: np.ndarray, key: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(chain, seq, indexes, kind) of the keys that differ from the snapshot before.

    ``key`` and ``row`` hold dense numbers of the hashes; for a removed key the index is that
    of the row in the snapshot before.
    """
    order = np.lexsort((key, seq, chain))
    chain, seq, last, key, row = chain[order], seq[order], last[order], key[order], row[order]
    bounds = np.flatnonzero(np.r_[True, (chain[1:] != chain[:-1]) | (seq[1:] != seq[:-1])])
    ends = np.r_[bounds[1:], len(chain)]
    parts = {(chain[a], int(seq[a])): slice(a, b) for a, b in zip(bounds, ends, strict=True)}
    none = slice(0, 0)
    for c, n in {c: int(n) for c, n in zip(chain[bounds], last[bounds], strict=True)}.items():
        for s in range(2, n + 1):
            old, new = parts.get((c, s - 1), none), parts.get((c, s), none)
            a, b = key[old], key[new]
            if not len(a) and not len(b):
                continue
            place = np.searchsorted(a, b)
            known = np.zeros(len(b), bool)
            inside = place < len(a)
            known[inside] = a[place[inside]] == b[inside]
            yield c, s, order[new][~known], 0
            back = np.searchsorted(b, a)
            kept = np.zeros(len(a), bool)
            inside = back < len(b)
            kept[inside] = b[back[inside]] == a[inside]
            yield c, s, order[old][~kept], 1
            differs = row[new][known] != row[old][place[known]]
            yield c, s, order[new][known][differs], 2


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.r_[False, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return out


def _first_rows(col: dict[str, np.ndarray]) -> np.ndarray:
    """Of each key of a snapshot the place of the row that holds: lowest ordinal, then lowest hash."""
    order = np.lexsort((col["r2"], col["r1"], col["o"], col["k2"], col["k1"], col["seq"], col["chain"]))
    same = np.ones(max(0, len(order) - 1), bool)
    for c in ("chain", "seq", "k1", "k2"):
        x = col[c][order]
        same &= x[1:] == x[:-1]
    return order[np.r_[True, ~same]] if len(order) else order


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch without rows that others of it replace: a key repeated very often shrinks before the shuffle."""
    for batch in batches:
        kept = _first_rows({n: batch.column(n).to_numpy() for n in batch.schema.names})
        yield batch if len(kept) == batch.num_rows else batch.take(pa.array(kept))


def _diff_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    col = {n: t.column(n).to_numpy() for n in t.column_names}
    kept = _first_rows(col)
    col = {n: c[kept] for n, c in col.items()}
    key, row = _dense(col["k1"], col["k2"]), _dense(col["r1"], col["r2"])
    for chain, seq, at, kind in _differences(col["chain"], col["seq"], col["n_seq"], key, row):
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chain, np.int64)), pa.array(np.full(len(at), seq, np.int32)), pa.array(col["k1"][at]), pa.array(col["k2"][at]), pa.array(np.full(len(at), kind, np.int8))], names=_FOUND.names)


def snapshot_changes(
    states: DataFrame,
    records: DataFrame,
    *,
    key_col: str = "source_id",
    compared: Sequence[str] = ("title", "description", "infohash_v1", "size_bytes", "categories"),
    caseless: Sequence[str] = ("infohash_v1",),
    values: Sequence[str] = (),
    snapshot_col: str = "snapshot_id",
    ordinal_col: str = "ordinal",
    chain_col: str = "provider",
    bucket_rows: int = 500_000,
) -> DataFrame:
    """Keys added, removed or changed from each snapshot of a chain to the next.

    Returns ``snapshot_id`` (of the later snapshot), the trimmed key, ``change_kind`` and, for
    each name in ``values``, ``<name>_before`` and ``<name>_after``.

    Within a snapshot the row of the lowest ordinal of a key holds; of equal ordinals the one
    with the lower row hash. Array columns are compared as sets, texts with whitespace runs as
    one space, ``caseless`` ones without case; null equals empty. A null or blank key is the
    empty key. Records of unknown snapshots are left out; a snapshot without records removes
    every key of the one before; the first snapshot of a chain gives no rows. Empty tables give
    an empty result; other columns are ignored.

    One shuffle of 64 bytes a row, into buckets of about ``bucket_rows`` rows; rows that others of
    their batch replace don't enter it. Values are fetched by a join of differing keys.
    """
    types = dict(records.dtypes)
    compared = [c for c in compared if c in types]
    sets = [c for c in compared if types[c].startswith("array")]
    chained = chain_snapshots(states, chain_col, snapshot_col)
    key = strip(F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    body = [_text(c, caseless, sets, types[c]) for c in compared]
    ordinal = F.coalesce(F.col(ordinal_col), F.lit(2**62)).cast("long")
    k1, k2 = F.xxhash64(key), F.xxhash64(F.lit("second"), key)
    hashed = (
        records.select(F.col(snapshot_col).alias("snapshot_id"), k1.alias("k1"), k2.alias("k2"), ordinal.alias("o"), F.xxhash64(*body, F.lit(0)).alias("r1"), F.xxhash64(F.lit("second"), *body).alias("r2"))
        .join(chained.select("snapshot_id", "chain", "seq", "n_seq"), "snapshot_id")
        .select("chain", "seq", "n_seq", "k1", "k2", "o", "r1", "r2")
    )
    buckets = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // bucket_rows))
    thin = hashed.mapInArrow(_thin, hashed.schema).repartition(buckets, "chain", "k1")
    found = cut_lineage(thin.mapInArrow(_diff_partition, _FOUND)).join(chained.select("chain", "seq", "snapshot_id", "before_id"), ["chain", "seq"])

    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind").cast("int") + 1)
    later, before = F.when(F.col("kind") != 1, F.col("snapshot_id")), F.when(F.col("kind") != 0, F.col("before_id"))
    wanted = found.select("snapshot_id", "k1", "k2", kind.alias("change_kind"), F.explode(F.filter(F.array(F.struct(later.alias("at"), F.lit("after").alias("side")), F.struct(before.alias("at"), F.lit("before").alias("side"))) if values else F.array(F.struct(F.coalesce(later, before).alias("at"), F.lit("after").alias("side"))), lambda x: x["at"].isNotNull())).alias("x")).select("snapshot_id", "k1", "k2", "change_kind", "x.at", "x.side")
    # full values of differing keys only; the rest is left out before the shuffle
    some = among(records.select(F.col(snapshot_col).alias("at"), k1.alias("k1"), k2.alias("k2"), key.alias("_key"), ordinal.alias("_o"), F.struct(*[c for c in dict.fromkeys((*compared, *values)) if c in types] or [F.lit(0)]).alias("_row")), ["at", "k1", "k2"], wanted)
    full = some.select("at", "k1", "k2", "_key", "_o", F.xxhash64(*[_text(c, caseless, sets, types[c], F.col("_row")[c]) for c in compared], F.lit(0)).alias("_r"), *[F.col("_row")[c].alias(f"_v_{c}") for c in values])
    keep = F.struct("_key", *[f"_v_{c}" for c in values])
    rows = wanted.join(full, ["at", "k1", "k2"]).groupBy("snapshot_id", "k1", "k2", "change_kind").agg(
        *[F.min_by(F.when(F.col("side") == s, keep), F.when(F.col("side") == s, F.struct("_o", "_r"))).alias(s) for s in ("before", "after")]
    )
    out = [F.col(f"{s}._v_{c}").alias(f"{c}_{s}") for c in values for s in ("before", "after")]
    return rows.select("snapshot_id", F.coalesce("after._key", "before._key").alias(key_col), "change_kind", *out)
