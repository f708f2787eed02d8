"""One record per source, and the groups of sources that share a content hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight import schema as S
from trovelight.functions.facets import completeness
from trovelight.operators.membership import flagged
from trovelight.operators.records import encoded, source_key, with_identity
from trovelight.session import cut_lineage

#: Writes a named step and returns it read back.
Keep = Callable[[DataFrame, str], DataFrame]

#: Distinct hashes that one group may link; beyond it the build fails.
GROUP_HASHES = 65_536


@dataclass(frozen=True)
class Limits:
    """What a generation may hold at most; None where nothing is limited. Bytes are of canonical JSON."""

    records: int | None = None
    record_bytes: int | None = None
    group_sources: int | None = None
    group_bytes: int | None = None

    def check(self, records: DataFrame) -> None:
        """Raise for grouped records beyond a limit. Groups are only counted and summed."""
        sizes = records.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length(encoded(records)) + 1).alias("bytes"))
        row = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
        for what, is_, most in zip(("records", "bytes", "sources of a group", "bytes of a group"), row, astuple(self), strict=True):
            if most is not None and is_ > most:
                raise ValueError(f"{is_} {what}, over the limit of {most}")


# What an index of one process may hold.
ONE_PROCESS = Limits(1_000_000, 256 << 20, 4096, 16 << 20)


def merge_sources(records: DataFrame) -> DataFrame:
    """One record per (provider, source_id), with ``conflict`` where its rows contradict each other.

    The rows' only v1 and v2 hash are filled in; two different ones conflict, and so do a v1 and a
    v2 that no row holds together. The survivor is the most complete row, of equals the one of the
    least canonical JSON. A pure aggregation, combined map-side, so a source delivered very often
    costs nothing extra.
    """
    hashes = ("infohash_v1", "infohash_v2")
    rest = [c for c in records.columns if c not in hashes]
    ranked = records.withColumn("_rank", F.struct((-completeness(records.drop(*hashes), cleaned=True)).alias("less"), encoded(records, skip=hashes).alias("json")))
    full = {h: F.nullif(F.col(h), F.lit("")) for h in hashes}
    merged = ranked.groupBy("provider", "source_id").agg(
        F.min_by(F.struct(*rest), "_rank").alias("row"),
        *[F.max(c).alias(h) for h, c in full.items()],
        *[F.min(c).alias(f"_{h}") for h, c in full.items()],
        F.bool_or(full["infohash_v1"].isNotNull() & full["infohash_v2"].isNotNull()).alias("_both"),
        F.count("*").alias("n_rows"),
    )
    differ = (F.col("infohash_v1") != F.col("_infohash_v1")) | (F.col("infohash_v2") != F.col("_infohash_v2"))
    apart = F.col("infohash_v1").isNotNull() & F.col("infohash_v2").isNotNull() & ~F.col("_both")
    back = {h: F.coalesce(F.col(h), F.lit("")).alias(h) for h in hashes}
    return merged.select(*[back[c] if c in back else F.col(f"row.{c}").alias(c) for c in records.columns], (F.coalesce(differ, F.lit(False)) | apart).alias("conflict"), "n_rows")


def merge_stored(records: DataFrame) -> DataFrame:
    """The same of records that may be read several times: those of sources delivered once don't move."""
    key = ["provider", "source_id"]
    marked = flagged(records, key, records.groupBy(*key).count().where("count > 1"))
    back = [F.coalesce(c, F.lit("")).alias(c) if c in ("infohash_v1", "infohash_v2") else F.col(c) for c in records.columns]
    once = marked.where("NOT _among").select(*back, F.lit(False).alias("conflict"), F.lit(1).cast("long").alias("n_rows"))
    return once.unionByName(merge_sources(marked.where("_among").drop("_among")))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of a graph that fits one task."""
    above: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := above[x]) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], names=["node", "label"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, task_edges: int = 200_000) -> DataFrame:
    """``node`` and ``label``, the least node of its component, of an undirected graph of text nodes.

    Labels spread along edges and then jump to their label's label, so long chains take few rounds.
    Every round is written to the shared folder. A graph of at most ``task_edges`` distinct edges is
    labelled by one task instead, with the same result. Empty graphs give an empty result.
    """
    given = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    lone = given.where("x = y").select(F.col("x").alias("node")).distinct()
    once = cut_lineage(given.where("x <> y").distinct())
    if once.limit(task_edges + 1).count() <= task_edges:
        labels = once.coalesce(1).mapInArrow(_union_find, "node string, label string")
        return labels.unionByName(lone.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    linked = cut_lineage(once.unionByName(once.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    alone = lone.join(linked, F.col("node") == F.col("x"), "left_anti").select("node", F.col("node").alias("label"))
    labels = cut_lineage(linked.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    for _ in range(rounds):
        near = linked.join(labels, linked.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.x).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = cut_lineage(spread.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels.unionByName(alone)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def _named(v1: Column, v2: Column) -> Column:
    """The names of a record's hashes, such as ``v1:...``."""
    return F.filter(F.array(F.when(v1 != "", F.concat(F.lit("v1:"), v1)), F.when(v2 != "", F.concat(F.lit("v2:"), v2))), lambda x: x.isNotNull())


def group_records(records: DataFrame, limit: int = GROUP_HASHES) -> DataFrame:
    """Records with ``group``: those linked by a v1 or v2 hash, directly or through others, share one.

    The id is the digest of the group's sorted hash names; a record without hashes is a group of its
    own, by its source. The graph has a node per hash that some record holds beside another, and an
    edge per such pair, so it shrinks with copies; only records that may hold one of these hashes are
    joined with it, all others know their group. A group of over ``limit`` hashes raises an error.
    Null hashes count as absent.
    """
    held = records.withColumn("_h", _named(F.coalesce("infohash_v1", F.lit("")), F.coalesce("infohash_v2", F.lit(""))))
    edges = held.where(F.size("_h") == 2).select(F.get("_h", 0).alias("a"), F.get("_h", 1).alias("b")).distinct()
    nodes = connected(edges)
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"))
    guarded = nodes.join(sizes.where(F.col("n") > limit), "label", "left").where(F.when(F.col("n").isNotNull(), F.raise_error(F.lit("a group links too many hashes")).cast("boolean")).otherwise(True))
    ids = guarded.groupBy("label").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("node")), "\x00"), 256).alias("group"))
    by_hash = cut_lineage(nodes.join(ids, "label").select(F.col("node").alias("_first"), "group"))
    keyed = flagged(held.withColumn("_first", F.get("_h", 0)).drop("_h"), ["_first"], by_hash)
    own = F.sha2(F.coalesce("_first", source_key(F.col("provider"), F.col("source_id"))), 256)
    linked = keyed.where("_among").join(by_hash, "_first", "left").withColumn("group", F.coalesce("group", own))
    return keyed.where("NOT _among").withColumn("group", own).unionByName(linked).drop("_first", "_among")


def _checkpoint(df: DataFrame, name: str) -> DataFrame:
    return cut_lineage(df)


def build_records(valid: DataFrame, keep: Keep = _checkpoint) -> DataFrame:
    """Grouped records of a catalogue: merged by source, grouped, with completeness; conflicts raise.

    The steps are written, by default to the shared folder: each reads its input more than once.
    """
    merged = merge_stored(keep(valid.select(*S.FIELDS), "normal"))
    clash = F.raise_error(F.concat(F.lit("conflicting hashes of "), F.col("provider"), F.lit("/"), F.col("source_id")))
    return _grouped(keep(merged.where(F.when(F.col("conflict"), clash.cast("boolean")).otherwise(True)), "merged"))


def build_sound_records(valid: DataFrame, keep: Keep = _checkpoint) -> tuple[DataFrame, DataFrame]:
    """The same of the sources without conflicts, and the sources with one, for the quarantine. ``valid`` is read several times."""
    merged = keep(merge_stored(valid.select(*S.FIELDS)), "merged")
    return _grouped(merged.where(~F.col("conflict"))), merged.where("conflict").select(*S.FIELDS, F.array(F.lit("conflicting hashes")).alias("errors"))


def _grouped(merged: DataFrame) -> DataFrame:
    return with_identity(group_records(merged.drop("conflict", "n_rows")))


def agreed(c: Column) -> Column:
    """Aggregate: the one value all non-null rows agree on, else null."""
    return F.when(F.min(c) == F.max(c), F.max(c))


def group_summary(records: DataFrame) -> DataFrame:
    """Per group: agreed size and day, the greatest completeness, the sources and the providers."""
    return records.groupBy("group").agg(
        agreed(F.col("size_bytes")).alias("size_bytes"),
        agreed(F.col("published_at")).alias("published_at"),
        F.max("completeness").alias("completeness"),
        F.count("*").alias("source_count"),
        F.array_join(F.sort_array(F.collect_set("provider")), ",").alias("providers"),
    )


def first_of(df: DataFrame, key: str, ordinal: str | Column) -> DataFrame:
    """The row of the lowest ordinal of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), ordinal).alias("r")).select("r.*")
