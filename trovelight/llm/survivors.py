"""The best representative of each group of records that share a hash.

Fields that depend on each other form bundles which are taken whole from one record. The choice
of bundles maximises trust by branch and bound, under the dependency that the group's hash
determines its second hash: bundles that name different second hashes exclude each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.functions.facets import clean_facet, completeness
from trovelight.functions.text import filled, info_hash
from trovelight.operators.membership import among
from trovelight.session import cut_lineage

#: Bundles of fields that hold together: an address with its swarm, a payload, a text, its facets.
BUNDLES: Mapping[str, Sequence[str]] = {
    "access": ("provider", "source_id", "details_url", "magnet_uri", "torrent_url", "seeders", "leechers"),
    "payload": ("infohash_v2", "size_bytes", "extensions", "resolutions", "codecs"),
    "words": ("title", "description", "languages"),
    "subject": ("categories", "content_kinds", "media_kinds", "architectures", "published_at"),
}

_RANK = "struct<trust:int,at:long,back:long>"


def branch_and_bound(options: Sequence[Sequence[tuple[tuple, str | None]]], start: Sequence[int]) -> list[int]:
    """For each bundle the index of the option to take, so that the ranks' sum is greatest.

    An option is (rank, determined value); two options whose values differ, both given, exclude
    each other. A rank is (trust, tie-breakers...); trusts add up, and of equal sums the
    lexicographically greater list of ranks wins. ``start`` is an allowed choice, the first bound.

    Of a bundle's options with the same value only the best can be taken. They are indexed by value:
    once one is fixed, two options are left of each later bundle, so the search is linear in them.
    """
    index: list[dict[str | None, int]] = []
    for held in options:
        best_of: dict[str | None, int] = {}
        for k, (rank, value) in enumerate(held):
            if value not in best_of or rank > held[best_of[value]][0]:
                best_of[value] = k
        index.append(best_of)
    order = [sorted(x.values(), key=lambda k, o=o: o[k][0], reverse=True) for x, o in zip(index, options, strict=True)]
    most = [o[x[0]][0] for x, o in zip(order, options, strict=True)]
    ahead = [sum(r[0] for r in most[b:]) for b in range(len(options) + 1)]
    best = list(start)
    best_value = (sum(o[k][0][0] for o, k in zip(options, start, strict=True)), [o[k][0] for o, k in zip(options, start, strict=True)])
    chosen: list[int] = []
    ranks: list[tuple] = []

    def go(b: int, trust: int, fixed: str | None) -> None:
        nonlocal best, best_value
        if b == len(options):
            if (trust, ranks) > best_value:
                best, best_value = list(chosen), (trust, list(ranks))
            return
        left = order[b] if fixed is None else sorted((index[b][v] for v in (fixed, None) if v in index[b]), key=lambda k: options[b][k][0], reverse=True)
        for k in left:
            rank, value = options[b][k]
            if (trust + rank[0] + ahead[b + 1], [*ranks, rank, *most[b + 1 :]]) <= best_value:
                return  # sorted by rank: no later option does better
            chosen.append(k)
            ranks.append(rank)
            go(b + 1, trust + rank[0], value or fixed)
            chosen.pop()
            ranks.pop()

    go(0, 0, None)
    return best


def _filled(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith("array"):
        return (F.size(clean_facet(name, c)) > 0).cast("int")
    return (filled(c) if kind == "string" else c.isNotNull()).cast("int")


def survivors(
    records: DataFrame,
    *,
    hash_col: str = "infohash_v1",
    id_col: str = "record_id",
    time_col: str = "fetched_at",
    determined_col: str = "infohash_v2",
    bundles: Mapping[str, Sequence[str]] = BUNDLES,
    trust: Column | None = None,
    chunk: int = 4096,
) -> DataFrame:
    """One row per hash that at least two records share.

    Returns ``hash_col`` (normalised), ``id_col`` of the most complete record (of equals the latest
    ``time_col``, then the lowest id), ``n_records``, and for each bundle ``<name>_from``, the
    record that supplies it. A bundle's trust is its number of filled fields times ``trust``
    (an int per record, 1 if not given); ties go to the later, then the lower id.

    Hashes are compared trimmed and in lower case, and only if they are 40 hex digits; other rows
    belong to no group. Null and blank fields aren't filled. A null time is the earliest. Repeated
    ids count as rows of their own. Of the rows with one (hash, determined value) only the best of
    each bundle goes on, combined map-side, so a hot hash shrinks before the shuffle; what is left
    of a hash is searched in chunks of ``chunk`` values, each with the rows that name no value.
    """
    kinds = dict(records.dtypes)
    weight = trust if trust is not None else F.lit(1)
    names = {b: [f for f in fields if f in kinds] for b, fields in bundles.items()}
    at = F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(-(2**62)))
    tail = [at.alias("at"), (-F.col(id_col)).alias("back")]
    determined = info_hash(F.col(determined_col), 64) if determined_col in kinds else F.lit(None).cast("string")
    ranked = records.select(
        F.unhex(info_hash(F.col(hash_col))).alias("h"),
        F.unhex(determined).alias("d"),
        F.struct(completeness(records).alias("trust"), *tail).cast(_RANK).alias("base"),
        *[F.struct((weight * sum((_filled(f, kinds[f]) for f in fields), F.lit(0))).alias("trust"), *tail).cast(_RANK).alias(b) for b, fields in names.items()],
    ).where("h IS NOT NULL")
    classes = ranked.groupBy("h", "d").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("base", *names)])

    # hashes with more values than a chunk holds are split, and their value-less class goes to each part
    hot = classes.groupBy("h").count().where(F.col("count") > chunk).select("h", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    split = classes.join(hot, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = split.withColumn("part", F.explode(F.when(F.col("d").isNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("d"), F.col("parts")).cast("int")))))
    placed = placed.withColumn("n", F.when(F.col("d").isNull() & (F.col("part") > 0), 0).otherwise(F.col("n")))

    choice = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.StructType([T.StructField("trust", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("back", T.LongType())])) for c in ("base", *names)], T.StructField("total", T.IntegerType())])
    columns = ["base", *names]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        out: list[dict] = []
        for (h, _), group in groupby(rows(), key=lambda r: (r["h"], r["part"])):
            held = list(group)  # at most a chunk of values
            n = sum(r["n"] for r in held)
            rank = [{c: tuple(r[c].values()) for c in columns} for r in held]
            base = max(range(len(held)), key=lambda k: rank[k]["base"])
            if len(held) == 1:
                if n == 1:
                    out.append({"h": h, "n": n, "base": held[0]["base"], **{b: held[0][b] for b in names}, "total": 0})
                else:
                    out.append({"h": h, "n": n, "base": held[0]["base"], **{b: held[0][b] for b in names}, "total": sum(rank[0][b][0] for b in names)})
            else:
                options = [[(rank[k][b], held[k]["d"]) for k in range(len(held))] for b in names]
                taken = branch_and_bound(options, [base] * len(options))
                out.append({"h": h, "n": n, "base": held[base]["base"], **{b: held[k][b] for b, k in zip(names, taken, strict=True)}, "total": sum(rank[k][b][0] for b, k in zip(names, taken, strict=True))})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rank_type = pa.struct([("trust", pa.int32()), ("at", pa.int64()), ("back", pa.int64())])
    arrow = pa.schema([("h", pa.binary()), ("n", pa.int64()), *[(c, rank_type) for c in columns], ("total", pa.int32())])
    parts = placed.select("h", "part", "d", "n", *columns).repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(search, choice)
    best = parts.groupBy("h").agg(F.sum("n").alias("n_records"), F.max("base").alias("base"), *[F.max_by(b, F.struct("total", *names)).alias(b) for b in names]).where("n_records > 1")
    id_type = kinds[id_col]
    return best.select(F.lower(F.hex("h")).alias(hash_col), (-F.col("base.back")).cast(id_type).alias(id_col), "n_records", *[(-F.col(f"{b}.back")).cast(id_type).alias(f"{b}_from") for b in names])


def assemble(chosen: DataFrame, records: DataFrame, *, hash_col: str = "infohash_v1", id_col: str = "record_id", bundles: Mapping[str, Sequence[str]] = BUNDLES, filter_bits: int = 25) -> DataFrame:
    """The surviving records: each hash with every bundle's fields, from the record that supplies them.

    Records that supply nothing are left out before the shuffle by a bitmap of at most
    ``2**filter_bits`` bits. A repeated id supplies the fields of one of its rows, that of lowest hash.
    """
    present = {b: [f for f in fields if f in records.columns] for b, fields in bundles.items()}
    every = [f for fields in present.values() for f in fields]
    froms = [F.col(f"{b}_from") for b in present]
    chosen = cut_lineage(chosen)
    wanted = chosen.select(F.col(hash_col).alias("_h"), "n_records", F.explode(F.array_distinct(F.array(*froms))).alias("from_id"), *[c.alias(f"_{b}_from") for b, c in zip(present, froms, strict=True)])
    rows = records.select(F.col(id_col).alias("from_id"), *[F.struct(*fields).alias(f"_{b}") for b, fields in present.items()], F.xxhash64(*every).alias("_order"))
    got = wanted.join(among(rows, ["from_id"], wanted, filter_bits), "from_id")
    best = got.groupBy("_h", "n_records").agg(*[F.min_by(f"_{b}", F.when(F.col("from_id") == F.col(f"_{b}_from"), F.col("_order"))).alias(b) for b in present])
    return best.select(F.col("_h").alias(hash_col), "n_records", *[F.col(f"{b}.{f}").alias(f if f != hash_col else f"{f}_raw") for b, fields in present.items() for f in fields])
