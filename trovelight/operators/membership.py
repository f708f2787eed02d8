"""Filters by membership whose size is fixed, for use before a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def among(rows: DataFrame, keys: Sequence[str], wanted: DataFrame, bits: int = 25) -> DataFrame:
    """The rows whose keys may be among those of ``wanted``: all that are, and few others.

    A bitmap of the keys' hashes of at most ``2**bits`` bits is broadcast, whatever their number, so
    with very many keys it only filters less. A join must follow. Null keys are kept or dropped like
    any other value. Other columns stay as they are.
    """
    return _marked(rows, keys, wanted, bits, "inner").where("_among").drop("_among")


def flagged(rows: DataFrame, keys: Sequence[str], wanted: DataFrame, bits: int = 25) -> DataFrame:
    """All rows with ``_among``, which is true of those that :func:`among` keeps."""
    return _marked(rows, keys, wanted, bits, "left").withColumn("_among", F.coalesce("_among", F.lit(False)))


def _marked(rows: DataFrame, keys: Sequence[str], wanted: DataFrame, bits: int, how: str) -> DataFrame:
    at = F.pmod(F.xxhash64(*keys), F.lit(2**bits)) + 1
    bitmap = wanted.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bitmap"))
    bit = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap), "_bucket", how)
    return joined.withColumn("_among", F.getbit(byte, bit % 8) == 1).drop("_bucket", "_bitmap")
