"""Bounded samples that don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, about those of lowest key hash; all rows where there are fewer.

    One count sets the hash below which about a quarter more than ``rows`` lie, so partitions send
    only their share of the sample, not ``rows`` each.
    """
    total = df.count()
    if total <= rows:
        return df
    place = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    below = int(2**63 * min(1.0, 1.25 * rows / total + 100 / total))
    return df.withColumn("_place", place).where(F.col("_place") < F.lit(min(below, 2**63 - 1))).orderBy("_place", *keys).limit(rows).drop("_place")
