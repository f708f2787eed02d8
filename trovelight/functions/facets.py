"""Cleaning of facet lists and the completeness of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.functions.text import ascii_fold, filled

IDENTIFIER_FACETS = ("categories", "content_kinds", "media_kinds", "languages", "architectures", "codecs")
TEXT_FIELDS = ("description", "infohash_v1", "infohash_v2", "details_url", "magnet_uri", "torrent_url")
KNOWN_FIELDS = ("size_bytes", "published_at", "seeders", "leechers")


def identifiers(c: Column) -> Column:
    """Facet identifiers: folded, valid ones only, sorted, each once; null becomes empty."""
    folded = F.transform(F.coalesce(c, F.array().cast("array<string>")), ascii_fold)
    return F.array_sort(F.array_distinct(F.filter(folded, lambda x: x.rlike("^[a-z0-9_-]{1,64}$"))))


def extension_set(c: Column) -> Column:
    """File extensions: lower case, one leading point, sorted, each once."""
    bare = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_replace(ascii_fold(x), r"^\.", ""))
    kept = F.filter(bare, lambda x: x.rlike("^[a-z0-9]{1,16}$"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.concat(F.lit("."), x))))


def resolution_set(c: Column) -> Column:
    """Resolutions from 100 to 8640, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda x: x.between(100, 8640))))


def clean_facet(name: str, c: Column) -> Column:
    if name == "extensions":
        return extension_set(c)
    return resolution_set(c) if name == "resolutions" else identifiers(c)


def completeness(df: DataFrame, cleaned: bool = False) -> Column:
    """Number of filled fields and facet values of a record.

    Title, provider and source_id don't count. Blank texts and nulls count nothing.
    ``cleaned``: the facet lists have been cleaned before.
    """
    facets = [c for c in (*IDENTIFIER_FACETS, "extensions", "resolutions") if c in df.columns]
    parts = [filled(F.col(c)).cast("int") for c in TEXT_FIELDS if c in df.columns]
    parts += [F.col(c).isNotNull().cast("int") for c in KNOWN_FIELDS if c in df.columns]
    parts += [F.size(F.coalesce(F.col(c), F.array()) if cleaned else clean_facet(c, F.col(c))) for c in facets]
    return sum(parts[1:], parts[0]) if parts else F.lit(0)
