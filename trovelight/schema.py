"""Schemas and limits of records and results."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("infohash_v1", T.StringType()),
        T.StructField("infohash_v2", T.StringType()),
        T.StructField("details_url", T.StringType()),
        T.StructField("magnet_uri", T.StringType()),
        T.StructField("torrent_url", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("published_at", T.DateType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("content_kinds", T.ArrayType(T.StringType())),
        T.StructField("media_kinds", T.ArrayType(T.StringType())),
        T.StructField("extensions", T.ArrayType(T.StringType())),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("architectures", T.ArrayType(T.StringType())),
        T.StructField("resolutions", T.ArrayType(T.IntegerType())),
        T.StructField("codecs", T.ArrayType(T.StringType())),
        T.StructField("seeders", T.IntegerType()),
        T.StructField("leechers", T.IntegerType()),
    ]
)
FIELDS = tuple(RECORD.names)
FACETS = ("categories", "content_kinds", "media_kinds", "extensions", "languages", "architectures", "resolutions", "codecs")

# Limits on untrusted input, in bytes where a text is meant.
TITLE_BYTES, SOURCE_ID_BYTES, DESCRIPTION_BYTES, URL_BYTES = 1024, 1024, 65_536, 4096
FACET_VALUES, FACET_BYTES = 64, 64
QUERY_BYTES, QUERY_TOKENS, RESULT_LIMIT, DEFAULT_LIMIT = 4096, 256, 1000, 50
CATALOGUE_BYTES, CATALOGUE_RECORDS, METAINFO_BYTES, BODY_BYTES = 8 << 20, 100_000, 16 << 20, 32 << 20
CELL_BYTES = 4096
OUTPUT_VERSION = SNAPSHOT_VERSION = QUERY_VERSION = 1


def conform(df):
    """``df`` with every field of :data:`RECORD`, absent ones null, in order; other columns go."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD])
