"""Provider rows to canonical records, each with the reasons why it isn't one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight import schema as S
from trovelight.functions.facets import completeness, extension_set, identifiers, resolution_set
from trovelight.functions.text import info_hash, strip
from trovelight.functions.unicode import display_text, search_text


def _error(condition: Column, reason: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(reason))


def web_url(c: Column) -> Column:
    """Whether a URL is https with a host and no user."""
    return (F.octet_length(c) <= S.URL_BYTES) & c.rlike(r"^(?i:https)://[^/?#@\s\\]+(?:[/?#]\S*)?$")


def magnet_uri(c: Column) -> Column:
    return (F.octet_length(c) <= S.URL_BYTES) & c.rlike(r"^(?i:magnet):[^?#\s]*\?[^#\s]+")


def normalize_records(raw: DataFrame) -> DataFrame:
    """Canonical records with ``errors``, an array of reasons, empty for a valid one.

    Texts are cleaned, hashes and facets folded, times cut to days; absent texts are empty, unknown
    numbers and days null, absent lists empty. A value that breaks a rule gives an error, and of
    lists the valid values are kept. Missing columns count as null, others are left out; repeated
    rows stay repeated. Null rows fail on their required fields.
    """
    df = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in S.RECORD])
    text = {n: F.coalesce(F.col(n), F.lit("")) for n in ("source_id", "title", "description")}
    caps = {"source_id": S.SOURCE_ID_BYTES, "title": S.TITLE_BYTES, "description": S.DESCRIPTION_BYTES}
    clean = df.select(
        *[F.col(n).alias(f"raw_{n}") for n in df.columns],
        search_text(F.coalesce("provider", F.lit(""))).alias("provider"),
        *[display_text(c).alias(n) for n, c in text.items()],
    )

    def raw_of(n: str) -> Column:
        return F.col(f"raw_{n}")

    hashes = {n: F.coalesce(info_hash(raw_of(n), d), F.lit("")) for n, d in (("infohash_v1", 40), ("infohash_v2", 64))}
    urls = {n: F.coalesce(strip(raw_of(n)), F.lit("")) for n in ("details_url", "magnet_uri", "torrent_url")}
    lists = {n: identifiers(raw_of(n)) for n in S.FACETS if n not in ("extensions", "resolutions")} | {"extensions": extension_set(raw_of("extensions")), "resolutions": resolution_set(raw_of("resolutions"))}
    given = {n: F.coalesce(raw_of(n), F.array()) for n in lists}

    def all_valid(n: str) -> Column:
        if n == "resolutions":
            return F.forall(given[n], lambda x: x.between(100, 8640))
        folded = F.transform(given[n], lambda x: F.lower(strip(x)))
        return F.forall(folded, lambda x: x.rlike(r"^\.?[a-z0-9]{1,16}$" if n == "extensions" else "^[a-z0-9_-]{1,64}$"))

    problems = [
        _error(~F.col("provider").rlike("^[a-z0-9_-]{1,64}$"), "provider"),
        *[_error((F.octet_length(raw_of(n)) > cap) | (F.octet_length(n) > cap) | ~F.is_valid_utf8(raw_of(n)), f"{n} too long or not UTF-8") for n, cap in caps.items()],
        *[_error(F.col(n) == "", f"{n} missing") for n in ("source_id", "title")],
        *[_error((strip(raw_of(n)) != "") & (c == ""), n) for n, c in hashes.items()],
        *[_error((c != "") & ~(magnet_uri(c) if n == "magnet_uri" else web_url(c)), n) for n, c in urls.items()],
        *[_error(raw_of(n) < 0, n) for n in ("size_bytes", "seeders", "leechers")],
        *[_error((F.size(given[n]) > S.FACET_VALUES) | ~all_valid(n), n) for n in lists],
    ]
    # lists are read before their names are given to the clean ones
    return clean.select(
        "provider",
        *text,
        *[c.alias(n) for n, c in hashes.items()],
        *[urls[n].alias(n) for n in ("details_url", "magnet_uri", "torrent_url")],
        F.when(raw_of("size_bytes") >= 0, raw_of("size_bytes")).cast("long").alias("size_bytes"),
        F.to_date(raw_of("published_at")).alias("published_at"),
        *[lists[n].alias(n) for n in S.FACETS],
        *[F.when(raw_of(n) >= 0, raw_of(n)).cast("int").alias(n) for n in ("seeders", "leechers")],
        F.filter(F.array(*problems), lambda e: e.isNotNull()).alias("errors"),
    )


def split_records(normal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantined ones with their errors)."""
    return normal.where(F.size("errors") == 0).drop("errors"), normal.where(F.size("errors") > 0)


def require_valid(normal: DataFrame) -> DataFrame:
    """The records, raising on the first invalid one when evaluated."""
    failed = F.raise_error(F.concat(F.lit("invalid record: "), F.concat_ws(", ", "errors")))
    return normal.where(F.when(F.size("errors") > 0, failed.cast("boolean")).otherwise(True)).drop("errors")


def structured_text(df: DataFrame) -> Column:
    """The facets as one text, in their fixed order, resolutions as ``1080p``."""
    order = ("categories", "content_kinds", "media_kinds", "extensions", "languages", "architectures")
    lines = F.transform(F.coalesce("resolutions", F.array().cast("array<int>")), lambda x: F.concat(x.cast("string"), F.lit("p")))
    return F.array_join(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in order], lines, F.coalesce("codecs", F.array().cast("array<string>"))), " ")


def source_key(provider: Column, source_id: Column) -> Column:
    return F.concat(provider, F.char(F.lit(0)), source_id)


def with_identity(records: DataFrame) -> DataFrame:
    """Records with ``completeness`` and ``source``, the digest of provider and source_id."""
    return records.withColumn("completeness", completeness(records, cleaned=True)).withColumn("source", F.sha2(source_key(F.col("provider"), F.col("source_id")), 256))


def encoded(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """A record's canonical JSON: fields in order, absent ones left out, HTML characters escaped."""
    kinds = dict(df.dtypes)

    def present(n: str) -> Column:
        c = F.col(n)
        if kinds[n].startswith("array"):
            return F.when(F.size(c) > 0, c)
        if n == "published_at":
            return F.date_format(c, "yyyy-MM-dd'T00:00:00Z'")
        return F.when(c != "", c) if kinds[n] == "string" else c

    text = F.to_json(F.struct(*[present(n).alias(n) for n in S.FIELDS if n in kinds and n not in skip]))
    for raw in "&<>\u2028\u2029":
        text = F.replace(text, F.lit(raw), F.lit(f"\\u{ord(raw):04x}"))
    return text
