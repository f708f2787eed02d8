"""The core's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelight import demo
from trovelight.demo import CATALOGUE_SQL, MERGED_SQL, batch_sql, search_sql, search_text_sql
from trovelight.functions.facets import completeness, identifiers
from trovelight.functions.text import info_hash, squash
from trovelight.functions.unicode import compact_text, search_text, terminal_text
from trovelight.operators.grouping import agreed, group_summary, merge_sources
from trovelight.operators.index import DOCUMENT
from trovelight.operators.records import normalize_records, split_records, structured_text
from trovelight.operators.snapshots import snapshot_changes
from trovelight.output import json_lines
from trovelight.plans.search import hits, search
from trovelight.schema import METAINFO_BYTES
from trovelight.session import table
from trovelight.sources.metainfo import files_of, inspect_bodies, inspect_magnets
from trovelight.sources.xml import items_of
from trovelight.sync import replace_provider

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "cache_states"), table(spark, folder, "snapshot_records"))


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "cache_states"), table(spark, folder, "snapshot_records"), values=("title", "size_bytes"))


_SQL_STATES = """
WITH chained AS (
  SELECT snapshot_id, provider, row_number() OVER w AS seq, lag(snapshot_id) OVER w AS before_id
  FROM cache_states WINDOW w AS (PARTITION BY provider ORDER BY strptime(last_modified, '%a, %d %b %Y %H:%M:%S GMT'), snapshot_id)
), cleaned AS (
  SELECT snapshot_id, ordinal, trim(source_id, E' \\t\\n') AS source_id, title AS raw_title, size_bytes,
    trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')) AS description,
    lower(trim(regexp_replace(coalesce(infohash_v1, ''), '\\s+', ' ', 'g'))) AS infohash_v1,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(categories, []), lambda x: trim(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g'))), lambda x: x <> ''))), '|') AS categories
  FROM snapshot_records
), held AS (
  SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY snapshot_id, source_id ORDER BY ordinal) = 1
), after_rows AS (SELECT c.snapshot_id AS at_id, h.* FROM chained c JOIN held h ON h.snapshot_id = c.snapshot_id WHERE c.before_id IS NOT NULL
), before_rows AS (SELECT c.snapshot_id AS at_id, h.* FROM chained c JOIN held h ON h.snapshot_id = c.before_id
), compared AS (
  SELECT coalesce(a.at_id, b.at_id) AS snapshot_id, coalesce(a.source_id, b.source_id) AS source_id,
    CASE WHEN b.source_id IS NULL THEN 'added' WHEN a.source_id IS NULL THEN 'removed'
      WHEN (a.title, a.description, a.infohash_v1, a.categories) <> (b.title, b.description, b.infohash_v1, b.categories) OR a.size_bytes IS DISTINCT FROM b.size_bytes THEN 'changed' END AS change_kind,
    b.raw_title AS title_before, a.raw_title AS title_after, b.size_bytes AS size_bytes_before, a.size_bytes AS size_bytes_after
  FROM after_rows a FULL JOIN before_rows b ON a.at_id = b.at_id AND a.source_id = b.source_id
)
"""


def _searched(text: str, limit: int | None = None, **providers) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        got = search(demo.index(spark, folder), demo.query(text, **providers), limit)
        return got.select(F.col("rank").cast("long").alias("rank"), "group", F.col("record.source_id").alias("source_id"), "source_count")

    return run


_SHELF, _HARBOR, _MILL = "openshelf", "harbor_index", "old_mill"
_ALLOWED, _DENIED = f"rec.provider IN ('{_SHELF}', '{_HARBOR}')", f"rec.provider NOT IN ('{_SHELF}')"
_DATE_DESC, _DATE_ASC, _SIZE_ASC, _SIZE_DESC = "published_at DESC NULLS LAST,", "published_at NULLS LAST,", "size_bytes NULLS LAST,", "size_bytes DESC NULLS LAST,"

#: name: (query text, further arguments, arguments of its SQL)
SEARCHES: dict[str, tuple[str, dict, dict]] = {
    "search_required_term": ("survey", {}, {"must": [["survey"]]}),
    "search_two_terms_cross_field": ("survey reader", {}, {"must": [["survey"], ["reader"]]}),
    "search_hyphen_all_tokens": ("kernels-survey", {}, {"must": [["kernels", "survey"]]}),
    "search_optional_boost": ("survey ?reader", {}, {"must": [["survey"]], "optional": [["reader"]]}),
    "search_optional_only": ("?galaxies", {}, {"optional": [["galaxies"]]}),
    "search_excluded_term": ("survey -kernels", {}, {"must": [["survey"]], "excluded": [["kernels"]]}),
    "search_excluded_only": ("-survey", {}, {"excluded": [["survey"]]}),
    "search_match_all": ("limit:1000 lang:en", {}, {"where": "list_contains(languages, 'en')", "limit": 1000}),
    "search_phrase": ('"second look"', {}, {"phrases": [["second", "look"]]}),
    "search_phrase_excluded": ('collection -"collection of open"', {}, {"must": [["collection"]], "phrases": [["-", "collection", "of", "open"]]}),
    "search_unicode_term": ("ÉTUDES", {}, {"must": [["études"]]}),
    "search_cyrillic_phrase": ('"Старые карты"', {}, {"phrases": [["старые", "карты"]]}),
    "search_folded_term": ("größere", {}, {"must": [["grössere"]]}),
    "search_ranked_topk": ("tracker", {"limit": 10}, {"must": [["tracker"]], "limit": 10}),
    "filter_size_range": ("collection size:>=1MB size:<2GiB", {}, {"must": [["collection"]], "where": "g_size >= 1000000 AND g_size < 2147483648"}),
    "filter_size_natural": ("collection between 1 MB and 2 GiB", {}, {"must": [["collection"]], "where": "g_size >= 1000000 AND g_size <= 2147483648"}),
    "filter_date_range": ("collection date:2010..2015", {}, {"must": [["collection"]], "where": "g_date BETWEEN DATE '2010-01-01' AND DATE '2015-12-31'"}),
    "filter_date_unknown_excluded": ("collection since 2004", {}, {"must": [["collection"]], "where": "g_date >= DATE '2004-01-01'"}),
    "filter_date_after": ("collection after 2015", {}, {"must": [["collection"]], "where": "g_date >= DATE '2016-01-01'"}),
    "filter_language_any": ("lang:fr lang:de", {}, {"where": "list_has_any(languages, ['fr', 'de'])"}),
    "filter_language_natural": ("galaxien in german", {}, {"must": [["galaxien"]], "where": "list_contains(languages, 'de')"}),
    "filter_category_any": ("category:science category:law", {}, {"where": "list_has_any(categories, ['science', 'law'])"}),
    "filter_kind_natural": ("survey dataset", {}, {"must": [["survey"]], "where": "list_contains(content_kinds, 'dataset')"}),
    "filter_media_any": ("media:video media:audio", {}, {"where": "list_has_any(media_kinds, ['video', 'audio'])"}),
    "filter_extension_any": ("ext:csv ext:.json survey", {}, {"must": [["survey"]], "where": "list_has_any(extensions, ['.csv', '.json'])"}),
    "filter_resolution_any": ("resolution:720p resolution:4k", {}, {"where": "list_has_any(resolutions, [720, 2160])"}),
    "filter_families": ("lang:en category:science kind:dataset", {}, {"where": "list_contains(languages, 'en') AND list_contains(categories, 'science') AND list_contains(content_kinds, 'dataset')"}),
    "filter_provider_allow": ("collection", {"allow": (_SHELF, _HARBOR)}, {"must": [["collection"]], "providers": _ALLOWED}),
    "filter_provider_deny": ("collection", {"deny": (_SHELF,)}, {"must": [["collection"]], "providers": _DENIED}),
    "filter_provider_deny_wins": ("collection", {"allow": (_SHELF, _HARBOR), "deny": (_SHELF,)}, {"must": [["collection"]], "providers": f"{_ALLOWED} AND {_DENIED}"}),
    "order_date_desc_nulls_last": ("collection newest first", {}, {"must": [["collection"]], "by": _DATE_DESC, "each": _DATE_DESC}),
    "order_date_asc_nulls_last": ("collection oldest first", {}, {"must": [["collection"]], "by": _DATE_ASC, "each": _DATE_ASC}),
    "order_size_asc": ("collection smallest first", {}, {"must": [["collection"]], "by": _SIZE_ASC, "each": _SIZE_ASC}),
    "order_size_desc": ("collection sort:largest", {}, {"must": [["collection"]], "by": _SIZE_DESC, "each": _SIZE_DESC}),
    "order_title": ("collection sort:title", {}, {"must": [["collection"]], "by": "folded,", "each": "folded,"}),
    "order_title_desc": ("collection sort:title-desc", {}, {"must": [["collection"]], "by": "folded DESC,", "each": "folded DESC,"}),
    "order_multi_key": ("collection sort:title sort:newest", {}, {"must": [["collection"]], "by": f"folded, {_DATE_DESC}", "each": f"folded, {_DATE_DESC}"}),
    "limit_default_50": ("the", {}, {"must": [["the"]]}),
    "limit_override": ("the limit:7", {}, {"must": [["the"]], "limit": 7}),
    "representative_relevance": ("kernels sort:relevance", {}, {"must": [["kernels"]]}),
    "representative_newest": ("kernels newest first", {}, {"must": [["kernels"]], "by": _DATE_DESC, "each": _DATE_DESC}),
}


_BATCH = ("search_two_terms_cross_field", "search_optional_only", "search_excluded_only", "search_phrase", "search_folded_term", "filter_date_range", "filter_families", "filter_language_any", "order_multi_key", "order_size_desc", "limit_override", "representative_newest")


def search_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Searches of all kinds in one plan."""
    names = [n for n in SEARCHES if n in _BATCH]
    got = hits(demo.index(spark, folder), [demo.query(SEARCHES[n][0]) for n in names])
    return got.select(F.element_at(F.array(*map(F.lit, names)), F.col("q") + 1).alias("name"), F.col("rank").cast("long").alias("rank"), "group", "source_id", "source_count")


def group_transitive_hash(spark: SparkSession, folder: str) -> DataFrame:
    return demo.index(spark, folder).records.select("provider", "source_id", "group")


def group_size_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return demo.index(spark, folder).records.groupBy("group").count().groupBy(F.col("count").alias("n_sources")).agg(F.count("*").alias("n_groups"))


def group_values(spark: SparkSession, folder: str) -> DataFrame:
    """Agreed size and day, completeness, sources and providers of each group."""
    return group_summary(demo.index(spark, folder).records).withColumn("published_at", F.col("published_at").cast("string"))


def record_completeness(spark: SparkSession, folder: str) -> DataFrame:
    return demo.index(spark, folder).records.select("provider", "source_id", F.col("completeness").cast("long").alias("completeness"))


def record_structured_text(spark: SparkSession, folder: str) -> DataFrame:
    records = demo.index(spark, folder).records
    return records.select("source_id", structured_text(records).alias("structured"))


def catalogue_scan(spark: SparkSession, folder: str) -> DataFrame:
    return demo.catalogue(spark, folder).records().select("provider", "source_id", "title")


def posting_stats(spark: SparkSession, folder: str) -> DataFrame:
    return demo.index(spark, folder).postings.groupBy("field", "term").agg(F.count("*").alias("n"))


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return demo.index(spark, folder).terms.select("field", "term", "df")


def field_length(spark: SparkSession, folder: str) -> DataFrame:
    return demo.index(spark, folder).lengths.select(*DOCUMENT, "field", "n")


def dedupe_source_key(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered records merged by source, with the rows each had and whether they contradict."""
    valid, _ = split_records(normalize_records(table(spark, folder, "records")))
    return merge_sources(valid).select("provider", "source_id", "title", F.col("infohash_v1"), "conflict", F.col("n_rows").cast("long").alias("n_rows"))


def record_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How many delivered records break each rule."""
    normal = normalize_records(table(spark, folder, "records"))
    return normal.select("provider", F.explode("errors").alias("error")).groupBy("provider", "error").agg(F.count("*").alias("n"))


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """What the catalogue left out, by reason."""
    return demo.catalogue(spark, folder).quarantine().select("provider", F.explode("errors").alias("error")).groupBy("provider", "error").agg(F.count("*").alias("n"))


def record_infohash_valid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records").select("record_id", info_hash(F.col("infohash_v1")).alias("infohash_v1"), info_hash(F.col("infohash_v2"), 64).alias("infohash_v2"))


def record_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records").select("record_id", F.array_join(identifiers(F.col("categories")), ",").alias("categories"), F.array_join(identifiers(F.col("media_kinds")), ",").alias("media_kinds"))


def raw_completeness(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records")
    return records.select("record_id", completeness(records).cast("long").alias("completeness"))


def agreed_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Agree-or-null size of the records of each provider and source."""
    return table(spark, folder, "records").groupBy("provider", "source_id").agg(agreed(F.col("size_bytes")).alias("size_bytes"))


def normalize_search_text_ascii(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", search_text(F.col("p_name")).alias("name"))


def compact_text_query(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", compact_text(F.col("p_type")).alias("kind"))


def sanitize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records").select("record_id", terminal_text(F.col("title"), 64).alias("title"))


def sync_replace_provider(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue's sources with one provider's replaced by those of them that have a size."""
    rows = demo.catalogue(spark, folder).scan()
    fresh = rows.where((F.col("provider") == _MILL) & F.col("size_bytes").isNotNull())
    return replace_provider(rows, fresh, _MILL).select("provider", "source_id", "title")


def magnet_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of the records' magnet addresses; the SQL reads them with a pattern."""
    magnets = table(spark, folder, "records").where("magnet_uri <> ''")
    return inspect_magnets(magnets, "record_id", "magnet_uri").where("error IS NULL").select("record_id", "infohash_v1")


def inspection_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Files and their sizes per inspection, overflow as null."""
    return table(spark, folder, "inspection_files").groupBy("inspection_id").agg(F.count("*").alias("n_files"), F.try_sum("size").alias("total_size"))


def piece_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where each file starts in its torrent, and inside which piece."""
    before = Window.partitionBy("inspection_id").orderBy("file_index").rowsBetween(Window.unboundedPreceding, -1)
    files = table(spark, folder, "inspection_files").withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    pieces = table(spark, folder, "inspections").where("piece_length > 0").select("inspection_id", "piece_length")
    return files.join(pieces, "inspection_id").select("inspection_id", "file_index", "offset", F.floor(F.col("offset") / F.col("piece_length")).alias("piece"))


def ndjson_encode(spark: SparkSession, folder: str) -> DataFrame:
    got = _searched("survey", 10)(spark, folder)
    return json_lines(got, "result", "rank")


def infohash_from_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Both digests of bytes, as of a torrent's info."""
    return table(spark, folder, "part").select("p_partkey", F.sha1(F.encode("p_name", "utf-8")).alias("infohash_v1"), F.sha2(F.encode("p_name", "utf-8"), 256).alias("infohash_v2"))


def nfkc_fold(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records").select("record_id", search_text(F.col("title")).alias("title"))


def _string(c: Column) -> Column:
    """An ASCII text as a metainfo string."""
    return F.concat(F.length(c).cast("string"), F.lit(":"), c)


def _safe_name(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]", "_")


def _inspected(bodies: DataFrame) -> DataFrame:
    return inspect_bodies(bodies, "inspection_id", "content").select("inspection_id", "format", "infohash_v1", "infohash_v2", "total_size", "error")


def inspect_metainfo(spark: SparkSession, folder: str) -> DataFrame:
    """Torrent metadata of a body for each inspection, of one file of its size; without a size there is no body.

    One whose pieces alone exceed ``METAINFO_BYTES`` ends one piece behind them, as its reader refuses it whatever follows.
    """
    total, piece = F.col("total_size"), F.greatest(F.col("piece_length"), F.lit(16384))
    count = F.least(F.ceil(total / piece), F.lit(METAINFO_BYTES // 20 + 1)).cast("int")
    info = F.concat(F.lit("d6:lengthi"), total.cast("string"), F.lit("e4:name"), _string(_safe_name(F.col("name"))), F.lit("12:piece lengthi"), piece.cast("string"), F.lit("e6:pieces"), (count * 20).cast("string"), F.lit(":"), F.repeat(F.lit("x" * 20), count), F.lit("e"))
    return _inspected(table(spark, folder, "inspections").select("inspection_id", F.encode(F.concat(F.lit("d4:info"), info, F.lit("e")), "utf-8").alias("content")))


def inspect_metainfo_v2(spark: SparkSession, folder: str) -> DataFrame:
    """The same of a version 2 body, whose one file fits a piece and so needs no layer."""
    piece, name = F.lit(16384), _string(_safe_name(F.col("name")))
    size = F.pmod(F.col("total_size"), piece) + 1
    info = F.concat(F.lit("d9:file treed"), name, F.lit("d0:d6:lengthi"), size.cast("string"), F.lit("e11:pieces root32:" + "r" * 32 + "eee12:meta versioni2e4:name"), name, F.lit("12:piece lengthi16384ee"))
    return _inspected(table(spark, folder, "inspections").select("inspection_id", F.encode(F.concat(F.lit("d4:info"), info, F.lit("e")), "utf-8").alias("content")))


def inspect_metainfo_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The same of a body of both versions."""
    name = _string(_safe_name(F.col("name")))
    size = (F.pmod(F.col("total_size"), F.lit(16384)) + 1).cast("string")
    info = F.concat(F.lit("d9:file treed"), name, F.lit("d0:d6:lengthi"), size, F.lit("e11:pieces root32:" + "r" * 32 + "eee6:lengthi"), size, F.lit("e12:meta versioni2e4:name"), name, F.lit("12:piece lengthi16384e6:pieces20:" + "x" * 20 + "e"))
    return _inspected(table(spark, folder, "inspections").select("inspection_id", F.encode(F.concat(F.lit("d4:info"), info, F.lit("e")), "utf-8").alias("content")))


def inspect_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a body made of each inspection's files, with their places in it."""
    place = F.lpad(F.col("file_index").cast("string"), 6, "0")
    name = F.concat(place, F.lit("-"), _safe_name(F.col("path")))
    entry = F.struct("file_index", F.concat(F.lit("d6:lengthi"), F.col("size").cast("string"), F.lit("e4:pathl"), _string(name), F.lit("ee")).alias("entry"), "size")
    held = table(spark, folder, "inspection_files").groupBy("inspection_id").agg(F.array_sort(F.collect_list(entry)).alias("f"))  # a torrent's own files
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    piece = F.greatest(F.lit(16384).cast("long"), F.ceil(total / 1000))
    info = F.concat(F.lit("d5:filesl"), F.array_join(F.transform("f", lambda x: x["entry"]), ""), F.lit("e4:name1:t12:piece lengthi"), piece.cast("string"), F.lit("e6:pieces"), (F.ceil(total / piece) * 20).cast("string"), F.lit(":"), F.repeat(F.lit("x" * 20), F.ceil(total / piece).cast("int")), F.lit("e"))
    got = inspect_bodies(held.select("inspection_id", F.encode(F.concat(F.lit("d4:info"), info, F.lit("e")), "utf-8").alias("content")), "inspection_id", "content")
    return files_of(got, "inspection_id").select("inspection_id", F.col("file_index").cast("long").alias("file_index"), "file_path", "size")


def catalogue_xml_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Items of an XML body made of each record; a record that can't be an item gives its error."""
    def field(name: str, c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(by))
        return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))

    h = F.lower(F.trim(F.coalesce("infohash_v1", F.lit(""))))
    item = F.concat(field("title", F.col("title")), field("category", F.get("categories", 0)), field("infohash", h), field("guid", F.col("record_id").cast("string")), field("link", F.lit("l")), field("description", F.lit("d")), field("size", F.col("size_bytes").cast("string")))
    body = F.encode(F.concat(F.lit('<rss version="2.0"><channel><item>'), item, F.lit("</item></channel></rss>")), "utf-8")
    return items_of(table(spark, folder, "records").select("record_id", body.alias("body")), "record_id", "body").select("record_id", "title", "category", "infohash", "size_bytes", "error")


def squashed_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "snapshot_records").select("snapshot_id", "ordinal", squash(F.col("title")).alias("title"))


QUERIES: dict[str, Query] = {name: _searched(text, **more) for name, (text, more, _) in SEARCHES.items()} | {
    f.__name__: f
    for f in (
        group_transitive_hash, group_size_histogram, group_values, record_completeness, record_structured_text, catalogue_scan, posting_stats, document_frequency, field_length, dedupe_source_key, record_errors,
        record_infohash_valid, record_identifiers, raw_completeness, agreed_sizes, normalize_search_text_ascii, sanitize_text, quarantine, search_batch, sync_replace_provider, magnet_parse, inspection_totals, piece_offsets,
        ndjson_encode, squashed_titles, infohash_from_bytes, nfkc_fold, inspect_metainfo, inspect_metainfo_v2, inspect_metainfo_hybrid, inspect_files, catalogue_xml_scan, p2_found, p2_changes,
    )
} | {"compact_text": compact_text_query}
_TRIM = "E' \\t\\n\\r'"
_HASH = "CASE WHEN regexp_full_match(lower(trim({c}, " + _TRIM + ")), '[0-9a-f]{{{n}}}') THEN lower(trim({c}, " + _TRIM + ")) END"
_IDS = "array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: lower(trim(x, " + _TRIM + "))), lambda x: regexp_full_match(x, '[a-z0-9_-]{{1,64}}')))), ',')"

_SQL_COMPLETENESS = " + ".join(
    [f"(trim(coalesce({c}, ''), {_TRIM}) <> '')::INT" for c in ("description", "infohash_v1", "infohash_v2", "details_url", "magnet_uri", "torrent_url")]
    + [f"({c} IS NOT NULL)::INT" for c in ("size_bytes", "published_at", "seeders", "leechers")]
    + [f"len({demo._facet_sql(c)})" for c in demo._FACETS]
)

_SQL_NAMED = "WITH named AS (SELECT inspection_id, total_size, piece_length, regexp_replace(coalesce(name, ''), '[^A-Za-z0-9_-]', '_', 'g') AS name, total_size % 16384 + 1 AS size FROM inspections) "

SQL: dict[str, str] = {name: search_sql(**more) for name, (_, _, more) in SEARCHES.items()} | {
    "group_transitive_hash": CATALOGUE_SQL + 'SELECT provider, source_id, grp AS "group" FROM rec',
    "group_size_histogram": CATALOGUE_SQL + "SELECT n_sources, count(*) AS n_groups FROM (SELECT count(*) AS n_sources FROM rec GROUP BY grp) GROUP BY n_sources",
    "group_values": CATALOGUE_SQL + """SELECT grp AS "group", CASE WHEN min(size_bytes) = max(size_bytes) THEN max(size_bytes) END AS size_bytes, CASE WHEN min(published_at) = max(published_at) THEN max(published_at) END::DATE::VARCHAR AS published_at,
  max(completeness) AS completeness, count(*) AS source_count, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM rec GROUP BY grp""",
    "record_completeness": CATALOGUE_SQL + "SELECT provider, source_id, completeness::BIGINT AS completeness FROM rec",
    "record_structured_text": CATALOGUE_SQL + "SELECT source_id, structured FROM rec",
    "catalogue_scan": CATALOGUE_SQL + "SELECT provider, source_id, title FROM r",
    "posting_stats": CATALOGUE_SQL + "SELECT field, term, count(*) AS n FROM postings GROUP BY ALL",
    "document_frequency": CATALOGUE_SQL + "SELECT field, term, df FROM df",
    "field_length": CATALOGUE_SQL + 'SELECT grp AS "group", provider, field, n::BIGINT AS n FROM lengths',
    "record_infohash_valid": f"SELECT record_id, {_HASH.format(c='infohash_v1', n=40)} AS infohash_v1, {_HASH.format(c='infohash_v2', n=64)} AS infohash_v2 FROM records",
    "record_identifiers": f"SELECT record_id, {_IDS.format(c='categories')} AS categories, {_IDS.format(c='media_kinds')} AS media_kinds FROM records",
    "agreed_sizes": "SELECT provider, source_id, CASE WHEN min(size_bytes) = max(size_bytes) THEN max(size_bytes) END AS size_bytes FROM records GROUP BY ALL",
    "normalize_search_text_ascii": "SELECT p_partkey, lower(trim(p_name)) AS name FROM part",
    "compact_text": "SELECT p_partkey, regexp_replace(lower(trim(p_type)), '[-_. ]', '', 'g') AS kind FROM part",
    "sync_replace_provider": CATALOGUE_SQL + f"SELECT provider, source_id, title FROM r WHERE provider <> '{_MILL}' OR size_bytes IS NOT NULL",
    "dedupe_source_key": MERGED_SQL + "SELECT provider, source_id, title, v1 AS infohash_v1, conflict, n_rows FROM merged",
    "record_errors": MERGED_SQL + "SELECT provider, error, count(*) AS n FROM (SELECT provider, unnest(errors) AS error FROM judged) GROUP BY ALL",
    "quarantine": MERGED_SQL + "SELECT provider, error, count(*) AS n FROM (SELECT provider, unnest(errors) AS error FROM judged UNION ALL SELECT provider, 'conflicting hashes' FROM merged WHERE conflict) GROUP BY ALL",
    "nfkc_fold": f"WITH {MERGED_SQL.split('RECURSIVE ', 1)[1].split(', cleaned AS', 1)[0]} SELECT record_id, {search_text_sql('title')} AS title FROM records, folds",
    "raw_completeness": f"SELECT record_id, ({_SQL_COMPLETENESS})::BIGINT AS completeness FROM records",
    "search_batch": batch_sql({n: more for n, (_, given, more) in SEARCHES.items() if n in _BATCH}),
    "magnet_parse": "SELECT record_id, lower(regexp_extract(magnet_uri, '^magnet:\\?xt=urn:btih:([0-9a-fA-F]{40})$', 1)) AS infohash_v1 FROM records WHERE regexp_matches(magnet_uri, '^magnet:\\?xt=urn:btih:([0-9a-fA-F]{40})$')",
    "inspection_totals": "SELECT inspection_id, count(*) AS n_files, sum(size)::BIGINT AS total_size FROM inspection_files GROUP BY ALL",
    "piece_offsets": """SELECT inspection_id, file_index, f_offset AS "offset", (f_offset // piece_length)::BIGINT AS piece FROM (
  SELECT inspection_id, file_index, coalesce(sum(size) OVER (PARTITION BY inspection_id ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f_offset FROM inspection_files
) JOIN inspections USING (inspection_id) WHERE piece_length > 0""",
    "ndjson_encode": f"""WITH hits AS ({search_sql(**SEARCHES["search_required_term"][2] | {"limit": 10})})
SELECT rank AS sequence, '{{"schema_version":1,"type":"result","sequence":' || rank || ',"data":{{"group":"' || "group" || '","source_id":' || to_json(source_id)::VARCHAR || ',"source_count":' || source_count || '}}}}' AS line FROM hits
UNION ALL SELECT count(*) + 1, '{{"schema_version":1,"type":"done","sequence":' || (count(*) + 1) || ',"data":null}}' FROM hits""",
    "inspect_metainfo": _SQL_NAMED + f"""SELECT inspection_id, CASE WHEN bad IS NULL THEN 'v1' END AS format, CASE WHEN bad IS NULL THEN sha1(info) END AS infohash_v1, NULL::VARCHAR AS infohash_v2, CASE WHEN bad IS NULL THEN total_size END AS total_size, bad AS error FROM (
  SELECT *, CASE WHEN total_size IS NULL OR piece IS NULL THEN 'nothing to inspect' WHEN n > {METAINFO_BYTES // 20} THEN 'too large' WHEN name = '' THEN 'unsafe path' END AS bad,
    'd6:lengthi' || total_size || 'e4:name' || length(name) || ':' || name || '12:piece lengthi' || piece || 'e6:pieces' || (n * 20) || ':' || repeat('{"x" * 20}', n) || 'e' AS info
  FROM (SELECT *, least(ceil(total_size / piece), {METAINFO_BYTES // 20 + 1})::INT AS n FROM (SELECT *, greatest(piece_length, 16384) AS piece FROM named)))""",
    "inspect_metainfo_v2": _SQL_NAMED + f"""SELECT inspection_id, CASE WHEN bad IS NULL THEN 'v2' END AS format, NULL::VARCHAR AS infohash_v1, CASE WHEN bad IS NULL THEN sha256(info) END AS infohash_v2, CASE WHEN bad IS NULL THEN size END AS total_size, bad AS error FROM (
  SELECT *, CASE WHEN size IS NULL THEN 'nothing to inspect' WHEN name = '' THEN 'unsafe path' END AS bad,
    'd9:file treed' || length(name) || ':' || name || 'd0:d6:lengthi' || size || 'e11:pieces root32:{"r" * 32}eee12:meta versioni2e4:name' || length(name) || ':' || name || '12:piece lengthi16384ee' AS info
  FROM named)""",
    "inspect_metainfo_hybrid": _SQL_NAMED + f"""SELECT inspection_id, CASE WHEN bad IS NULL THEN 'hybrid' END AS format, CASE WHEN bad IS NULL THEN sha1(info) END AS infohash_v1, CASE WHEN bad IS NULL THEN sha256(info) END AS infohash_v2, CASE WHEN bad IS NULL THEN size END AS total_size, bad AS error FROM (
  SELECT *, CASE WHEN size IS NULL THEN 'nothing to inspect' WHEN name = '' THEN 'unsafe path' END AS bad,
    'd9:file treed' || length(name) || ':' || name || 'd0:d6:lengthi' || size || 'e11:pieces root32:{"r" * 32}eee6:lengthi' || size || 'e12:meta versioni2e4:name' || length(name) || ':' || name || '12:piece lengthi16384e6:pieces20:{"x" * 20}e' AS info
  FROM named)""",
    "inspect_files": "SELECT inspection_id, row_number() OVER (PARTITION BY inspection_id ORDER BY file_index) AS file_index, lpad(file_index::VARCHAR, 6, '0') || '-' || regexp_replace(coalesce(path, ''), '[^A-Za-z0-9_-]', '_', 'g') AS file_path, size FROM inspection_files",
    "catalogue_xml_scan": f"""SELECT record_id, CASE WHEN bad IS NULL THEN t END AS title, CASE WHEN bad IS NULL THEN c END AS category, CASE WHEN bad IS NULL THEN h END AS infohash, CASE WHEN bad IS NULL THEN size_bytes END AS size_bytes, bad AS error FROM (
  SELECT *, CASE WHEN regexp_matches(raw, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]') THEN 'malformed' WHEN strlen(raw) > 1024 THEN 'title too long' WHEN t = '' THEN 'title' WHEN NOT regexp_full_match(h, '[0-9a-f]{{40}}') THEN CASE WHEN strlen(h) > 40 THEN 'infohash too long' ELSE 'infohash' END WHEN size_bytes IS NULL THEN 'size' END AS bad
  FROM (SELECT record_id, coalesce(title, '') AS raw, trim(coalesce(title, ''), {demo._quoted(demo._BLANK)}) AS t, trim(coalesce(categories[1], ''), {demo._quoted(demo._BLANK)}) AS c, lower(trim(coalesce(infohash_v1, ''), ' ')) AS h, size_bytes FROM records))""",
    "infohash_from_bytes": "SELECT p_partkey, sha1(p_name) AS infohash_v1, sha256(p_name) AS infohash_v2 FROM part",
    "squashed_titles": "SELECT snapshot_id, ordinal, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title FROM snapshot_records",
    "p2_found": _SQL_STATES + "SELECT snapshot_id, source_id, change_kind FROM compared WHERE change_kind IS NOT NULL",
    "p2_changes": _SQL_STATES + "SELECT * FROM compared WHERE change_kind IS NOT NULL",
}
