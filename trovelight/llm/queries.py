"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm import cuts, glyphs, leakage, markup, mojibake, subjects, survivors, terms, tokens
from trovelight.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records")
    return glyphs.unify(records, garbled=mojibake.fit_models(records)).select("record_id", "field_name")


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.unify(table(spark, folder, "records"), changed_only=False).select("record_id", "field_name", "unified")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records")
    return mojibake.repair(records, mojibake.fit_models(records)).select("record_id", "field_name")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records")
    return mojibake.repair(records, mojibake.fit_models(records))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_markup(table(spark, folder, "records")).where(F.size("kinds") > 0).select("record_id")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_markup(table(spark, folder, "records"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.survivors(table(spark, folder, "records")).select("infohash_v1", "record_id")


def p5_survivors(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records")
    return survivors.assemble(survivors.survivors(records), records)


def p5_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """The record that supplies each bundle of each group."""
    return survivors.survivors(table(spark, folder, "records"))


def _cut_values(spark: SparkSession, folder: str) -> DataFrame:
    records, inspections = table(spark, folder, "records"), table(spark, folder, "inspections")
    return cuts.cut_values([("records", records, "record_id", ("title",), ("description",)), ("inspections", inspections, "inspection_id", (), ("comment",))])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut_values(spark, folder).where("how IS NOT NULL").select("table_name", "row_id", "field_name")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.cut_rates(_cut_values(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.rarest_shared_term(terms.term_scores(table(spark, folder, "records")))


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_scores(table(spark, folder, "records")).withColumn("ppmi", F.round("ppmi", 6))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return spans.select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    return leakage.leaked_items(leakage.leaked_spans(table(spark, folder, "documents"), items), items)


def p9_removals(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document to remove, over all items."""
    return leakage.removal_spans(leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))).select("doc_id", "n_words")


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return subjects.assign(docs, subjects.train(docs, table(spark, folder, "subject_labels"), table(spark, folder, "subjects")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select("doc_id", "subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(_assigned(spark, folder), table(spark, folder, "documents"))


_SQL_GRAMS = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM i)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

_SQL_TERMS = """
WITH t AS (
  SELECT record_id, provider, source_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, description, array_to_string(categories, ' '))), '[^\\p{L}\\p{N}]+'), lambda x: regexp_full_match(x, '[a-z]{4,}')) AS terms
  FROM records
), pairs AS (SELECT record_id, provider, source_id, len(terms) AS n_r, unnest(terms) AS term FROM t
), tf AS (SELECT record_id, provider, source_id, n_r, term, count(*) AS tf FROM pairs GROUP BY ALL
), counts AS (SELECT term, sum(tf) AS n, count(DISTINCT (provider, source_id)) AS entries FROM tf GROUP BY term)
"""

_FACETS = ("categories", "content_kinds", "media_kinds", "languages", "architectures", "codecs")
_TRIM = "E' \\t\\n\\r'"


def _sql_values(c: str) -> str:
    """The number of an array column's clean values."""
    if c == "resolutions":
        return "len(list_distinct(list_filter(coalesce(resolutions, []), lambda x: x BETWEEN 100 AND 8640)))"
    bare, rule = f"lower(trim(x, {_TRIM}))", "[a-z0-9_-]{1,64}"
    if c == "extensions":
        bare, rule = f"regexp_replace({bare}, '^\\.', '')", "[a-z0-9]{1,16}"
    return f"len(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {bare}), lambda x: regexp_full_match(x, '{rule}'))))"


def _sql_filled(c: str) -> str:
    if c in (*_FACETS, "extensions", "resolutions"):
        return f"({_sql_values(c)} > 0)::INT"
    if c in ("size_bytes", "published_at", "seeders", "leechers"):
        return f"({c} IS NOT NULL)::INT"
    return f"(trim(coalesce({c}, ''), {_TRIM}) <> '')::INT"


_SQL_COMPLETENESS = " + ".join([_sql_filled(c) for c in ("description", "infohash_v1", "infohash_v2", "details_url", "magnet_uri", "torrent_url", "size_bytes", "published_at", "seeders", "leechers")] + [_sql_values(c) for c in (*_FACETS, "extensions", "resolutions")])
_SQL_RANKS = ", ".join(f"({' + '.join(map(_sql_filled, fields))}) AS {b}" for b, fields in survivors.BUNDLES.items())

# every value of the second hash that a group names, with the best row of each bundle that agrees with it; the best of these
_SQL_BUNDLES = f"""
WITH r AS (
  SELECT lower(trim(infohash_v1, {_TRIM})) AS h, lower(trim(infohash_v2, {_TRIM})) AS d2, record_id, fetched_at, coalesce(epoch_us(fetched_at), -4611686018427387904) AS us, {_SQL_COMPLETENESS} AS completeness, {_SQL_RANKS}
  FROM records
), g AS (SELECT *, CASE WHEN regexp_full_match(d2, '[0-9a-f]{{64}}') THEN d2 END AS d FROM r WHERE regexp_full_match(h, '[0-9a-f]{{40}}') QUALIFY count(*) OVER (PARTITION BY h) > 1
), base AS (SELECT h, count(*) AS n_records, max_by(record_id, row(completeness, us, -record_id)) AS record_id FROM g GROUP BY h
), named AS (SELECT DISTINCT h, d AS v FROM g WHERE d IS NOT NULL UNION ALL SELECT h, NULL FROM g GROUP BY h HAVING count(d) = 0
), best AS (
  SELECT g.h, v, {", ".join(f"max(row({b}, us, -record_id)) AS {b}" for b in survivors.BUNDLES)} FROM g JOIN named ON g.h = named.h AND (g.d IS NULL OR g.d IS NOT DISTINCT FROM v) GROUP BY g.h, v
), taken AS (SELECT h, max(row({" + ".join(f"{b}[1]" for b in survivors.BUNDLES)}, {", ".join(survivors.BUNDLES)})) AS m FROM best GROUP BY h)
SELECT base.h AS infohash_v1, record_id, n_records, {", ".join(f"-(m[{k}][3]) AS {b}_from" for k, b in enumerate(survivors.BUNDLES, 2))} FROM base JOIN taken USING (h)
"""

QUERIES = {
    "p1_found": p1_found, "p1_unified": p1_unified, "p3_found": p3_found, "p3_restored": p3_restored,
    "p4_found": p4_found, "p4_clean": p4_clean,
    "p6_found": p6_found, "p6_rates": p6_rates,
    "p5_found": p5_found, "p5_survivors": p5_survivors, "p5_bundles": p5_bundles, "p7_found": p7_found, "p7_scores": p7_scores,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_items": p9_items, "p9_removals": p9_removals,
    "p10_found": p10_found, "p10_composition": p10_composition,
}

SQL = {
    "p5_found": f"""
WITH r AS (SELECT lower(trim(infohash_v1, E' \\t\\n\\r')) AS infohash_v1, record_id, fetched_at, {_SQL_COMPLETENESS} AS completeness FROM records)
SELECT infohash_v1, record_id FROM r WHERE regexp_full_match(infohash_v1, '[0-9a-f]{{40}}')
QUALIFY count(*) OVER (PARTITION BY infohash_v1) > 1 AND row_number() OVER (PARTITION BY infohash_v1 ORDER BY completeness DESC, fetched_at DESC, record_id) = 1""",
    "p5_bundles": _SQL_BUNDLES,
    "p7_found": _SQL_TERMS + "SELECT record_id, term FROM tf JOIN counts USING (term) WHERE entries >= 2 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY entries, tf DESC, term) = 1",
    "p7_scores": _SQL_TERMS + """, total AS (SELECT sum(pow(len(terms), 0.75)) AS all_q FROM t WHERE len(terms) > 0)
SELECT record_id, term, tf, entries, round(greatest(0, ln((tf * all_q) / (n * pow(n_r, 0.75)))), 6) AS ppmi FROM tf JOIN counts USING (term), total""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": _SQL_GRAMS + "SELECT doc_id, item_id FROM found",
    "p9_removals": _SQL_GRAMS + """, hit AS (
  SELECT doc_id, k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d) WHERE array_to_string(w[k:k+7], ' ') IN (SELECT g FROM ig)
) SELECT doc_id, count(DISTINCT k + j) AS n_words FROM (SELECT doc_id, k, unnest(range(8)) AS j FROM hit) GROUP BY doc_id""",
    "p9_items": _SQL_GRAMS + """, hit AS (
  SELECT DISTINCT doc_id, item_id, k FROM (SELECT doc_id, k, array_to_string(w[k:k+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)) JOIN ig USING (g)
), words AS (SELECT doc_id, item_id, count(DISTINCT k + j) AS n FROM (SELECT *, unnest(range(8)) AS j FROM hit) GROUP BY ALL
) SELECT i.item_id, count(DISTINCT doc_id) AS n_docs, coalesce(max(n), 0)::BIGINT AS most_words FROM i LEFT JOIN words USING (item_id) GROUP BY i.item_id""",
}
