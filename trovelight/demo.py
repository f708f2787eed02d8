"""The catalogue of the ``records`` table, for queries that have SQL beside them, and the same in SQL."""

from __future__ import annotations

import functools
import hashlib
import os
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from trovelight.catalogue import Catalogue
from trovelight.operators.index import Index
from trovelight.plans.query import Query, Span, Value, parse
from trovelight.session import shared_dir, table

_open: dict[tuple[str, str], Catalogue] = {}


def provider_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered rows: all of the records table, as they are."""
    return table(spark, folder, "records")


def catalogue(spark: SparkSession, folder: str) -> Catalogue:
    """The published catalogue of a data folder, built once a session; invalid rows are in its quarantine."""
    key = (spark.sparkContext.applicationId, os.path.realpath(folder))
    if key not in _open:
        root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
        made = Catalogue(spark, f"{root}/catalogue-{hashlib.sha1('|'.join(key).encode()).hexdigest()[:16]}")
        made.rebuild(provider_rows(spark, folder), strict=False)
        _open[key] = made
    return _open[key]


def index(spark: SparkSession, folder: str) -> Index:
    return catalogue(spark, folder).index()


def query(text: str, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> Query:
    """A parsed query, its providers named by their ids."""
    q = parse(text)
    q.allow, q.deny = [Value(p, Span(0, 0)) for p in allow], [Value(p, Span(0, 0)) for p in deny]
    return q


# the same in SQL


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def _fold_maps() -> str:
    """Two maps of characters, as SQL: to their compatibility form, and to that of their case-folded form."""
    signs = [c for c in map(chr, range(0x41, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff"]
    out = []
    for name, to in (("nf", lambda c: unicodedata.normalize("NFKC", c)), ("cf", lambda c: unicodedata.normalize("NFKC", c.casefold()))):
        pairs = [(c, t) for c in signs if (t := to(c)) != c]
        out.append(f"map(regexp_extract_all({_quoted(''.join(c for c, _ in pairs))}, '(?s).'), string_split({_quoted(chr(1).join(t for _, t in pairs))}, chr(1))) AS {name}")
    return "folds AS (SELECT " + ", ".join(out) + ")"


def _mapped(x: str, name: str) -> str:
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: coalesce({name}[c], c)), ''))"


# The characters Unicode calls White_Space.
_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROLS = "\\x00-\\x1f\\x7f-\\x9f\\x{61c}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}"


def _ascii_sql(x: str) -> str:
    return f"length({x}) = strlen({x})"


def search_text_sql(x: str) -> str:
    """The search form of a text; ``folds`` must be in scope."""
    t = f"trim({x}, {_quoted(_BLANK)})"
    return f"CASE WHEN {_ascii_sql(x)} THEN lower({t}) ELSE {_mapped('lower_later', 'cf').replace('lower_later', _mapped(t, 'nf'))} END"


def display_text_sql(x: str) -> str:
    """The display form of a text: compatibility forms plain, controls as spaces, runs of spaces as one."""
    plain = f"CASE WHEN {_ascii_sql(x)} THEN {x} ELSE {_mapped(x, 'nf')} END"
    return f"trim(regexp_replace(regexp_replace({plain}, '[{_CONTROLS}]', ' ', 'g'), '[\\s\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


_TRIM = "E' \\t\\n\\r'"
_IDENTIFIERS = ("categories", "content_kinds", "media_kinds", "languages", "architectures", "codecs")
_TEXTS = ("description", "details_url", "magnet_uri", "torrent_url")
_NUMBERS = ("size_bytes", "published_at", "seeders", "leechers")


def _facet_sql(c: str) -> str:
    if c == "resolutions":
        return "list_sort(list_distinct(list_filter(coalesce(resolutions, []), lambda x: x BETWEEN 100 AND 8640)))"
    bare, rule = f"lower(trim(x, {_TRIM}))", "[a-z0-9_-]{1,64}"
    if c == "extensions":
        return f"list_sort(list_distinct(list_transform(list_filter(list_transform(coalesce(extensions, []), lambda x: regexp_replace({bare}, '^\\.', '')), lambda x: regexp_full_match(x, '[a-z0-9]{{1,16}}')), lambda x: '.' || x)))"
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {bare}), lambda x: regexp_full_match(x, '{rule}'))))"


def _hash_sql(c: str, n: int) -> str:
    t = f"lower(trim(coalesce({c}, ''), {_TRIM}))"
    return f"CASE WHEN regexp_full_match({t}, '[0-9a-f]{{{n}}}') THEN {t} ELSE '' END"


_FACETS = ("categories", "content_kinds", "media_kinds", "extensions", "languages", "architectures", "resolutions", "codecs")
_JSON_FIELDS = ("provider", "source_id", "title", *_TEXTS, "size_bytes", "published_at", *_FACETS, "seeders", "leechers")


def _json_sql(c: str) -> str:
    """A field of a record's canonical JSON, null where it is absent."""
    if c in _FACETS:
        return f"CASE WHEN len({c}) > 0 THEN '\"{c}\":' || to_json({c})::VARCHAR END"
    if c == "published_at":
        return "'\"published_at\":\"' || strftime(published_at, '%Y-%m-%dT00:00:00Z') || '\"'"
    if c in _NUMBERS:
        return f"'\"{c}\":' || {c}::VARCHAR"
    return f"CASE WHEN {c} <> '' THEN '\"{c}\":' || to_json({c})::VARCHAR END"


_CANONICAL = "concat_ws(',', " + ", ".join(map(_json_sql, _JSON_FIELDS)) + ")"
for _sign in "&<>\u2028\u2029":
    _CANONICAL = f"replace({_CANONICAL}, {_quoted(_sign)}, '\\u{ord(_sign):04x}')"
_COMPLETENESS = " + ".join([f"({c} <> '')::INT" for c in _TEXTS] + [f"({c} IS NOT NULL)::INT" for c in _NUMBERS] + [f"len({c})" for c in _FACETS])

MERGED_SQL = f"""
WITH RECURSIVE {_fold_maps()}, cleaned AS (
  SELECT {search_text_sql("coalesce(provider, '')")} AS provider, {", ".join(f"{display_text_sql(f'coalesce({c}, {chr(39) * 2})')} AS {c}" for c in ("source_id", "title", "description"))},
    {_hash_sql("infohash_v1", 40)} AS v1, {_hash_sql("infohash_v2", 64)} AS v2, trim(coalesce(infohash_v1, ''), {_TRIM}) AS raw_v1, trim(coalesce(infohash_v2, ''), {_TRIM}) AS raw_v2,
    {", ".join(f"trim(coalesce({c}, ''), {_TRIM}) AS {c}" for c in ("details_url", "magnet_uri", "torrent_url"))}, size_bytes, published_at::DATE AS published_at, {", ".join(f"{_facet_sql(c)} AS {c}" for c in _FACETS)}, seeders, leechers,
    {" + ".join(f"len(coalesce({c}, []))" for c in _FACETS)} AS n_given
  FROM records, folds
), judged AS (
  SELECT *, list_filter([CASE WHEN NOT regexp_full_match(provider, '[a-z0-9_-]{{1,64}}') THEN 'provider' END, CASE WHEN source_id = '' THEN 'source_id missing' END, CASE WHEN title = '' THEN 'title missing' END,
    CASE WHEN raw_v1 <> '' AND v1 = '' THEN 'infohash_v1' END, CASE WHEN raw_v2 <> '' AND v2 = '' THEN 'infohash_v2' END, CASE WHEN size_bytes < 0 THEN 'size_bytes' END, CASE WHEN seeders < 0 THEN 'seeders' END, CASE WHEN leechers < 0 THEN 'leechers' END,
    {", ".join(f"CASE WHEN {c} <> '' AND NOT regexp_full_match({c}, '(?i:https)://[^/?#@[:space:]]+([/?#][^[:space:]]*)?') THEN '{c}' END" for c in ("details_url", "torrent_url"))}, CASE WHEN magnet_uri <> '' AND NOT regexp_full_match(magnet_uri, '(?i:magnet):[^?#[:space:]]*\\?[^#[:space:]]+.*') THEN 'magnet_uri' END], lambda x: x IS NOT NULL) AS errors
  FROM cleaned
), ranked AS (SELECT *, {_COMPLETENESS} AS rest, {_CANONICAL} AS canonical FROM judged WHERE len(errors) = 0
), merged AS (
  SELECT * EXCLUDE (v1, v2), max(v1) OVER s AS v1, max(v2) OVER s AS v2, count(*) OVER s AS n_rows,
    coalesce(min(nullif(v1, '')) OVER s <> max(nullif(v1, '')) OVER s, false) OR coalesce(min(nullif(v2, '')) OVER s <> max(nullif(v2, '')) OVER s, false) OR (max(v1) OVER s <> '' AND max(v2) OVER s <> '' AND NOT bool_or(v1 <> '' AND v2 <> '') OVER s) AS conflict
  FROM ranked WINDOW s AS (PARTITION BY provider, source_id)
  QUALIFY row_number() OVER (PARTITION BY provider, source_id ORDER BY rest DESC, canonical) = 1
)"""

CATALOGUE_SQL = MERGED_SQL + """, r AS (SELECT * FROM merged WHERE NOT conflict),
names AS (SELECT 'v1:' || v1 AS h FROM r WHERE v1 <> '' UNION SELECT 'v2:' || v2 FROM r WHERE v2 <> ''),
pairs AS (SELECT DISTINCT 'v1:' || v1 AS a, 'v2:' || v2 AS b FROM r WHERE v1 <> '' AND v2 <> ''),
link AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT h AS x, h AS y FROM names UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x AS h, min(y) AS label FROM reach GROUP BY x),
gid AS (SELECT label, sha256(string_agg(h, chr(0) ORDER BY h)) AS gid FROM comp GROUP BY label),
rec AS (
  SELECT r.*, coalesce(gid, sha256(provider || chr(0) || source_id)) AS grp, rest + (v1 <> '')::INT + (v2 <> '')::INT AS completeness,
    array_to_string(list_concat(list_concat(list_concat(categories, content_kinds), list_concat(media_kinds, extensions)), list_concat(list_concat(languages, architectures), list_concat(list_transform(resolutions, lambda x: x::VARCHAR || 'p'), codecs))), ' ') AS structured
  FROM r LEFT JOIN comp ON comp.h = CASE WHEN v1 <> '' THEN 'v1:' || v1 ELSE 'v2:' || v2 END LEFT JOIN gid USING (label)
),
texts AS (
  SELECT DISTINCT grp, provider, field, text FROM (
    SELECT grp, provider, field, """ + search_text_sql("raw") + """ AS text
    FROM (SELECT grp, provider, 'title' AS field, title AS raw FROM rec UNION SELECT grp, provider, 'description', description FROM rec UNION SELECT grp, provider, 'structured', structured FROM rec), folds
  ) WHERE text <> ''
),
words AS (SELECT grp, provider, field, text, w FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM texts) WHERE len(w) > 0),
postings AS (SELECT grp, provider, field, text, unnest(w) AS term, unnest(range(len(w))) AS pos FROM words),
lengths AS (SELECT grp, provider, field, sum(len(w)) AS n FROM words GROUP BY ALL),
df AS (SELECT field, term, count(DISTINCT (grp, provider)) AS df FROM postings GROUP BY ALL),
n_docs AS (SELECT count(DISTINCT (grp, provider)) AS n_docs FROM lengths)
"""

_BOOST = "CASE field WHEN 'title' THEN 8.0 WHEN 'structured' THEN 3.0 ELSE 1.0 END"


def _clause_sql(words: list[str], phrase: bool) -> str:
    """(grp, provider, s) of the documents that match a clause."""
    if phrase:
        joins = " ".join(f"JOIN postings p{k} ON p{k}.grp = p0.grp AND p{k}.provider = p0.provider AND p{k}.field = p0.field AND p{k}.text = p0.text AND p{k}.pos = p0.pos + {k} AND p{k}.term = '{w}'" for k, w in enumerate(words) if k)
        source = f"SELECT p0.grp, p0.provider, p0.field, x.term, count(*) AS tf FROM postings p0 {joins}, (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in words)}) x(term) WHERE p0.term = '{words[0]}' AND p0.field <> 'structured' GROUP BY ALL"
    else:
        names = ", ".join(f"'{w}'" for w in words)
        source = f"SELECT grp, provider, field, term, count(*) AS tf FROM postings WHERE term IN ({names}) GROUP BY ALL"
    each = f"SELECT grp, provider, field, {_BOOST} * sum(sqrt(tf) * pow(1 + ln(n_docs / (df + 1)), 2)) / sqrt(any_value(n)) AS s FROM ({source}) JOIN df USING (field, term) JOIN lengths USING (grp, provider, field), n_docs GROUP BY grp, provider, field HAVING count(*) = {len(words)}"
    return f"SELECT grp, provider, sum(s) AS s FROM ({each}) GROUP BY grp, provider"


def _search_parts(must=(), optional=(), excluded=(), phrases=(), providers: str = "true", where: str = "true", by: str = "", each: str = "", limit: int = 50) -> tuple[str, str]:
    """The common tables and the query of a search: word lists of the clauses, a provider condition, a group condition, the explicit order and that of a group's sources."""
    parts = [(w, "must", False) for w in must] + [(w, "may", False) for w in optional] + [(w, "not", False) for w in excluded] + [(w, "must", True) for w in phrases if w[0] != "-"] + [(w[1:], "not", True) for w in phrases if w[0] == "-"]
    ctes, docs = [], f"SELECT DISTINCT rec.grp, rec.provider, 0.0 AS score FROM rec WHERE {providers}"
    if parts:
        ctes = [f"c{k} AS ({_clause_sql(list(w), phrase)})" for k, (w, _, phrase) in enumerate(parts)]
        score = " + ".join(f"coalesce(c{k}.s, 0)" for k, p in enumerate(parts) if p[1] != "not") or "0"
        joins = " ".join(f"{'JOIN' if p[1] == 'must' else 'LEFT JOIN'} c{k} ON c{k}.grp = b.grp AND c{k}.provider = b.provider" for k, p in enumerate(parts))
        nots = " AND ".join(f"c{k}.grp IS NULL" for k, p in enumerate(parts) if p[1] == "not") or "true"
        docs = f"SELECT b.grp, b.provider, round({score}, 9) AS score FROM (SELECT DISTINCT rec.grp, rec.provider FROM rec WHERE {providers}) b {joins} WHERE {nots}"
    ctes += [
        f"docs AS ({docs})",
        f"usable AS (SELECT rec.*, s.score, {search_text_sql('title') if 'folded' in by else 'title'} AS folded FROM rec JOIN (SELECT grp, max(score) AS score FROM docs GROUP BY grp) s USING (grp), folds WHERE {providers})",
        f"""groups AS (SELECT grp, any_value(score) AS score, max(completeness) AS completeness, count(*) AS source_count, {", ".join(f"flatten(list({c})) AS {c}" for c in _FACETS)},
  CASE WHEN min(size_bytes) = max(size_bytes) THEN max(size_bytes) END AS g_size, CASE WHEN min(published_at) = max(published_at) THEN max(published_at) END AS g_date FROM usable GROUP BY grp)""",
        f"best AS (SELECT grp, source_id, folded, size_bytes, published_at FROM usable QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {each} completeness DESC, provider, source_id) = 1)",
        f"hits AS (SELECT row_number() OVER (ORDER BY {by or 'score DESC,'} completeness DESC, source_count DESC, grp) AS rank, grp, source_id, source_count FROM groups JOIN best USING (grp) WHERE {where})",
    ]
    return ",\n".join(ctes), f'SELECT rank, grp AS "group", source_id, source_count FROM hits WHERE rank <= {limit}'


def search_sql(**more) -> str:
    """SQL of a search; see :func:`_search_parts`."""
    ctes, last = _search_parts(**more)
    return f"{CATALOGUE_SQL}, {ctes}\n{last}"


def batch_sql(searches: dict[str, dict]) -> str:
    """SQL of several named searches over the same catalogue."""
    each = [(name, *_search_parts(**more)) for name, more in searches.items()]
    return CATALOGUE_SQL + " UNION ALL ".join(f"SELECT '{name}' AS name, * FROM (WITH {ctes} {last})" for name, ctes, last in each)
