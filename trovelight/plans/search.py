"""Queries over an index as one DataFrame plan, one query or a batch.

Only narrow columns are ranked; the records of the best hits are fetched afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelight import schema as S
from trovelight.functions.unicode import search_text
from trovelight.operators.grouping import agreed
from trovelight.operators.index import DOCUMENT, Index
from trovelight.plans.query import Clause, Order, Query, QueryError, Range, Span

# How much a match in each field counts.
BOOSTS = {"title": 8.0, "structured": 3.0, "description": 1.0}
#: Queries that a batch may hold.
BATCH = 256
FAMILIES = ("categories", "content_kinds", "media_kinds", "extensions", "languages", "architectures", "resolutions", "codecs")


def check(query: Query) -> None:
    """Raise for a query that a parser couldn't have made."""
    clauses = len(query.required) + len(query.optional) + len(query.excluded) + len(query.phrases)
    if query.schema_version != S.QUERY_VERSION or clauses > S.QUERY_TOKENS or (query.limit is not None and not 1 <= query.limit <= S.RESULT_LIMIT) or query.size.empty or query.date.empty:
        raise QueryError("invalid_query", query)


def _words(clause: Clause) -> list[str]:
    return re.findall(r"\w+", clause.normalized.lower())


def _clauses(query: Query) -> list[tuple[int, str, bool, list[str]]]:
    """(id, occurrence, whether a phrase, words) of each text clause."""
    held = [*query.required, *query.optional, *query.excluded, *query.phrases]
    phrases = {id(c) for c in query.phrases}
    return [(k, c.occurrence, id(c) in phrases, _words(c)) for k, c in enumerate(held)]


def _providers(query: Query, c: Column) -> Column:
    """Whether a provider may be used: a denial beats an allowance."""
    ok = F.lit(True)
    if query.allow:
        ok = c.isin([v.value for v in query.allow])
    if query.deny:
        ok = ok & ~c.isin([v.value for v in query.deny])
    return ok


def _each(queries: Sequence[Query], make: Callable[[Query], Column], otherwise: Column | None = None) -> Column:
    """An expression that depends on the row's query, of number ``q``; of one query just its own."""
    if len(queries) == 1:
        return make(queries[0])
    out = reduce(lambda c, k: c.when(F.col("q") == k, make(queries[k])), range(1, len(queries)), F.when(F.col("q") == 0, make(queries[0])))
    return out if otherwise is None else out.otherwise(otherwise)


def clause_matches(index: Index, queries: Sequence[Query]) -> DataFrame:
    """Documents that match a text clause in some field: query, document, clause and score.

    All words of a clause must lie in one field; those of a phrase next to each other in one text of
    the title or description. The clauses are at most a few hundred words a query, so they are
    broadcast; the postings are scanned once for all queries.
    """
    spark = index.records.sparkSession
    rows = [(q, k, phrase, len(set(words)) if not phrase else len(words), i, w) for q, query in enumerate(queries) for k, _, phrase, words in _clauses(query) for i, w in (enumerate(words) if phrase else enumerate(dict.fromkeys(words)))]
    asked = spark.createDataFrame(rows, "q int, clause int, phrase boolean, n int, ord int, term string")
    terms = sorted({r[5] for r in rows})
    found = index.postings.where(F.col("term").isin(terms)).join(F.broadcast(asked), "term").where(_each(queries, lambda x: _providers(x, F.col("provider"))))
    weight = F.pow(1 + F.log(index.documents() / (F.col("df") + 1)), 2)
    rarity = index.terms.where(F.col("term").isin(terms)).select("field", "term", weight.alias("w"))

    key = ["q", *DOCUMENT, "field", "words", "clause", "n"]
    counted = found.where("NOT phrase").groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighed = counted.withColumn("ord", F.lit(0))
    if any(r[2] for r in rows):
        runs = found.where("phrase AND field <> 'structured'").groupBy(*key, "text_id", (F.col("pos") - F.col("ord")).alias("start")).agg(F.collect_set(F.struct("ord", "term")).alias("hit"))
        whole = runs.where(F.size("hit") == F.col("n")).select(*key, F.explode("hit").alias("h"))
        weighed = weighed.unionByName(whole.groupBy(*key, F.col("h.ord").alias("ord"), F.col("h.term").alias("term")).agg(F.count("*").alias("tf")))
    # a document has few rows now; placed by group, all that follows needs no further shuffle
    weighed = weighed.join(F.broadcast(rarity), ["field", "term"]).repartition("q", "group")
    # a fold in a fixed order, so that equal documents tie exactly
    parts = F.array_sort(F.collect_list(F.struct("term", "ord", (F.sqrt("tf") * F.col("w")).alias("s"))))
    each = weighed.groupBy(*key).agg(parts.alias("parts")).where(F.size("parts") == F.col("n"))
    boost = reduce(lambda a, b: a.when(F.col("field") == b[0], b[1]), list(BOOSTS.items())[1:], F.when(F.col("field") == "title", BOOSTS["title"]))
    summed = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["s"])
    scored = each.select("q", *DOCUMENT, "clause", "field", (boost * summed / F.sqrt("words")).alias("s"))
    fields = F.array_sort(F.collect_list(F.struct("field", "s")))
    return scored.groupBy("q", *DOCUMENT, "clause").agg(F.aggregate(fields, F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))


def matching_documents(index: Index, queries: Sequence[Query]) -> DataFrame:
    """Documents that satisfy every required clause and no excluded one, with their score, by query."""
    clauses = [_clauses(q) for q in queries]
    of = [{o: [k for k, x, _, _ in c if x == o] for o in ("required", "excluded")} for c in clauses]
    numbers = dict(zip(map(id, queries), range(len(queries)), strict=True))
    hopeless = [any(not words for k, _, _, words in c if k in o["required"]) for c, o in zip(clauses, of, strict=True)]
    open_ones = [k for k, o in enumerate(of) if not o["required"]]
    every = index.records.select(*DOCUMENT).distinct().withColumn("q", F.explode(F.array(*[F.lit(k) for k in open_ones] or [F.lit(None).cast("int")]))).where(F.col("q").isNotNull() & _each(queries, lambda x: _providers(x, F.col("provider"))))
    if not any(words for c in clauses for *_, words in c):
        return every.select("q", *DOCUMENT, F.lit(0.0).alias("score"))

    def counts(kind: str) -> Column:
        return F.count(F.when(_each(queries, lambda x: F.col("clause").isin(of[numbers[id(x)]][kind]) if of[numbers[id(x)]][kind] else F.lit(False)), 1))

    never = _each(queries, lambda x: F.col("clause").isin(of[numbers[id(x)]]["excluded"]) if of[numbers[id(x)]]["excluded"] else F.lit(False))
    parts = F.array_sort(F.collect_list(F.when(~never, F.struct("clause", "score"))))
    docs = clause_matches(index, queries).groupBy("q", *DOCUMENT).agg(counts("required").alias("n_must"), counts("excluded").alias("n_never"), F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["score"]), 9).alias("score"))
    must = _each(queries, lambda x: F.lit(-1 if hopeless[numbers[id(x)]] else len(of[numbers[id(x)]]["required"])))
    found = docs.where((F.col("n_must") == must) & (must > 0) & (F.col("n_never") == 0)).select("q", *DOCUMENT, "score")
    if not open_ones:
        return found
    rest = every.join(docs, ["q", *DOCUMENT], "left").where("coalesce(n_never, 0) = 0").select("q", *DOCUMENT, F.coalesce("score", F.lit(0.0)).alias("score"))
    return rest if len(open_ones) == len(queries) else found.unionByName(rest)


def _within(c: Column, r: Range) -> list[Column]:
    """Conditions of a range; an unknown value fails them."""
    out = []
    for bound, least in ((r.low, True), (r.high, False)):
        if bound:
            v = F.lit(bound.value) if isinstance(bound.value, int) else F.to_date(F.lit(bound.value))
            out.append(((c >= v) if bound.inclusive else (c > v)) if least else ((c <= v) if bound.inclusive else (c < v)))
    return out


def _down(text: Column) -> Column:
    """A text that sorts the other way round."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def _slots(queries: Sequence[Query], orders: Callable[[Query], list]) -> list[Column]:
    """Ascending sort keys of the explicit orders, unknown values last either way.

    A slot holds a key of any kind, so that the queries of a batch can differ: whether it is unknown,
    a whole number, a number, a text.
    """

    def slot(o) -> Column:
        unknown, whole, number, text = F.lit(False), F.lit(0).cast("long"), F.lit(0.0), F.lit("")
        if o and o.field == "title":
            text = F.col("_title") if o.direction == "asc" else _down(F.col("_title"))
        elif o and o.field in ("date", "size"):
            c = F.datediff("published_at", F.lit("1970-01-01")).cast("long") if o.field == "date" else F.col("size_bytes")
            unknown, whole = c.isNull(), F.coalesce(c if o.direction == "asc" else -c, F.lit(0).cast("long"))
        elif o and o.field == "relevance":
            number = -F.col("score")
        return F.struct(unknown.alias("unknown"), whole.alias("whole"), number.alias("number"), text.alias("text"))

    most = max((len(orders(q)) for q in queries), default=0)
    return [_each(queries, lambda q, i=i: slot(orders(q)[i] if i < len(orders(q)) else None)).alias(f"_k{i}") for i in range(most)]


def hits(index: Index, queries: Sequence[Query], limits: Sequence[int | None] | None = None) -> DataFrame:
    """The best hits of each query in order, without their records.

    Of a hit: ``q``, the query's place, ``rank``, ``group``, ``score``; ``completeness``,
    ``source_count`` and ``providers`` over the group's usable sources; ``provider`` and
    ``source_id`` of the source that represents it. A facet family is met by any source; a size or
    day is known only if all sources agree on it. Ties go to the more complete group, then to more
    sources, then to the lower id. The limit is the given one, else the query's, else the default.

    Only narrow columns take part, and only aggregates that are combined map-side run over a group's
    sources, so a group of any size is never gathered and no description moves.
    """
    if not 1 <= len(queries) <= BATCH:
        raise ValueError(f"1 to {BATCH} queries")
    most = []
    for query, limit in zip(queries, limits or [None] * len(queries), strict=True):
        check(query)
        most.append(limit or query.limit or S.DEFAULT_LIMIT)
        if not 1 <= most[-1] <= S.RESULT_LIMIT:
            raise QueryError("invalid_limit", query)
    families = [f for f in FAMILIES if any(getattr(q, f) for q in queries)]
    titled = any(o.field == "title" for q in queries for o in q.order)  # else no Python worker is needed
    sources = index.records.select(*DOCUMENT, "source_id", "completeness", "size_bytes", "published_at", *families, (search_text(F.col("title")) if titled else F.lit("")).alias("_title"))
    scores = matching_documents(index, queries).groupBy("q", "group").agg(F.max("score").alias("score"))
    usable = sources.join(scores, "group").where(_each(queries, lambda q: _providers(q, F.col("provider"))))

    def meets(family: str) -> Callable[[Query], Column]:
        return lambda q: F.coalesce(F.arrays_overlap(F.col(family), F.array(*[F.lit(v.value) for v in getattr(q, family)])), F.lit(False)) if getattr(q, family) else F.lit(True)

    rank = F.struct(*_slots(queries, lambda q: q.order), (-F.col("completeness")).alias("less"), "provider", "source_id")
    groups = usable.groupBy("q", "group", "score").agg(
        *[F.bool_or(_each(queries, meets(f))).alias(f"_has_{f}") for f in families],
        agreed(F.col("size_bytes")).alias("_size"),
        agreed(F.col("published_at")).alias("_date"),
        F.max("completeness").alias("completeness"),
        F.count("*").alias("source_count"),
        F.array_join(F.sort_array(F.collect_set("provider")), ",").alias("providers"),
        F.min_by(F.struct("provider", "source_id", "size_bytes", "published_at", "_title"), rank).alias("best"),
    )
    fits = reduce(lambda a, b: a & b, [F.col(f"_has_{f}") for f in families], F.lit(True))
    fits = fits & _each(queries, lambda q: reduce(lambda a, b: a & b, _within(F.col("_size"), q.size) + _within(F.col("_date"), q.date), F.lit(True)))
    flat = groups.where(fits).select("q", "group", "score", "completeness", "source_count", "providers", "best.*")
    by_score = [Order("relevance", "desc", Span(0, 0))]
    order = [*_slots(queries, lambda q: q.order or by_score), F.desc("completeness"), F.desc("source_count"), F.asc("group")]
    places = {id(q): n for q, n in zip(queries, most, strict=True)}
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= max(most))
    return ranked.where(F.col("rank") <= _each(queries, lambda q: F.lit(places[id(q)]))).select("q", "rank", "group", "score", "completeness", "source_count", "providers", "provider", "source_id")


def with_records(index: Index, top: DataFrame) -> DataFrame:
    """Hits with ``record``. They are at most a thousand a query, and their groups, of which the records are laid out, prune the scan."""
    rows = top.collect()
    held = index.records.sparkSession.createDataFrame(rows, top.schema)
    groups = list(dict.fromkeys(r["group"] for r in rows))
    if not groups:
        some = index.records.where(F.lit(False))
    elif len(groups) <= 64:  # each is looked up in the row groups' bounds
        some = index.records.where(reduce(lambda a, b: a | b, [F.col("group") == g for g in groups]))
    else:
        some = index.records.where(F.col("group").between(min(groups), max(groups)) & F.col("group").isin(groups))
    got = some.select(*DOCUMENT, "source_id", F.struct(*S.FIELDS).alias("record"))
    return got.join(F.broadcast(held), [*DOCUMENT, "source_id"]).select("q", "rank", "group", "score", "completeness", "source_count", "providers", "record")


def search(index: Index, query: Query, limit: int | None = None) -> DataFrame:
    """The best hits in order: ``rank``, ``group``, ``score``, counts, ``providers`` and ``record``; see :func:`hits`."""
    return with_records(index, hits(index, [query], [limit])).drop("q")


def search_many(index: Index, queries: Sequence[Query], limits: Sequence[int | None] | None = None) -> DataFrame:
    """The hits of a batch of queries, by the query's place ``q``: one scan of the index for all."""
    return with_records(index, hits(index, queries, limits))
