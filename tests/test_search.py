import datetime as dt

import pytest

from trovelight import schema as S
from trovelight.operators.index import build
from trovelight.operators.records import normalize_records, require_valid
from trovelight.plans.query import QueryError, parse
from trovelight.plans.search import search

H1, H2, H3, H4 = ("1" * 40, "2" * 40, "3" * 40, "4" * 40)
MIB, GIB = 2**20, 2**30


def index_of(spark, *rows):
    names = S.FIELDS
    full = [tuple(r.get(n) for n in names) for r in rows]
    return build(require_valid(normalize_records(spark.createDataFrame(full, S.RECORD))))


def record(provider, source_id, title, **more):
    return {"provider": provider, "source_id": source_id, "title": title} | more


def ids(index, text, limit=None):
    return [r.record.source_id for r in search(index, parse(text), limit).orderBy("rank").collect()]


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def golden(spark):
    return index_of(
        spark,
        record("internet_archive", "title-match", "Climate of the northern fens", description="Sounds of reed beds, kept on tape.", infohash_v1=H1, size_bytes=734003200, published_at=day("2024-08-10"), content_kinds=["dataset"], media_kinds=["audio"], extensions=[".flac"], languages=["en"]),
        record("academic_torrents", "facet-match", "Daily weather of one village", description="Rain and wind, read off each morning.", infohash_v1=H2, size_bytes=GIB, published_at=day("2025-02-03"), categories=["climate"], content_kinds=["dataset"], extensions=[".csv"], languages=["en"]),
        record("internet_archive", "description-match", "Old weather charts", description="Sheets of climate maps with a page of notes.", infohash_v1=H3, size_bytes=2 * GIB, published_at=day("2020-01-15"), content_kinds=["image"], extensions=[".tif"], languages=["en"]),
        record("debian", "debian-13-amd64", "A system image for amd64", description="Boots from a stick and installs the rest.", infohash_v1=H4, size_bytes=734003200, published_at=day("2025-07-01"), content_kinds=["disk_image"], media_kinds=["disk_image"], extensions=[".iso"], architectures=["amd64"]),
    )


def test_title_then_facets_then_description(golden):
    assert ids(golden, "climate") == ["title-match", "facet-match", "description-match"] == ids(golden, "climate")
    assert ids(golden, "arm64 Linux image under 2 GiB newest first") == []


def test_optional_excluded_and_all(golden):
    assert set(ids(golden, "weather -charts")) == {"facet-match"}
    assert ids(golden, "?weather")[0] in ("facet-match", "description-match") and len(ids(golden, "?weather")) == 4
    assert len(ids(golden, "-nothing")) == 4 and len(ids(golden, "lang:en")) == 3
    assert ids(golden, '"climate maps"') == ["description-match"] and ids(golden, '"maps climate"') == []
    assert set(ids(golden, 'weather -"of notes"')) == {"facet-match"}
    assert ids(golden, "%%") == []


def test_unknown_is_not_zero(spark):
    def row(p, s, size, when):
        return record(p, s, "climate dataset", size_bytes=size, published_at=when and day(when), content_kinds=["dataset"])

    index = index_of(spark, row("academic_torrents", "match", GIB, "2024-06-01"), row("academic_torrents", "too-large", 2 * GIB, "2024-06-01"), row("academic_torrents", "too-old", GIB, "2022-01-01"), row("academic_torrents", "unknown", None, None), row("internet_archive", "wrong-provider", GIB, "2024-06-01"))
    assert ids(index, "climate dataset after 2023 under 2 GiB academic sources only") == ["match"]


def test_transitive_groups(spark):
    import hashlib

    v1, v2 = "a" * 40, "b" * 64
    index = index_of(
        spark,
        record("internet_archive", "bridge", "payload bridge", infohash_v1=v1, infohash_v2=v2),
        record("academic_torrents", "v1", "payload", infohash_v1=v1),
        record("debian", "v2", "payload", infohash_v2=v2),
        record("internet_archive", "alone", "payload other", description="more"),
        record("academic_torrents", "no-hash", "payload different"),
    )
    hits = search(index, parse("payload")).collect()
    assert len(hits) == 3 and index.lengths.select("group", "provider").distinct().count() == 5
    bridge = next(h for h in hits if h.source_count == 3)
    assert bridge.group == hashlib.sha256(f"v1:{v1}\0v2:{v2}".encode()).hexdigest() and bridge.providers == "academic_torrents,debian,internet_archive"
    assert ids(index, "payload from academic") == ["v1", "no-hash"]


def test_phrases_stay_in_one_value(spark):
    index = index_of(spark, record("debian", "unicode", "Die Straße SEE", categories=["public", "domain"]), record("debian", "a", "alpha", infohash_v1=H1), record("debian", "b", "beta", infohash_v1=H1))
    assert ids(index, "Straße") == ids(index, '"Straße SEE"') == ["unicode"]
    assert ids(index, '"alpha beta"') == ids(index, '"public domain"') == []


def test_text_is_the_providers_own_facets_are_the_groups(spark):
    index = index_of(
        spark,
        record("internet_archive", "n", "nebula", infohash_v1=H1, size_bytes=GIB),
        record("academic_torrents", "g", "glacier", infohash_v1=H1, content_kinds=["dataset"]),
        record("internet_archive", "c1", "conflicted", infohash_v1=H2, size_bytes=GIB),
        record("academic_torrents", "c2", "conflicted", infohash_v1=H2, size_bytes=2 * GIB),
    )
    assert ids(index, "nebula glacier") == []
    assert len(ids(index, "nebula kind:dataset under 2 GiB")) == 1
    assert ids(index, "nebula kind:dataset under 2 GiB from archive") == [] == ids(index, "conflicted under 3 GiB")


def test_all_words_of_a_term(spark):
    index = index_of(spark, record("debian", "part", "machine image"), record("debian", "complete", "machine learning image"))
    assert ids(index, "machine-learning") == ["complete"]


def test_ranking_uses_usable_sources(spark):
    index = index_of(
        spark,
        record("academic_torrents", "sparse", "beacon", infohash_v1=H1),
        record("internet_archive", "excluded-rich", "beacon", infohash_v1=H1, description="d", size_bytes=1, seeders=1, leechers=1),
        record("academic_torrents", "eligible-rich", "beacon", size_bytes=1, seeders=2),
    )
    assert ids(index, "beacon from academic") == ["eligible-rich", "sparse"]


def test_ties_orders_and_limits(spark):
    index = index_of(spark, record("debian", "plain", "beacon"), record("debian", "rich", "beacon", infohash_v1=H2, size_bytes=3, seeders=1), record("debian", "multi-a", "beacon", infohash_v1=H1), record("archive", "multi-b", "beacon", infohash_v1=H1))
    assert ids(index, "beacon") == ["rich", "multi-b", "plain"]
    rows = [record("debian", f"r{k:02}", "tied") for k in range(64)]
    tied = index_of(spark, *rows)
    assert ids(tied, "tied", 1) == ids(tied, "tied", 64)[:1] and len(ids(tied, "tied")) == 50
    dated = index_of(spark, record("debian", "old", "x", published_at=day("2022-01-01"), size_bytes=5), record("debian", "new", "x", published_at=day("2025-01-01"), size_bytes=9), record("debian", "unknown", "x"))
    assert ids(dated, "x newest first") == ["new", "old", "unknown"] and ids(dated, "x oldest first") == ["old", "new", "unknown"]
    assert ids(dated, "x sort:largest") == ["new", "old", "unknown"]
    named = index_of(spark, record("debian", "1", "b x"), record("debian", "2", "B x y"), record("debian", "3", "a x"))
    assert ids(named, "x sort:title") == ["3", "1", "2"] and ids(named, "x sort:title-desc") == ["2", "1", "3"]
    with pytest.raises(QueryError):
        search(named, parse("x"), 1001)


def test_representative(spark):
    index = index_of(spark, record("debian", "rich-old", "shared", infohash_v1=H1, published_at=day("2022-01-01"), content_kinds=["dataset"], description="d"), record("debian", "new", "shared", infohash_v1=H1, published_at=day("2025-01-01")))
    hit = search(index, parse("kind:dataset newest first")).first()
    assert (hit.record.source_id, hit.source_count) == ("new", 2)
    assert ids(index, "shared") == ids(index, "shared sort:relevance") == ids(index, "shared sort:title") == ["rich-old"]


def test_empty_catalogue_and_clashing_columns(spark):
    assert ids(index_of(spark), "x") == []
    df = spark.createDataFrame([("debian", "s", "word", "g", 5)], "provider string, source_id string, title string, group string, score int")
    assert [r.record.source_id for r in search(build(require_valid(normalize_records(df))), parse("word")).collect()] == ["s"]
