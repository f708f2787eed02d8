import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trovelight import output
from trovelight import schema as S
from trovelight.functions.unicode import compact_text, sanitize, search_text, terminal_text, tokens
from trovelight.operators.grouping import connected, merge_sources
from trovelight.operators.records import encoded, normalize_records, require_valid, source_key, split_records, structured_text, with_identity
from trovelight.sync import replace_provider

# Rows and the canonical records they must give.


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in S.FIELDS) for r in rows], S.RECORD)


GOOD = {"provider": " Internet_Archive ", "source_id": " item\t42 ", "title": "  Public\u202e  Domain\nFilm ", "description": "A\0 restored\tfilm", "infohash_v1": " " + "AB" * 20, "size_bytes": 0, "published_at": dt.date(2025, 4, 3), "categories": ["Film", "film"], "extensions": ["MKV", ".mkv"], "resolutions": [1080, 720, 1080]}


def test_normal_form(spark):
    (r,) = normalize_records(frame(spark, GOOD)).collect()
    assert r.errors == [] and (r.provider, r.source_id, r.title, r.description) == ("internet_archive", "item 42", "Public Domain Film", "A restored film")
    assert (r.infohash_v1, r.categories, r.extensions, r.resolutions, r.size_bytes) == ("ab" * 20, ["film"], [".mkv"], [720, 1080], 0)


@pytest.mark.parametrize(
    "change",
    [{"provider": ""}, {"title": "é" * 513}, {"title": " "}, {"source_id": None}, {"infohash_v1": "g" * 40}, {"details_url": "https://u:p@a.example/"}, {"details_url": "http://a.example/"}, {"magnet_uri": "magnet:?"}, {"size_bytes": -1}, {"categories": [f"c{k}" for k in range(65)]}, {"categories": ["a b"]}, {"resolutions": [99]}, {"extensions": ["a.b"]}, {"seeders": -1}],
)
def test_hostile_rows(spark, change):
    normal = normalize_records(frame(spark, GOOD | change, GOOD))
    good, bad = split_records(normal)
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(Exception, match="invalid record"):
        require_valid(normal).collect()


def test_text_columns(spark):
    df = spark.createDataFrame([(" Straße ＳＥＥ ",), ("X_86-64. b",), ("",), (None,), ("a\x1b[31mb",)], "t string")
    rows = df.select(search_text(F.col("t")).alias("s"), compact_text(F.col("t")).alias("c"), terminal_text(F.col("t")).alias("x"), tokens(F.col("t")).alias("w")).collect()
    assert [r.s for r in rows][:4] == ["strasse see", "x_86-64. b", "", None] and rows[1].c == "x8664b" and rows[4].x == "ab" and rows[1].w == ["x_86", "64", "b"]


@pytest.mark.parametrize("raw, cap, want", [("a\x1b[31mb\x1b[0mc\x1b]title\ad\x1bPsecret\x1b\\e", 99, "abcde"), ("ab船cd", 6, "ab…"), ("船", 2, ".."), ("a\u2028b\u202ec\x85", 9, "abc"), ("x\x1b[31", 9, "x"), ("a\nb", 9, "ab"), ("x\x9b1my", 9, "xy")])
def test_sanitize(raw, cap, want):
    assert sanitize(raw, cap) == want and len(sanitize(raw, cap).encode()) <= cap and sanitize(want, cap) == want


def test_completeness_and_texts(spark):
    df = normalize_records(frame(spark, GOOD, {"provider": "p", "source_id": "1", "title": "t"}))
    a, b = with_identity(df).orderBy("provider").collect()
    assert (a.completeness, b.completeness) == (2 + 2 + 1 + 1 + 2, 0)
    assert df.select(structured_text(df).alias("s")).collect()[0].s == "film .mkv 720p 1080p"
    (e,) = frame(spark, {"provider": "p", "source_id": "1", "title": "<&>", "categories": [], "published_at": dt.date(2024, 1, 2)}).transform(lambda d: d.select(encoded(d).alias("e"))).collect()
    assert e.e == '{"provider":"p","source_id":"1","title":"\\u003c\\u0026\\u003e","published_at":"2024-01-02T00:00:00Z"}'
    assert spark.range(1).select(F.hex(source_key(F.lit("a"), F.lit("b"))).alias("k")).first().k == "610062"


def test_merging(spark):
    one, two, both = "1" * 40, "2" * 40, "3" * 64
    rows = [{"title": "t", "source_id": s, "provider": "p"} | m for s, m in (("a", {"infohash_v1": one}), ("a", {"description": "d"}), ("b", {"infohash_v1": one}), ("b", {"infohash_v1": two}), ("c", {"infohash_v1": one}), ("c", {"infohash_v2": both}), ("d", {"infohash_v1": one, "infohash_v2": both}), ("d", {"infohash_v1": one}), ("e", {"title": "z"}), ("e", {"title": "y"}))]
    got = {r.source_id: r for r in merge_sources(normalize_records(frame(spark, *rows)).drop("errors")).collect()}
    assert {k: r.conflict for k, r in got.items()} == {"a": False, "b": True, "c": True, "d": False, "e": False}
    assert (got["a"].description, got["a"].infohash_v1, got["d"].infohash_v2, got["e"].title) == ("d", one, both, "y")


def test_components(spark):
    chain = [(f"n{k:03}", f"n{k + 1:03}") for k in range(40)]
    df = spark.createDataFrame([*chain, ("x", "x"), ("y", "z"), ("y", "z"), (None, "q")], "a string, b string")
    got = {r.node: r.label for r in connected(df).collect()}
    assert {got[f"n{k:03}"] for k in range(41)} == {"n000"} and (got["x"], got["z"]) == ("x", "y") and "q" not in got
    assert connected(df.limit(0)).count() == 0


def test_replace_provider(spark):
    old = frame(spark, {"provider": "a", "source_id": "1"}, {"provider": "b", "source_id": "2"})
    new = frame(spark, {"provider": "a", "source_id": "3"})
    assert sorted(r.source_id for r in replace_provider(old, new, "a").collect()) == ["2", "3"]
    with pytest.raises(Exception, match="foreign"):
        replace_provider(old, frame(spark, {"provider": "c"}), "a").collect()


def test_output(spark):
    assert output.envelope("search", {"a": "\x9f"}) == '{"schema_version":1,"type":"search","data":{"a":"\\u009f"}}\n'
    lines = []
    stream = output.Ndjson(lines.append)
    stream.send("result", {"a": 1})
    with pytest.raises(ValueError):
        loop = []
        loop.append(loop)
        stream.send("result", loop)
    stream.done()
    assert [json.loads(x)["sequence"] for x in lines] == [1, 2] and json.loads(lines[1])["data"] is None
    assert output.table_text(["ID", "TITLE"], [["1", "Debian"], ["2\x1b[31mforged", "Archive\nitem"]]) == "ID       TITLE\n1        Debian\n2forged  Archiveitem\n"
    with pytest.raises(ValueError):
        output.table_text(["A"], [["1", "2"]])
    df = spark.createDataFrame([(1, "x"), (2, None)], "rank int, t string")
    got = [r.line for r in output.json_lines(df, "result", "rank").orderBy("sequence").collect()]
    assert got == ['{"schema_version":1,"type":"result","sequence":1,"data":{"t":"x"}}', '{"schema_version":1,"type":"result","sequence":2,"data":{"t":null}}', '{"schema_version":1,"type":"done","sequence":3,"data":null}']
