import hashlib
import io
import json
import os
import re
import shutil

import pytest

from trovelight import cli
from trovelight.catalogue import Catalogue, CatalogueError
from trovelight.operators.grouping import ONE_PROCESS, Limits, connected, group_records, merge_sources, merge_stored
from trovelight.operators.index import arranged, build_index
from trovelight.operators.records import normalize_records, split_records
from trovelight.plans.query import parse
from trovelight.plans.search import search, search_many
from trovelight.sources.http import Answer
from trovelight.sources.snapshot import SnapshotError
from trovelight.streaming.snapshots import merge_stream
from trovelight.sync import XmlProvider, sync

RAW = "provider string, source_id string, title string"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("c") / "live"
    made = Catalogue(spark, str(at))
    assert made.open() is False
    made.rebuild(spark.createDataFrame([("debian", "2", "beta"), ("archive", "1", "alpha"), ("debian", "2", "beta")], RAW))
    return made


def copied(spark, built, tmp_path):
    for at in (built.root, built.previous):
        if at.exists():
            shutil.copytree(at, tmp_path / at.name)
    return Catalogue(spark, str(tmp_path / built.root.name))


def test_scan_and_search(built):
    assert [tuple(r)[:3] for r in built.records().collect()] == [("archive", "1", "alpha"), ("debian", "2", "beta")]
    assert [r.record.source_id for r in built.search("beta").collect()] == ["2"]


def test_a_failed_build_leaves_the_live_one(spark, built, tmp_path):
    c = copied(spark, built, tmp_path)
    with pytest.raises(Exception, match="invalid record"):
        c.rebuild(spark.createDataFrame([("", "1", "x")], RAW))
    assert c.open() and c.records().count() == 2 and not c.building.exists()
    h1, h2 = "1" * 40, "2" * 40
    with pytest.raises(Exception, match="conflicting"):
        c.rebuild(spark.createDataFrame([("a", "1", "x", h1), ("a", "1", "x", h2)], RAW + ", infohash_v1 string"))
    assert c.rebuild(spark.createDataFrame([("", "1", "x"), ("a", "1", "x")], RAW), strict=False)["records"] == 1 and c.previous.exists()


def test_recovery(spark, built, tmp_path):
    c = copied(spark, built, tmp_path)
    os.rename(c.root, c.previous)
    assert c.open() and c.root.exists() and not c.previous.exists()
    shutil.copytree(c.root, c.previous)
    (c.root / "_GENERATION.json").write_text("{")
    assert c.open() and c.failed.exists() and c.records().count() == 2
    (c.root / "_GENERATION.json").write_text("{")
    with pytest.raises(CatalogueError):
        c.open()
    c.previous.mkdir()
    with pytest.raises(CatalogueError):
        c.open()
    assert not c.previous.exists()
    shutil.rmtree(c.root)
    c.root.mkdir()
    assert c.open() is False and not c.root.exists()
    c.root.symlink_to(built.root)
    with pytest.raises(CatalogueError):
        c.open()


def item(k, title):
    return f"<item><title>{title}</title><category>Dataset</category><infohash>{k * 40}</infohash><guid>g</guid><link>l</link><description>Open\nDataset</description><size>42</size></item>"


def rss(*items):
    return ('<rss version="2.0"><channel>' + "".join(items) + "</channel></rss>").encode()


def test_sync(spark, built, tmp_path):
    c = copied(spark, built, tmp_path)
    answers = [Answer(200, {"ETag": '"1"', "Last-Modified": "Mon"}, rss(item("a", "one"), item("b", "two"), item("a", "again")))]
    asked = []

    def send(url, headers):
        asked.append(headers)
        return answers[-1]

    p = XmlProvider(spark, "debian", "https://shelf.example", send, tmp_path)
    assert sync(c, p) == "updated"
    rows = {r.source_id: r for r in c.records().collect()}
    assert set(rows) == {"1", "a" * 40, "b" * 40} and rows["a" * 40].title == "one" and rows["a" * 40].categories == ["dataset"] and rows["a" * 40].description == "Open Dataset" and rows["a" * 40].seeders is None
    answers.append(Answer(304))
    assert sync(c, p) == "unchanged" and asked[-1] == {"If-None-Match": '"1"', "If-Modified-Since": "Mon"} and c.records().count() == 3
    answers.append(Answer(200, {}, rss()))
    with pytest.raises(ValueError):
        sync(c, p)
    assert c.records().count() == 3
    with pytest.raises(SnapshotError):
        XmlProvider(spark, "other", "https://shelf.example", lambda u, h: Answer(304), tmp_path).sync()


def test_stream(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "live"))
    schema = RAW + ", delivered_at timestamp"
    source = str(tmp_path / "in")
    day = lambda d, rows: spark.createDataFrame(rows, RAW).selectExpr("*", f"timestamp'2025-01-0{d} 00:00:00' AS delivered_at")
    day(1, [("a", "1", "old"), ("b", "1", "kept")]).unionByName(day(2, [("a", "2", "new")])).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(schema).parquet(source)
    merge_stream(read(), c, str(tmp_path / "cp")).awaitTermination()
    assert [(r.provider, r.source_id) for r in c.records().collect()] == [("a", "2"), ("b", "1")]
    day(3, [("b", "7", "later")]).coalesce(1).write.mode("append").parquet(source)
    merge_stream(read(), c, str(tmp_path / "cp")).awaitTermination()
    assert [(r.provider, r.source_id) for r in c.records().collect()] == [("a", "2"), ("b", "7")]


def run(*args):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(args), out, err), out.getvalue(), err.getvalue()


def test_command_line(built, tmp_path):
    assert run("version")[0] == 0 and run()[0] == 2 and run("search", "--explain", "--offline", "x", "y")[0] == 2
    code, out, _ = run("--output", "json", "search", "--explain", "linux", "under", "2GiB")
    assert code == 0 and json.loads(out)["data"]["size"]["high"]["value"] == 2**31
    assert run("search", "--explain", "size:>2GiB size:<1GiB")[::2] == (2, "error: unsatisfiable\n")
    code, out, err = run("--output", "ndjson", "search", "--offline", str(built.root), "beta")
    assert code == 0 and [json.loads(x)["type"] for x in out.splitlines()] == ["result", "done"] and err == ""
    code, out, err = run("search", "--offline", str(built.root), "beta codec:none")
    assert code == 0 and "warning: invalid_filter" in err
    assert run("inspect", str(tmp_path / "none.torrent"))[0] == 1
    code, out, _ = run("--output", "ndjson", "inspect", "magnet:?xt=urn:btih:" + "a" * 40)
    assert json.loads(out.splitlines()[0])["data"]["infohash_v1"] == "a" * 40
    code, out, _ = run("records", str(built.root))
    assert out.splitlines()[1].split() == ["archive", "1", "alpha"]


def test_whole_records_are_indexed(spark, tmp_path):
    """The index queries over the records table, against plain Python; invalid rows are quarantined."""
    from collections import Counter
    from unicodedata import normalize

    from trovelight.queries import QUERIES

    texts = ["Les élèves, ÉLÈVES – folder", "Новые каталоги и folder", "Straße Ｆｏｌｄｅｒ", "каталоги", " ", None]
    rows = [(k, "s", str(k), "A title", t, "") for k, t in enumerate(texts)] + [(8, "s", "8", "Bad hash", "x", "zz"), (9, "", "9", "No provider", "x", None), (10, "s", "0", "A title", texts[0], " ")]
    rows += [(11, "t", "two", "One", None, "a" * 40), (12, "t", "two", "One", None, "b" * 40)]
    spark.createDataFrame(rows, "record_id long, provider string, source_id string, title string, description string, infohash_v1 string").write.parquet(f"{tmp_path}/records.parquet")
    words = [re.findall(r"\w+", normalize("NFKC", normalize("NFKC", t).casefold())) for t in texts[:4]]
    got = {r.term: r.n for r in QUERIES["posting_stats"](spark, str(tmp_path)).where("field = 'description'").collect()}
    assert got == Counter(w for held in words for w in held) and got["élèves"] == 2
    df = {r.term: r.df for r in QUERIES["document_frequency"](spark, str(tmp_path)).where("field = 'description'").collect()}
    assert df == Counter(w for held in words for w in set(held)) and df["каталоги"] == 2
    assert sorted(r.n for r in QUERIES["field_length"](spark, str(tmp_path)).where("field = 'description'").collect()) == sorted(map(len, words))
    assert QUERIES["catalogue_scan"](spark, str(tmp_path)).count() == 6
    left = {(r.provider, r.error): r.n for r in QUERIES["quarantine"](spark, str(tmp_path)).collect()}
    assert left == {("s", "infohash_v1"): 1, ("", "provider"): 1, ("t", "conflicting hashes"): 1}


def test_batch_equals_single_searches(spark, built):
    index = Catalogue(spark, str(built.root)).index()
    texts = ["beta", "alpha ?beta", "-beta", "sort:title", "beta newest first limit:1", "from archive", '"beta"', "nothing"]
    many = {}
    for h in search_many(index, [parse(t) for t in texts]).collect():
        many.setdefault(h.q, []).append((h["rank"], h.group, h.score, h.source_count, h.record.source_id))
    for k, t in enumerate(texts):
        one = [(h["rank"], h.group, h.score, h.source_count, h.record.source_id) for h in search(index, parse(t)).collect()]
        assert sorted(one) == sorted(many.get(k, [])), t
    with pytest.raises(ValueError):
        search_many(index, [])


def test_components_agree(spark):
    """One task's labels and those of rounds are the same."""
    import random

    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}") for _ in range(45)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(30)] + [("z", "z"), (None, "q")]
    df = spark.createDataFrame(edges, "a string, b string")
    one, rounds = ({r.node: r.label for r in connected(df, task_edges=n).collect()} for n in (10**6, 0))
    assert one == rounds and one["c30"] == "c00" and one["z"] == "z" and "q" not in one
    assert connected(df.limit(0)).count() == 0


def test_commands_that_fetch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    asked = []

    def send(url, headers):
        asked.append(url)
        return Answer(200, {}, rss(item("a", "one"), item("b", "two"))) if url.endswith(".xml") else Answer(200, {}, TORRENT)

    def call(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(list(args), out, err, send), out.getvalue(), err.getvalue()

    root = str(tmp_path / "live")
    code, out, err = call("--output", "ndjson", "providers", "sync", "debian", "--origin", "https://shelf.example", "--catalogue", root, "--snapshots", str(tmp_path))
    assert code == 0, err
    assert [json.loads(x)["type"] for x in out.splitlines()] == ["provider_sync", "done"] and json.loads(out.splitlines()[0])["data"] == {"provider": "debian", "status": "updated", "records": 2}
    code, out, _ = call("--output", "json", "records", root)
    assert [r["source_id"] for r in json.loads(out)["data"]] == ["a" * 40, "b" * 40]
    code, out, _ = call("--output", "ndjson", "inspect", "https://shelf.example/x.torrent")
    lines = [json.loads(x) for x in out.splitlines()]
    assert [x["type"] for x in lines] == ["torrent", "file", "done"] and lines[1]["data"] == {"index": 1, "path": "sample.bin", "size": 5} and lines[2]["data"] == {"files": 1, "total_size": 5} and asked[-1].endswith("/x.torrent")
    assert call("providers", "sync")[0] == 2


TORRENT = b"d4:infod6:lengthi5e4:name10:sample.bin12:piece lengthi16384e6:pieces20:" + b"x" * 20 + b"ee"


def test_saved_rows_are_checked(spark, tmp_path):
    """A snapshot that was tampered with is refused."""
    send = lambda url, headers: Answer(200, {"ETag": "1"}, rss(item("a", "one")))
    p = XmlProvider(spark, "debian", "https://shelf.example", send, tmp_path)
    p.sync()
    path = tmp_path / "debian.json"
    saved = json.loads(path.read_text())
    for change in ({"infohash_v1": "zz"}, {"codecs": ["injected"]}, {"size_bytes": -5}, {"seeders": 1}, {"title": ""}, {"categories": ["a", "b"]}):
        path.write_text(json.dumps(saved | {"records": [saved["records"][0] | change]}))
        with pytest.raises(ValueError):
            p.sync()
    path.write_text(json.dumps(saved | {"records": [saved["records"][0] | {"details_url": "https://elsewhere.example/"}]}))
    p.send = lambda url, headers: Answer(304)
    assert p.sync().records.first().details_url == "https://shelf.example/details/" + "a" * 40


def test_limits(spark, tmp_path):
    rows = spark.createDataFrame([("a", str(k), "x", "a" * 40) for k in range(3)], RAW + ", infohash_v1 string")
    assert Catalogue(spark, str(tmp_path / "ok"), ONE_PROCESS).rebuild(rows)["records"] == 3
    for limits in (Limits(records=2), Limits(record_bytes=50), Limits(group_sources=2), Limits(group_bytes=100)):
        c = Catalogue(spark, str(tmp_path / "live"), limits)
        with pytest.raises(ValueError, match="over the limit"):
            c.rebuild(rows)
        assert c.open() is False and not c.building.exists()


def test_a_build_moves_texts_once_and_postings_never(spark, tmp_path):
    """Shuffles of whole texts or of postings, and steps that stay, took 9 times the records' disk."""
    rows = spark.createDataFrame([("a", "1", "one"), ("a", "2", "two two"), ("b", "1", "é"), ("a", "1", "one more")], RAW)
    c = Catalogue(spark, str(tmp_path / "live"))
    c.rebuild(rows, strict=False)
    assert not c.work.exists() and not c.building.exists()
    index = build_index(c.index().records)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")
    assert exchanges(arranged("postings", index.postings)) == exchanges(index.lengths) == 1
    files = next((c.root / "postings").glob("*.parquet"))
    assert ".zstd." in files.name


def test_stored_merge_and_groups_are_those_of_all_rows(spark, tmp_path):
    """Only rows that may be repeated or linked are merged and joined; the result is that of all rows."""
    v1, v2 = [str(k) * 40 for k in range(4)], [str(k) * 64 for k in range(4)]
    given = [("a", "1", "x", v1[0], ""), ("a", "1", "longer", "", ""), ("a", "2", "y", v1[0], v2[0]), ("b", "1", "z", "", v2[0]), ("b", "2", "alone", v1[1], ""), ("b", "3", "bare", "", ""), ("b", "4", "w", v1[2], v2[2]), ("b", "4", "w", v1[3], v2[2])]
    valid = split_records(normalize_records(spark.createDataFrame(given, RAW + ", infohash_v1 string, infohash_v2 string")))[0]
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(merge_stored(valid)) == rows(merge_sources(valid))
    got = {(r.provider, r.source_id): r.group for r in group_records(merge_sources(valid).where("NOT conflict")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    three = sha(f"v1:{v1[0]}\0v2:{v2[0]}")
    assert got == {("a", "1"): three, ("a", "2"): three, ("b", "1"): three, ("b", "2"): sha(f"v1:{v1[1]}"), ("b", "3"): sha("b\x003")}
