import gzip
import hashlib
import time

import pytest

from trovelight.sources import http, metainfo, snapshot, transport, xml
from trovelight.sources.metainfo import MetainfoError, inspect_magnet, inspect_metainfo

V1, V2 = "0123456789abcdef0123456789abcdef01234567", "ab" * 32

# Inputs and how they must be read.


def rss(*items, tail=""):
    return ('<?xml version="1.0"?><rss version="2.0"><channel><title/><description/><link/>' + "".join(items) + "</channel></rss>" + tail).encode()


def item(**more):
    held = {"title": "First", "category": "Dataset", "infohash": V1, "guid": "g", "link": "l", "description": "d", "size": "42"} | more
    return "<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in held.items() if v is not None) + "</item>"


def test_items():
    (got,) = xml.parse_items(rss(item()))
    assert (got["title"], got["size_bytes"], got["category"], got["infohash"]) == ("First", 42, "Dataset", V1)
    assert [i["title"] for i in xml.parse_items(rss(item(), item(title="Second")))] == ["First", "Second"]


@pytest.mark.parametrize(
    "body",
    [
        b"<rss", b"\xff", rss(item(infohash=V1.upper())), rss(item(infohash=V1[:-1])), rss(item(size="-1")), rss(item(size="+1")), rss(item(size="9223372036854775808")), rss(item(guid=None)), rss(item(title="")),
        rss(item().replace("<size>", "<size>1</size><size>")), rss(item().replace("<guid>", "<other>1</other><guid>")), rss(item(title="<b>x</b>")), b'<!DOCTYPE rss><rss version="2.0"/>', rss(item(), tail="<x/>"), b"<rss/>", rss(), rss("text"), rss(item(title="a" * 1025)), rss("<extra/>"),
    ],
)
def test_hostile_catalogues(body):
    with pytest.raises(xml.CatalogueFormatError):
        xml.parse_items(body)


def test_catalogue_limits():
    for limits in ({"most_bytes": 32}, {"most_records": 1}):
        with pytest.raises(xml.CatalogueFormatError):
            xml.parse_items(rss(item(), item()), **limits)


def test_catalogue_scan(spark, tmp_path):
    (tmp_path / "c.xml").write_bytes(rss(item(), item(title="Later"), item(infohash="f" * 40, category="no facet!")))
    items = xml.read_catalogues(spark, str(tmp_path))
    rows = {r.infohash_v1: r for r in xml.item_records(items, "shelf", "https://shelf.example").collect()}
    assert rows[V1].title == "First" and rows[V1].categories == ["dataset"] and rows["f" * 40].categories == []
    assert rows[V1].details_url == f"https://shelf.example/details/{V1}" and rows[V1].size_bytes == 42


def test_fetch():
    later = time.monotonic() + 60
    seen = []

    def send(url, headers):
        seen.append((url, dict(headers)))
        return http.Answer(200, {"ETag": '"n"', "Content-Type": "text/xml; charset=utf-8"}, b"body")

    got = http.fetch("https://shelf.example", "/a", send, deadline=later, etag='"e"', last_modified="Mon")
    assert seen == [("https://shelf.example/a", {"If-None-Match": '"e"', "If-Modified-Since": "Mon"})] and (got.body, got.media_type, got.etag) == (b"body", "text/xml", '"n"')
    assert http.fetch("https://shelf.example", "/a", lambda u, h: http.Answer(304), deadline=later).unchanged
    hops = iter([http.Answer(302, {"Location": "/b"}), http.Answer(302, {"Location": "/c"}), http.Answer(200, {}, b"x")])
    assert http.fetch("https://shelf.example", "/a", lambda u, h: next(hops), deadline=later).body == b"x"
    cases = {
        "too many redirects": http.Answer(302, {"Location": "/b"}), "changed origin": http.Answer(302, {"Location": "https://other.example/"}), "status": http.Answer(206), "rate limit": http.Answer(429, {"Retry-After": "7"}),
        "body too large": http.Answer(200, {"Content-Encoding": "gzip"}, gzip.compress(b"a" * 4096)),
    }
    for code, answer in cases.items():
        with pytest.raises(http.FetchError) as e:
            http.fetch("https://shelf.example", "/a", lambda u, h, a=answer: a, deadline=later, most=32)
        assert e.value.code == code and (code != "rate limit" or e.value.seconds == 7)
    for deadline, code in ((None, "no deadline"), (time.monotonic() - 1, "deadline")):
        with pytest.raises(http.FetchError, match=code):
            http.fetch("https://shelf.example", "/a", send, deadline=deadline)


@pytest.mark.parametrize("origin", ["http://a.example", "https://u:p@a.example", "https://a.example/x", "https://127.0.0.1", "https://[::1]", "https://169.254.169.254", "https://localhost"])
def test_refused_origins(origin):
    with pytest.raises(http.FetchError):
        http.origin_of(origin)


def test_paths_and_addresses():
    for path in ("https://a.example/x", "//a.example", "x", "/x#y"):
        with pytest.raises(http.FetchError):
            http.path_of("https://a.example", path)
    assert all(map(http.unsafe_address, "0.0.0.0 10.1.2.3 100.64.0.1 127.0.0.1 169.254.0.1 192.0.2.1 198.18.0.1 224.0.0.1 ::1 fe80::1 64:ff9b::7f00:1 ::ffff:10.0.0.1".split()))
    assert not any(map(http.unsafe_address, "8.8.8.8 1.1.1.1 2606:4700:4700::1111".split()))


def test_snapshots(tmp_path):
    at = tmp_path / "shelf.json"
    assert snapshot.load(at, "shelf").records == []
    snapshot.save(at, snapshot.Snapshot('"e"', "Mon", [{"provider": "shelf", "source_id": "1", "title": "t"}]))
    assert snapshot.load(at, "shelf").etag == '"e"'
    for text in ("{} x", '{"schema_version":1,"records":[],"x":1}', '{"schema_version":1,"records":[]}', '{"schema_version":2,"records":[{"provider":"shelf"}]}', '{"schema_version":1,"records":[{"provider":"other"}]}', '{"schema_version":1,"records":[{"provider":"shelf","zz":1}]}'):
        at.write_text(text)
        with pytest.raises(snapshot.SnapshotError):
            snapshot.load(at, "shelf")
    (tmp_path / "link.json").symlink_to(at)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(tmp_path / "link.json", "shelf")
    for name in ("", ".hidden", "../state", "sub\\state", "C:state", "state.", "CON", "nul.txt", "COM1.log", "a" * 129):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.safe_name(name)


# torrent metadata


def bencode(v) -> bytes:
    if isinstance(v, int):
        return b"i%de" % v
    if isinstance(v, bytes):
        return b"%d:%s" % (len(v), v)
    if isinstance(v, list):
        return b"l" + b"".join(map(bencode, v)) + b"e"
    return b"d" + b"".join(bencode(k) + bencode(v[k]) for k in sorted(v)) + b"e"


def v1_info(**more):
    return {b"length": 5, b"name": b"sample.bin", b"piece length": 16384, b"pieces": b"a" * 20} | {k.encode().replace(b"_", b" "): v for k, v in more.items()}


def v2_info(size=5, piece=16384, root=b"r" * 32, **more):
    return {b"file tree": {b"sample.bin": {b"": {b"length": size, b"pieces root": root}}}, b"meta version": 2, b"name": b"sample.bin", b"piece length": piece} | {k.encode().replace(b"_", b" "): v for k, v in more.items()}


def test_v1():
    got = inspect_metainfo(bencode({b"announce": b"https://t.example/a", b"comment": b"safe\x1b[31m red", b"info": v1_info(), b"url-list": [b"https://w.example/b", b"https://w.example/a"]}))
    assert (got["format"], got["total_size"], got["comment"], got["files"]) == ("v1", 5, "safe red", [{"path": "sample.bin", "size": 5}])
    assert got["infohash_v1"] == hashlib.sha1(bencode(v1_info())).hexdigest() and got["webseeds"] == ["https://w.example/a", "https://w.example/b"]


def test_v2_and_hybrid():
    got = inspect_metainfo(bencode({b"info": v2_info()}))
    assert (got["format"], got["infohash_v1"], got["infohash_v2"]) == ("v2", None, hashlib.sha256(bencode(v2_info())).hexdigest())
    assert inspect_metainfo(bencode({b"info": v1_info() | v2_info()}))["format"] == "hybrid"


def test_piece_layers():
    leaves = [bytes([k]) * 32 for k in range(3)]
    root = metainfo.merkle_root(list(leaves), b"\0" * 32)
    info = v2_info(size=3 * 16384, root=root)
    assert inspect_metainfo(bencode({b"info": info, b"piece layers": {root: b"".join(leaves)}}))["total_size"] == 49152
    for layers in ({}, {root: b"".join(leaves[:2])}, {root: b"".join(leaves[::-1])}, {root: b"".join(leaves), b"x" * 32: b"y" * 32}):
        with pytest.raises(MetainfoError):
            inspect_metainfo(bencode({b"info": info, b"piece layers": layers}))


def padded(pad):
    files = [{b"length": 5, b"path": [b"a"]}, *([{b"attr": b"p", b"length": pad, b"path": [b".pad", b"1"]}] if pad else []), {b"length": 5, b"path": [b"b"]}]
    total = 10 + pad
    tree = {n: {b"": {b"length": 5, b"pieces root": r * 32}} for n, r in ((b"a", b"x"), (b"b", b"y"))}
    return {b"files": files, b"file tree": tree, b"meta version": 2, b"name": b"n", b"piece length": 16384, b"pieces": b"p" * 20 * -(-total // 16384)}


def test_hybrid_padding():
    assert len(inspect_metainfo(bencode({b"info": padded(16379)}))["files"]) == 2
    for pad in (0, 16378):
        with pytest.raises(MetainfoError):
            inspect_metainfo(bencode({b"info": padded(pad)}))


@pytest.mark.parametrize(
    "body",
    [
        b"", b"i1e", b"d4:infoi1ee", b"d4:infode", b"d4:infodee0", b"d1:a1:b1:a1:c4:infodee", b"d1:b0:1:a0:e", b"di1e0:e", b"d4:info" + b"l" * 70 + b"e" * 70 + b"e",
        bencode({b"info": v1_info()}).replace(b"i5e", b"i05e"), bencode({b"info": v1_info()}).replace(b"i5e", b"i-0e"), bencode({b"info": v1_info()}).replace(b"i5e", b"i+5e"), bencode({b"info": v1_info()}) + b"x",
        bencode({b"info": v1_info(pieces=b"a" * 19)}), bencode({b"info": v1_info(pieces=b"a" * 40)}), bencode({b"info": v1_info(private=2)}), bencode({b"info": v1_info(length=-1)}), bencode({b"info": v1_info(name=b"..")}),
        bencode({b"info": v2_info(piece=16385)}), bencode({b"info": v2_info(root=b"r" * 31)}), bencode({b"announce": b"http://127.0.0.1/a", b"info": v1_info()}), bencode({b"announce": b"gopher://t.example", b"info": v1_info()}),
    ],
)
def test_hostile_metainfo(body):
    with pytest.raises(MetainfoError):
        inspect_metainfo(body)


@pytest.mark.parametrize("paths", [[[b".."]], [[b"a\\b"]], [[b"C:"]], [[b"a"], [b"A"]], [[b"a"], [b"a", b"b"]], [[b"CON"]], [[b"nul.txt"]], [[b"COM1"]], [["COM¹".encode()]], [["LPT³".encode()]], [[b"CONIN$"]], [[b"CONOUT$"]], [["ſ".encode()], [b"s"]], [["ς".encode()], ["σ".encode()]], [[b"end."]]])
def test_hostile_paths(paths):
    info = {b"files": [{b"length": 1, b"path": p} for p in paths], b"name": b"n", b"piece length": 16384, b"pieces": b"a" * 20}
    with pytest.raises(MetainfoError):
        inspect_metainfo(bencode({b"info": info}))


def test_magnets(spark):
    got = inspect_magnet(f"magnet:?xt=urn:btih:{V1}&xt=urn:btmh:1220{V2}&dn=Public+data&tr=https%3A%2F%2Ft.example%2Fa&ws=https%3A%2F%2Fw.example%2Fd")
    assert (got["infohash_v1"], got["infohash_v2"], got["name"], got["metadata_available"], got["trackers"]) == (V1, V2, "Public data", False, ["https://t.example/a"])
    assert inspect_magnet("magnet:?xt=urn:btih:" + "a" * 32)["infohash_v1"] == "00" * 20
    bad = ["magnet:?", "magnet:?dn=x", f"http:?xt=urn:btih:{V1}", f"magnet:?xt=urn:btih:{V1}&xt=urn:btih:{V1}", "magnet:?xt=urn:btih:zz", f"magnet:?xt=urn:btih:{V1}&dn=a&dn=b", f"magnet:?xt=urn:btih:{V1}&tr=http%3A%2F%2F10.0.0.1", f"magnet:?xt=urn:btih:{V1}&dn=" + "a" * 5000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate([f"magnet:?xt=urn:btih:{V1}", *bad, None])], "id int, uri string")
    rows = {r.id: r for r in metainfo.inspect_magnets(df, "id", "uri").collect()}
    assert rows[0].infohash_v1 == V1 and rows[0].error is None and all(rows[k].error for k in range(1, len(rows)))


def test_bulk_files(spark, tmp_path):
    (tmp_path / "a.torrent").write_bytes(bencode({b"info": padded(16379)}))
    (tmp_path / "bad.torrent").write_bytes(b"x")
    rows = metainfo.read_metainfo(spark, str(tmp_path))
    assert sorted(r.error is None for r in rows.collect()) == [False, True]
    assert sorted((r.file_index, r.file_path, r.size) for r in metainfo.files_of(rows).collect()) == [(1, "a", 5), (2, "b", 5)]
    (tmp_path / "l.torrent").symlink_to(tmp_path / "a.torrent")
    with pytest.raises(MetainfoError):
        metainfo.read_metainfo(spark, str(tmp_path / "l.torrent"))
    kinds = spark.createDataFrame([(s,) for s in ("magnet:?x", "https://a", "http://a", "C:\\x.torrent", "x.torrent", "file:///x", "")], "s string").select("s", metainfo.source_kind(metainfo.F.col("s")).alias("k")).collect()
    assert [r.k for r in kinds] == ["magnet", "https", None, "local", "local", None, None]


def test_long_piece_lists_are_inspected(spark, tmp_path):
    """Bodies of many pieces reach the parser; those over its limit are error rows."""
    from trovelight.queries import QUERIES

    rows = [(1, "small", 40_000, 16384), (2, "long", 5001 * 16384, 16384), (3, "longer", 100_000 * 16384, 16384), (4, "too long", 2**62, 16384), (5, "unknown", None, 16384)]
    spark.createDataFrame(rows, "inspection_id long, name string, total_size long, piece_length long").write.parquet(f"{tmp_path}/inspections.parquet")
    got = {r.inspection_id: (r.error, r.infohash_v1, r.total_size) for r in QUERIES["inspect_metainfo"](spark, str(tmp_path)).collect()}

    def said(name, total, piece):
        n = -(-total // piece)
        info = f"d6:lengthi{total}e4:name{len(name)}:{name}12:piece lengthi{piece}e6:pieces{20 * n}:" + "x" * 20 * n + "e"
        return None, hashlib.sha1(info.encode()).hexdigest(), total

    assert got == {k: said(n.replace(" ", "_"), t, p) for k, n, t, p in rows[:3]} | {4: ("too large", None, None), 5: ("nothing to inspect", None, None)}


def test_addresses_are_checked_after_resolving():
    later = time.monotonic() + 60
    answer = lambda u, h: http.Answer(200, {}, b"x")
    assert http.unsafe_address("168.63.129.16")
    assert http.fetch("https://shelf.example", "/a", answer, deadline=later, resolve=lambda h: ["10.0.0.1", "1.1.1.1"]).body == b"x"
    with pytest.raises(http.FetchError, match="private address"):
        http.fetch("https://shelf.example", "/a", answer, deadline=later, resolve=lambda h: ["10.0.0.1", "::1"])
    with pytest.raises(http.FetchError, match="private address"):
        transport.https("https://shelf.example/a", {}, resolve=lambda h: ["127.0.0.1"])


def test_large_and_foreign_files(spark, tmp_path):
    """Too large files are an error row or fail the read; names of a namespace are none of the format's."""
    with open(tmp_path / "big.torrent", "wb") as f:
        f.truncate((16 << 20) + 1)
    (tmp_path / "bad.torrent").write_bytes(b"de")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in metainfo.read_metainfo(spark, str(tmp_path)).collect()}
    assert got["big.torrent"] == "too large" and got["bad.torrent"]
    with open(tmp_path / "big.xml", "wb") as f:
        f.truncate((8 << 20) + 1)
    with pytest.raises(Exception, match="too large"):
        xml.read_catalogues(spark, str(tmp_path / "big.xml")).collect()
    with pytest.raises(xml.CatalogueFormatError):
        xml.parse_items(b'<rss xmlns="urn:x"><channel></channel></rss>')
