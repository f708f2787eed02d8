import datetime as dt
import random

from trovelight.operators.snapshots import http_date, snapshot_changes

STATE = "snapshot_id long, provider string, last_modified string, delivered_at timestamp"
ROW = "snapshot_id long, ordinal long, source_id string, title string, description string, infohash_v1 string, size_bytes long, categories array<string>"


def state(k, provider, day, stamp=True):
    when = dt.datetime(2025, 1, day, 5, 6, 7)
    return (k, provider, when.strftime("%a, %d %b %Y %H:%M:%S GMT") if stamp else None, when)


def changes(spark, states, rows, **more):
    got = snapshot_changes(spark.createDataFrame(states, STATE), spark.createDataFrame(rows, ROW), **more).collect()
    return sorted(tuple(r) for r in got)


def row(snapshot, ordinal, key, title="t", description=None, h=None, size=None, cats=None):
    return (snapshot, ordinal, key, title, description, h, size, cats)


def test_cases(spark):
    states = [state(5, "p", 1), state(3, "p", 2), state(4, "p", 3), state(9, "q", 1), state(8, None, 1), state(7, None, 2, stamp=False)]
    rows = [
        row(5, 1, "same", " A  b ", None, "AB", 1, ["x", "y"]), row(5, 2, "gone"), row(5, 3, "twice", "first"), row(5, 4, " twice\t", "second"), row(5, 5, "sizes", size=1),
        row(3, 9, "same ", "A b", "  ", "ab ", 1, ["y", " x", "x"]), row(3, 2, "new"), row(3, 3, "twice", "first"), row(3, 4, "sizes", size=None),
        row(9, 1, "only"), row(8, 1, None), row(7, 1, "", "other"), row(77, 1, "unknown"),
    ]
    want = [(3, "gone", "removed"), (3, "new", "added"), (3, "sizes", "changed"), (4, "new", "removed"), (4, "same", "removed"), (4, "sizes", "removed"), (4, "twice", "removed"), (7, "", "changed")]
    assert changes(spark, states, rows) == want
    valued = snapshot_changes(spark.createDataFrame(states, STATE), spark.createDataFrame(rows, ROW), values=("title", "size_bytes")).where("source_id = 'sizes' AND snapshot_id = 3").first()
    assert (valued.size_bytes_before, valued.size_bytes_after, valued.title_before) == (1, None, "t")


def test_empty_and_clashing(spark):
    assert changes(spark, [state(1, "p", 1)], []) == [] == changes(spark, [], [row(1, 1, "a")])
    states = spark.createDataFrame([(*state(k, "p", k), 1, 1) for k in (1, 2)], STATE + ", seq int, k1 int")
    rows = spark.createDataFrame([(*row(1, 1, "a"), 1, 1)], ROW + ", chain int, kind int")
    assert [tuple(r) for r in snapshot_changes(states, rows).collect()] == [(2, "a", "removed")]


def test_against_brute_force(spark):
    rng = random.Random(8)
    states = [state(10 * p + k, f"p{p}", rng.randint(1, 28)) for p in range(2) for k in range(5)]
    rows = [row(s[0], o, f"k{rng.randint(0, 8)}", rng.choice("ab"), size=rng.choice([None, 1])) for s in states for o in range(rng.randint(0, 9))]
    held = {}
    for r in sorted(rows, key=lambda r: r[1], reverse=True):
        held.setdefault(r[0], {})[r[2]] = (r[3], r[6])
    want = []
    for p in ("p0", "p1"):
        order = [s[0] for s in sorted((s for s in states if s[1] == p), key=lambda s: (s[3], s[0]))]
        for a, b in zip(order, order[1:]):
            x, y = held.get(a, {}), held.get(b, {})
            want += [(b, k, "added") for k in y.keys() - x.keys()] + [(b, k, "removed") for k in x.keys() - y.keys()] + [(b, k, "changed") for k in x.keys() & y.keys() if x[k] != y[k]]
    assert changes(spark, states, rows) == sorted(want)


def test_http_dates(spark):
    df = spark.createDataFrame([("Mon, 13 Jan 2025 17:11:35 GMT",), ("nonsense",), (None,)], "d string")
    assert [r.t for r in df.select(http_date(df.d).alias("t")).collect()] == [dt.datetime(2025, 1, 13, 17, 11, 35), None, None]
