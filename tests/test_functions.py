from pyspark.sql import functions as F

from trovelight.functions.facets import completeness, extension_set, identifiers, resolution_set
from trovelight.functions.text import ascii_fold, filled, info_hash, squash, strip
from trovelight.functions.unicode import bounded, compact_text, display_text, search_text
from trovelight.operators.sampling import hash_sample
from trovelight.plans.query import compact, normalize


def test_texts(spark):
    rows = ["  a \t b ", "", " \n", None, "ＡＢc", " " + "AB" * 20 + "\t", "g" * 40, "ab" * 21]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(strip(F.col("t")).alias("s"), squash(F.col("t")).alias("q"), filled(F.col("t")).alias("f"), ascii_fold(F.col("t")).alias("a"), info_hash(F.col("t")).alias("h")).collect()
    assert [r.s for r in got[:4]] == ["a \t b", "", "", None] and [r.q for r in got[:4]] == ["a b", "", "", ""]
    assert [r.f for r in got[:4]] == [True, False, False, False] and got[4].a == "abc" and [r.h for r in got[5:]] == ["ab" * 20, None, None]


def test_facets(spark):
    df = spark.createDataFrame([(["B", " a", "b", "no good", None], [".MKV", "mkv", "", "a.b"], [1080, 99, 720, 1080, None], None, " ", "x", 5)], "categories array<string>, extensions array<string>, resolutions array<int>, languages array<string>, description string, details_url string, seeders int")
    r = df.select(identifiers(F.col("categories")).alias("c"), extension_set(F.col("extensions")).alias("e"), resolution_set(F.col("resolutions")).alias("r"), identifiers(F.col("languages")).alias("l"), completeness(df).alias("n")).first()
    assert (r.c, r.e, r.r, r.l, r.n) == (["a", "b"], [".mkv"], [720, 1080], [], 2 + 1 + 2 + 0 + 1 + 1)


def test_samples(spark):
    df = spark.range(5000)
    assert hash_sample(df, "id", rows=6000).count() == 5000 and hash_sample(df, "id", rows=700).count() == 700 and hash_sample(df.limit(0), "id", rows=7).count() == 0
    assert sorted(hash_sample(df, "id", rows=700).collect()) == sorted(hash_sample(df.repartition(7), "id", rows=700).collect())


def test_array_forms_agree_with_plain_ones(spark):
    """ASCII texts are folded as arrays, others one by one, to the same forms."""
    texts = ["", None, " \t A-b_C.d \x1f\x1c", "x\x00y\x7f z\r\n", "Straße ＳＥＥ ", "e\u0301", "\x1b[31m", "a" * 5000 + "É", "İ ǅ ﬁ", "\u2028a\u00a0b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search_text(F.col("t")).alias("s"), compact_text(F.col("t")).alias("c"), display_text(F.col("t")).alias("d")).collect()
    for r in got:
        assert (r.s, r.c, r.d) == ((None,) * 3 if r.t is None else (normalize(r.t), compact(r.t), bounded(r.t)))
