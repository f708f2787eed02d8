import random

import pytest

from trovelight.plans.query import QueryError, byte_quantity, explain, override, parse

# Queries and what they must mean.


def values(held):
    return [v.value for v in held]


def words(held):
    return [c.normalized for c in held]


def codes(q):
    return sorted(w.code for w in q.warnings)


def test_architecture_image_size_and_order():
    q = parse("arm64 Linux image under 2 GiB newest first")
    assert values(q.architectures) == ["arm64"] and values(q.content_kinds) == ["disk_image"]
    assert words(q.required) == ["linux"] and (q.size.high.value, q.size.high.inclusive) == (2**31, False)
    assert [(o.field, o.direction) for o in q.order] == [("date", "desc")] and not q.warnings


def test_academic_sources_after_a_year():
    q = parse("machine-learning climate dataset after 2023 academic sources only")
    assert words(q.required) == ["machine-learning", "climate"] and values(q.content_kinds) == ["dataset"]
    assert (q.date.low.value, q.date.low.inclusive) == ("2024-01-01", True) and values(q.allow) == ["academic_torrents"]


def test_phrase_and_provider():
    q = parse('"public domain" animation under 4 GiB from archive')
    assert [(p.normalized, p.span.start_byte, p.span.end_byte) for p in q.phrases] == [("public domain", 0, 15)]
    assert values(q.content_kinds) == ["animation"] and q.size.high.value == 2**32 and values(q.allow) == ["internet_archive"]


def test_every_explicit_filter():
    q = parse(
        '+linux ?desktop -server -"beta build" category:software kind:disk-image ext:mkv media:video date:2020..2023 lang:en-US '
        "arch:x86_64 resolution:4k codec:HEVC provider:archive -provider:debian sort:smallest limit:25 size:>=1.5GiB"
    )
    assert (words(q.required), words(q.optional), words(q.excluded)) == (["linux"], ["desktop"], ["server"])
    assert [(p.normalized, p.occurrence) for p in q.phrases] == [("beta build", "excluded")]
    assert [values(getattr(q, f)) for f in ("categories", "content_kinds", "extensions", "media_kinds", "languages", "architectures", "resolutions", "codecs")] == [["software"], ["disk_image"], [".mkv"], ["video"], ["en-us"], ["amd64"], [2160], ["h265"]]
    assert (q.date.low.value, q.date.high.value, q.limit, q.size.low.value, q.size.low.inclusive) == ("2020-01-01", "2023-12-31", 25, 1610612736, True)
    assert (values(q.allow), values(q.deny)) == (["internet_archive"], ["debian"])


@pytest.mark.parametrize("text, low, high", [("size:<1.5KiB", None, (1536, False)), ("max-size:1.25KB", None, (1250, True)), ("min-size:0.5GiB", (536870912, True), None), ("max-size:7EiB", None, (8070450532247928832, True)), ("between 1 GB and 2 GiB", (10**9, True), (2**31, True))])
def test_sizes(text, low, high):
    q = parse(text)
    assert [b and (b.value, b.inclusive) for b in (q.size.low, q.size.high)] == [low, high] and not q.required


@pytest.mark.parametrize("text", ["size:<0.1KiB", "size:<8EiB", f"size:<{'9' * 41}TiB", "size:1GB"])
def test_invalid_sizes_stay_text(text):
    q = parse(text)
    assert codes(q) == ["invalid_size"] and len(q.required) == 1


@pytest.mark.parametrize("text, low, high", [("after:2023", ("2024-01-01", True), None), ("since:2023-06-15", ("2023-06-15", True), None), ("after:2023-06-15", ("2023-06-15", False), None), ("before:2023-06-15", None, ("2023-06-15", False)), ("before 2023", None, ("2022-12-31", True)), ("year:2020", ("2020-01-01", True), ("2020-12-31", True))])
def test_dates(text, low, high):
    q = parse(text)
    assert [b and (b.value, b.inclusive) for b in (q.date.low, q.date.high)] == [low, high]


@pytest.mark.parametrize("text", ["size:>2GiB size:<1GiB", "after:2023 before:2024"])
def test_contradictions(text):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.code == "unsatisfiable" and "range_conflict" in codes(e.value.query)


def test_spans_count_bytes():
    q = parse('α ?β -γ +"quoted phrase" ?"δelta phrase"')
    raw = q.raw.encode()
    assert [raw[c.span.start_byte : c.span.end_byte].decode() for c in (*q.required, *q.optional, *q.excluded, *q.phrases)] == ["α", "?β", "-γ", '+"quoted phrase"', '?"δelta phrase"']


def test_unicode_forms():
    q = parse('ＡＲＭ６４ Straße e\u0301 ＳＩＺＥ:<1GiB "Straße SEE"')
    assert values(q.architectures) == ["arm64"] and words(q.required) == ["strasse", "é"] and words(q.phrases) == ["strasse see"] and q.size.high.value == 2**30


def test_unknown_filters_stay_text():
    q = parse("frobnicate source:unknown codec:madeup lang:not_a_tag")
    assert len(q.required) == 4 and codes(q) == ["invalid_filter", "invalid_filter", "unknown_provider"]
    q = parse("-codec:h265 ?kind:video ?provider:archive")
    assert (len(q.excluded), len(q.optional)) == (1, 2)


def test_ambiguous_words():
    assert codes(parse("4K 03/04/2025")) == ["ambiguous_date", "ambiguous_resolution"]
    for text in ("-video 4k", '-"video" 4k', "?video 4k"):
        assert not parse(text).resolutions and codes(parse(text)) == ["ambiguous_resolution"]
    assert values(parse("4k video").resolutions) == [2160]


def test_conflicts():
    q = parse("provider:archive -provider:archive provider:archive sort:newest sort:oldest sort:smallest")
    assert (values(q.allow), values(q.deny)) == ([], ["internet_archive"])
    assert [(o.field, o.direction) for o in q.order] == [("date", "desc"), ("size", "asc")]
    assert codes(q) == ["order_conflict", "provider_conflict", "provider_conflict"]


@pytest.mark.parametrize("text, code", [("  ", "empty"), ("a" * 4097, "too_long"), (b"\xff", "invalid_utf8"), ("a " * 257, "too_many_tokens")])
def test_rejected(text, code):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.code == code


def test_unclosed_quote():
    q = parse('alpha "unfinished phrase')
    assert words(q.phrases) == ["unfinished phrase"] and codes(q) == ["unclosed_quote"]


def test_limits_languages_and_override():
    q = parse("top 7 results maps in german not from debian")
    assert q.limit == 7 and values(q.languages) == ["de"] and values(q.deny) == ["debian"] and words(q.required) == ["maps"]
    q = override(q, ["archive"], "largest", 3)
    assert values(q.allow) == ["internet_archive"] and not q.deny and q.limit == 3 and ("order", "size desc") in explain(q)
    with pytest.raises(QueryError):
        override(q, ["nowhere"])


def test_quantities():
    assert byte_quantity("1.5GiB") == 1610612736 and byte_quantity("0.1KiB") is None and byte_quantity("5") is None


def test_any_text_parses_the_same_twice_with_spans_inside():
    random.seed(4)
    pool = ["linux", '"a b', '"x"', "-", "+", "?", "size:<1GiB", "after", "2020", "под", "é", "not", "from", "archive", "top", "5", "\u3000", "between", "and", "1", "GB", "4k", "video", "newest", "first", ".iso", "::", "kind:"]
    for _ in range(400):
        text = " ".join(random.choices(pool, k=random.randint(1, 9)))
        try:
            a, b = parse(text), parse(text)
        except QueryError:
            continue
        assert a == b
        for c in (*a.required, *a.optional, *a.excluded, *a.phrases, *a.warnings, *a.order):
            assert 0 <= c.span.start_byte <= c.span.end_byte <= len(text.encode())
