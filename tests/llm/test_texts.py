"""Glyph forms, encodings, markup, cut texts and tokens, on small tables and by round trips."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trovelight.llm import cuts, glyphs, lookalikes, markup, mojibake, tokens
from trovelight.llm.markup_text import convert

RECORD = "record_id long, title string, description string, extra int"


def fields(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# one form


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "Ｓｕｒｖｅｙ of maps", "plain"), (2, "Cafe\u0301", "Do\u200bsages"), (3, "p\u0430tients", "a\u00a0b"), (4, "non\u2011breaking", "\ufb01nd co\ufb06"), (5, "Школьныe карты", None),
        (6, "whole слово in another script", "β phase – 40 km² … “quoted”"), (7, "emoji 👩\u200d🔬 ☀\ufe0f and 👨\u200d👩\u200d👧", "№ 5 ™"), (8, "", None), (8, "x\ufeff", "x" * 50_000 + "\u200d"),
    ]
    return spark.createDataFrame([(*r, 0) for r in rows], RECORD)


def test_consistent_form(odd):
    got = {(r.record_id, r.field_name, r.raw[:20]): r.unified for r in glyphs.unify(odd).collect()}
    assert {k[:2] for k in got} == {(1, "title"), (2, "title"), (2, "description"), (3, "title"), (3, "description"), (4, "title"), (4, "description"), (5, "title"), (8, "title"), (8, "description")}
    by = {k[:2]: v for k, v in got.items()}
    assert (by[1, "title"], by[2, "title"], by[2, "description"], by[3, "title"], by[3, "description"]) == ("Survey of maps", "Café", "Dosages", "patients", "a b")
    assert (by[4, "title"], by[4, "description"], by[5, "title"], by[8, "title"]) == ("non-breaking", "find cost", "Школьные карты", "x") and by[8, "description"] == "x" * 50_000


def test_form_is_stable_and_keeps_every_row(odd, spark):
    every = glyphs.unify(odd, changed_only=False)
    assert every.count() == 16
    again = glyphs.unify(every.selectExpr("record_id", "unified AS title", "CAST(NULL AS string) AS description"))
    assert again.count() == 0
    assert glyphs.unify(odd.limit(0)).count() == 0


def test_forms_of_other_scripts(spark):
    rows = [(1, "\ufefb \ufe8d\ufedf", "\u2460 \u24d0 \u3371 \u3392"), (2, "\ufb2a\ufb4f", "\ufdfa")]
    df = spark.createDataFrame([(*r, 0) for r in rows], RECORD)
    got = {(r.record_id, r.field_name): r.unified for r in glyphs.unify(df).collect()}
    assert got == {(1, "title"): "\u0644\u0627 \u0627\u0644", (1, "description"): "1 a hPa MHz", (2, "title"): "\u05e9\u05c1\u05d0\u05dc", (2, "description"): "\u0635\u0644\u0649 \u0627\u0644\u0644\u0647 \u0639\u0644\u064a\u0647 \u0648\u0633\u0644\u0645"}


def test_python_fold_agrees_with_sql(odd):
    for r in glyphs.unify(odd, changed_only=False).collect():
        if r.record_id != 7:
            assert lookalikes.fold(r.raw) == r.unified


# encodings


TEXTS = {
    "en": ["The provider refreshed the catalogue – nothing was filled in", "Students wrote summaries of libraries for the reader", "What remains of the measurements is stored"],
    "fr": ["Les élèves ont résumé les pages sur les caméras", "Une deuxième copie des côtes a été numérisée", "L’équipe a préparé les télescopes pour l’école"],
    "de": ["Für Gesetze und Verträge wurde jede Seite einzeln geprüft", "Größere Lücken sind seit langem bekannt", "Später wurden die Übersetzer nachträglich überarbeitet"],
    "es": ["También se añadió una guía sobre partículas", "Más de mil páginas aparecen en la última versión", "El número y su año según la región"],
    "ru": ["Новые наблюдения добавлены позже", "Все снимки проверены вручную", "Здесь хранятся каталоги и таблицы из местного архива"],
}


@pytest.fixture(scope="module")
def models(spark):
    rows = [(k * 10 + n, t, None, [lang]) for k, (lang, held) in enumerate(TEXTS.items()) for n, t in enumerate(held)] + [(99, None, None, None)]
    return mojibake.fit_models(spark.createDataFrame(rows, "record_id long, title string, description string, languages array<string>"))


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp866", "cp1251")]


@pytest.mark.parametrize("written, read", CHAINS)
def test_round_trip(models, written, read):
    detector, tried, restored = models.ready(), 0, 0
    for lang, held in TEXTS.items():
        for text in held:
            try:
                bad = text.encode(written).decode(read)
            except UnicodeError:
                continue
            if sum(a != b for a, b in zip(bad, text)) > (lang == "en") and (lang == "ru") == (written in ("cp1251", "cp866") or (written == "utf-8" and lang == "ru")):
                tried += 1
                assert detector.garbled(bad), (bad, text)
                restored += detector.restore(bad)[1] == text
    assert tried and restored >= 0.8 * tried


def test_twice_and_partly(models):
    detector = models.ready()
    text = "Les élèves ont résumé les pages"
    assert detector.restore(text.encode().decode("cp1252").encode().decode("cp1252"))[1] == text
    assert detector.restore("Une côte a été numÃ©risÃ©e près de là")[1] == "Une côte a été numérisée près de là"


@pytest.mark.parametrize("written, read", [("cp1251", "koi8-r"), ("koi8-r", "cp1251")])
def test_small_words_read_as_capitals(models, written, read):
    """Such a word holds letters of the same alphabet only, and no small letter before a capital."""
    detector = models.ready()
    for word in ("наблюдения", "снимки", "каталоги", "таблицы"):
        bad = word.encode(written).decode(read)
        assert bad.isupper() and detector.restore(f"{bad} 1955") == ([f"{read}>{written}"], f"{word} 1955")
        assert not detector.garbled(f"{word.upper()} 1955") and not detector.garbled(f"{word} США")


def test_not_garbled(models):
    detector = models.ready()
    for text in ("", None, "plain", *(t for held in TEXTS.values() for t in held), "The label reads AÇÃO E SÃO", "p\u0430tients", "The β phase and the α line", "10 € ± 2 €", "\ufb01nd", "Straße, naïve and coöperate", "👩\u200d🔬"):
        assert not detector.garbled(text), text


def test_lost_characters_and_rows(models, spark):
    df = spark.createDataFrame([(1, "Antr\ufffdge", None, 0), (1, "fÃ¼r", "ok", 0), (2, None, "", 0), (3, "é" * 30_000, "x", 0)], RECORD)
    got = mojibake.repair(df, models)
    assert fields(got, "record_id", "field_name", "restored", "lost") == [(1, "title", "Antr\ufffdge", True), (1, "title", "für", False)]
    assert mojibake.repair(df.limit(0), models).count() == 0 and mojibake.repair(df, mojibake.Models()).count() >= 1


# models of whole tables


RARE = "Czêœæ s³ów\u00a0kart"  # cp1250 read as cp1252; without the language's dictionary only odd signs


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """40,000 labelled records, of which 310, over the whole table, are in a language without a fixed alphabet."""
    rare = "CASE WHEN id < 310 THEN concat('Część słów ułożona została według żółtych kart numer ', id) WHEN id = 310 THEN '" + RARE + "' ELSE concat('Plain record ', id) END"
    df = spark.range(40_000).selectExpr("id AS record_id", f"{rare} AS title", "CAST(NULL AS string) AS description", "array(CASE WHEN id < 310 THEN 'pl' ELSE 'en' END) AS languages")
    df.write.parquet(str((folder := tmp_path_factory.mktemp("many")) / "records.parquet"))
    return str(folder)


def test_garbled_fields_are_told_by_models_of_the_whole_table(spark, many):
    """A sample of 20,000 records holds too few texts of the language, and the field would count as a variant."""
    from trovelight.llm import queries

    assert RARE in {r.raw for r in glyphs.unify(spark.read.parquet(f"{many}/records.parquet")).collect()}
    assert (310, "title") not in fields(queries.p1_found(spark, many), "record_id", "field_name")


def test_language_of_few_texts_among_many(spark, many):
    from trovelight.llm import queries

    assert fields(queries.p3_found(spark, many), "record_id", "field_name") == [(310, "title")]


def test_long_and_last_texts_are_trained_on(spark):
    rows = [(f"a{k} plain catalogue of measurements number {k * 7919 % 10007}", ["en"]) for k in range(6000)] + [(f"z{k} quixotic flumes", ["en"]) for k in range(1500)] + [("zymurgical vessels " * 500, ["en"])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "record_id long, title string, languages array<string>")
    learned = mojibake.fit_models(df, fields=["title"], dictionary_bytes=16_384).dictionaries["en"]
    assert b"quixotic flumes" in learned and b"zymurgical vessels" in learned and len(learned) <= 16_384


def test_models_of_many_blocks(spark):
    """Counts over all blocks are exact, and the partitioning doesn't matter."""
    rows = [(f"Relatório das estações de medição número {k}", ["pt"]) for k in range(310)] + [(f"Text {k} of plain measurements {k * 7919 % 10007}", ["en"]) for k in range(2500)]
    df = spark.createDataFrame(rows, "title string, languages array<string>")
    one = mojibake.fit_models(df.repartition(2), fields=["title"], block_bytes=1000)
    assert one == mojibake.fit_models(df.repartition(7), fields=["title"], block_bytes=1000)
    assert set("ãçõóú") <= set(one.alphabets["pt"]) and "medição".encode() in one.dictionaries["pt"] and b"plain measurements" in one.dictionaries["en"]
    assert "pt" not in mojibake.fit_models(df.where("title NOT LIKE '%número 1%'"), fields=["title"], block_bytes=1000).alphabets


# markup


MARKED = {
    "<h2>Title</h2>\n<p>Some <b>bold</b> text.</p><ul><li>one</li><li>two</li></ul>": "## Title\n\nSome bold text.\n\n- one\n- two",
    "R&eacute;sum&#xE9; &amp; more": "Résumé & more",
    "&lt;p&gt;twice&lt;/p&gt;": "twice",
    "# Head\n\nA **strong** `code` [link](https://a.example/x).": "# Head\n\nA strong `code` link.",
    "Title\n=====\n\n1. one\n2. two": "# Title\n\n1. one\n2. two",
    "== Head ==\n'''Bold''' [[Page|words]] [[Category:X]]\n* item": "## Head\n\nBold words\n- item",
    "\\section{Head}\nIn \\textbf{bold}~\\cite{a} with $x_{1}^2$.": "# Head\n\nIn bold with $x_{1}^2$.",
    "<pre><code>run --all</code></pre>": "```\nrun --all\n```",
    "Text \\(n \\ge 2\\) here": "Text $n \\ge 2$ here",
    "cut off <p class=\"le": "cut off",
    '<pre>&lt;div class="x"&gt;hi&lt;/div&gt;</pre>': '```\n<div class="x">hi</div>\n```',
    "```\nprint('<b>')  # &amp;\n```": "```\nprint('<b>')  # &amp;\n```",
    "```py\nif a:\n    b()": "```\nif a:\n    b()\n```",
    "5 &lt;b 6 and the end": "5 <b 6 and the end",
    "Use the &lt;div&gt; tag": "Use the <div> tag",
    "<p>a &amp;lt; b</p>": "a &lt; b",
    "\\textbf{a \\emph{b} c}": "a b c",
    "{\\bf a {b}} and\\footnote{see \\emph{x}}": "a b and (see x)",
    "{{Infobox|a={{nested|x}}|b=2}}": "a: x; b: 2",
    "[[File:x.png|thumb|A [[word|label]] here]]": "A label here",
    "'''a ''b'' c'''": "a b c",
    "{|\n! a !! b\n|-\n| style=\"x\" | 1 || 2\n|}": "a | b\n1 | 2",
    "* a\n** b\n* c": "- a\n  - b\n- c",
    "[https://a.example/x label] text\n# one\n# two": "label text\n1. one\n2. two",
    "<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>": "- a\n  1. b\n  2. c\n- d",
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>": "a | b\n1 | 2",
    "- a\n  - b\n    - c\n- d": "- a\n  - b\n    - c\n- d",
    "\\begin{itemize}\\item a\\begin{enumerate}\\item b\\end{enumerate}\\item c\\end{itemize}": "- a\n  1. b\n- c",
    "\\begin{equation}a_{1} < b\\end{equation}": "$a_{1} < b$",
    "na\\\"{\\i}ve caf\\'e": "naïve café",
    "[![alt](i.png)](https://a.example/x \"t\") **a *b* c**": "alt a b c",
    "\ue1000\ue101 &amp; <b>x</b>": "\ue1000\ue101 & x",
}


@pytest.mark.parametrize("raw, clean", MARKED.items())
def test_markup(raw, clean):
    kinds, got = convert(raw)
    assert kinds and got == clean


@pytest.mark.parametrize("raw", [r for r in MARKED if "lt;" not in r and "```" not in r])
def test_clean_text_stays_clean(raw):
    once = convert(raw)[1]
    assert convert(once)[1] == once and not set(convert(once)[0]) & {"html", "entity", "wiki"}


@pytest.mark.parametrize("sign", ["{{", "[[", "<b", "<p '", "$", "**a ", "__b ", "\\textbf{", "''", "&lt;", "`", "<code>", "|", "\ue1007\ue101", "# ", "$_"])
def test_odd_texts_end(sign):
    """Repeated signs, unclosed or nested without end, take time in proportion."""
    began = time.perf_counter()
    kinds, got = convert(sign * 20_000)
    assert time.perf_counter() - began < 10 and isinstance(got, str)


@pytest.mark.parametrize("text", ["size < 5 MB or > 900 MB", "Price was $20 to $35 per box, #3 sold out", "See note [4] and the remark (page 12) [more]", "user_name_v2, and 5 * 3 * 2", "https://a.example/list?x=1&y=2", "R&D notes use C# and F#", "The set {a, b} is 50% of it", "a -> b means next, x^2 is a square", "Keywords: field_work, maps", "for 3 <b and c> 4", "5 <b 6", "#1 and #2\n#3", "", None])
def test_no_markup(text):
    assert convert(text) == ([], (text or "").strip())


def test_cover_against_brute_force():
    random.seed(3)
    import numpy as np

    for _ in range(30):
        streams = [[random.randint(0, 2) for _ in range(random.randint(0, 25))] for _ in range(6)]
        length, pages = 4, 3
        seen: dict[tuple, set] = {}
        for p, s in enumerate(streams):
            for i in range(len(s) - length + 1):
                seen.setdefault(tuple(s[i : i + length]), set()).add(p)
        want = [any(i - d >= 0 and i - d + length <= len(s) and len(seen[tuple(s[i - d : i - d + length])]) >= pages for d in range(length)) for s in streams for i in range(len(s))]
        got = markup.repeated_cover(np.array([t for s in streams for t in s], np.int64), np.repeat(np.arange(6), [len(s) for s in streams]), length, pages)
        assert got.tolist() == want


def test_boilerplate(spark):
    footer = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"Page {k} says <b>{k * 7}</b>. {footer}", f"https://{'a' if k < 4 else 'b'}.example/{k}", "p") for k in range(5)] + [(9, None, None, None), (9, "", None, "p")]
    df = spark.createDataFrame(rows, "record_id long, description string, details_url string, provider string")
    got = {(r.record_id, r.clean is None): r for r in markup.clean_markup(df, pages=3).collect()}
    assert len(got) == 7 and got[0, False].unique_text == "Page 0 says 0" and got[0, False].removed == 41 and got[4, False].removed == 0
    assert got[9, True].kinds == [] and got[9, False].clean == "" and got[1, False].kinds == ["html"]
    assert markup.clean_markup(df.limit(0)).count() == 0
    split = markup.clean_markup(df, shard_pages=2)
    assert sorted(r.record_id for r in split.collect()) == sorted(r[0] for r in rows)


@pytest.mark.parametrize("limits", [{"shard_pages": 2}, {"shard_chars": 300}, {"shard_pages": 3, "broadcast_hosts": 0}])
def test_boilerplate_of_split_hosts(spark, limits):
    """Pages of a host that meet in no shard share their boilerplate all the same."""
    notes = [" ".join(f"{w}{k}" for k in range(36)) for w in "abcde"]
    rows = [(k, f"Page {k} says {k * 7}. {notes[k % 5]} <b>end</b> {k}", f"https://{'a' if k < 13 else 'b'}.example/{k}", "p") for k in range(16)] + [(3, None, "https://a.example/x", "p"), (4, "", "https://a.example/y", "p")]
    rows += [(0, rows[0][1], rows[0][2], "p")]
    df = spark.createDataFrame(rows, "record_id long, description string, details_url string, provider string")
    want, got = markup.clean_markup(df).collect(), markup.clean_markup(df, **limits).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r.removed > 0 for r in want) == 10


# cut texts


def test_cut_values(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, "a", "Title " + str(1900 + k), long(rng.randint(5, 40)) + ".") for k in range(60)]
    rows += [(100 + k, "a", "Whole title", (long(40) + ".")[:80]) for k in range(20)]
    rows += [(200, "b", "A guide to", "Ends. Keywords: a, b"), (201, "b", "Cut tit…", "First.\nContact: the desk"), (202, "b", "Maps (19", "Text.\nhttps://a.example/list"), (203, None, None, " "), (204, "b", "Charter of colle", "The collection [more]")]
    # what the table's own values teach: words that no title ends with, closing lines and notes
    rows += [(300 + k, "c", f"A guide to maps of {1000 + k}", f"One text.\nContact: the {k} desk") for k in range(160)] + [(500 + k, "c", None, f"Text {k}.\nhttps://a.example/{k}") for k in range(9)] + [(600 + k, "c", None, "mirror copy") for k in range(9)]
    rows += [(700, "c", None, "Text 1.\nThe mirror copy and"), (701, "c", "The desk", "A text of three words here")]
    df = spark.createDataFrame(rows, "record_id long, provider string, title string, description string")
    got = {(r.row_id, r.field_name): r.how for r in cuts.cut_values([("records", df, "record_id", ("title",), ("description",))]).collect()}
    assert all(got[k, "description"] is None for k in (*range(300, 460), *range(500, 509), *range(600, 609))) and got[700, "description"] == got[701, "description"] == "open" and got[701, "title"] is None
    cut = [k for k in range(100, 120) if not dict((r[0], r[3]) for r in rows)[k].endswith(".")]
    assert cut and all(got[k, "description"] == "limit" for k in cut) and all(got[k, "description"] is None for k in range(60))
    assert [got[200, "title"], got[201, "title"], got[202, "title"], got[204, "title"], got[204, "description"]] == ["open", "sign", "open", "open", "sign"]
    assert got[201, "description"] is None and got[202, "description"] is None and (203, "title") not in got and (203, "description") not in got
    rates = cuts.cut_rates(cuts.cut_values([("records", df, "record_id", ("title",), ("description",))])).where("source = 'b' AND field_name = 'title'").first()
    assert (rates.n_values, rates.n_cut, rates.share) == (4, 4, 1.0)
    assert cuts.cut_values([("records", df.limit(0), "record_id", ("title",), ("description",))]).count() == 0


def test_endings_of_long_last_lines(spark):
    """A last line, and a title's brackets, are read whole, however long."""
    words = ", ".join(f"word{k}" for k in range(60))
    half = "and so it goes on " * 13
    rows = [(10 + k, "p", None, f"Line.\nKeywords: a{k}") for k in range(8)] + [(1, "p", "A note", f"First line.\nKeywords: {words}"), (2, "p", "A note", f"This is one (long) line that was cut and holds, far on, {words[:30]}, xlabel: {half}"[:-1] + " nowher"), (3, "p", f"Open (list {'of maps ' * 40}and views", "Done."), (4, "p", f"List (maps {'of towns ' * 40}) 1955", "Done.")]
    df = spark.createDataFrame(rows, "record_id long, provider string, title string, description string")
    got = {(r.row_id, r.field_name): r.how for r in cuts.cut_values([("records", df, "record_id", ["title"], ["description"])]).collect()}
    assert got[1, "description"] is None and got[2, "description"] == "open" and got[3, "title"] == "open" and got[4, "title"] is None


# tokens


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_pieces_keep_the_ids(text):
    whole = tokens._id_lists([text], tokens.RANK_FILE, tokens.PATTERN, 10**9)
    assert whole == tokens._id_lists([text], tokens.RANK_FILE, tokens.PATTERN, 5) and "".join(tokens.pieces(text, 5)) == text


def test_encoding_tables(spark):
    texts = [None, "", "<|endoftext|>", "naïve 👩\u200d🔬", "a b " * 20_000, "x" * 5_000, "  \n\n end", "naïve 👩\u200d🔬"]
    df = spark.createDataFrame([(k % 7, t, "ids") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = tokens.encode_corpus(df, piece_chars=1000)
    rows = got.collect()
    assert len(rows) == len(texts) and sum(r.ids == [] for r in rows) == 2 and max(max(r.ids, default=0) for r in rows) < 50_256
    back = tokens.decode_corpus(got).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((k % 7, t or "") for k, t in enumerate(texts))
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_ids_equal_the_published_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(re.sub(r"\.tiktoken$", ".json", tokens.RANK_FILE))
    t.encode_special_tokens = True
    texts = ["We don’t claim it's 42.5%!", "Größere  Lücken\n\n\tsind", "Новые 字符 👍🏽", "<|endoftext|> x'll"]
    assert tokens._id_lists(texts, tokens.RANK_FILE, tokens.PATTERN, 4).to_pylist() == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
