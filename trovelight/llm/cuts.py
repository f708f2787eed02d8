"""Texts cut off by a field limit or in transfer, and how often each source cuts them.

Per source and column the length histograms, in characters and in bytes, are tested for spikes;
values of a spike's length that don't end like a whole text are cut at the limit. Values cut in
transfer lie at no spike. For them the table's own endings tell: which words no title ends with,
and which closing lines and notes end without a sign.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.functions.text import FULL_WIDTH, HALF_WIDTH
from trovelight.session import cut_lineage

# Signs that a text was cut, also as a wrong encoding leaves them.
SIGN = r"(?i)(?:…|\.\.\.|\[(?:more|mehr|suite|más|\.\.\.|…)\]|â€¦|вЂ¦|ΓÇª|‚Ä¶|â\x80¦)\s*$"
#: The end of a sentence, brackets and quotes after it included.
SENTENCE_END = r"[.!?。！？؟]['\"”“»›’)\]*_]*$"
#: A construct that closes: a bracket, a tag, a code fence, a table, a formula, an entity.
CLOSER = r"(?:[)\]}>|$]|```|={3,}|\\[\])])$"
#: A token that is an address, whatever it names.
ADDRESS = r"^(?:(?:https?|ftp|magnet):|www\.)\S+$|^\S+@\S+$"
# The characters Unicode calls White_Space.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_OPEN_SIGN = r"[,;&(\[–-]$"


def _halved(c: Column) -> Column:
    """Full-width forms as ASCII."""
    return F.when(F.octet_length(c) > F.length(c), F.translate(c, FULL_WIDTH, HALF_WIDTH)).otherwise(c)


def spikes(values: DataFrame, least: int = 8, times: float = 3.0, around: int = 8) -> DataFrame:
    """Lengths at which a source's values pile up: ``source``, ``field_name``, ``unit``, ``length``.

    ``values`` holds ``source``, ``field_name`` and of each value ``chars``, ``bytes`` and its hash ``v``. Distinct values count, so a text that is
    often repeated makes no spike. A length is a spike when at least ``least`` values have it and
    they are ``times`` as many as the mean of the ``around`` lengths on either side, the two next
    to it (a space trimmed after the cut) left out, and as each of the two lengths above it: beyond
    a limit values are few. The histogram is one row per length.
    """
    distinct = values.groupBy("source", "field_name", "chars", "bytes", "v").agg(F.lit(1).alias("one"))
    each = distinct.select("source", "field_name", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"))
    count = each.groupBy("source", "field_name", "x.unit", "x.length").agg(F.count("*").alias("n"))
    # each length tells its count to the lengths around it; -d is how far it lies above them
    told = count.select("source", "field_name", "unit", "n", F.explode(F.array(*[F.struct((F.col("length") + d).alias("length"), F.lit(-d).alias("above")) for d in range(-around, around + 1)])).alias("x"))
    near = F.sum(F.when(F.abs("x.above") > 1, F.col("n")).otherwise(0)) / (2 * around - 2)
    level = told.groupBy("source", "field_name", "unit", "x.length").agg(F.sum(F.when(F.col("x.above") == 0, F.col("n")).otherwise(0)).alias("n"), near.alias("mean"), F.coalesce(F.max(F.when(F.col("x.above").between(1, 2), F.col("n"))), F.lit(0)).alias("next"))
    return level.where((F.col("n") >= least) & (F.col("n") >= times * (F.col("mean") + 1)) & (F.col("n") >= times * F.col("next"))).select("source", "field_name", "unit", "length", "n", "mean")


def _word_state(word: Column, context: Column) -> Column:
    """``known`` if the context holds the word, ``begun`` if it holds only longer words that begin so."""
    held = F.split(context, r"[^\p{L}\p{M}\p{N}]+")
    return F.when((word == "") | ~F.contains(context, word), None).when(F.array_contains(held, word), "known").when(F.exists(held, lambda x: F.startswith(x, word)), "begun")


def _learned(judged: DataFrame, least: int, frequent: int) -> DataFrame:
    """What the values' own endings teach: ``table_name``, ``field_name``, ``is_title`` and ``key``.

    For titles, the words that at least ``frequent`` distinct titles hold and fewer than one in
    ``frequent`` of those ends with off the spikes. For texts, the first tokens of last lines of
    which at least ``least`` distinct ones occur and fewer than half end with a sign; repeated notes
    count each time.
    """
    title = F.col("is_title")
    h = F.when(title, 0).when(F.col("note"), F.xxhash64("row_id")).otherwise(F.col("v"))
    distinct = judged.where("NOT sign").groupBy("table_name", "field_name", "is_title", "value", "last", "opener", h.alias("h")).agg(F.bool_and("at_limit").alias("at_limit"), F.bool_or("ended").alias("ended"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    ends = (F.col("last") != "") & ~F.col("at_limit")
    told = F.when(title, F.transform(words, lambda w: F.struct(w.alias("key"), (ends & (w == F.col("last"))).cast("int").alias("hit")))).otherwise(F.array(F.struct(F.col("opener").alias("key"), F.col("ended").cast("int").alias("hit"))))
    total = distinct.select("table_name", "field_name", "is_title", F.explode(told).alias("x")).groupBy("table_name", "field_name", "is_title", "x.key").agg(F.count("*").alias("n"), F.sum("x.hit").alias("hit"))
    kept = F.when(title, (F.col("n") >= frequent) & (F.col("hit") > 0) & (F.col("hit") * frequent < F.col("n"))).otherwise((F.col("n") >= least) & (F.col("hit") * 2 < F.col("n")))
    return total.where(kept).select("table_name", "field_name", "is_title", "key")


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` written, and broadcast if it has at most ``most`` rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut_values(
    tables: Sequence[tuple[str, DataFrame, str, Sequence[str], Sequence[str]]],
    *,
    source_col: str = "provider",
    least: int = 8,
    times: float = 3.0,
    frequent: int = 150,
    note_words: int = 3,
    broadcast_rows: int = 20_000,
) -> DataFrame:
    """Every value with its verdict: ``table_name``, ``row_id``, ``source``, ``field_name`` and ``how``.

    ``tables``: (name, table, id column, title columns, text columns). ``how`` is

    * ``sign``: a mark such as an ellipsis ends it;
    * ``limit``: it has a spike's length and no whole ending;
    * ``open``: off the spikes, it ends as whole values of its field don't;
    * null: a whole value.

    Whole are texts that end a sentence, a bracket or a construct of markup, and those whose last
    line begins like a closing line or note, which the field's values teach (see :func:`_learned`).
    Titles are whole where they end a sentence, bracket or number or a word that the record's texts
    hold in full. Off the spikes a title is open only with evidence: a comma or the like, a bracket
    never closed, a word that titles hold often but don't end with, or a part of a word that the
    record's texts hold in full. Null and blank values have no row. A null source is a source of its
    own. Spikes and learned endings are broadcast up to ``broadcast_rows`` rows, else joined by
    shuffle. Repeated ids are rows of their own; other columns are ignored.
    """
    parts = []
    for name, df, id_col, titles, texts in tables:
        for is_title, fields in ((True, titles), (False, texts)):
            # a title's last word is looked for in the record's texts
            context = F.concat_ws(" ", *[F.col(c) for c in texts]) if is_title and texts else F.lit("")
            parts += [df.select(F.lit(name).alias("table_name"), F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.lit(f).alias("field_name"), F.lit(is_title).alias("is_title"), F.col(f).alias("value"), context.alias("context")) for f in fields]
    values = reduce(DataFrame.unionByName, parts).where(F.col("value").rlike(r"\S"))

    title = F.col("is_title")
    trimmed = values.select("*", F.rtrim(F.col("value"), F.lit(SPACES)).alias("trimmed"))
    tail = trimmed.select("*", F.rtrim(_halved(F.right(F.col("trimmed"), F.lit(240))), F.lit(SPACES)).alias("t"), _halved(F.lower(F.regexp_extract(F.substring_index("trimmed", "\n", -1), r"(\S+)", 1))).alias("token"))
    ended = tail.select("*", F.regexp_extract("t", r"([\p{L}\p{M}]+)$", 1).alias("word"), (F.col("t").rlike(SENTENCE_END) | F.when(title, F.col("t").rlike(r"[)\]]$") | F.col("t").rlike(r"(?:\s\d{1,4}|[–-]\d{4})$")).otherwise(F.col("t").rlike(CLOSER))).alias("ended"))
    held = _halved(F.col("value"))  # brackets may open long before the end
    loose = F.col("t").rlike(_OPEN_SIGN) | (F.length(F.regexp_replace(held, r"[^(\[]", "")) > F.length(F.regexp_replace(held, r"[^)\]]", "")))
    # all that is read of the texts, once
    found = cut_lineage(ended.select(
        "table_name", "row_id", "source", "field_name", "is_title", "ended", F.length("value").alias("chars"), F.octet_length("value").alias("bytes"), F.xxhash64("value").alias("v"),
        F.when(title, F.col("value")).alias("value"), F.col("t").rlike(SIGN).alias("sign"), F.when(title, F.lower("word")).otherwise("").alias("last"), F.when(title, "").when(F.col("token").rlike(ADDRESS), "://").otherwise(F.col("token")).alias("opener"),
        (~title & F.col("value").rlike(rf"^\s*\S+(?:[^\S\n]+\S+){{0,{note_words - 1}}}\s*$")).alias("note"), F.when(title, loose).otherwise(F.lit(False)).alias("loose"),
        F.when(title & ~F.col("ended") & (F.length("word") > 1), _word_state(F.col("word"), F.col("context"))).alias("state"),
    ))
    lengths = _small(spikes(found.where("NOT sign"), least, times).groupBy("source", "field_name").agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"{u}_limits") for u in ("chars", "bytes")]), broadcast_rows)
    at_limit = F.coalesce(F.array_contains("chars_limits", F.col("chars")) | F.array_contains("bytes_limits", F.col("bytes")), F.lit(False))
    judged = found.join(lengths, ["source", "field_name"], "left").withColumn("at_limit", at_limit)
    learned = _small(_learned(judged, least, frequent), broadcast_rows).withColumn("taught", F.lit(True))
    known = judged.withColumn("key", F.when(title, F.col("last")).otherwise(F.col("opener"))).join(learned, ["table_name", "field_name", "is_title", "key"], "left")

    taught = F.col("taught").isNotNull()
    whole = F.when(title, ~taught & (F.col("ended") | (F.coalesce("state", F.lit("")) == "known"))).otherwise(F.col("ended") | taught)
    is_open = F.when(title, taught | F.col("loose") | (F.coalesce("state", F.lit("")) == "begun")).otherwise(F.lit(True))
    how = F.when(F.col("sign"), "sign").when(~whole & F.col("at_limit"), "limit").when(~whole & is_open, "open")
    return known.select("table_name", "row_id", "source", "field_name", how.alias("how"))


def cut_rates(verdicts: DataFrame) -> DataFrame:
    """Per table, source and field: the number of values, of cut ones, and their share."""
    out = verdicts.groupBy("table_name", "source", "field_name").agg(F.count("*").alias("n_values"), F.count("how").alias("n_cut"))
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))
