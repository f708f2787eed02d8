"""One consistent form for texts that look the same but are written with different characters.

The work is SQL that DuckDB runs over each Arrow batch inside the task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trovelight.llm import lookalikes as L
from trovelight.llm.mojibake import Models

_HOLD = "\ue000"  # stands for a joiner inside an emoji while the others go


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(what: str, table: dict[str, str]) -> str:
    one = {a: b for a, b in table.items() if len(a) == 1 and len(b) == 1}
    return f"translate({what}, {_quote(''.join(one))}, {_quote(''.join(one.values()))})"


@functools.cache
def _cleaned_sql(t: str) -> str:
    """Joiners and selectors inside emoji held, other invisible characters gone, spaces and hyphens ordinary."""
    held = t
    for _ in range(2):  # the matches of one pass can't overlap
        held = f"regexp_replace({held}, '([{L.EMOJI}\ufe0f\U0001f3fb-\U0001f3ff])\u200d([{L.EMOJI}])', '\\1{_HOLD}\\2', 'g')"
    held = f"regexp_replace({held}, '([{L.EMOJI}#*0-9©®])\ufe0f', '\\1\ue001', 'g')"
    joined = f"CASE WHEN regexp_matches({t}, '[\u200d\ufe0f]') THEN {held} ELSE {t} END"
    plain = f"regexp_replace({joined}, '[{L.INVISIBLE}]', '', 'g')"
    plain = f"regexp_replace(regexp_replace({plain}, '[{L.SPACES}]', ' ', 'g'), '[{L.HYPHENS}]', '-', 'g')"
    return f"translate({plain}, '{_HOLD}\ue001', '\u200d\ufe0f')"


@functools.cache
def _spelled_sql(t: str) -> str:
    """Forms that stand for several characters spelled out, where a text holds any."""
    many = {a: b for a, b in L.compatibility_forms().items() if len(b) > 1}
    forms = f"map(regexp_extract_all({_quote(''.join(many))}, '(?s).'), string_split({_quote(chr(1).join(many.values()))}, chr(1)))"
    each = f"array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda c: coalesce({forms}[c], c)), '')"
    return f"CASE WHEN regexp_matches({t}, {_quote('[' + ''.join(many) + ']')}) THEN {each} ELSE {t} END"


@functools.cache
def _one_script_sql(column: str) -> str:
    mixed = f"[{L.LATIN}][{L.FOREIGN}]|[{L.FOREIGN}][{L.LATIN}]"
    word = f"CASE WHEN NOT regexp_matches(w, '{mixed}') THEN w WHEN 2 * len(regexp_extract_all(w, '[{L.LATIN}]')) >= length(w) THEN {_translate('w', L.TO_LATIN)} ELSE {_translate('w', L.TO_CYRILLIC)} END"
    words = f"array_to_string(list_transform(regexp_extract_all({column}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: {word}), '')"
    return f"CASE WHEN regexp_matches({column}, '{mixed}') THEN {words} ELSE {column} END"


@functools.cache
def _batch_sql(fields: tuple[str, ...], every: bool) -> str:
    rows = " UNION ALL ".join(f"SELECT place, {_quote(f)} AS field_name, c{k} AS raw FROM batch WHERE c{k} IS NOT NULL" + ("" if every else f" AND length(c{k}) <> strlen(c{k})") for k, f in enumerate(fields))
    cleaned = f"SELECT *, {_cleaned_sql('raw')} AS cleaned FROM ({rows})"
    spelled = f"SELECT *, {_spelled_sql('cleaned')} AS spelled FROM ({cleaned})"
    plain = f"SELECT *, nfc_normalize({_translate('spelled', L.compatibility_forms())}) AS plain FROM ({spelled})"
    done = f"SELECT place, field_name, raw, {_one_script_sql('plain')} AS unified FROM ({plain})"
    return f"SELECT * FROM ({done})" + ("" if every else " WHERE unified <> raw")


def unify(records: DataFrame, *, id_col: str = "record_id", fields: Sequence[str] = ("title", "description"), garbled: Models | None = None, changed_only: bool = True) -> DataFrame:
    """Fields in their consistent form: ``id_col``, ``field_name``, ``raw`` and ``unified``.

    Only fields whose form changes come out unless ``changed_only`` is false, when all but null
    ones do. ``garbled``: language models; fields that a wrong encoding garbled are then left out of
    the changed ones, as their odd characters are no variants. Null, empty and ASCII texts don't
    change. Repeated ids are separate rows; other columns are ignored. Narrow: no shuffle, whole
    texts; DuckDB gets one thread and one batch at a time.
    """
    kind = records.select(id_col).schema[0]
    schema = T.StructType([kind, *[T.StructField(c, T.StringType()) for c in ("field_name", "raw", "unified")]])
    fields = tuple(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as db:
            for big in batches:
                for at in range(0, big.num_rows, 5_000):
                    part = big.slice(at, 5_000)
                    db.register("batch", pa.table([pa.array(range(part.num_rows)), *part.columns[1:]], names=["place", *[f"c{k}" for k in range(len(fields))]]))
                    got = db.sql(_batch_sql(fields, not changed_only)).to_arrow_table()
                    db.unregister("batch")
                    if garbled and changed_only and got.num_rows:
                        detector = garbled.ready()
                        got = got.filter(pa.array([not detector.garbled(x) for x in got.column("raw").to_pylist()]))
                    got = got.combine_chunks()
                    ids = part.column(0).take(got.column("place").combine_chunks().cast(pa.int64()))
                    for b in pa.table([ids, *[got.column(c).cast(pa.string()) for c in schema.names[1:]]], names=schema.names).to_batches():
                        yield b

    return records.select(id_col, *fields).mapInArrow(run, schema)
