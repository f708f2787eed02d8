"""Texts that went through a wrong character encoding, found and restored by description length.

Each candidate decoding of a text is compressed with a dictionary of its language; the chain of
decodings with the shortest description, its own cost included, wins, else the text stays.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.functions.facets import identifiers
from trovelight.llm import lookalikes

# Letters beyond ASCII that a language's ordinary spelling uses.
ALPHABETS = {
    "en": "",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "de": "äöüßÄÖÜ",
    "es": "áéíñóúüÁÉÍÑÓÚÜ¿¡",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
}
# Signs that ordinary texts of any language hold.
SIGNS = "–—‘’“”„‚«»‹›…•·°€£§©®™№±×÷²³¹½¼¾µ\xa0\u202f\u2009\xad"
# Encodings a text may have been read with, and those it may have been in.
READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "mac_roman", "koi8-r", "cp866", "iso8859-5", "cp850")
WRITTEN_IN = {
    "cp1252": ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r", "cp866", "iso8859-5"),
    "cp437": ("cp1252", "latin-1", "cp1251", "mac_roman"),
    "mac_roman": ("cp1252", "latin-1", "cp437"),
    "cp1250": ("cp1252", "latin-1"),
    "cp1251": ("cp1252", "latin-1", "koi8-r", "cp866", "iso8859-5", "mac_roman", "cp437", "cp1250"),
    "koi8-r": ("cp1251", "cp1252", "latin-1", "cp866", "iso8859-5"),
    "cp866": ("cp1251", "cp1252", "latin-1", "koi8-r", "cp437"),
    "iso8859-5": ("cp1251", "cp1252", "latin-1", "koi8-r"),
}
_PAIRS = [(e, w) for w, sources in WRITTEN_IN.items() for e in sources]
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")

#: Bytes of description that a decoding step itself costs: into UTF-8, and between one-byte encodings.
UTF8_COST, BYTE_COST = 2.0, 4.0
#: Units of oddness that some word must lose for a stretch of words to be decoded together.
LEAST_GAIN = 2.0
#: Bytes that each unit of an unusual character costs over what the compressor sees.
UNUSUAL_COST = 1.5
#: Bytes of a segment that a dictionary takes from the texts, and what stands before a trained dictionary's segments: the format's repeat offsets.
_SEGMENT, _BEFORE_CONTENT = 512, b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"

fold = functools.lru_cache(maxsize=256)(lookalikes.fold)

_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"([ \t\r\n]+)")
#: A whole word of another script, or a symbol of it, which texts of any language may hold.
_WHOLE_FOREIGN = re.compile(r"[!-@\[-`{-~«»“”„—–…’]*(?:[А-Яа-яЁё]+(?:-[А-Яа-яЁё]+)*|[Α-Ωα-ω]+)[!-@\[-`{-~«»“”„—–…’]*")
#: A sign between two letters of a word.
_INNER = re.compile("(?<=[^\\W\\d_])[\x80-\xa9\xab-\xb9\xbb-\xbf‚„†‡ˆ‰‹•˜™›€∙√≤≥≈∞─-▟](?=[^\\W\\d_])")
#: The first half of a two-byte sequence whose second half is gone.
_LONE = re.compile("(?<=[a-zà-ÿ])[ÃÂ](?![A-ZÀ-Þ\x80-¿])|(?<![^\\W\\d_])[ÃГ](?=[a-z])|(?<=[A-Za-zà-ÿ])Г(?=[a-z ]|$)|(?<=[a-zà-ÿ])[ÐÑ]$")


def _lone(text: str) -> bool:
    return any(c in text for c in "ÃÂÐÑГ") and _LONE.search(text) is not None


@functools.lru_cache(maxsize=16)
def _parts(text: str) -> tuple[list[str], list[int]]:
    """A text's words and the space between, and which of them aren't ASCII."""
    parts = _SPLIT.split(text)
    return parts, [k for k, p in enumerate(parts) if not p.isascii()]


@functools.cache
def _to_byte(encoding: str) -> dict[str, int]:
    """Bytes of an encoding's upper characters; bytes it leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@functools.cache
def _utf8_runs(encoding: str) -> re.Pattern:
    """Runs of characters that are whole UTF-8 sequences when read in ``encoding``."""
    char = {b: re.escape(c) for c, b in _to_byte(encoding).items()}

    def among(a: int, z: int) -> str:
        return "[" + "".join(char[b] for b in range(a, z + 1) if b in char) + "]"

    rest = among(0x80, 0xBF)
    return re.compile(f"(?:{among(0xC2, 0xDF)}{rest}|{among(0xE0, 0xEF)}{rest}{{2}}|{among(0xF0, 0xF4)}{rest}{{3}})+")


@functools.cache
def _recoding(read_as: str, written_in: str) -> dict[int, str]:
    """Translation of upper characters between one-byte encodings."""
    out = {}
    for c, b in _to_byte(read_as).items():
        try:
            out[ord(c)] = bytes([b]).decode(written_in)
        except UnicodeDecodeError:
            out[ord(c)] = "�"
    return out


def _recoded(part: str) -> dict[tuple[str, bool], list[tuple[str, str]]]:
    """What a word becomes by decodings between one-byte encodings, and whether into a Cyrillic one: the pairs that make it."""
    upper = {c for c in part if c > "\x7f"}
    out: dict[tuple[str, bool], list[tuple[str, str]]] = {}
    raw: dict[str, bytes | None] = {}
    for e, w in _PAIRS:
        if e not in raw:
            try:
                raw[e] = part.encode(e)
            except UnicodeEncodeError:  # or it holds bytes that the encoding leaves open
                codes = _to_byte(e)
                raw[e] = bytes(codes[c] if c > "\x7f" else ord(c) for c in part) if upper <= codes.keys() else None
        if raw[e] is not None:
            out.setdefault((raw[e].decode(w, "replace"), w in CYRILLIC), []).append((e, w))
    return out


@functools.cache
def _run_chars(encoding: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters that begin and that continue a UTF-8 sequence read in ``encoding``."""
    codes = _to_byte(encoding)
    return frozenset(c for c, b in codes.items() if b >= 0xC2), frozenset(c for c, b in codes.items() if b < 0xC0)


def _has_run(text: str, chars: frozenset[str], encoding: str) -> bool:
    """Whether the text, whose upper characters are ``chars``, holds a run of UTF-8 sequences."""
    first, rest = _run_chars(encoding)
    return not first.isdisjoint(chars) and not rest.isdisjoint(chars) and _utf8_runs(encoding).search(text) is not None


def _as_utf8(text: str, encoding: str) -> str:
    codes = _to_byte(encoding)

    def one(m: re.Match) -> str:
        try:
            return bytes(codes[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _utf8_runs(encoding).sub(one, text)


@functools.lru_cache(maxsize=200_000)
def _marked(part: str) -> bool:
    """Whether a word holds UTF-8 sequences read in a usual encoding, a sign between letters or an odd shape."""
    chars = frozenset(c for c in part if c > "\x7f")
    if any(_has_run(part, chars, e) for e in ("cp1252", "latin-1", "cp1251", "cp1250")) or _INNER.search(part):
        return True
    return any(_shape(w) for w in _WORD.findall(part) if not w.isascii())


@functools.cache
def _kind(c: str) -> float:
    """How unusual a character outside the language's alphabet is."""
    o = ord(c)
    if c in SIGNS:
        return 0.3
    if o < 0xA0:
        return 4.0
    if 0xC0 <= o <= 0x24F:
        return 1.0 if c.isalpha() else 2.0
    if 0x410 <= o <= 0x44F or c in "Ёё":
        return 1.5
    if 0x1F000 <= o <= 0x1FAFF or o in (0x200D, 0xFE0F):
        return 0.3
    if 0x370 <= o <= 0x52F or 0x2000 <= o <= 0x2BFF:
        return 2.5
    return 3.0 if c == "�" else 6.0


@functools.lru_cache(maxsize=50_000)
def _shape(word: str) -> float:
    """What is odd in a word: letters of two scripts, a capital after a small letter."""
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in word)
    other = sum("Ͱ" <= c <= "Ͽ" or "℀" <= c for c in word)
    odd = min(cyrillic + other, len(word) - cyrillic - other) * 2.0
    return odd + sum(2.0 for a, b in zip(word, word[1:], strict=False) if a.islower() and b.isupper() and not (b.isascii() and a.isascii()))


@dataclass
class Models:
    """Dictionary and alphabet of each language; small, and sent to every task."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    alphabets: dict[str, str] = field(default_factory=dict)

    def ready(self) -> Detector:
        return _detector(tuple(sorted(self.dictionaries.items())), tuple(sorted(self.alphabets.items())))


@functools.lru_cache(maxsize=4)
def _detector(dictionaries: tuple, alphabets: tuple) -> Detector:
    return Detector(dict(dictionaries), dict(alphabets))


class Detector:
    """Chooses the decoding chain of least description length."""

    def __init__(self, dictionaries: dict[str, bytes], alphabets: dict[str, str]):
        import zstandard

        self.alphabets = {k: frozenset(v) for k, v in alphabets.items()} or {"en": frozenset()}
        self.compress = {}
        for lang in self.alphabets:
            raw = dictionaries.get(lang, b"")
            given = zstandard.ZstdCompressionDict(raw) if raw else None  # trained, or plain content where texts were too few
            if given:
                given.precompute_compress(level=3)
            self.compress[lang] = zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.usual = [a | frozenset(SIGNS) | frozenset(map(chr, range(128))) for a in self.alphabets.values()]
        self.letters = frozenset().union(*self.alphabets.values())
        self.least = {lang: self.length("", lang) for lang in self.alphabets}

    @functools.lru_cache(maxsize=200_000)  # noqa: B019 - a detector lives as long as its worker
    def _odd(self, part: str, lang: str) -> float:
        alphabet = self.alphabets[lang]
        ordinary = _WHOLE_FOREIGN.fullmatch(part) is not None
        odd = sum(0.3 if ordinary else _kind(c) for c in part if c > "\x7f" and c not in alphabet) + 2.0 * len(_INNER.findall(part))
        return odd + sum(_shape(w) for w in _WORD.findall(part) if not w.isascii())

    def unusual(self, text: str, lang: str) -> float:
        return sum(self._odd(p, lang) for p in text.split() if not p.isascii())

    def length(self, text: str, lang: str) -> float:
        return len(self.compress[lang](text.encode("utf-8", "surrogatepass"))) + UNUSUAL_COST * self.unusual(text, lang)

    @functools.lru_cache(maxsize=200_000)  # noqa: B019
    def _gains(self, part: str) -> dict[tuple[str, str, str], float]:
        """Bytes that decodings between one-byte encodings save of a word, by its dictionary alone and with its oddness: {(read as, written in, language): bytes}."""
        if fold(part).isascii():
            return {}
        now = {lang: len(self.compress[lang](part.encode("utf-8", "surrogatepass"))) for lang in self.alphabets}
        least, whole = min(now.values()), min(n + UNUSUAL_COST * self._odd(part, lang) for lang, n in now.items())
        out = {}
        for (new, cyrillic), pairs in _recoded(part).items():
            room = (whole - min(self.least.values())) / UNUSUAL_COST  # no description is shorter than that of no text
            if sum(_kind(c) for c in new if c > "\x7f" and c not in self.letters) >= room:
                continue
            for lang in self._langs(cyrillic):
                if (odd := self._odd(new, lang)) < room:
                    size = len(self.compress[lang](new.encode("utf-8", "surrogatepass")))
                    if (gain := min(least - size, whole - size - UNUSUAL_COST * odd)) > 0:
                        out |= {(e, w, lang): gain for e, w in pairs}
        return out

    @functools.lru_cache(maxsize=200_000)  # noqa: B019
    def _losses(self, part: str) -> dict[tuple[str, str, str], float]:
        """Oddness that decodings between one-byte encodings take from a word: {(read as, written in, language): units}."""
        out = {}
        for (new, cyrillic), pairs in _recoded(part).items():
            for lang in self._langs(cyrillic):
                if (lost := self._odd(part, lang) - self._odd(new, lang)) > 0:
                    out |= {(e, w, lang): lost for e, w in pairs}
        return out

    def _savings(self, text: str) -> dict[tuple[str, str, str], dict[int, float]]:
        """The decodings by which words save more than the step costs: {(read as, written in, language): {part: bytes}}."""
        out: dict[tuple[str, str, str], dict[int, float]] = {}
        parts, upper = _parts(text)
        for k in upper:
            for x, gain in self._gains(parts[k]).items():
                out.setdefault(x, {})[k] = gain
        return {x: saved for x, saved in out.items() if sum(saved.values()) > BYTE_COST}

    @functools.lru_cache(maxsize=2)  # noqa: B019
    def _langs(self, cyrillic: bool) -> list[str]:
        return [x for x, a in self.alphabets.items() if ("а" in a) == cyrillic] or list(self.alphabets)

    def clean(self, text: str) -> bool:
        """Whether no candidate needs a look: usual characters only, none in a UTF-8 pattern, and no word that another one-byte encoding describes shorter."""
        chars = frozenset(text)
        if not any(chars <= u for u in self.usual) or _lone(text):
            return False
        parts, upper = _parts(text)  # no sign looks beyond the white space that splits them
        return not any(_marked(parts[k]) for k in upper) and not self._savings(text)

    def _into_utf8(self, text: str) -> Iterator[tuple[list[str], str]]:
        chars = frozenset(c for c in text if c > "\x7f")
        for e in READ_AS:
            if _has_run(text, chars, e):
                once = _as_utf8(text, e)
                yield [f"{e}>utf-8"], once
                for again in ("cp1252", "latin-1", e):  # read wrongly twice
                    if _utf8_runs(again).search(once):
                        yield [f"{e}>utf-8", f"{again}>utf-8"], _as_utf8(once, again)
        if _lone(text):  # the second byte was an invisible character, since lost
            for c in ("í", "à", "Í"):
                yield ["cp1252>utf-8"], _LONE.sub(c, text)

    def _between_bytes(self, text: str) -> Iterator[tuple[str, str, str]]:
        """(step, text, language) of decodings between one-byte encodings that make words less odd or shorter to describe.

        Where a word loses much oddness, made are the words that become less odd; besides, all
        between the first and the last of them, and all. Else made are the words that their
        dictionary describes shorter, one more each time, the largest gain first.
        """
        parts, upper = _parts(text)
        savings = self._savings(text)
        losses: dict[tuple[str, str, str], dict[int, float]] = {}
        for k in upper:
            for x, lost in self._losses(parts[k]).items():
                losses.setdefault(x, {})[k] = lost
        losses = {x: lost for x, lost in losses.items() if max(lost.values()) >= LEAST_GAIN}
        if losses and min(self.unusual(fold(text), x) for x in self.alphabets) < LEAST_GAIN:
            losses = {}
        seen = set()
        for e, w in _PAIRS:
            for lang in self._langs(w in CYRILLIC):
                lost, saved = losses.get((e, w, lang)), savings.get((e, w, lang))
                if not lost and not saved:
                    continue
                codes, table = _to_byte(e), _recoding(e, w)
                able = [k for k in upper if all(c in codes for c in parts[k] if c > "\x7f")]
                new = {k: parts[k].translate(table) for k in able}
                if lost:
                    better = sorted(lost)
                    sets = [better, [k for k in able if better[0] <= k <= better[-1]], able]
                else:
                    shorter = sorted(saved, key=lambda k: (-saved[k], k))
                    sets = [shorter[: n + 1] for n in range(len(shorter))]
                for chosen in map(frozenset, sets):
                    t = "".join(new[k] if k in chosen else p for k, p in enumerate(parts))
                    if (t, lang) not in seen:
                        seen.add((t, lang))
                        yield f"{e}>{w}", t, lang

    def _own(self, text: str, looks: str) -> float:
        return min(self.length(t, lang) for t in {text, looks} for lang in self.alphabets)

    def restore(self, text: str) -> tuple[list[str], str]:
        """The chain of steps, the last encoding error first, and the restored text; ([], text) where nothing is gained.

        What only looks odd, such as a look-alike letter or an invisible character, competes as an
        explanation of its own, free of charge.
        """
        chain: list[str] = []
        while len(chain) < 4 and not text.isascii() and not self.clean(text):
            looks = fold(text)
            if looks.isascii() and not _lone(text):
                break
            best, pick = None, None  # the text's own description is only made once there is another
            for steps, t in self._into_utf8(text):
                best = best if best is not None else self._own(text, looks)
                size = min(self.length(fold(t), x) for x in self.alphabets) + UTF8_COST * len(steps)
                if size < best:
                    best, pick = size, (steps, t)
            for step, t, lang in self._between_bytes(text) if not (pick and self.clean(fold(pick[1]))) else ():
                best = best if best is not None else self._own(text, looks)
                size = self.length(fold(t), lang) + BYTE_COST
                if size < best:
                    best, pick = size, ([step], t)
            if not pick:
                break
            chain += pick[0]
            text = pick[1]
        return chain, text

    def damaged(self, text: str) -> bool:
        """Whether a stretch is lost for good: replacement characters, or half a UTF-8 sequence."""
        return "�" in text or "ï¿½" in text or _lone(text)

    def garbled(self, text: str | None) -> bool:
        return bool(text) and not text.isascii() and (self.damaged(text) or bool(self.restore(text)[0]))


def fit_models(records: DataFrame, *, fields: Sequence[str] = ("title", "description"), lang_col: str = "languages", block_bytes: int = 4_194_304, dictionary_bytes: int = 65_536) -> Models:
    """Dictionaries and alphabets of the languages, from all labelled records.

    Every whole text of the records with one language counts, but for those that show signs of a
    wrong encoding. Texts are placed by their hash in blocks of about ``block_bytes`` bytes of a
    language, so the partitioning doesn't change the result. A task trains a dictionary on a block,
    of each distinct text once; up to 64 of a language are trained on in turn until one is left. The
    driver gets a dictionary of at most ``dictionary_bytes`` and counts of letters of each language.
    A Latin letter joins the alphabet of a language in Latin script when at least one in 300 of its
    texts holds it. Languages without records keep their fixed alphabet and no dictionary; others
    need 300 texts.
    """
    models = Models({k: b"" for k in ALPHABETS}, dict(ALPHABETS))
    lang = F.get(identifiers(F.col(lang_col)), 0)
    one = records.where(F.size(identifiers(F.col(lang_col))) == 1).select(lang.alias("lang"), F.explode(F.array(*fields)).alias("text")).where("text <> ''")
    sizes = one.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = {name: -(-n // block_bytes) for name, _, n in sizes.where(F.col("lang").isin(*ALPHABETS) | (F.col("texts") >= 300)).collect()}
    if not blocks:
        return models
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("texts", pa.int64()), ("letters", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("dictionary", pa.binary())])

    def row(group: pa.Table, texts: int, letters: Counter[str], dictionary: bytes) -> pa.Table:
        return pa.table([[x] for x in (group.column("lang")[0].as_py(), group.column("block")[0].as_py(), texts, list(letters), list(letters.values()), dictionary)], schema=schema)

    def train(group: pa.Table) -> pa.Table:
        held = sorted((t, n) for t, n in zip(group.column("text").to_pylist(), group.column("copies").to_pylist(), strict=True) if not _teaches_wrong(t))
        letters: Counter[str] = Counter()
        for t, n in held:
            for c in () if t.isascii() else set(t):
                if c > "\x7f" and c.isalpha() and _kind(c) == 1.0:
                    letters[c] += n
        return row(group, sum(n for _, n in held), letters, _dictionary([t.encode() for t, _ in held], dictionary_bytes))

    def merge(group: pa.Table) -> pa.Table:
        letters: Counter[str] = Counter()
        for some, counts in zip(group.column("letters").to_pylist(), group.column("counts").to_pylist(), strict=True):
            letters.update(dict(zip(some, counts, strict=True)))
        return row(group, sum(group.column("texts").to_pylist()), letters, _merged(sorted(filter(None, group.column("dictionary").to_pylist())), dictionary_bytes))

    kind = "lang string, block long, texts long, letters array<string>, counts array<long>, dictionary binary"
    of = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    placed = one.withColumn("block", F.pmod(F.xxhash64("text"), F.try_element_at(of, F.col("lang")))).where("block IS NOT NULL")
    copies = placed.repartition("lang", "block").groupBy("lang", "block", "text").agg(F.count("*").alias("copies"))
    trained, most = copies.groupBy("lang", "block").applyInArrow(train, kind), max(blocks.values())
    while most > 1:
        trained = trained.withColumn("block", F.shiftright("block", 6)).groupBy("lang", "block").applyInArrow(merge, kind)
        most = -(-most // 64)
    for name, _, texts, letters, counts, dictionary in trained.collect():
        if name in ALPHABETS or texts >= 300:
            latin = "а" not in ALPHABETS.get(name, "")
            common = {c for c, n in zip(letters, counts, strict=True) if n * 300 >= texts and n >= 5 and latin}
            models.alphabets[name], models.dictionaries[name] = "".join(sorted(set(ALPHABETS.get(name, "")) | common)), bytes(dictionary)
    return models


def _teaches_wrong(text: str) -> bool:
    """Whether a text itself may have been read in a wrong encoding, and so must not enter a dictionary."""
    if text.isascii():
        return False
    if _lone(text):  # it looks beyond spaces, the other signs don't
        return True
    return any((_part_wrong if len(p) < 100 else _part_wrong.__wrapped__)(p) for p in text.split(" ") if not p.isascii())


@functools.lru_cache(maxsize=50_000)
def _part_wrong(part: str) -> bool:
    if "\ufffd" in part or any("\x80" <= c < "\xa0" or "\u2500" <= c <= "\u259f" for c in part) or _INNER.search(part) or any(_shape(w) for w in _WORD.findall(part)):
        return True
    chars = frozenset(c for c in part if c > "\x7f")
    for e in READ_AS:
        for m in _utf8_runs(e).finditer(part) if _has_run(part, chars, e) else ():
            if (t := _as_utf8(m.group(), e)) != m.group() and all(c.isascii() or _kind(c) <= 1.5 for c in t):
                return True
    return False


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard

    pieces = [t[i : i + 65_536] for t in texts for i in range(0, len(t), 65_536)]  # the trainer counts the first 128 KB of a piece
    try:  # with neither k nor a split point it would leave out the last quarter
        return zstandard.train_dictionary(size, pieces, k=_SEGMENT, d=8, split_point=1.0, level=3).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: they are the dictionary
        return b"\n".join(pieces)[-size:]


def _merged(dictionaries: list[bytes], size: int) -> bytes:
    """One dictionary trained on the segments of several."""
    if len(dictionaries) < 2:
        return b"".join(dictionaries)
    held = [d.partition(_BEFORE_CONTENT)[2] or d for d in dictionaries]
    return _dictionary([c[max(0, i - _SEGMENT) : i] for c in held for i in range(len(c), 0, -_SEGMENT)], size)


def repair(records: DataFrame, models: Models, *, id_col: str = "record_id", fields: Sequence[str] = ("title", "description"), changed_only: bool = True) -> DataFrame:
    """Garbled fields: ``id_col``, ``field_name``, ``chain``, ``raw``, ``restored`` and ``lost``.

    ``chain`` holds the decoding steps taken, empty where the text can't be restored; ``lost``
    tells whether characters are gone for good. Only garbled fields come out unless
    ``changed_only`` is false. Null, empty and pure ASCII texts are never garbled. Repeated ids are
    separate rows; other columns are ignored. Narrow: no shuffle, whole texts.
    """
    kind = records.select(id_col).schema[0]
    schema = T.StructType([kind, T.StructField("field_name", T.StringType()), T.StructField("chain", T.ArrayType(T.StringType())), T.StructField("raw", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("lost", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = models.ready()
        for batch in batches:
            ids, out = batch.column(0), []
            for k, name in enumerate(fields):
                column = batch.column(1 + k).to_pylist()
                for i, text in enumerate(column):
                    if text is None or (changed_only and text.isascii()):
                        continue
                    chain, restored = detector.restore(text)
                    lost = detector.damaged(text) or "�" in restored
                    if chain or lost or not changed_only:
                        out.append((ids[i].as_py(), name, chain, text, restored, lost))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_()), strict=True)], names=schema.names)

    return records.select(id_col, *fields).mapInArrow(run, schema)
