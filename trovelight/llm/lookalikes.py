"""Characters that look like others or vanish beside them, and what they stand for.

The tables come from rules over Unicode's own data, but for the look-alike letters, which are
listed. Both the SQL of :mod:`glyphs` and the encoding repair read them.
"""

from __future__ import annotations

import functools
import re
import unicodedata

# Letters of other scripts (or unusual ones) that look like a Latin letter.
TO_LATIN = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "ё": "ë", "Ё": "Ë", "Н": "H", "һ": "h", "Һ": "H", "і": "i", "І": "I", "ї": "ï", "Ї": "Ï",
    "ј": "j", "Ј": "J", "К": "K", "к": "k", "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S", "Т": "T", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "Х": "X", "у": "y", "У": "Y", "ү": "y", "Ү": "Y",
    "α": "a", "Α": "A", "Β": "B", "ϲ": "c", "Ε": "E", "Η": "H", "ι": "i", "Ι": "I", "ϳ": "j", "κ": "k", "Κ": "K", "Μ": "M", "Ν": "N", "ν": "v", "ο": "o", "Ο": "O", "σ": "o", "ρ": "p", "Ρ": "P", "Τ": "T", "τ": "t", "υ": "u", "χ": "x", "Χ": "X", "Υ": "Y", "γ": "y", "Ζ": "Z",
    "օ": "o", "Օ": "O", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ѡ": "w", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ꓲ": "I",
}
# Latin and other letters that look like a Cyrillic letter.
TO_CYRILLIC = {
    "a": "а", "A": "А", "B": "В", "c": "с", "C": "С", "e": "е", "E": "Е", "ë": "ё", "Ë": "Ё", "H": "Н", "K": "К", "k": "к", "M": "М", "m": "м", "o": "о", "O": "О", "p": "р", "P": "Р", "T": "Т", "t": "т", "x": "х", "X": "Х", "y": "у", "Y": "У", "n": "п", "r": "г", "u": "и",
    "α": "а", "Α": "А", "Β": "В", "ο": "о", "Ο": "О", "ρ": "р", "Ρ": "Р", "ϲ": "с", "Ε": "Е", "Η": "Н", "Κ": "К", "Μ": "М", "Τ": "Т", "Χ": "Х", "χ": "х", "օ": "о", "ɑ": "а",
}

MARKS = "\u0300-\u036f\u1ab0-᫿\u1dc0-\u1dff\u20d0-⃿\ufe20-\ufe2f"
INVISIBLE = "\u00ad\u034f\u061cᅟᅠ\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206fㅤ\ufe00-\ufe0f\ufeffﾠ"
SPACES = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HYPHENS = "‐‑֊⁃﹣－"
EMOJI = "‼-⁉←-⇿⌀-⏿☀-➿⬀-⯿\U0001f000-\U0001faff"
LATIN, FOREIGN = r"A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", r"Ͱ-Ͽἀ-῿Ѐ-ԯԱ-֏ɑɡɩꓲ"
#: Blocks whose compatibility forms stand for plain characters: widths, ligatures, styled letters, Roman numerals,
#: Hebrew and Arabic presentation forms, enclosed letters and numbers, East Asian squares.
FORMS = (
    (0xFF01, 0xFF9F), (0xFFA1, 0xFFDC), (0xFFE0, 0xFFEE), (0xFE50, 0xFE6B), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x1D400, 0x1D7FF), (0x2160, 0x217F), (0x0132, 0x0133), (0x01C4, 0x01CC),
    (0xFB1D, 0xFB4F), (0xFB50, 0xFDFC), (0xFE70, 0xFEFC), (0x2460, 0x24FF), (0x3200, 0x33FF),
)


def expand(ranges: str) -> str:
    """Every character of a class such as ``a-c``."""
    return "".join(chr(c) for a, b in re.findall(r"(.)(?:-(.))?", ranges, re.S) for c in range(ord(a), ord(b or a) + 1))


@functools.cache
def compatibility_forms() -> dict[str, str]:
    """Each compatibility form of the blocks, and the plain characters it stands for."""
    out = {}
    for a, b in FORMS:
        for c in map(chr, range(a, b + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and c not in HYPHENS:
                out[c] = plain
    return out


@functools.cache
def _fold_table() -> dict[int, str]:
    table = {ord(c): p for c, p in compatibility_forms().items()}
    return table | {ord(c): "" for c in expand(INVISIBLE)} | {ord(c): " " for c in expand(SPACES)} | {ord(c): "-" for c in expand(HYPHENS)}


_MIXED = re.compile(f"[{LATIN}][{FOREIGN}]|[{FOREIGN}][{LATIN}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(f"[{LATIN}]")
_TO_LATIN, _TO_CYRILLIC = str.maketrans(TO_LATIN), str.maketrans(TO_CYRILLIC)


def _one_script(m: re.Match) -> str:
    word = m.group()
    if not _MIXED.search(word):
        return word
    latin = len(_LATIN.findall(word))
    return word.translate(_TO_LATIN if 2 * latin >= len(word) else _TO_CYRILLIC)


def fold(text: str) -> str:
    """The text as it looks: look-alikes, forms, spaces and invisible characters made plain."""
    plain = unicodedata.normalize("NFC", text.translate(_fold_table()))
    return _LETTERS.sub(_one_script, plain) if _MIXED.search(plain) else plain
