"""HTML, wiki, LaTeX and Markdown to clean text that keeps headings, lists, code and formulas.

A text passes through one stage per language. Code and formulas are held back first, as written, so
no later stage and no decoding of entities touches them; nested constructs are resolved from the
inside out; entities are decoded once, at the end. Each stage notes the kinds of markup it met, so
what a text holds is known from what its conversion did.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

# The element names of HTML, and those that wikis add.
ELEMENTS = (
    "a", "abbr", "acronym", "address", "article", "aside", "audio", "b", "base", "bdi", "bdo", "big", "blockquote", "body", "br", "button", "canvas", "caption", "center", "cite", "code", "col", "colgroup",
    "data", "dd", "del", "details", "dfn", "dialog", "div", "dl", "dt", "em", "embed", "fieldset", "figcaption", "figure", "font", "footer", "form", "frame", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "i", "iframe", "img", "input", "ins", "kbd", "label", "legend", "li", "link", "main", "map", "mark", "math", "menu", "meta", "meter",
    "nav", "noscript", "object", "ol", "optgroup", "option", "output", "p", "param", "picture", "pre", "progress", "q", "rp", "rt", "ruby", "s", "samp", "script", "section", "select", "small", "source", "span", "strike", "strong", "style", "sub", "summary", "sup", "svg",
    "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "time", "title", "tr", "track", "tt", "u", "ul", "var", "video", "wbr",
    "ref", "references", "nowiki", "gallery", "syntaxhighlight", "includeonly", "noinclude",
)
_BLOCKS = frozenset(("p", "div", "table", "thead", "tbody", "tfoot", "blockquote", "section", "article", "header", "footer", "main", "nav", "aside", "figure", "figcaption", "form", "fieldset", "address", "dl", "caption", "br", "hr", "title", "body", "details", "summary"))
_SILENT = frozenset(("script", "style", "template"))
_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_ATTRIBUTES = ("class", "href", "src", "style", "id", "title", "alt", "rel", "target", "width", "height", "name", "lang", "align", "type", "data-")

ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<(/?)({_NAMES})((?:\s(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*|\s[^<>]*)?/?)(>|\Z)", re.I | re.S)
_ESCAPED = re.compile(rf"&(?:amp;)*lt;({_NAMES})(?:\s[^<>]*?)?/?&(?:amp;)*gt;", re.I)
_ESCAPED_END = re.compile(rf"&(?:amp;)*lt;/({_NAMES})\s*&(?:amp;)*gt;", re.I)

#: A held place, and one step of a list's depth; a text that holds these signs itself has them held.
_PLACE = re.compile("\ue100(\\d+)\ue101")
_OWN = re.compile("[\ue100-\ue102]")
_STEP = "\ue102"
#: How deep constructs may lie within each other; what lies deeper stays as written.
DEPTH = 60

_HINT = re.compile(r"[<&\[{'=*#`_~|>$\\;+]|^[ \t]*(?:[-•]|\d{1,3}[.)]) |^-{3,}", re.M)

_CODE_HTML = re.compile(r"<(pre|syntaxhighlight|listing|xmp)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.I | re.S)
_CODE_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n`]*(?:\n|\Z)(.*?)(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_CODE_LATEX = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\]|\{[^{}]*\})?(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
_INLINE_HTML = re.compile(r"<(code|kbd|samp|tt)\b[^>]*>((?:(?!<\1\b).)*?)</\1\s*>", re.I | re.S)
_INLINE_TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+|[^`\n]*`[^`\n]+)\1(?!`)")
_INLINE_LATEX = re.compile(r"\\(?:verb|lstinline)\*?([^\w\s{])(.*?)\1")
_LITERAL = re.compile(r"<nowiki>(.*?)(?:</nowiki>|\Z)", re.I | re.S)
FORMULA = re.compile(r"(?<![\\\w$])\$\$?(?=\S)(?:(?=[^$\n]*[\\^_{}])[^$\n]+|[A-Za-z])(?<=\S)\$\$?(?![\w$])|\\\[.*?(?:\\\]|$)|\\\(.*?(?:\\\)|$)", re.S)
_FORMULA_BLOCK = re.compile(r"<math\b[^>]*>(.*?)(?:</math\s*>|\Z)|\$\$(?=\s)(?=[^$]*[\\^_{}])([^$]+)\$\$|\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)(?:\\end\{\3\}|\Z)", re.I | re.S)
_FORMULA_SIGNS = re.compile(r"^(?:\$\$?|\\[\[(])|(?:\$\$?|\\[\])])$")

_IMAGE_OPTION = re.compile(r"(?i)^\s*(?:thumb|thumbnail|mini|vignette|frame|frameless|border|left|right|center|none|upright[^|]*|\d+x?\d*px|alt=.*|link=.*)\s*$")
_NAMESPACE_DROPPED = ("category", "kategorie", "catégorie", "categoría", "категория")
_NAMESPACE_FILE = ("file", "image", "datei", "bild", "fichier", "archivo", "файл")


class Draft:
    """A text on its way through the stages: what is held back, and the kinds of markup met."""

    def __init__(self, text: str):
        self.held: list[str] = []
        self.kinds: dict[str, None] = {}
        self.text = _OWN.sub(lambda m: self.hold(m.group()), text)

    def hold(self, value: str) -> str:
        self.held.append(value)
        return f"\ue100{len(self.held) - 1}\ue101"

    def sub(self, kind: str, pattern: re.Pattern, by: str | Callable[[re.Match], str]) -> None:
        """Replace a construct wherever it stands, and note its kind."""
        self.text, n = pattern.subn(by, self.text)
        if n:
            self.kinds.setdefault(kind)

    def inside_out(self, kind: str, pattern: re.Pattern, by: str | Callable[[re.Match], str]) -> None:
        """Replace a construct that may hold others of its kind; ``pattern`` matches innermost ones."""
        for _ in range(DEPTH):
            self.text, n = pattern.subn(by, self.text)
            if not n:
                return
            self.kinds.setdefault(kind)

    def back(self, text: str) -> str:
        """The text with all that was held."""
        return _PLACE.sub(lambda m: self.back(self.held[int(m[1])]) if len(self.held[int(m[1])]) > 1 else self.held[int(m[1])], text)


def _decoded(text: str) -> str:
    return ENTITY.sub(lambda m: html.unescape(m.group()), text)


# escaped as a whole


def _unescape_whole(d: Draft) -> None:
    """Decode a text whose tags are all escaped: it was written as HTML and escaped once more.

    Such a text begins with an escaped tag or has one that is also closed; a single tag that prose
    speaks of stays as it is.
    """
    for _ in range(3):
        if "lt;" not in d.text or any(_is_tag(m) for m in TAG.finditer(d.text)):
            return
        begins = _ESCAPED.match(d.text.lstrip()) is not None
        ends = {m[1].lower() for m in _ESCAPED_END.finditer(d.text)}
        if not begins and not any(m[1].lower() in ends for m in _ESCAPED.finditer(d.text)):
            return
        d.text = _decoded(d.text)
        d.kinds.setdefault("entity")


# code and formulas


def _html_code(text: str) -> str:
    return _decoded(TAG.sub("", text))


def _hold_code(d: Draft) -> None:
    def block(text: str) -> str:
        return "\n" + d.hold("```\n" + text.strip("\n") + "\n```") + "\n"

    if "`" in d.text or "~~~" in d.text:
        d.sub("markdown", _CODE_FENCE, lambda m: block(m[2]))
    if "<" in d.text:
        d.sub("html", _CODE_HTML, lambda m: block(_html_code(m[2])))
        d.sub("html", _LITERAL, lambda m: d.hold(_decoded(m[1])))
    if "\\" in d.text:
        d.sub("latex", _CODE_LATEX, lambda m: block(m[2]))
        d.sub("latex", _INLINE_LATEX, lambda m: d.hold(f"`{m[2]}`"))
    if "<" in d.text:
        d.sub("html", _INLINE_HTML, lambda m: d.hold(f"`{_html_code(m[2]).strip()}`"))
    if "`" in d.text:
        d.sub("markdown", _INLINE_TICKS, lambda m: d.hold(f"`{m[2].strip()}`"))


def _hold_formulas(d: Draft) -> None:
    if "$" in d.text or "\\" in d.text or "<math" in d.text.lower():
        d.sub("formula", _FORMULA_BLOCK, lambda m: d.hold("$" + _decoded(TAG.sub("", next(g for g in (m[1], m[2], m[4]) if g is not None))).strip() + "$"))
        d.sub("formula", FORMULA, lambda m: d.hold("$" + _decoded(_FORMULA_SIGNS.sub("", m.group())).strip() + "$"))


# HTML


def _is_tag(m: re.Match) -> bool:
    """Whether a match is a tag: one of a single letter, or that the text's end cuts, must look like one."""
    if m[2] is None or (m[4] and len(m[2]) > 1):
        return True
    rest = m[3].strip().rstrip("/")
    if m[4]:
        return not rest or "=" in rest
    return not rest or "=" in rest or any(a.startswith(rest.split()[-1].lower()) for a in _ATTRIBUTES)


def _attribute(tag: str, name: str) -> str:
    m = re.search(rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", tag, re.I)
    return next((g for g in m.groups() if g is not None), "") if m else ""


def _html(d: Draft) -> None:
    text = d.text
    if "<" not in text:
        return
    out: list[str] = []
    lists: list[list] = []  # kind and items so far of each open list
    rows: list[bool] = []  # whether the open row of each open table has a cell
    heading: tuple[int, int] | None = None  # level and where its text begins in ``out``
    silent, notes, at, met = "", 0, 0, False

    def close_heading() -> None:
        nonlocal heading
        if heading:
            level, begin = heading
            title = " ".join("".join(out[begin:]).split())
            out[begin:] = [f"\n\n{'#' * level} {title}\n\n"] if title else []
            heading = None

    for m in TAG.finditer(text):
        if not _is_tag(m):
            continue
        name, closing = (m[2] or "").lower(), bool(m[1])
        if silent:
            if closing and name == silent:
                silent, at = "", m.end()
            continue
        out.append(text[at : m.start()])
        at, met = m.end(), True
        if name in _SILENT and not closing and not m.group().endswith("/>"):
            silent = name
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            close_heading()
            if not closing:
                heading = (int(name[1]), len(out))
        elif name in ("ul", "ol", "menu"):
            close_heading()
            if not closing:
                lists.append([name, 0])
            elif lists:
                lists.pop()
            if not lists:
                out.append("\n")
        elif name == "li" and not closing:
            close_heading()
            mark = "- "
            if lists:
                lists[-1][1] += 1
                if lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
            out.append("\n" + _STEP * (len(lists) - 1) + mark)
        elif name == "dt" and not closing:
            out.append("\n- ")
        elif name == "dd" and not closing:
            out.append(": ")
        elif name == "tr":
            out.append("" if closing else "\n")
            if rows:
                rows[-1] = False
        elif name in ("td", "th"):
            if not closing:
                if rows and rows[-1]:
                    out.append(" | ")
                elif rows:
                    rows[-1] = True
                else:
                    out.append(" ")
        elif name == "table":
            rows.append(False) if not closing else rows and rows.pop()
            out.append("\n")
        elif name == "ref":
            if not closing and not m.group().endswith("/>"):
                notes += 1
                out.append(" (")
            elif closing and notes:
                notes -= 1
                out.append(")")
        elif name == "img" and not closing:
            out.append(_attribute(m.group(), "alt"))
        elif name in ("sup", "sub") and not closing and re.match(r"[\w+−-]{1,4}</su", text[at : at + 9]):
            out.append("^" if name == "sup" else "_")
        elif name in _BLOCKS:
            if name not in ("br", "title", "summary"):
                close_heading()
            out.append("\n")
    if not met:
        return
    if not silent:
        out.append(text[at:])
    close_heading()
    d.text = "".join(out) + ")" * notes
    d.kinds.setdefault("html")


# wiki

_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_TEMPLATE_CUT = re.compile(r"\{\{([^{}]*)\Z|\{\{([^{}\n]*)$", re.M)
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_LINK_CUT = re.compile(r"\[\[([^\[\]]*)\Z|\[\[([^\[\]\n]*)$", re.M)
_OUTER_LINK = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)(?:\s+([^\]\n]*))?(?:\]|$)", re.M)
_TABLE = re.compile(r"^[ \t:]*\{\|(.*?)(?:^[ \t]*\|\}|\Z)", re.M | re.S)
_TABLE_REST = re.compile(r"^\|[-}].*$", re.M)
_CELL_STYLE = re.compile(r"^[^|\[\]{}]*=[^|\[\]{}]*\|(?!\|)")
_QUOTES = re.compile(r"('{2,5})(?=[^\s'])((?:[^'\n]|'(?!'))*[^\s'])\1(?!')")
_WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_TERM = re.compile(r"^;[ \t]*(\S.*?)\s:\s+", re.M)
_NUMBERED = re.compile(r"(?:^#{1,4}[ \t]+\S[^\n]*(?:\n|\Z)){2,}", re.M)
_STARRED = re.compile(r"^(\*{2,5}|\*+#[*#]*)[ \t]+(?=\S)", re.M)


def _template(d: Draft, body: str) -> str:
    """A template's values; its name is dropped."""
    parts = [p.replace("=", ": ", 1).strip() for p in body.split("|")[1:]]
    return d.hold("; ".join(p for p in parts if p.strip(": "))) if len(parts) else ""


def _link(d: Draft, body: str) -> str:
    target, *labels = body.split("|")
    space = target.partition(":")[0].strip().lower() if ":" in target else ""
    if space in _NAMESPACE_DROPPED:
        return ""
    if space in _NAMESPACE_FILE:
        label = next((x for x in reversed(labels) if not _IMAGE_OPTION.match(x)), "")
    else:
        label = (labels[-1] if labels else "") or target
    return d.hold(label.strip()) if "|" in label or "=" in label else label.strip()


def _table(body: str) -> str:
    """Rows as lines, cells between bars; styles are dropped."""
    rows: list[list[str]] = [[]]
    for line in body.split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows += [[_CELL_STYLE.sub("", line[2:]).strip()], []]
        elif line[:1] in ("|", "!"):
            rows[-1] += [_CELL_STYLE.sub("", c).strip() for c in re.split(r"\|\||!!" if line[0] == "!" else r"\|\|", line[1:])]
        elif line:
            rows[-1].append(line)
    return "\n" + "\n".join(" | ".join(r) for r in rows if r) + "\n"


def _numbered(m: re.Match, wiki: bool) -> str:
    """Adjacent lines of the same sign are a numbered list, not headings; two only in a wiki's text."""
    lines = m.group().rstrip("\n").split("\n")
    depth = [len(x) - len(x.lstrip("#")) for x in lines]
    if not any(a == b for a, b in zip(depth, depth[1:], strict=False)) or (len(lines) < 3 and not wiki):
        return m.group()
    count: dict[int, int] = {}
    out = []
    for k, x in zip(depth, lines, strict=True):
        count = {a: n for a, n in count.items() if a <= k}
        count[k] = count.get(k, 0) + 1
        out.append(f"{_STEP * (k - 1)}{count[k]}. {x[k:].strip()}")
    return "\n".join(out) + "\n"


def _wiki(d: Draft) -> None:
    if "{{" in d.text:
        d.inside_out("wiki", _TEMPLATE, lambda m: _template(d, m[1]))
        d.sub("wiki", _TEMPLATE_CUT, lambda m: _template(d, m[1] or m[2] or ""))
    if "[[" in d.text:
        d.inside_out("wiki", _LINK, lambda m: _link(d, m[1]))
        d.sub("wiki", _LINK_CUT, lambda m: _link(d, m[1] or m[2] or ""))
    if "[" in d.text:
        d.sub("wiki", _OUTER_LINK, lambda m: (m[2] or m[1]).strip())
    if "|" in d.text:
        d.inside_out("wiki", _TABLE, lambda m: _table(m[1]))
        d.sub("wiki", _TABLE_REST, "")
    if "==" in d.text:
        d.sub("wiki", _WIKI_HEADING, lambda m: f"\n{'#' * len(m[1])} {m[2]}\n")
    if "''" in d.text:
        d.inside_out("wiki", _QUOTES, r"\2")
    if ";" in d.text:
        d.sub("wiki", _TERM, r"- \1: ")
    if "**" in d.text:
        d.sub("wiki", _STARRED, lambda m: _STEP * (len(m[1]) - 1) + "- ")
    if "#" in d.text:
        before, d.text = d.text, _NUMBERED.sub(lambda m: _numbered(m, "wiki" in d.kinds), d.text)
        if d.text != before:
            d.kinds.setdefault("wiki")


# LaTeX

LATEX = re.compile(r"(?<![\w:\\])~?\\(?:[a-zA-Z]{2,}\*?|[%&#_{}\"'`^])(?=[\s{\[\\]|$)|(?<!\w)\\item\b|\\(?:begin|end)\{|\\[\"'`^]\{\\?[A-Za-z]\}")
# What an accent command puts on its letter, and commands that stand for characters.
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328"}
_CHARACTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "ldots": "…", "dots": "…", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "textendash": "–", "textemdash": "—", "textdegree": "°", "euro": "€", "pounds": "£", "copyright": "©"}
# Sectioning commands by depth; commands whose arguments aren't text.
_SECTIONS = {"part": 1, "chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_DROPPED = ("cite", "citep", "citet", "ref", "eqref", "pageref", "autoref", "label", "index", "bibliography", "bibliographystyle", "usepackage", "documentclass", "includegraphics", "vspace", "hspace", "input", "include", "pagestyle", "setlength", "nocite")
_LATEX_SIGN = re.compile(r"\\([%&#_{}$])")
_LATEX_ACCENT = re.compile(r"\\(?:(['`^\"~=.])\s*(?:\{\\?([A-Za-z])\}|([A-Za-z]))|([cvuHrk])\{([A-Za-z])\})")
_LATEX_ARG = r"(?:\[[^\[\]]*\])*\{([^{}]*)\}"
_LATEX_SECTION = re.compile(rf"\\({'|'.join(_SECTIONS)})\*?{_LATEX_ARG}")
_LATEX_DROPPED = re.compile(rf"~?\\(?:{'|'.join(_DROPPED)})\*?(?![a-zA-Z])(?:\[[^\[\]]*\])*\{{[^{{}}]*(?:\}}|\Z)")
_LATEX_TWO = re.compile(r"\\(?:href|textcolor|colorbox)\{[^{}]*\}\{([^{}]*)\}")
_LATEX_NOTE = re.compile(rf"\\(?:footnote|thanks)\*?{_LATEX_ARG}")
_LATEX_ANY = re.compile(rf"(?<![\w:\\])\\[a-zA-Z]{{2,}}\*?{_LATEX_ARG}")
_LATEX_ANY_CUT = re.compile(r"(?<![\w:\\])\\[a-zA-Z]{2,}\*?(?:\[[^\[\]]*\])*\{([^{}]*)\Z")
_LATEX_GROUP = re.compile(r"(?<![a-zA-Z*\]\\])\{([^{}]*)\}")
_LATEX_NAME = re.compile(r"(?<![\w:\\])\\([a-zA-Z]{2,})\*?(?=[\s{\[\\]|$)[ ]?")
_LATEX_LIST = re.compile(r"\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]]*\])?|(?<!\w)\\item\b\s*(?:\[([^\]]*)\])?\s*")
_LATEX_TABULAR = re.compile(r"\\begin\{(tabular[x*]?|array|longtable)\}(?:\{[^{}]*\}|\[[^\]]*\])*(.*?)(?:\\end\{\1\}|\Z)", re.S)
_LATEX_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?")


def _latex_lists(d: Draft) -> None:
    lists: list[list] = []

    def one(m: re.Match) -> str:
        if m[1] == "begin":
            lists.append([m[2], 0])
            return ""
        if m[1] == "end":
            if lists:
                lists.pop()
            return "" if lists else "\n"
        mark = "- "
        if lists:
            lists[-1][1] += 1
            if lists[-1][0] == "enumerate":
                mark = f"{lists[-1][1]}. "
        return "\n" + _STEP * max(0, len(lists) - 1) + mark + (f"{m[3]}: " if m[3] else "")

    d.text = _LATEX_LIST.sub(one, d.text)


def _latex(d: Draft) -> None:
    if "\\" not in d.text or not LATEX.search(d.text):
        return
    d.kinds.setdefault("latex")
    d.text = _LATEX_TABULAR.sub(lambda m: "\n" + re.sub(r"\s*\\\\\s*", "\n", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", re.sub(r"\s*(?<!\\)&\s*", " | ", m[2]))).strip() + "\n", d.text)
    d.text = _LATEX_SIGN.sub(lambda m: d.hold(m[1]), d.text)
    d.text = _LATEX_ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[3] or m[5]) + _ACCENTS[m[1] or m[4]]), d.text)
    _latex_lists(d)
    for _ in range(DEPTH):
        before = d.text
        d.text = _LATEX_DROPPED.sub("", d.text)
        d.text = _LATEX_SECTION.sub(lambda m: f"\n\n{'#' * _SECTIONS[m[1]]} {m[2].strip()}\n\n", d.text)
        d.text = _LATEX_TWO.sub(r"\1", d.text)
        d.text = _LATEX_NOTE.sub(r" (\1)", d.text)
        d.text = _LATEX_ENVIRONMENT.sub("\n", d.text)
        d.text = _LATEX_ANY.sub(r"\1", d.text)
        if d.text == before:
            d.text = _LATEX_GROUP.sub(r"\1", d.text)
        if d.text == before:
            break
    d.text = _LATEX_ANY_CUT.sub(r"\1", d.text)
    d.text = re.sub(r"\\\\[ \t]*", "\n", d.text)
    d.text = _LATEX_NAME.sub(lambda m: _CHARACTERS.get(m[1], ""), d.text)
    d.text = re.sub(r"(?<=\S)~(?=\S)", " ", d.text)


# Markdown

_SETEXT = re.compile(r"^(?![ \t]*(?:[-*+>|]|\d+[.)])[ \t])(?=[^\n]*\S)([^\n|]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_ATX = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
_TABLE_RULE = re.compile(r"^\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*(?::?-{3,}:?)?[ \t]*$\n?", re.M)
_TABLE_ROW = re.compile(r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", re.M)
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\(<?[^()\s]*(?:\([^()\s]*\)[^()\s]*)*>?(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?(?:\)|\Z|$)|\[[^\[\]\n]*\])?", re.M)
_IMAGE_CUT = re.compile(r"!\[([^\[\]\n]*)$", re.M)
_ANCHOR = re.compile(r"\[([^\[\]\n]*)\]\(<?[^()\s]+(?:\([^()\s]*\)[^()\s]*)*>?(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?(?:\)|$)", re.M)
_DEFINITION = re.compile(r"^[ ]{0,3}\[(?!\^)([^\[\]\n]+)\]:[ \t]+<?(?:https?|ftp|mailto)[^\n]*$\n?", re.M)
_FOOTNOTE = re.compile(r"^\[\^[\w-]+\]:[ \t]*", re.M)
_FOOTNOTE_REF = re.compile(r"\[\^[\w-]+\]")
_AUTOLINK = re.compile(r"<((?:https?|ftp)://[^\s<>]+|mailto:[^\s<>]+)>")
_STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])((?:[^*\n]|\*(?!\*))+)(?<=\S)\*\*(?![\w*])")
_EMPHASIS = re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])")
_UNDER2 = re.compile(r"(?<![\w_])__(?=[^\s_])((?:[^_\n]|_(?!_))+)(?<=\S)__(?![\w_])")
_UNDER1 = re.compile(r"(?<![\w_])_(?=[^\s_])([^_\n]*)(?<=\S)_(?![\w_])")
_STRUCK = re.compile(r"~~(?=\S)([^~\n]*)~~")
_QUOTE = re.compile(r"^(?:>[ \t]?)+(?=\S)|^>[ \t]*$", re.M)
_ITEM = re.compile(r"^([ \t\ue102]*)([-*+•]|\d{1,3}[.)])([ \t]+)(?=\S)", re.M)
_BULLETS = re.compile(r"^[ \t]*(?:[-•]|\d{1,3}[.)]) \S[^\n]*\n+[ \t]*(?:[-•]|\d{1,3}[.)]) \S", re.M)
_MARKED_ITEM = re.compile(r"^[ \t]{2,}[*+-] \S|^[*+] \S", re.M)


def _items(d: Draft) -> None:
    """List items at their depth, which the indentation of the items above tells."""
    if _MARKED_ITEM.search(d.text):
        d.kinds.setdefault("markdown")
    elif _BULLETS.search(d.text):
        d.kinds.setdefault("list")
    else:
        return
    lines, stack = d.text.split("\n"), []
    for k, line in enumerate(lines):
        m = _ITEM.match(line)
        if not m:
            if line.strip() and not line[:1].isspace():
                stack = []
            continue
        if _STEP in m[1]:
            continue  # a stage before knew its depth
        indent = len(m[1].expandtabs(4))
        while stack and stack[-1] > indent:
            stack.pop()
        if not stack or indent > stack[-1] + 1:
            stack.append(indent)
        lines[k] = _STEP * (len(stack) - 1) + ("- " if m[2] in "-*+•" else f"{m[2]} ") + line[m.end() :]
    d.text = "\n".join(lines)


def _markdown(d: Draft) -> None:
    if "[" in d.text and _DEFINITION.search(d.text):
        names = {m[1].lower() for m in _DEFINITION.finditer(d.text)}
        d.sub("markdown", _DEFINITION, "")
        d.text = re.sub(r"\[([^\[\]\n]+)\](?:\[([^\[\]\n]*)\])?", lambda m: m[1] if (m[2] or m[1]).lower() in names else m.group(), d.text)
    if "===" in d.text or "---" in d.text:
        d.sub("markdown", _TABLE_RULE, "")
        d.sub("markdown", _SETEXT, lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1].strip()}\n")
    if "#" in d.text:
        d.sub("markdown", _ATX, r"\1 \2")
    if "|" in d.text:
        d.sub("markdown", _TABLE_ROW, r"\1")
    if "[" in d.text:
        for _ in range(2):  # an image may be the text of a link
            d.sub("markdown", _IMAGE, r"\1")
            d.sub("markdown", _ANCHOR, r"\1")
        d.sub("markdown", _IMAGE_CUT, r"\1")
        d.sub("markdown", _FOOTNOTE, "- ")
        d.sub("markdown", _FOOTNOTE_REF, "")
    if "<" in d.text:
        d.sub("markdown", _AUTOLINK, r"\1")
    if "*" in d.text:
        d.inside_out("markdown", _STRONG, r"\1")
        d.inside_out("markdown", _EMPHASIS, r"\1")
    if "_" in d.text:
        d.inside_out("markdown", _UNDER2, r"\1")
        d.inside_out("markdown", _UNDER1, r"\1")
    if "~~" in d.text:
        d.sub("markdown", _STRUCK, r"\1")
    if ">" in d.text:
        d.sub("markdown", _QUOTE, "")
    _items(d)


def convert(text: str | None) -> tuple[list[str], str]:
    """The kinds of markup met and the clean text; without markup the text, trimmed.

    Headings come out as ``#`` lines, list items as ``- `` or ``1. `` at two spaces a level, code in
    back-ticks, formulas between dollar signs, cells between bars. Comparisons, prices, remarks,
    plain names and URLs are no markup. Constructs that the text's end cuts count. Linear in the
    text but for nesting, which is resolved to ``DEPTH`` levels.
    """
    if not text:
        return [], ""
    if not _HINT.search(text):
        return [], text.strip()
    d = Draft(text)
    _unescape_whole(d)
    _hold_code(d)
    _hold_formulas(d)
    for stage in (_html, _wiki, _latex, _markdown):
        stage(d)
    if "&" in d.text:
        before, d.text = d.text, _decoded(d.text)
        if d.text != before:
            d.kinds.setdefault("entity")
    if not d.kinds:
        return [], text.strip()
    out = re.sub(r"[ \t\xa0]+", " ", d.text)
    out = re.sub(r" ?\n ?", "\n", out)
    out = re.sub(r"\n{3,}", "\n\n", out).strip(" \n")
    return list(d.kinds), d.back(out.replace(_STEP, "  "))
