"""The query language: text to a typed, serialisable query.

A query is lexed into tokens with byte spans; a list of readers then claims tokens as filters,
ranges, providers, orders and limits; what no reader claims is searched as text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import date
from fractions import Fraction

from trovelight.plans import vocabulary as V
from trovelight.schema import QUERY_BYTES, QUERY_TOKENS, QUERY_VERSION, RESULT_LIMIT


class QueryError(ValueError):
    """A query that can't be run; ``code`` tells why and ``query`` holds what was parsed."""

    def __init__(self, code: str, query: Query | None = None):
        super().__init__(code)
        self.code, self.query = code, query


@dataclass(frozen=True)
class Span:
    start_byte: int
    end_byte: int


@dataclass(frozen=True)
class Clause:
    raw: str
    normalized: str
    span: Span
    occurrence: str = "required"


@dataclass(frozen=True)
class Value:
    value: str | int
    span: Span


@dataclass(frozen=True)
class Bound:
    """An end of a range: bytes or an ISO date."""

    value: int | str
    inclusive: bool
    span: Span
    lexeme: str = ""


@dataclass
class Range:
    low: Bound | None = None
    high: Bound | None = None

    def narrow(self, low: Bound | None, high: Bound | None) -> None:
        """Intersect with another range; of equal ends the exclusive one wins."""
        if low and (not self.low or (low.value, not low.inclusive) > (self.low.value, not self.low.inclusive)):
            self.low = low
        if high and (not self.high or (high.value, high.inclusive) < (self.high.value, self.high.inclusive)):
            self.high = high

    @property
    def empty(self) -> bool:
        if not self.low or not self.high:
            return False
        return self.low.value > self.high.value or (self.low.value == self.high.value and not (self.low.inclusive and self.high.inclusive))


@dataclass(frozen=True)
class Order:
    field: str
    direction: str
    span: Span


@dataclass(frozen=True)
class Warning:
    code: str
    message: str
    span: Span


@dataclass
class Query:
    raw: str
    schema_version: int = QUERY_VERSION
    required: list[Clause] = field(default_factory=list)
    optional: list[Clause] = field(default_factory=list)
    excluded: list[Clause] = field(default_factory=list)
    phrases: list[Clause] = field(default_factory=list)
    categories: list[Value] = field(default_factory=list)
    content_kinds: list[Value] = field(default_factory=list)
    extensions: list[Value] = field(default_factory=list)
    media_kinds: list[Value] = field(default_factory=list)
    languages: list[Value] = field(default_factory=list)
    architectures: list[Value] = field(default_factory=list)
    resolutions: list[Value] = field(default_factory=list)
    codecs: list[Value] = field(default_factory=list)
    date: Range = field(default_factory=Range)
    size: Range = field(default_factory=Range)
    allow: list[Value] = field(default_factory=list)
    deny: list[Value] = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    limit: int | None = None
    warnings: list[Warning] = field(default_factory=list)

    def warn(self, code: str, message: str, span: Span) -> None:
        self.warnings.append(Warning(code, message, span))

    def add(self, family: str, value: str | int, span: Span) -> None:
        """Add a facet value to its family, once."""
        held = getattr(self, family)
        if all(v.value != value for v in held):
            held.append(Value(value, span))

    def choose(self, provider: str, deny: bool, span: Span) -> None:
        """Allow or deny a provider; a denial always wins."""
        named = {v.value for v in (self.allow if deny else self.deny)}
        if provider in named:
            self.warn("provider_conflict", f"provider {provider!r} is both allowed and denied; it stays denied", span)
            self.allow = [v for v in self.allow if v.value != provider]
        if deny or provider not in named:
            self.add("deny" if deny else "allow", provider, span)

    def sort(self, by: str, direction: str, span: Span) -> None:
        """Add an order; of two by the same field the first holds."""
        for o in self.order:
            if o.field == by:
                if o.direction != direction:
                    self.warn("order_conflict", f"already ordered by {by} {o.direction}", span)
                return
        self.order.append(Order(by, direction, span))

    def to_dict(self) -> dict:
        return asdict(self)


def normalize(text: str) -> str:
    """Search form of a text: trimmed, compatibility-composed and case-folded."""
    text = text.strip()
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def compact(text: str) -> str:
    """The search form without hyphens, underscores, points and spaces."""
    return normalize(text).translate(dict.fromkeys(map(ord, "-_. ")))


def byte_quantity(text: str) -> int | None:
    """Bytes of a quantity such as ``1.5GiB``; None if malformed, fractional or beyond 63 bits."""
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)([A-Za-z]+)", text.strip())
    unit = V.BYTE_UNITS.get(m[2].lower()) if m else None
    if not unit or sum(c.isdigit() for c in m[1]) > 40 or m[1].startswith("."):
        return None
    value = Fraction(m[1]) * unit
    return int(value) if value.denominator == 1 and value < 2**63 else None


def iso_date(text: str) -> str | None:
    """The date if the text is exactly ``YYYY-MM-DD``."""
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return None
    try:
        return date.fromisoformat(text).isoformat()
    except ValueError:
        return None


def year_of(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[0-9]{4}", text) and text != "0000" else None


def _date_span(text: str, span: Span) -> tuple[Bound, Bound] | None:
    """First and last day of a year or of a day."""
    if (year := year_of(text)) is not None:
        ends = f"{year:04d}-01-01", f"{year:04d}-12-31"
    elif day := iso_date(text):
        ends = day, day
    else:
        return None
    return Bound(ends[0], True, span), Bound(ends[1], True, span)


def _date_range(text: str, span: Span) -> tuple[Bound, Bound] | None:
    left, dots, right = text.partition("..")
    first, last = _date_span(left, span), _date_span(right if dots else left, span)
    return (first[0], last[1]) if first and last else None


def _date_from(word: str, text: str, span: Span) -> tuple[Bound | None, Bound | None] | None:
    """The range that *after*, *since* or *before* a year or day leaves."""
    if (year := year_of(text)) is not None:
        bound = {"after": year + 1, "since": year, "before": year - 1}[word]
        if not 1 <= bound <= 9999:
            return None
        return (None, Bound(f"{bound:04d}-12-31", True, span)) if word == "before" else (Bound(f"{bound:04d}-01-01", True, span), None)
    if not (day := iso_date(text)):
        return None
    bound = Bound(day, word == "since", span)
    return (None, bound) if word == "before" else (bound, None)


def language_tag(text: str) -> str | None:
    """A language by name or by tag, such as ``en`` or ``pt-br``."""
    text = normalize(text)
    if text in V.LANGUAGES:
        return V.LANGUAGES[text]
    tag = text.replace("_", "-")
    return tag if len(tag) <= 35 and re.fullmatch(r"[a-z]{2,3}(?:-[a-z0-9]{2,8})*", tag) else None


def resolution(text: str, named: bool) -> int | None:
    """Lines of a resolution such as ``1080p``; names such as ``4k`` only if ``named``."""
    text = compact(text)
    if named and text in ("4k", "uhd", "8k"):
        return 4320 if text == "8k" else 2160
    m = re.fullmatch(r"([0-9]+)p", text)
    return int(m[1]) if m and len(m[1]) < 10 and 100 <= int(m[1]) <= 8640 else None


def extension(text: str) -> str | None:
    bare = normalize(text).removeprefix(".")
    return f".{bare}" if re.fullmatch(r"[a-z0-9]{1,16}", bare) else None


def _whole(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[+-]?[0-9]{1,18}", text) and 1 <= int(text) <= RESULT_LIMIT else None


@dataclass
class Token:
    text: str
    span: Span
    quoted: bool
    occurrence: str
    used: bool = False

    @property
    def word(self) -> str:
        return normalize(self.text)

    @property
    def free(self) -> bool:
        return not self.used and not self.quoted and self.occurrence == "required"


_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = re.compile(rf'(?P<mark>[+?-](?=[^{_SPACE}]))?(?:"(?P<phrase>(?:\\["\\]|[^"])*)(?P<close>"?)|(?P<plain>[^{_SPACE}]+))')
_MARKS = {None: "required", "+": "required", "?": "optional", "-": "excluded"}


def lex(text: str, query: Query) -> list[Token]:
    """Tokens of a query, their spans in bytes of its UTF-8 form."""
    tokens: list[Token] = []
    place = [0]
    for c in text:
        place.append(place[-1] + len(c.encode()))
    at = 0
    while m := re.compile(rf"[{_SPACE}]*").match(text, at):
        if (at := m.end()) == len(text):
            break
        m = _TOKEN.match(text, at)
        span = Span(place[at], place[m.end()])
        quoted = m["phrase"] is not None
        tokens.append(Token(re.sub(r'\\(["\\])', r"\1", m["phrase"]) if quoted else m["plain"], span, quoted, _MARKS[m["mark"]]))
        if quoted and not m["close"]:
            query.warn("unclosed_quote", "the phrase runs to the end of the query", span)
        if len(tokens) > QUERY_TOKENS:
            raise QueryError("too_many_tokens", query)
        at = m.end()
    return tokens


class _Reader:
    """Claims tokens for a query; each reader tells whether it claimed the token at ``i``."""

    def __init__(self, tokens: list[Token], query: Query):
        self.tokens, self.query = tokens, query

    def free(self, i: int, n: int) -> bool:
        return i + n <= len(self.tokens) and all(t.free for t in self.tokens[i : i + n])

    def words(self, i: int, *words: str) -> bool:
        return self.free(i, len(words)) and all(t.word == w for t, w in zip(self.tokens[i:], words, strict=False))

    def claim(self, i: int, n: int) -> bool:
        for t in self.tokens[i : i + n]:
            t.used = True
        return True

    def span(self, i: int, n: int) -> Span:
        return Span(self.tokens[i].span.start_byte, self.tokens[i + n - 1].span.end_byte)

    # filters of the form key:value

    def explicit(self, i: int) -> bool:
        t = self.tokens[i]
        key, colon, value = t.text.partition(":")
        key = normalize(key)
        if not colon or not key or t.occurrence == "optional" or (t.occurrence == "excluded" and key not in ("provider", "source")):
            return False
        taken = self._explicit(key, value, t)
        if taken is None or taken is True:
            return taken is True and self.claim(i, 1)
        self.query.warn(*taken, t.span)
        return False

    def _explicit(self, key: str, value: str, t: Token) -> bool | None | tuple[str, str]:
        """True if understood, None if it is no filter, else the warning."""
        q = self.query
        looked_up: dict[str, tuple[str, Callable[[str], str | int | None]]] = {
            "category": ("categories", lambda v: normalize(v) if re.fullmatch(r"[a-z0-9_-]{1,40}", normalize(v)) else None),
            "kind": ("content_kinds", lambda v: V.CONTENT_KINDS.get(normalize(v))),
            "ext": ("extensions", extension),
            "media": ("media_kinds", lambda v: V.MEDIA_KINDS.get(normalize(v))),
            "lang": ("languages", language_tag),
            "arch": ("architectures", lambda v: V.ARCHITECTURES.get(normalize(v))),
            "res": ("resolutions", lambda v: resolution(v, named=True)),
            "codec": ("codecs", lambda v: V.CODECS.get(compact(v))),
        }
        key = {"type": "kind", "extension": "ext", "language": "lang", "architecture": "arch", "resolution": "res", "source": "provider", "order": "sort", "year": "date"}.get(key, key)
        if key in looked_up:
            family, read = looked_up[key]
            found = read(value)
            if found is None:
                return "invalid_filter", f"invalid {key} {value!r}"
            q.add(family, found, t.span)
        elif key == "provider":
            found = V.PROVIDERS.get(normalize(value.lstrip("-!")))
            if not found:
                return "unknown_provider", f"unknown provider {value!r}"
            q.choose(found, t.occurrence == "excluded" or value[:1] in ("-", "!"), t.span)
        elif key == "sort":
            if not (order := V.ORDERS.get(compact(value))):
                return "invalid_filter", f"unknown order {value!r}"
            q.sort(*order, t.span)
        elif key == "limit":
            if (n := _whole(value)) is None:
                return "invalid_limit", f"a limit lies between 1 and {RESULT_LIMIT}"
            q.limit = n
        elif key in ("date", "after", "since", "before"):
            found = _date_range(value, t.span) if key == "date" else _date_from(key, value, t.span)
            if not found:
                return "invalid_date", f"invalid date {value!r}"
            q.date.narrow(*found)
        elif key in ("size", "min-size", "max-size"):
            m = re.match(r"[<>]=?", value) if key == "size" else None
            sign = m[0] if m else {"min-size": ">=", "max-size": "<="}.get(key)
            rest = value[len(m[0]) :] if m else value
            n = byte_quantity(rest) if sign else None
            if n is None:
                return "invalid_size", f"invalid size {value!r}"
            bound = Bound(n, "=" in sign, t.span, rest)
            q.size.narrow(*((bound, None) if sign[0] == ">" else (None, bound)))
        else:
            return None
        return True

    # natural forms

    def _quantity(self, i: int) -> tuple[int, int, str] | None:
        """(bytes, tokens taken, lexeme) of a quantity of one or two tokens."""
        for n in (1, 2):
            if self.free(i, n):
                parts = [t.text for t in self.tokens[i : i + n]]
                if (found := byte_quantity("".join(parts))) is not None:
                    return found, n, " ".join(parts)
        return None

    def size(self, i: int) -> bool:
        for phrase, (least, inclusive) in V.SIZE_WORDS.items():
            words = phrase.split()
            if not self.words(i, *words):
                continue
            if not (got := self._quantity(i + len(words))):
                return False
            n = len(words) + got[1]
            bound = Bound(got[0], inclusive, self.span(i, n), got[2])
            self.query.size.narrow(*((bound, None) if least else (None, bound)))
            return self.claim(i, n)
        if not self.words(i, "between") or not (a := self._quantity(i + 1)) or not self.words(i + 1 + a[1], "and"):
            return False
        if not (b := self._quantity(i + 2 + a[1])):
            return False
        n = 2 + a[1] + b[1]
        span = self.span(i, n)
        self.query.size.narrow(Bound(a[0], True, span, a[2]), Bound(b[0], True, span, b[2]))
        return self.claim(i, n)

    def dated(self, i: int) -> bool:
        word = self.tokens[i].word
        if word in ("after", "since", "before") and self.free(i, 2):
            if found := _date_from(word, self.tokens[i + 1].text, self.span(i, 2)):
                self.query.date.narrow(*found)
                return self.claim(i, 2)
        elif word == "between" and self.free(i, 4) and self.tokens[i + 2].word == "and":
            span = self.span(i, 4)
            first, last = _date_span(self.tokens[i + 1].text, span), _date_span(self.tokens[i + 3].text, span)
            if first and last:
                self.query.date.narrow(first[0], last[1])
                return self.claim(i, 4)
        return False

    def provider(self, i: int) -> bool:
        for before, after, deny in ((("from",), (), False), (("not", "from"), (), True), ((), ("sources", "only"), False)):
            at, n = i + len(before), len(before) + 1 + len(after)
            if self.free(i, n) and self.words(i, *before) and self.words(at + 1, *after) and (name := V.PROVIDERS.get(self.tokens[at].word)):
                self.query.choose(name, deny, self.span(i, n))
                return self.claim(i, n)
        return False

    def ordered(self, i: int) -> bool:
        order = V.ORDERS.get(compact(self.tokens[i].text))
        if not order or not self.free(i, 2) or not self.words(i + 1, "first"):
            return False
        self.query.sort(*order, self.span(i, 2))
        return self.claim(i, 2)

    def limited(self, i: int) -> bool:
        if not self.free(i, 2) or self.tokens[i].word not in ("top", "first") or (n := _whole(self.tokens[i + 1].text)) is None:
            return False
        self.query.limit = n
        after = self.tokens[i + 2] if i + 2 < len(self.tokens) else None
        return self.claim(i, 3 if after and not after.used and after.word == "results" else 2)

    def language(self, i: int) -> bool:
        if not self.free(i, 2) or self.tokens[i].word not in ("in", "language") or not (tag := V.LANGUAGES.get(self.tokens[i + 1].word)):
            return False
        self.query.add("languages", tag, self.span(i, 2))
        return self.claim(i, 2)

    def facet(self, i: int) -> bool:
        t = self.tokens[i]
        if not t.free:
            return False
        word = t.word
        beside = [x.word for x in (*self.tokens[max(0, i - 1) : i], *self.tokens[i + 1 : i + 2]) if not x.quoted and x.occurrence == "required"]
        video = word in ("4k", "8k") and any(w in ("video", "movie", "animation") for w in beside)
        if word == "linux" and self.free(i, 2) and self.tokens[i + 1].word == "image":
            self.query.add("content_kinds", "disk_image", self.tokens[i + 1].span)
            self.claim(i + 1, 1)
            return False  # the first word is searched as well
        for family, value in (
            ("architectures", V.ARCHITECTURES.get(word)),
            ("codecs", V.CODECS.get(compact(word))),
            ("resolutions", resolution(word, named=video)),
            ("extensions", extension(word) if word.startswith(".") else None),
            ("content_kinds", V.CONTENT_KINDS.get(word)),
        ):
            if value is not None:
                self.query.add(family, value, t.span)
                return self.claim(i, 1)
        return False


def parse(text: str | bytes) -> Query:
    """The query of a text; raises :class:`QueryError` for one that can't be run."""
    try:
        text = text.decode() if isinstance(text, bytes) else text
        size = len(text.encode())
    except UnicodeError as e:
        raise QueryError("invalid_utf8") from e
    query = Query(text)
    if not text.strip():
        raise QueryError("empty", query)
    if size > QUERY_BYTES:
        raise QueryError("too_long", query)
    tokens = lex(text, query)
    reader = _Reader(tokens, query)
    natural = (reader.size, reader.dated, reader.provider, reader.ordered, reader.limited, reader.language, reader.facet)
    for i, t in enumerate(tokens):
        if not t.used and not t.quoted and not reader.explicit(i):
            any(read(i) for read in natural)  # the first that claims it

    for t in tokens:
        if t.used:
            continue
        clause = Clause(t.text, t.word, t.span, t.occurrence)
        if not clause.normalized:
            if t.quoted:
                query.warn("empty_phrase", "an empty phrase is left out", t.span)
        elif t.quoted:
            query.phrases.append(clause)
        else:
            if clause.normalized in ("4k", "8k"):
                query.warn("ambiguous_resolution", "name a resolution: filter, or put it beside video", t.span)
            elif re.fullmatch(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", clause.normalized):
                query.warn("ambiguous_date", "write dates as YYYY-MM-DD, in a date filter", t.span)
            getattr(query, t.occurrence).append(clause)
    if query.size.empty or query.date.empty:
        query.warn("range_conflict", "no record can match these ranges", Span(0, size))
        raise QueryError("unsatisfiable", query)
    return query


def override(query: Query, providers: list[str] | None = None, sort: str | None = None, limit: int | None = None) -> Query:
    """Replace a query's providers, order or limit by given ones, such as a command line's."""
    whole = Span(0, 0)
    if providers:
        query.allow, query.deny = [], []
        for p in providers:
            if not re.fullmatch(r"[A-Za-z0-9_-]+", p) or normalize(p) not in V.PROVIDERS:
                raise QueryError("unknown_provider", query)
            query.choose(V.PROVIDERS[normalize(p)], False, whole)
    if sort:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", sort) or compact(sort) not in V.ORDERS:
            raise QueryError("unknown_order", query)
        query.order = [Order(*V.ORDERS[compact(sort)], whole)]
    if limit is not None:
        if not 1 <= limit <= RESULT_LIMIT:
            raise QueryError("invalid_limit", query)
        query.limit = limit
    return query


def explain(query: Query) -> list[tuple[str, str]]:
    """The query's parts as (name, text) rows, without running it."""

    def one(v) -> str:
        if isinstance(v, Clause):
            return v.normalized if v.occurrence == "required" else f"{v.occurrence} {v.normalized}"
        if isinstance(v, Value):
            return str(v.value)
        return f"{v.field} {v.direction}" if isinstance(v, Order) else f"{v.code}: {v.message}"

    def ends(r: Range) -> list[str]:
        return [f"{'>' if low else '<'}{'=' * b.inclusive}{b.value}" for low, b in ((True, r.low), (False, r.high)) if b]

    rows = [(n, ", ".join(map(one, getattr(query, n)))) for n in ("required", "optional", "excluded", "phrases", "categories", "content_kinds", "extensions", "media_kinds", "languages", "architectures", "resolutions", "codecs", "allow", "deny", "order", "warnings")]
    rows += [(n, " ".join(ends(getattr(query, n)))) for n in ("date", "size")] + [("limit", "" if query.limit is None else str(query.limit))]
    return [(n, t) for n, t in rows if t]
