"""Conditional fetches from one https origin, with bounded bodies and checked addresses.

Only the driver fetches; the transport is a callable, so tests and offline runs inject their own.
"""

from __future__ import annotations

import ipaddress
import socket
import time
import zlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

from trovelight.schema import BODY_BYTES

REDIRECTS = 2
# Networks that no public provider lives in, beyond those the library knows as not global.
SPECIAL = [
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8",
        "100.64.0.0/10",
        "168.63.129.16/32",
        "192.0.0.0/24",
        "192.88.99.0/24",
        "198.18.0.0/15",
        "240.0.0.0/4",
        "64:ff9b::/96",
        "64:ff9b:1::/48",
        "2001::/23",
        "2002::/16",
        "fc00::/7",
        "fec0::/10",
        "ff00::/8",
    )
]


class FetchError(RuntimeError):
    """A fetch that failed; ``code`` tells how, ``seconds`` how long a rate limit lasts."""

    def __init__(self, code: str, seconds: float | None = None):
        super().__init__(code)
        self.code, self.seconds = code, seconds


def unsafe_address(text: str) -> bool:
    """Whether an address is private, local, reserved or embeds such a one."""
    try:
        a = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return True
    if isinstance(a, ipaddress.IPv6Address) and a.ipv4_mapped:
        return unsafe_address(str(a.ipv4_mapped))
    return not a.is_global or a.is_multicast or any(a in n for n in SPECIAL if n.version == a.version)


def origin_of(text: str) -> str:
    """The origin if it is https with a public host and nothing else."""
    u = urlsplit(text)
    host = u.hostname or ""
    literal = all(c in "0123456789.:abcdef" for c in host) and any(c in host for c in ".:")
    if u.scheme != "https" or not host or "@" in u.netloc or u.path.strip("/") or u.query or u.fragment or host == "localhost" or host.endswith(".localhost"):
        raise FetchError("origin")
    if literal and (":" in host or host.replace(".", "").isdigit()) and unsafe_address(host):
        raise FetchError("origin")
    return f"https://{u.netloc}"


def addresses_of(host: str) -> list[str]:
    """The addresses a host resolves to."""
    try:
        return list(dict.fromkeys(a[4][0] for a in socket.getaddrinfo(host, 443, type=socket.SOCK_STREAM)))
    except OSError as e:
        raise FetchError("resolve") from e


def safe_addresses(host: str, resolve: Callable[[str], list[str]]) -> list[str]:
    """The public addresses of a host; an error where it has none."""
    found = [a for a in resolve(host) if not unsafe_address(a)]
    if not found:
        raise FetchError("private address")
    return found


def path_of(origin: str, text: str) -> str:
    """The URL of an absolute path on the origin."""
    u = urlsplit(text)
    if u.scheme or u.netloc or not text.startswith("/") or text.startswith("//") or u.fragment:
        raise FetchError("path")
    return origin + text


@dataclass(frozen=True)
class Answer:
    status: int
    headers: Mapping[str, str] = field(default_factory=dict)
    body: bytes = b""


@dataclass(frozen=True)
class Fetched:
    body: bytes | None
    media_type: str = ""
    etag: str = ""
    last_modified: str = ""

    @property
    def unchanged(self) -> bool:
        return self.body is None


def inflate(body: bytes, most: int) -> bytes:
    """A gzip body, refused once it grows beyond ``most`` bytes."""
    d = zlib.decompressobj(31)
    out = d.decompress(body, most + 1)
    if len(out) > most or d.unconsumed_tail:
        raise FetchError("body too large")
    return out


def fetch(origin: str, path: str, send: Callable[[str, Mapping[str, str]], Answer], *, deadline: float | None, etag: str = "", last_modified: str = "", most: int = BODY_BYTES, accept: Callable[[str], bool] | None = None, resolve: Callable[[str], list[str]] | None = None) -> Fetched:
    """Fetch a path; ``deadline`` is a monotonic time and must be given.

    With ``resolve``, the host must have a public address before each request is sent; a transport
    of its own must connect to one of :func:`safe_addresses`, as ``transport.https`` does.
    """
    if deadline is None:
        raise FetchError("no deadline")
    origin = origin_of(origin)
    url, headers = path_of(origin, path), {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}
    for hop in range(REDIRECTS + 1):
        if time.monotonic() > deadline:
            raise FetchError("deadline")
        if resolve:
            safe_addresses(urlsplit(url).hostname or "", resolve)
        answer = send(url, headers)
        given = {k.lower(): v for k, v in answer.headers.items()}
        if answer.status in (301, 302, 303, 307, 308):
            if hop == REDIRECTS:
                raise FetchError("too many redirects")
            url = urljoin(url, given.get("location", ""))
            if not url.startswith(origin + "/"):
                raise FetchError("changed origin")
            continue
        break
    if answer.status == 304:
        return Fetched(None, "", given.get("etag", etag), given.get("last-modified", last_modified))
    if answer.status == 429:
        wait = given.get("retry-after", "")
        raise FetchError("rate limit", float(wait) if wait.isdigit() else None)
    if answer.status != 200:
        raise FetchError("status")
    media = given.get("content-type", "").split(";")[0].strip().lower()
    if accept and not accept(media):
        raise FetchError("media type")
    body = inflate(answer.body, most) if given.get("content-encoding") == "gzip" else answer.body
    if len(body) > most:
        raise FetchError("body too large")
    return Fetched(body, media, given.get("etag", ""), given.get("last-modified", ""))
