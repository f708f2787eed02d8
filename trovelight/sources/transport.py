"""An https transport that connects only to public addresses; it follows no redirects."""

from __future__ import annotations

import http.client
import socket
import ssl
from collections.abc import Callable, Mapping
from urllib.parse import urlsplit

from trovelight.schema import BODY_BYTES
from trovelight.sources.http import Answer, FetchError, addresses_of, safe_addresses


class _Pinned(http.client.HTTPSConnection):
    """A connection to a given address, its certificate checked for the host."""

    def __init__(self, host: str, port: int, address: str, seconds: float):
        self.address, self.tls = address, ssl.create_default_context()
        super().__init__(host, port, timeout=seconds, context=self.tls)

    def connect(self) -> None:
        raw = socket.create_connection((self.address, self.port), self.timeout)
        self.sock = self.tls.wrap_socket(raw, server_hostname=self.host)


def https(url: str, headers: Mapping[str, str], seconds: float = 30.0, most: int = BODY_BYTES, resolve: Callable[[str], list[str]] = addresses_of) -> Answer:
    """One GET; the body is read up to a byte beyond ``most``."""
    u = urlsplit(url)
    try:
        c = _Pinned(u.hostname or "", u.port or 443, safe_addresses(u.hostname or "", resolve)[0], seconds)
        try:
            c.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"Accept-Encoding": "gzip", **headers})
            got = c.getresponse()
            return Answer(got.status, dict(got.getheaders()), got.read(most + 1))
        finally:
            c.close()
    except (OSError, http.client.HTTPException) as e:
        raise FetchError("transport") from e
