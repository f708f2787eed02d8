"""What a provider offers."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Source:
    """A resolved payload: one of a magnet, an address or a body."""

    magnet_uri: str = ""
    torrent_url: str = ""
    metainfo: bytes = b""


@dataclass(frozen=True)
class CatalogSnapshot:
    """A provider's whole catalogue, or the news that it hasn't changed."""

    records: DataFrame
    unchanged: bool = False


@runtime_checkable
class CatalogSyncer(Protocol):
    name: str

    def sync(self) -> CatalogSnapshot: ...


@runtime_checkable
class Resolver(Protocol):
    def resolve(self, source_id: str, infohash_v1: str) -> Source: ...


@runtime_checkable
class Searcher(Protocol):
    def search(self, text: str, limit: int) -> DataFrame: ...


@runtime_checkable
class HealthChecker(Protocol):
    def healthy(self) -> bool: ...
