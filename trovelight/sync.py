"""Refreshing one provider's records without disturbing the others."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.catalogue import Catalogue
from trovelight.schema import CATALOGUE_BYTES, METAINFO_BYTES, conform
from trovelight.sources import snapshot as disk
from trovelight.sources.contract import CatalogSnapshot, Source
from trovelight.sources.http import Answer, fetch
from trovelight.sources.metainfo import MetainfoError, inspect_metainfo
from trovelight.sources.xml import check_item_record, item_records, parse_items

SYNC_SECONDS = 30.0


def replace_provider(existing: DataFrame, fresh: DataFrame, provider: str) -> DataFrame:
    """The records with one provider's rows replaced; fresh rows of other providers raise an error."""
    foreign = F.raise_error(F.concat(F.lit("foreign provider "), F.coalesce("provider", F.lit("null"))))
    own = conform(fresh).where(F.when(F.col("provider") == provider, True).otherwise(foreign.cast("boolean")))
    return conform(existing).where(~F.col("provider").eqNullSafe(provider)).unionByName(own)


@dataclass
class XmlProvider:
    """A provider whose catalogue is one XML file behind a conditional fetch, with a snapshot on disk."""

    spark: SparkSession
    name: str
    origin: str
    send: Callable[[str, dict], Answer]
    folder: Path
    path: str = "/database.xml"

    def _snapshot(self) -> Path:
        return self.folder / disk.safe_name(f"{self.name}.json")

    def sync(self) -> CatalogSnapshot:
        """Fetch what is new; an unchanged catalogue comes from the snapshot, and nothing is saved."""
        held = disk.load(self._snapshot(), self.name)
        held.records = [check_item_record(r, self.name, self.origin) for r in held.records]
        got = fetch(self.origin, self.path, self.send, deadline=time.monotonic() + SYNC_SECONDS, etag=held.etag if held.records else "", last_modified=held.last_modified if held.records else "", most=CATALOGUE_BYTES)
        if got.unchanged:
            if not held.records:
                raise disk.SnapshotError("unchanged, but there is no snapshot")
            return CatalogSnapshot(held.frame(self.spark), True)
        first: dict[str, dict] = {}
        for item in parse_items(got.body):
            first.setdefault(item["infohash"], item)
        items = self.spark.createDataFrame([tuple(i[c] for c in ("title", "category", "infohash", "description", "size_bytes")) for i in first.values()], "title string, category string, infohash string, description string, size_bytes long")
        records = item_records(items, self.name, self.origin)
        fresh = disk.Snapshot(got.etag, got.last_modified, [r.asDict(recursive=True) for r in records.collect()])  # bounded by the catalogue's size
        disk.save(self._snapshot(), fresh)
        return CatalogSnapshot(fresh.frame(self.spark))

    def resolve(self, source_id: str, infohash_v1: str) -> Source:
        """The metainfo of a record, its hash checked."""
        if source_id != infohash_v1:
            raise MetainfoError("another record")
        got = fetch(self.origin, f"/download/{infohash_v1}.torrent", self.send, deadline=time.monotonic() + SYNC_SECONDS, most=METAINFO_BYTES)
        if not got.body or inspect_metainfo(got.body)["infohash_v1"] != infohash_v1:
            raise MetainfoError("another hash")
        return Source(metainfo=got.body)


def sync(catalogue: Catalogue, provider: XmlProvider) -> str:
    """Refresh a provider and publish the result: ``updated`` or ``unchanged``.

    Whatever fails, the live generation stays as it was.
    """
    existing = catalogue.scan() if catalogue.open() else None
    snapshot = provider.sync()
    if snapshot.records.isEmpty():
        raise disk.SnapshotError("empty catalogue")
    rows = conform(snapshot.records) if existing is None else replace_provider(existing, snapshot.records, provider.name)
    catalogue.rebuild(rows)
    return "unchanged" if snapshot.unchanged else "updated"


def infohash_matches(info: bytes, infohash_v1: str) -> bool:
    return hashlib.sha1(info).hexdigest() == infohash_v1
