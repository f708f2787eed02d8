"""Persisted catalogues: immutable generations, published by renaming and recovered on open."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.operators.grouping import Limits, build_records, build_sound_records
from trovelight.operators.index import DOCUMENT, Index, arranged, build_index, document_words
from trovelight.operators.records import normalize_records, require_valid, split_records, with_identity
from trovelight.plans.query import parse
from trovelight.plans.search import search, search_many
from trovelight.schema import FIELDS
from trovelight.session import compact, freed_shuffles, stored

MANIFEST, VERSION = "_GENERATION.json", 2
TABLES = ("records", "postings", "lengths", "terms")


class CatalogueError(RuntimeError):
    """A generation that can't be read or published."""


class Catalogue:
    """One live generation under ``root`` (a folder all executors share, on a file system with rename).

    ``root.building`` is written first, from steps in ``root.work``, then takes the place of ``root``,
    which becomes ``root.previous``; any failure leaves the live generation in place. Readers keep the files of the
    generation they opened.
    """

    def __init__(self, spark: SparkSession, root: str, limits: Limits | None = None):
        self.spark, self.root, self.limits = spark, Path(root), limits
        self.building, self.previous, self.failed, self.work = (self.root.with_name(self.root.name + s) for s in (".building", ".previous", ".failed", ".work"))

    # lifecycle

    def _state(self, at: Path) -> str:
        """``absent``, ``empty``, ``corrupt`` or ``ok``."""
        if at.is_symlink() or (at.exists() and not at.is_dir()):
            raise CatalogueError(f"{at.name} is no folder")
        if not at.exists():
            return "absent"
        if not any(at.iterdir()):
            return "empty"
        try:
            counts = json.loads((at / MANIFEST).read_text())
            if counts["version"] != VERSION or any(not (at / t / "_SUCCESS").exists() for t in TABLES):
                return "corrupt"
        except (OSError, ValueError, KeyError):
            return "corrupt"
        return "ok" if counts["tables"]["records"] else "empty"

    def open(self) -> bool:
        """Make a whole generation live if there is one; False where none was ever built."""
        live, before = self._state(self.root), self._state(self.previous)
        if live == "ok":
            return True
        if live == "empty":
            shutil.rmtree(self.root)
            live = "absent"
        if before == "ok":
            if live == "corrupt":
                shutil.rmtree(self.failed, ignore_errors=True)
                os.rename(self.root, self.failed)
            os.rename(self.previous, self.root)
            return True
        if before == "empty":
            shutil.rmtree(self.previous)
        if live == "corrupt" or before == "corrupt":
            raise CatalogueError("no generation can be read")
        return False

    def rebuild(self, raw: DataFrame, strict: bool = True) -> dict[str, int]:
        """Build and publish a generation of provider rows; returns its row counts.

        ``strict``: one invalid row or contradicting source fails the build; else such rows and
        sources go to the generation's quarantine with their reasons.
        """
        normal = normalize_records(raw)
        shutil.rmtree(self.work, ignore_errors=True)
        try:
            with freed_shuffles(self.spark):
                if strict:
                    records, left_out = build_records(require_valid(normal), self._keep), None
                else:
                    valid, invalid = split_records(self._keep(normal, "normal"))
                    invalid = self._keep(invalid.select(*FIELDS, "errors"), "invalid")
                    records, clashing = build_sound_records(valid, self._keep)
                    left_out = invalid.unionByName(clashing)
                shutil.rmtree(self.work / "normal")  # merged by now
                return self.publish(records, left_out)
        finally:
            shutil.rmtree(self.work, ignore_errors=True)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """A step of the build, on disk until the next one has read it."""
        return stored(df, f"{self.work}/{name}")

    def publish(self, records: DataFrame, quarantine: DataFrame | None = None) -> dict[str, int]:
        """Write, verify and make live a generation of grouped records, if it keeps the catalogue's limits."""
        for at in (self.root, self.previous, self.building):
            self._state(at)
        shutil.rmtree(self.building, ignore_errors=True)
        self.building.parent.mkdir(parents=True, exist_ok=True)
        try:
            compact(with_identity(arranged("records", records.drop("completeness", "source"))), f"{self.building}/records")  # what can be told again doesn't move
            if self.limits:
                self.limits.check(self.spark.read.parquet(f"{self.building}/records"))
            if quarantine is not None:
                quarantine.write.parquet(f"{self.building}/quarantine")
            shutil.rmtree(self.work, ignore_errors=True)
            whole = self.spark.read.parquet(f"{self.building}/records")
            index = build_index(whole, self._keep(document_words(whole), "words"))
            for name in TABLES[1:]:
                compact(arranged(name, index.tables()[name]), f"{self.building}/{name}")
            shutil.rmtree(self.work)
            counts = {t: self.spark.read.parquet(f"{self.building}/{t}").count() for t in TABLES}
            documents = self.spark.read.parquet(f"{self.building}/lengths").select(*DOCUMENT).distinct().count()
            (self.building / MANIFEST).write_text(json.dumps({"version": VERSION, "tables": counts, "documents": documents}))
        except Exception:
            for at in (self.building, self.work):
                shutil.rmtree(at, ignore_errors=True)
            raise
        had = self.root.exists()
        if had:
            shutil.rmtree(self.previous, ignore_errors=True)
            os.rename(self.root, self.previous)
        try:
            os.rename(self.building, self.root)
        except OSError:
            if had:
                os.rename(self.previous, self.root)
            raise
        try:
            self.verify()
        except Exception:
            shutil.rmtree(self.failed, ignore_errors=True)
            os.rename(self.root, self.failed)
            if had:
                os.rename(self.previous, self.root)
            raise
        return counts

    def verify(self) -> None:
        """Raise unless every table holds the rows the manifest says."""
        said = json.loads((self.root / MANIFEST).read_text())["tables"]
        for t in TABLES:
            if (n := self.spark.read.parquet(f"{self.root}/{t}").count()) != said[t]:
                raise CatalogueError(f"{t} holds {n} rows, not {said[t]}")

    # reading

    def index(self) -> Index:
        if self._state(self.root) != "ok":
            raise CatalogueError("not initialised")
        said = json.loads((self.root / MANIFEST).read_text())
        return Index(*[self.spark.read.parquet(f"{self.root}/{t}") for t in TABLES], said["documents"])

    def quarantine(self) -> DataFrame:
        """Rows and sources left out of the generation, with ``errors``; none of one built strictly."""
        if (self.root / "quarantine").exists():
            return self.spark.read.parquet(f"{self.root}/quarantine")
        return self.scan().where("false").withColumn("errors", F.array().cast("array<string>"))

    def scan(self) -> DataFrame:
        """Every source once, in no order."""
        return self.index().records.select(*FIELDS)

    def records(self) -> DataFrame:
        """Every source once, by provider and source_id."""
        return self.scan().orderBy("provider", "source_id")

    def search(self, text: str, limit: int | None = None) -> DataFrame:
        return search(self.index(), parse(text), limit)

    def search_many(self, texts: Sequence[str], limit: int | None = None) -> DataFrame:
        """The hits of several queries in one plan, by their place ``q``."""
        return search_many(self.index(), [parse(t) for t in texts], [limit] * len(texts))
