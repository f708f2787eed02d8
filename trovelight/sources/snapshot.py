"""Snapshots of one provider's records on disk, and their atomic replacement."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from trovelight.schema import BODY_BYTES, CATALOGUE_RECORDS, FIELDS, RECORD, SNAPSHOT_VERSION

_RESERVED = re.compile(r"(?i)(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?")


class SnapshotError(ValueError):
    """A snapshot that can't be used."""


@dataclass
class Snapshot:
    etag: str = ""
    last_modified: str = ""
    records: list[dict] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The records as provider rows."""
        day = {"published_at"}
        rows = [tuple(_day(r.get(n)) if n in day else r.get(n) for n in FIELDS) for r in self.records]
        return spark.createDataFrame(rows, RECORD)


def _day(text):
    from datetime import date

    return date.fromisoformat(text[:10]) if text else None


def safe_name(name: str) -> str:
    """A plain file name, on any system."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}", name) or name.endswith(".") or _RESERVED.fullmatch(name):
        raise SnapshotError("file name")
    return name


def replace_file(path: Path, body: bytes) -> None:
    """Put a whole file in place of another: a crash leaves the old or the new one."""
    safe_name(path.name)
    handle, part = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def save(path: Path, snapshot: Snapshot) -> None:
    body = (json.dumps({"schema_version": SNAPSHOT_VERSION, "etag": snapshot.etag, "last_modified": snapshot.last_modified, "records": snapshot.records}, ensure_ascii=False, default=str) + "\n").encode()
    if len(body) > BODY_BYTES:
        raise SnapshotError("too large")
    replace_file(path, body)


def load(path: Path, provider: str) -> Snapshot:
    """The snapshot, empty if there is none; unknown keys, foreign rows and trailing text are errors."""
    if path.is_symlink():
        raise SnapshotError("symlink")
    if not path.exists():
        return Snapshot()
    raw = path.read_bytes()
    if len(raw) > BODY_BYTES:
        raise SnapshotError("too large")
    try:
        doc = json.loads(raw)
    except ValueError as e:
        raise SnapshotError("no JSON") from e
    if not isinstance(doc, dict) or set(doc) - {"schema_version", "etag", "last_modified", "records"} or doc.get("schema_version") != SNAPSHOT_VERSION:
        raise SnapshotError("format")
    records = doc.get("records")
    if not isinstance(records, list) or not 0 < len(records) <= CATALOGUE_RECORDS:
        raise SnapshotError("records")
    if any(not isinstance(r, dict) or set(r) - set(FIELDS) or r.get("provider") != provider for r in records):
        raise SnapshotError("record")
    return Snapshot(doc.get("etag") or "", doc.get("last_modified") or "", records)
