"""Snapshots as a stream: each micro-batch replaces the rows of the providers it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovelight.catalogue import Catalogue
from trovelight.schema import conform


def latest_snapshots(batch: DataFrame) -> DataFrame:
    """Of a batch with ``delivered_at``, each provider's rows of its latest delivery."""
    last = batch.groupBy("provider").agg(F.max("delivered_at").alias("delivered_at"))
    return batch.join(last, ["provider", "delivered_at"], "left_semi")


def merge_stream(stream: DataFrame, catalogue: Catalogue, checkpoint: str) -> StreamingQuery:
    """Keep a catalogue in step with a stream of whole snapshots (records with ``delivered_at``).

    A batch's providers are replaced, the others stay; a batch run again gives the same generation.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        fresh = latest_snapshots(batch)
        rows = conform(fresh)
        if catalogue.open():
            kept = catalogue.scan().join(fresh.select("provider").distinct(), "provider", "left_anti")
            rows = conform(kept).unionByName(rows)
        catalogue.rebuild(rows, strict=False)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
