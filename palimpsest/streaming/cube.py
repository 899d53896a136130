"""The metrics cube, kept up to date by a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palimpsest.operators import metrics
from palimpsest.streaming.store import Store


def add(store: Store, events: DataFrame, number: int) -> None:
    """The cells of a batch of events. They are of event time, so a late event counts where it belongs; no watermark drops it."""
    store.write("cells", number, metrics.cells(events))


def follow(store: Store, events: DataFrame) -> DataStreamWriter:
    """A streaming query's writer that adds its batches, each once however often it is run."""
    return events.writeStream.foreachBatch(lambda batch, number: add(store, batch, number))


def cube(store: Store, since_hour: int | None = None) -> DataFrame | None:
    """The cells of all batches, for all time or from an hour on. Cells of one place are several rows, which every reader sums anyway."""
    found = store.read("cells")
    return found if found is None or since_hour is None else found.filter(F.col("hour") >= since_hour)
