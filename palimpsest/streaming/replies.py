"""Reply streams decoded by numbered batches.

Each batch writes what its sessions said, and of all sessions that are still
open what they hold back and whether a word character came before. The next one
reads only that, so its work is that of its own deltas and of the open sessions;
a batch that is run again replaces its first run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.streaming.decoder import decoded_batch
from palimpsest.streaming.store import Store

HELD = "session string, held string, after_word boolean"


def advance(store: Store, number: int, deltas: DataFrame, expansions: dict[str, str], originals: dict[str, str] | None = None) -> None:
    """Decodes a batch of deltas (session, seq, delta, done)."""
    held = store.last("held", number)
    held = store.spark.createDataFrame([], HELD) if held is None else held.select("session", "held", "after_word")
    store.write("said", number, decoded_batch(deltas, held, expansions, originals))
    now = store.one("said", number)
    still = held.join(now.select("session"), "session", "left_anti")
    store.write("held", number, now.filter("not ended").select("session", "held", "after_word").unionByName(still))


def said(store: Store) -> DataFrame:
    """What has come out so far: session, out."""
    rows = store.read("said")
    if rows is None:
        return store.spark.createDataFrame([], "session string, out string")
    ordered = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("seqs", "texts"))))
    return rows.groupBy("session").agg(ordered.alias("rows")).select("session", F.array_join(F.col("rows.texts"), "").alias("out"))
