"""Sessions that go on: each batch of new messages is stored, and the requests that it brings are encoded.

What a session remembers is a function of its ordered messages, so the store
holds those (first content, role and place of each), what was computed for each
distinct text (``store.Memo``: originals, sizes, names, lines, codes, forms), and
the answered requests. Entities, digests and used codes follow from these by
joins and windows over the touched sessions; patterns run on new texts only.

Batches may come in any order, in any cut, and more than once. A message that
comes late changes what the requests after it send: those are answered again,
and the answer of the latest batch holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palimpsest.functions.config import Settings
from palimpsest.functions.tokens import estimate
from palimpsest.operators.automaton import Dictionary
from palimpsest.plans import intervals, replay
from palimpsest.streaming.store import Memo, Store

MESSAGE = ("role", "content", "has_tool_calls")


@dataclass(frozen=True)
class Sessions:
    """A store of sessions under one dictionary, one counter and one set of settings. ``ask`` gives the requests of messages, with scope, version and profile if need be."""

    store: Store
    settings: Settings
    known: Dictionary | None = None
    size: Callable[[Column], Column] = estimate
    ask: Callable[[DataFrame], DataFrame] = replay.requests

    def advance(self, batch: DataFrame, number: int) -> None:
        """Takes messages (conv_id, idx, role, content, has_tool_calls) in. Of a message that comes again, the first content stays; one without conversation or place belongs nowhere and is left out."""
        said = batch.filter("conv_id is not null and idx is not null").groupBy("conv_id", "idx").agg(F.min(F.struct(*MESSAGE)).alias("m")).select("conv_id", "idx", "m.*")
        before = self.store.read("messages", number)
        if before is not None:  # looked up by conversation and place
            said = said.join(before.select("conv_id", "idx").distinct(), ["conv_id", "idx"], "left_anti")
        self.store.write("messages", number, said.sortWithinPartitions("conv_id", "idx"))

        now = self.store.read("messages", number + 1)
        changed = now.filter(F.col("batch") == number).groupBy("conv_id").agg(F.min("idx").alias("changed"))
        messages = now.drop("batch").join(changed.select("conv_id"), "conv_id", "left_semi")
        asked = self.ask(messages)
        _, answers = intervals.encoded(messages, asked, self.settings, self.known, size=self.size, memo=Memo(self.store, number))
        due = asked.select("conv_id", "req_no", "last_idx").join(changed, "conv_id").filter("last_idx >= changed").drop("changed")
        self.store.write("requests", number, answers.join(due, ["conv_id", "req_no"]))

    def messages(self) -> DataFrame | None:
        """All messages so far, each once."""
        found = self.store.read("messages")
        return None if found is None else found.drop("batch")

    def answers(self) -> DataFrame | None:
        """The answer to each request (conv_id, req_no) so far: that of the latest batch."""
        found = self.store.read("requests")
        if found is None:
            return None
        latest = found.groupBy("conv_id", "req_no").agg(F.max("batch").alias("batch"))
        return found.join(latest, ["conv_id", "req_no", "batch"]).drop("batch")

    def compact(self, before: int, files: int = 1) -> None:
        """Lays the batches before a number together."""
        for name in ("messages", "requests", "texts", "lines", "codes", "judgements"):
            self.store.compact(name, before, files)

    def follow(self, messages: DataFrame) -> DataStreamWriter:
        """A streaming query's writer that takes its batches in. A batch that is run again replaces its first run."""
        return messages.writeStream.foreachBatch(self.advance)
