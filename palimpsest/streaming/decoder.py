"""Incremental decoding of reply streams, per session, with held-back tails.

A delta may end inside a code or a reference; that tail waits for the next
delta. Whether a word character came before is kept too, so that a code right
after one is no code, whether or not a chunk ends between them: the stream gives
exactly what decoding the whole reply would.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Where a code or a reference begins, what they are, and from which length on an open reference no longer waits.
BEGIN = re.compile(r"[KPE\[]")
CODE = re.compile(r"[KPE]\d*")
HEADS = ("[ref:", "[code:")
HASHED = re.compile(r"\[(?:ref|code):([0-9a-f]{16})")
REFERENCE = re.compile(r"\[(?:ref|code):([0-9a-f]{16})[^\]]*\]")
LONGEST = 48
#: Sessions of an Arrow batch that a worker holds as Python objects at once.
SESSIONS = 200


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _may_become_reference(rest: str) -> bool:
    """Whether a text without a closing bracket can still grow into a reference."""
    if len(rest) > LONGEST:
        return False
    return bool(HASHED.match(rest)) or any(h.startswith(rest) or rest.startswith(h) and set(rest[len(h) :]) <= set("0123456789abcdef") for h in HEADS)


def scan(source: str, after_word: bool, ended: bool, expansions: dict[str, str], originals: dict[str, str]) -> tuple[str, str, bool]:
    """One pass over a text: what can be said, what has to wait for more, and whether a word character comes right before that."""
    out: list[str] = []
    at, close = 0, -1
    while found := BEGIN.search(source, at):
        start = found.start()
        if start > at:
            out.append(source[at:start])
            after_word = _is_word(source[start - 1])
        if found[0] == "[":
            whole = REFERENCE.match(source, start)
            if not whole and close is not None and close < start:  # the next closing bracket is looked for once, not for every opening one
                close = source.find("]", start)
                close = None if close < 0 else close
            if not whole and not ended and close is None and len(source) - start <= LONGEST and _may_become_reference(source[start:]):
                return "".join(out), source[start:], after_word
            known = originals.get(whole[1]) if whole else None
            out.append("[" if known is None else known)
            at, after_word = start + 1 if known is None else whole.end(), False
            continue
        end = CODE.match(source, start).end()
        if after_word:  # inside a word
            end = start + 1
            out.append(source[start])
        elif end == len(source) and not ended:
            return "".join(out), source[start:], False
        elif end == start + 1 or end < len(source) and _is_word(source[end]):
            out.append(source[start:end])
        else:
            out.append(expansions.get(source[start:end], source[start:end]))
        at, after_word = end, True
    out.append(source[at:])
    return "".join(out), "", _is_word(source[-1]) if at < len(source) else after_word


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in ``spark.checkpoint.dir``; a temporary one only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def decode_stream(deltas: DataFrame, expansions: dict[str, str], originals: dict[str, str] | None = None, idle: str = "NoTimeout") -> DataFrame:
    """Streaming deltas (session, seq, delta, done): session, seq, text. ``done`` empties what is held.

    State is one short text per session; ``idle`` is a group state timeout,
    after which a session that never ended is flushed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, after_word = state.get if state.exists else ("", False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "seq": [-1], "text": [scan(held, after_word, True, expansions, originals or {})[0]]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        out, ended = [], False
        for delta, done in zip(rows["delta"].fillna(""), rows["done"], strict=True):
            piece, held, after_word = scan(held + delta, after_word, bool(done), expansions, originals or {})
            ended = ended or bool(done)
            out.append(piece)
        if ended:
            state.remove()
        else:
            state.update((held, after_word))
            if idle == GroupStateTimeout.ProcessingTimeTimeout:
                state.setTimeoutDuration(600_000)
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"].to_numpy(), "text": out})

    return deltas.groupBy("session").applyInPandasWithState(step, "session string, seq long, text string", "held string, after_word boolean", "append", idle)


def decoded_batch(deltas: DataFrame, held: DataFrame, expansions: dict[str, str], originals: dict[str, str] | None = None) -> DataFrame:
    """A batch of deltas (session, seq, delta, done) after what earlier ones left (session, held, after_word), one row per session: session, seqs, texts, held, after_word, ended.

    The same as ``decode_stream`` for sessions without a timeout. Workers take
    sessions by whole Arrow batches, so that none costs a group of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SESSIONS):
                b = whole.slice(at, SESSIONS)
                texts, helds, words, ends = [], [], [], []
                for said, dones, rest, after_word in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                    out, ended = [], False
                    for delta, done in zip(said, dones, strict=True):
                        piece, rest, after_word = scan(rest + (delta or ""), after_word, bool(done), expansions, originals or {})
                        ended = ended or bool(done)
                        out.append(piece)
                    texts.append(out)
                    helds.append(rest)
                    words.append(after_word)
                    ends.append(ended)
                made = [pa.array(texts, pa.list_(pa.string())), pa.array(helds, pa.string()), pa.array(words, pa.bool_()), pa.array(ends, pa.bool_())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["session", "seqs", "texts", "held", "after_word", "ended"])

    rows = deltas.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", "delta", "done"))).alias("rows")).join(held, "session", "left")
    apart = rows.select("session", F.col("rows.seq").alias("seqs"), "rows.delta", "rows.done", F.coalesce("held", F.lit("")).alias("held"), F.coalesce("after_word", F.lit(False)).alias("after_word"))
    return apart.mapInArrow(run, "session string, seqs array<bigint>, texts array<string>, held string, after_word boolean, ended boolean")


def decoded(deltas: list[str], expansions: dict[str, str], originals: dict[str, str] | None = None) -> Iterator[str]:
    """The same over an iterable of deltas."""
    held, after_word = "", False
    for delta in deltas:
        piece, held, after_word = scan(held + delta, after_word, False, expansions, originals or {})
        if piece:
            yield piece
    rest, _, _ = scan(held, after_word, True, expansions, originals or {})
    if rest:
        yield rest
