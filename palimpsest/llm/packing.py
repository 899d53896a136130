"""Operator 11: packing tokens into windows by minimum bin slack.

A document's ids (an end id closes them) are cut into whole windows, which are
sequences of their own, and a rest shorter than a window. Rests of one length are
interchangeable, so a histogram of lengths, with fewer entries than the window has
places, stands for all of them however many they are.

Minimum bin slack on the histogram: the longest length left opens a window, and a
subset-sum over the remaining multiset, a bitset with one bit per reachable sum,
picks what fills it closest to its capacity; the counts are found by going back
through the bitsets. A multiset that fills the window exactly is used for as many
windows as the counts allow, so steps are bounded by lengths, not by documents.

Where the closest multiset leaves a slack, it would for every rest of that length:
what is left only shrinks. Those rests are laid end to end and cut at every window,
one cut a window, so no slack remains. Their tail, shorter than a window, becomes
sequences whose lengths are powers of two (at most 12 for 4,096), which need no
padding. So padding is zero, and only rests without an exact partner are cut.

A rest knows its place among the rests of its length from counts by task, without a
sort: histogram by (task, length), running sums over tasks. The plan is a table of
(length, ranks from) -> (sequence, offset), broadcast: each of its steps uses up or
at least halves the count of a length below the multiple it needs, so there are
at most about 10,000 steps of at most 90 lengths for a window of 4,096.

Null texts count as empty: they have the end id alone. Repeated rows and rows
without an id are packed like others. Empty tables give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, prepare, stored, texts
from palimpsest.llm.token_counts import byte_letters

#: Words and their parts whose ids a worker remembers, and the longest one in bytes; on reaching the number a store starts anew.
STORE_WORDS, STORE_PARTS, LONG_WORD = 1_000_000, 500_000, 100
#: How this family of tokenizers cuts a word into parts (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are cut here; in them normal forms change nothing and lower case is the same everywhere.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\x20\x09-\x0da-z0-9ß-öø-ſ]+")


class WordIds(dict):
    """Ids of texts as little-endian unsigned 32-bit numbers; every word between ASCII white space is encoded once.

    The vocabulary drops white space and its words never span it, so a text's ids are those of its words. A plain word
    is cut into parts, many of which words share, and the vocabulary's own model encodes these; all other words, and
    all words of vocabularies with other rules, are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: How ids are kept in tables.
        self.kept = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in cut.get("pretokenizers", [])]
        known = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and cut["pretokenizers"][0]["pattern"] == {"Regex": PATTERN}
        # parts of special strings are no parts of words
        self.special = [t["content"].encode()[:2] for t in spec["added_tokens"]] if known else [b""]
        self.letters = str.maketrans({b: c for c, b in byte_letters().items()})

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONG_WORD:
            return self.whole(word)
        text = word.decode("utf-8", "replace")
        if any(x in word for x in self.special) or not _PLAIN.fullmatch(text):
            ids = self.whole(word)
        else:
            ids = b"".join([self.parts.get(p) or self.part(p) for p in _PARTS.findall(text.lower())])
        if len(self) >= STORE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def part(self, part: str) -> bytes:
        ids = np.array([t.id for t in self.library.model.tokenize(part.encode().decode("latin-1").translate(self.letters))], dtype="<u4").tobytes()
        if len(self.parts) >= STORE_PARTS:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def whole(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))  # bytes.split cuts at exactly the six ASCII white spaces


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenised(df: DataFrame, path: str, window: int, end_id: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n (tokens), task, whole (its whole windows: crc32 and, if asked, ids), before (whole windows of earlier rows of the task), rest (tokens), rank (among the task's rests of that length), crc32 and ids of the rest."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * window
    whole_type = pa.list_(pa.struct([("crc32", pa.int64()), ("ids", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = word_ids(path), TaskContext.get().partitionId()
        seen, windows = np.zeros(window, dtype=np.int64), 0
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n", "whole", "before", "rest", "rank", "crc32", "ids")}
            for t in texts(b, text_col):
                ids = words.of(t or b"") + tail
                cut = len(ids) // step * step
                whole = [{"crc32": zlib.crc32(part := ids[at : at + step]), "ids": part if keep_ids else None} for at in range(0, cut, step)]
                rest = (len(ids) - cut) // 4
                kept = np.frombuffer(ids, "<u4", offset=cut).astype(words.kept).tobytes()
                for k, v in zip(out, (len(ids) // 4, whole, windows, rest, int(seen[rest]), zlib.crc32(ids[cut:]), kept), strict=True):
                    out[k].append(v)
                windows += len(whole)
                seen[rest] += 1
            yield from as_batches({
                "id": (b.column(0), pa.int64()), "n": (out["n"], pa.int64()), "task": ([task] * b.num_rows, pa.int64()), "whole": (out["whole"], whole_type),
                "before": (out["before"], pa.int64()), "rest": (out["rest"], pa.int32()), "rank": (out["rank"], pa.int64()), "crc32": (out["crc32"], pa.int64()), "ids": (out["ids"], pa.binary()),
            })

    return arrow_map(df, (id_col, text_col), run, "id long, n long, task long, whole array<struct<crc32:long,ids:binary>>, before long, rest int, rank long, crc32 long, ids binary")


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a multiset, at most ``counts`` of each, whose sum comes closest to ``room`` from below. Longest lengths come first."""
    reach, steps = 1, []  # bit s: some multiset has the sum s
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most, part = min(counts[length], room // length), 1
        while most:  # times 1, 2, 4, ... and what is left give every number of times
            part = min(part, most)
            steps.append((length, part, reach))
            reach |= reach << (length * part) & mask
            most, part = most - part, 2 * part
        if reach >> room & 1:
            break
    best, found = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            best -= length * part
            found[length] = found.get(length, 0) + part
    return sorted(found.items(), reverse=True)


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Where the rests of each length go: rows (length, first rank, times in a window or 0, offset, sequence), how many windows come before the laid out rests, and those rests' tokens.

    A row with ``times`` k: rank first + i lies in window sequence + i // k, at offset + (i % k) * length. With 0 the
    rests are laid end to end, and rank first + i begins at place offset + i * length.
    """
    left, used = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0)
    rows, windows, laid = [], 0, 0
    while left:
        longest = max(left)
        opened = {k: v - (k == longest) for k, v in left.items() if v - (k == longest)}
        chosen = dict(fill(opened, window - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        if sum(k * v for k, v in chosen.items()) < window:
            rows.append((longest, used[longest], 0, laid, 0))
            laid += longest * left.pop(longest)
            continue
        times, offset = min(left[k] // v for k, v in chosen.items()), 0
        for k in sorted(chosen, reverse=True):
            rows.append((k, used[k], chosen[k], offset, windows))
            used[k] += times * chosen[k]
            left[k] -= times * chosen[k]
            offset += k * chosen[k]
            if not left[k]:
                del left[k]
        windows += times
    return rows, windows, laid


class Places:
    """The plan as sorted arrays, with the sequences of the laid out rests."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]], windows: int, laid: int, window: int):
        self.rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.keys = self.rows[:, 0] << 48 | self.rows[:, 1]
        self.windows, self.window, self.full = windows, window, laid // window
        #: Starts of the tail's sequences: powers of two, the largest first.
        tail, self.tail = laid % window, []
        at = self.full * window
        for bit in reversed(range(window.bit_length())):
            if tail >> bit & 1:
                self.tail.append(at)
                at += 1 << bit

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of one rest."""
        first, times, offset, sequence = (int(x) for x in self.rows[np.searchsorted(self.keys, length << 48 | rank, "right") - 1, 1:])
        i = rank - first
        if times:
            return [(0, length, sequence + i // times, offset + i % times * length)]
        at, end = offset + i * length, offset + (i + 1) * length
        cuts = [x for x in range(-(-at // self.window) * self.window, min(end, self.full * self.window + 1), self.window) if x > at] + [x for x in self.tail if at < x < end and x > self.full * self.window]
        out, bounds = [], [at, *cuts, end]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            if a < self.full * self.window:
                k, begin = a // self.window, a // self.window * self.window
            else:
                j = max(i for i, x in enumerate(self.tail) if x <= a)
                k, begin = self.full + j, self.tail[j]
            out.append((a - at, b - a, self.windows + k, a - begin))
        return out


def packed_pieces(df: DataFrame, path: str, window: int = 4096, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset (in its sequence), and ids (array of the piece's ids; null unless ``keep_ids``).

    ``window`` is a power of two. ``path`` names a vocabulary file whose words never span white space.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = prepare(df)
    rows = stored(tokenised(df, path, window, end_id, keep_ids, id_col, text_col))
    by_task = rows.filter("rest > 0").groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["rest"]: r["n"] for r in by_task.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # fewer than the window has places
    planned = plan(counts, window)
    laid = sorted({r[0] for r in planned[0] if not r[2]})
    places = spark.sparkContext.broadcast(Places(*planned, window))
    kept = word_ids(path).kept

    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a length has as many rows as there are tasks
    needed = F.lit(keep_ids) | F.col("rest").isin(laid)  # ids of whole rests are not looked at again
    rests = rows.filter("rest > 0").select("id", "n", "task", "rest", "rank", "crc32", F.when(needed, F.col("ids")).alias("ids"))
    ranked = rests.join(by_task.select("task", "rest", earlier.alias("earlier")), ["task", "rest"])
    ranked = ranked.select("id", "n", "rest", (F.col("earlier") + F.col("rank")).alias("rank"), "crc32", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                found = places.value.pieces(r["rest"], r["rank"])
                ids = np.frombuffer(r["ids"], kept).astype("<u4") if r["ids"] is not None else None
                for start, length, sequence, offset in found:
                    own = ids[start : start + length] if ids is not None else None
                    crc = r["crc32"] if length == r["rest"] else zlib.crc32(own.tobytes())
                    out.append((r["id"], r["n"] - r["rest"] + start, length, crc, r["n"], sequence, offset, own.astype(np.int64) if keep_ids else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.list_(pa.int64())], strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    cut = ranked.mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<long>")
    whole = rows.filter("size(whole) > 0").select("id", "n", "task", "before", F.posexplode("whole").alias("k", "w"))
    own = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.conv(F.hex(F.reverse(F.substring(F.col("w.ids"), k * 4 + 1, F.lit(4)))), 16, 10).cast("long"))
    # whole windows are numbered by task, above all planned sequences
    sequence = F.lit(planned[1] + planned[2] // window + 64) + F.shiftleft(F.col("task") + 1, 40) + F.col("before") + F.col("k")
    full = whole.select("id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("w.crc32").alias("ids_crc32"), F.col("n").alias("doc_tokens"), sequence.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.when(F.col("w.ids").isNotNull(), own).alias("ids"))
    return cut.unionByName(full).withColumnRenamed("id", id_col)
