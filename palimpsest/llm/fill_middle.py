"""Operator 13: fill-in-middle transformation over run-length class encodings.

A text is stored as its maximal runs of one character class: white space, or
other characters of 1, 2, 3 or 4 bytes. Each run has its end in bytes and in
code points and the units that are complete by then. Every unit inside a run
is of one width, so the place after any number of units is found without
looking at the text again: binary search for the run that holds it, then

    place = start of the run + (units - units before the run) * width

Units are words (white space before a word belongs to it, white space at the end
is a unit of its own; a run ends one unit or none) or single characters.

A text of n units is cut after min and max of h1 % (n + 1) and h2 % (n + 1) units
into prefix, middle and suffix; h1 to h4 are the first four 32-bit groups of
sha256("seed:id"). h3 decides whether it is transformed at all, h4 the form:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle

Texts that contain one of the marks stay plain, so the original can always be
rebuilt from output and form (``restored``), byte for byte. Null texts count as
empty ones, which are plain with 0 units. Rows without an id are hashed with an
empty one. Repeated rows are transformed alike. A text costs one pass and memory
in proportion to it; rows never meet, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Class of a byte: 0 white space, 1 to 4 a character of so many bytes, 5 inside a character.
_CLASS = np.ones(256, dtype=np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 5, 2, 3, 4


class Runs:
    """The runs of one text: ``ends`` (bytes), ``chars`` (code points) and ``units`` so far, with a zero in front."""

    def __init__(self, data: bytes, unit: str = "word"):
        kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)]
        leads = np.flatnonzero(kinds != 5)
        kinds = kinds[leads]
        first = np.flatnonzero(np.diff(kinds, prepend=255)) if len(kinds) else leads
        self.kinds = kinds[first]
        self.chars = np.append(first, len(kinds)).astype(np.int64)
        self.ends = np.append(leads[first], len(data)).astype(np.int64)
        if len(first):
            self.ends[0] = 0
        if unit == "char":
            self.units = self.chars
        else:  # a word ends with its last run; white space at the end of the text is a unit
            space = self.kinds == 0
            done = np.append(space[1:], True) & ~space
            if len(space):
                done[-1] = True
            self.units = np.concatenate(([0], np.cumsum(done))).astype(np.int64)

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def place(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before which exactly the first ``units`` units lie."""
        if not units:
            return 0, 0
        r = int(np.searchsorted(self.units, units, "left"))
        inside, whole = units - int(self.units[r - 1]), int(self.units[r] - self.units[r - 1])
        return tuple(int(x[r - 1]) + inside * (int(x[r] - x[r - 1]) // whole) for x in (self.ends, self.chars))


def draws(seed: int, row_id: int | None) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()[:16])


def transform(data: bytes, row_id: int | None, seed: int, rate: int, spm_rate: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, code points of prefix and of middle, output) of one text."""
    runs = Runs(data, unit)
    h1, h2, h3, h4 = draws(seed, row_id)
    if not data or h3 % 100 >= rate or any(m in data for m in _MARKS):
        return runs.n, "plain", None, None, data
    low, high = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    (a, a_chars), (b, b_chars) = runs.place(low), runs.place(high)
    p, s, m = _MARKS
    parts = (s, data[b:], p, data[:a], m, data[a:b]) if h4 % 100 < spm_rate else (p, data[:a], s, data[b:], m, data[a:b])
    return runs.n, "spm" if parts[0] == s else "psm", a_chars, b_chars - a_chars, b"".join(parts)


def transformed(df: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars, output. ``rate`` and ``spm_rate`` are percentages: of all texts, and of those that are transformed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            n, form, prefix, middle, out = zip(*(transform(t or b"", i, seed, rate, spm_rate, unit) for i, t in zip(ids, texts(b, text_col), strict=True)), strict=True) if ids else ((),) * 5
            yield from as_batches({
                id_col: (ids, pa.int64()), "n": (n, pa.int64()), "form": (form, pa.string()), "prefix_chars": (prefix, pa.int64()), "middle_chars": (middle, pa.int64()),
                "output": (pa.array(out, pa.binary()).cast(pa.string()), pa.string()),
            })

    return arrow_map(df, (id_col, text_col), run, f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The original text, from output and form alone."""

    def between(mark: str, following: str | None) -> Column:
        rest = F.substring_index(output, mark, -1)
        return rest if following is None else F.substring_index(rest, following, 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def class_runs(df: DataFrame, unit: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and runs (class, and bytes, code points and units up to its end), to be stored beside the corpus."""
    kind = pa.list_(pa.struct([("class", pa.int32()), ("bytes", pa.int64()), ("chars", pa.int64()), ("units", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts(b, text_col), strict=True):
                r = Runs(t or b"", unit)
                found = pa.StructArray.from_arrays([pa.array(r.kinds, pa.int32()), *(pa.array(x[1:], pa.int64()) for x in (r.ends, r.chars, r.units))], fields=list(kind.value_type))
                yield from as_batches({id_col: ([i], pa.int64()), "runs": (pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found).cast(kind), kind)})

    return arrow_map(df, (id_col, text_col), run, f"`{id_col}` long, runs array<struct<class:int,bytes:long,chars:long,units:long>>")


def cut_places(tables: DataFrame, units: Column) -> Column:
    """Of a row of ``class_runs``: struct (bytes, chars) of the place after ``units`` units, looked up without the text. Null beyond the last unit."""
    none = F.struct(F.lit(0).alias("class"), *[F.lit(0).cast("long").alias(c) for c in ("bytes", "chars", "units")])
    at = F.array_position(F.transform(tables["runs"], lambda r: r["units"] >= units), F.lit(True)).cast("int")
    run, before = F.try_element_at(tables["runs"], at), F.when(at > 1, F.try_element_at(tables["runs"], at - 1)).otherwise(none)
    share = lambda c: (before[c] + (units - before["units"]) * ((run[c] - before[c]) / (run["units"] - before["units"])).cast("long")).alias(c)
    zero = F.struct(none["bytes"].alias("bytes"), none["chars"].alias("chars"))
    return F.when(units == 0, zero).when(at > 0, F.struct(share("bytes"), share("chars")))
