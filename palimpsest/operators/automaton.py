"""Dictionaries that differ by row: each text is coded by the forms of its own scope and generation.

A chain of thousands of replacements for every text is out of the question, a plan can't hold a chain per scope, and a
task can't hold a large scope's forms. So forms and texts meet by keys: what every match of a form must hold, or its
first characters, is hashed, and so is every stretch of a text that is as long as some key of its scope and generation.
Both are dealt by hash, so a task holds the forms of a few hashes, and rows are linear in forms and in texts. Only the
forms that a text has the key of are then applied, in the dictionary's order and by the same replacement as a whole
chain would: forms that hold a code, which an earlier replacement may bring, and forms with nothing literal are always
tried. Of equal literal forms the first leaves nothing to the others, which are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.config import Settings
from palimpsest.functions.strings import folded, required
from palimpsest.operators import dictionary
from palimpsest.streaming.store import written

#: Characters of a key at most, buckets that hashes are dealt to, and characters of texts that are hashed at once.
KEY, BUCKETS, CHARS = 24, 4096, 400_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_CODE = re.compile(r"[kpe]\d")
_PLAIN = re.compile(r"\(\?iU\)([\w ]+)")


def _literal(pattern: str) -> str:
    plain = _PLAIN.fullmatch(pattern)
    return folded(plain[1]) if plain else required(pattern)


class Finder:
    """The forms (rank, pattern, code) of one scope and generation, where they are at hand: finds by an automaton what ``hits`` finds by keys."""

    def __init__(self, forms: list[tuple[int, str, str]]):
        import ahocorasick

        literals = [required(pattern) for _, pattern, _ in forms]
        self.forms, self.always = forms, [k for k, literal in enumerate(literals) if not literal or _CODE.search(literal)]
        by_literal: dict[str, list[int]] = {}
        for k, literal in enumerate(literals):
            if literal:
                by_literal.setdefault(literal, []).append(k)
        self.words = ahocorasick.Automaton()
        for literal, ks in by_literal.items():
            self.words.add_word(literal, ks)
        if by_literal:
            self.words.make_automaton()
        self.any = bool(by_literal)

    def of(self, text: str) -> list[tuple[int, str, str]]:
        """Forms that may match, in order."""
        hit = set(self.always)
        if self.any:
            for _, ks in self.words.iter(folded(text)):
                hit.update(ks)
        return sorted(self.forms[k] for k in hit)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Stretches:
    """Hashes of stretches of folded texts: differences of running sums of characters by powers, brought back to the first power."""

    def __init__(self, texts: list[str]):
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(_U)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.left = np.repeat(self.ends, sizes) - np.arange(len(chars))
        self.sums = np.concatenate([[_U(0)], np.cumsum(_mixed(chars + _U(1)) * np.cumprod(np.full(len(chars), _BASE, dtype=_U)))])
        self.back = np.cumprod(np.full(len(chars), _BACK, dtype=_U))

    def hashes(self, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        return _mixed(_mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U)) ^ place)


def _place() -> Column:
    return F.xxhash64("scope", F.col("version").cast("long"))


def keyed(forms: DataFrame) -> DataFrame:
    """Forms (scope, version, pattern, code) with n (characters of the key; null: always tried), hash and bucket of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            keys = ["" if _CODE.search(t) else t[:KEY] for t in map(_literal, b.column(3).to_pylist())]
            s = _Stretches([k or " " for k in keys])
            h = s.hashes(s.starts, s.ends, b.column(0).to_numpy().view(_U))
            n = pa.array([len(k) or None for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n, pa.array(h.view(np.int64)), pa.array((h % _U(BUCKETS)).astype(np.int32))], names=["scope", "version", "pattern", "code", "n", "hash", "bucket"])

    rows = forms.select(_place().alias("place"), "scope", F.col("version").cast("long").alias("version"), "pattern", "code")
    return rows.mapInArrow(run, "scope string, version long, pattern string, code string, n int, hash long, bucket int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, place, lengths, text) as hashes of their stretches, a row for each bucket: bucket, hashes, ids."""
    for b in filter(len, batches):
        ids, places = b.column(0).to_numpy(), b.column(1).to_numpy().view(_U)
        lengths, texts = b.column(2).to_pylist(), list(map(folded, b.column(3).to_pylist()))
        sizes = np.cumsum([len(t) for t in texts])
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // CHARS)) + 1):
            s = _Stretches([texts[k] for k in part])
            hashes, owners = [], []
            for n in sorted({n for k in part for n in lengths[k]}):
                wants = np.array([n in lengths[k] for k in part])
                at = np.flatnonzero((s.left >= n) & wants[s.text])
                own = part[s.text[at]]
                hashes.append(s.hashes(at, at + n, places[own]))
                owners.append(ids[own])
            if not hashes:
                continue
            h, own = np.concatenate(hashes), np.concatenate(owners)
            bucket = (h % _U(BUCKETS)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, own, bucket = h[order], own[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            offsets = pa.py_buffer((np.append(cuts, len(h)) * 8).astype(np.int32))
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(x)])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), binary(h), binary(own)], names=["bucket", "hashes", "ids"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, forms (kind 0: hash, pattern, code) before texts (kind 1: hashes, ids): id, pattern, code."""
    current, tables, known = None, [], None
    for b in batches:
        bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64) * 2 + kind, prepend=-1)), len(bucket))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if bucket[i] != current:
                current, tables, known = bucket[i], [], None
            if kind[i] == 0:
                tables.append(b.slice(i, j - i).select(["hash", "pattern", "code"]))
                continue
            if not tables:
                continue
            if known is None:
                forms = pa.Table.from_batches(tables)
                h = forms.column("hash").to_numpy()
                order = np.argsort(h)
                known = h[order], order, forms
            h, order, forms = known
            texts = b.slice(i, j - i)
            asked = np.frombuffer(b"".join(texts.column("hashes").to_pylist()), dtype=np.int64)
            ids = np.frombuffer(b"".join(texts.column("ids").to_pylist()), dtype=np.int64)
            first = np.searchsorted(h, asked)
            there = np.flatnonzero(h[np.minimum(first, len(h) - 1)] == asked)
            first, ids = first[there], ids[there]
            many = np.searchsorted(h, asked[there], side="right") - first
            form = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs = np.unique(np.stack([np.repeat(ids, many), order[form]]), axis=1)
            hit = forms.take(pa.array(pairs[1])).combine_chunks()
            columns = [pa.array(pairs[0]), *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (hit.column("pattern"), hit.column("code")))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "pattern", "code"])


def hits(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """id, hits (in the dictionary's order) of the texts (scope, version, id, text) on which a form, as ``keyed`` gives it, may match."""
    place = ["scope", "version"]
    lengths = forms.filter("n is not null").groupBy(*place).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    asked = texts.join(lengths, place).select("id", _place().alias("place"), "lengths", "text").mapInArrow(_packed, "bucket int, hashes binary, ids binary")
    none = F.lit(None).cast("binary")
    known = forms.filter("n is not null").select("bucket", F.lit(0).alias("kind"), "hash", "pattern", "code", none.alias("hashes"), none.alias("ids"))
    asked = asked.select("bucket", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("pattern"), F.lit("").alias("code"), "hashes", "ids")
    found = known.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_met, "id long, pattern string, code string")
    always = texts.select(*place, "id").join(forms.filter("n is null").select(*place, "pattern", "code"), place).select("id", "pattern", "code")
    hit = F.struct((-F.length("pattern")).alias("order"), *_code_order(), "pattern", "code")
    return found.unionByName(always).groupBy("id").agg(F.array_sort(F.collect_set(hit)).alias("hits"))


def _code_order() -> list[Column]:
    return [F.substring("code", 1, 1).alias("family"), F.substring("code", 2, 20).cast("long").alias("number")]


@dataclass(frozen=True)
class Dictionary:
    """What texts are coded by. ``rules``: one chain for all rows; or ``forms`` by scope and version, as ``keyed`` gives them. ``lines`` (scope, version, code, line) are the definitions, ``meanings`` (scope, code, expansion) what codes stand for; without a scope in ``rules`` dictionaries, they hold for all."""

    lines: DataFrame
    meanings: DataFrame
    rules: tuple[tuple[str, str], ...] | None = None
    forms: DataFrame | None = None

    @staticmethod
    def seeded(spark: SparkSession, settings: Settings) -> Dictionary:
        """The standard aliases for all scopes, or nothing where the settings leave them out."""
        seeds = dictionary.seeds(spark).filter(F.lit(settings.seed_dictionary))
        return Dictionary(seeds.select("code", dictionary.definition().alias("line")), seeds.select("code", "expansion"), tuple(dictionary.seed_rules()) if settings.seed_dictionary else ())

    @staticmethod
    def scoped(aliases: DataFrame, generations: DataFrame) -> Dictionary:
        """Aliases (all of each scope) and the generations that freeze which codes are usable: scope, version, codes."""
        usable = generations.select("scope", F.col("version").cast("long").alias("version"), F.explode("codes").alias("code"))
        known = aliases.join(usable, ["scope", "code"])
        forms = known.select("scope", "version", "code", F.explode("surface_forms").alias("form"))
        # a replacement by a code brings no form of letters and blanks, unless the form ends as some code begins
        letters = known.groupBy("scope").agg(F.collect_set(F.lower(F.substring("code", 1, 1))).alias("letters"), F.min(F.regexp_like("code", F.lit(r"^[A-Z]\d+$"))).alias("usual"))
        once = F.col("usual") & F.regexp_like("form", F.lit("^[A-Za-z ]+$")) & ~F.array_contains("letters", F.lower(F.substring("form", -1, 1)))
        forms = forms.join(letters, "scope").withColumn("own", F.when(once, "").otherwise(F.col("code")))
        forms = forms.groupBy("scope", "version", "form", "own").agg(F.min(F.struct(*_code_order(), "code"))["code"].alias("code"))
        forms = written(keyed(forms.withColumn("pattern", F.concat(F.lit("(?iU)"), F.col("form")))))
        return Dictionary(known.select("scope", "version", "code", dictionary.definition().alias("line")), aliases.select("scope", "code", "expansion"), None, forms)

    def coded(self, df: DataFrame, source: str, out: str) -> DataFrame:
        """``df`` with its texts' known phrases as codes; rows have scope and version where the dictionary is by scope."""
        if self.forms is None:
            return df.withColumn(out, dictionary.substitute(source, list(self.rules)))
        rows = df.withColumn("__id", F.xxhash64("scope", F.col("version").cast("long"), F.col(source)))
        texts = rows.select("scope", F.col("version").cast("long").alias("version"), F.col("__id").alias("id"), F.col(source).alias("text")).filter("text != ''").dropDuplicates(["id", "scope", "version", "text"])
        found = hits(texts, self.forms).withColumnsRenamed({"id": "__id", "hits": "__hits"})
        rows = rows.join(found, "__id", "left")
        each = F.aggregate("__hits", F.col(source), lambda t, h: F.regexp_replace(t, h["pattern"], h["code"]))
        return rows.withColumn(out, F.when(F.col("__hits").isNull(), F.col(source)).otherwise(each)).drop("__id", "__hits")

    def with_expansions(self, df: DataFrame, *said: Column, keys: tuple[str, ...] = ("key", "scope", "version", "profile")) -> DataFrame:
        """Adds ``expansions``, map<code, text>: of the codes that the columns mention, those that are known. ``keys`` tell rows apart."""
        mentioned = df.select(*keys, F.explode(F.array_distinct(F.concat(*map(dictionary.codes, said)))).alias("code"))
        found = mentioned.join(self.meanings, ["code"] if self.forms is None else ["scope", "code"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("code", "expansion"))).alias("expansions"))
        return df.join(found, list(keys), "left").withColumn("expansions", F.coalesce("expansions", F.create_map().cast("map<string,string>")))

    def defined(self, codes: DataFrame) -> DataFrame:
        """Codes (scope, version, code) that their generation defines, with ``line``."""
        return codes.join(self.lines, ["code"] if self.forms is None else ["scope", "version", "code"])
