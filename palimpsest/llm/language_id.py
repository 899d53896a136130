"""Operator 10: language identification by nearest clustered centroids.

A text's feature vector counts the character n-grams (1 to 3 letters, words
padded by spaces) of its letter runs in lower case, of any script, hashed into
``WIDTH`` places, weighted by inverse document frequency and normalised. Spherical k-means gives several centroids per
language; a text takes the language of the centroid with the largest cosine.

Rejection is by distance: every centroid keeps the cosine that nearly all of its
own training texts reach, and a text far below that (by a margin that grows as
the text gets shorter) is rejected, as is a text without any letter.

Fitting uses at most ``SAMPLE`` labelled texts per language, those with the
smallest hash of their id; each language's ``FEATURES`` commonest n-grams are
features, so none is crowded out by others. Prediction reads every text whole.
Languages are the non-null labels of the training rows.

Null texts and texts without a letter give ``und``, score 0 and rejection. Ties
go to the label that sorts first. Without any training row every text is
``und``. Repeated rows are treated alike. Rows without an id are never trained
on, and not counted as held out.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, texts

#: Bounds of the fit: texts per language, n-grams per language, centroids per language, rounds of k-means.
SAMPLE, FEATURES, CENTROIDS, ROUNDS = 400, 2500, 3, 8
#: Places that n-grams are hashed into, a power of two.
WIDTH = 1 << 20
#: A text is rejected below this share of what its centroid's training texts reach (their QUANTILE), less for texts of under SHORT letters.
SHARE, QUANTILE, SHORT = 0.5, 0.01, 60
UNKNOWN = "und"
_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = _U(64 - 20)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are never trained on, apart from those without an id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lower_table() -> np.ndarray:
    """Code point -> lower-case code point for letters, 0 for all else."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(ch := chr(c))[0] == "L":
            out[c] = ord(ch.lower()[0])
    return out


def gram_codes(symbols: np.ndarray) -> np.ndarray:
    """Places of the n-grams of 1 to 3 letters; grams without a letter, or with a space inside, are left out."""
    s = np.zeros(len(symbols) + 2, dtype=_U)
    s[1:-1] = symbols
    inside = symbols > 0
    one, two, three = (s * m for m in _MIX)
    pairs = (one[:-1] ^ two[1:])[(s[:-1] > 0) | (s[1:] > 0)]
    triples = (one[:-2] ^ two[1:-1] ^ three[2:])[inside]
    parts = (one[1:-1][inside], pairs + _U(1), triples + _U(2))
    return (np.concatenate([(p ^ (p >> _U(29))) * _MIX[0] for p in parts]) >> _SHIFT).astype(np.int32)


@dataclass
class Model:
    """Plain arrays, so that it travels with a task. ``letter``: code point -> lower-case letter or 0. ``feature``: n-gram place -> feature. ``reach``: cosine that a centroid's own texts reach."""

    letter: np.ndarray
    feature: np.ndarray
    weight: np.ndarray
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray

    def vector(self, symbols: np.ndarray) -> np.ndarray:
        """The normalised vector of a text with a letter. Unknown n-grams count in one last place, so they lengthen the vector and lower its cosines."""
        v = np.bincount(self.feature[gram_codes(symbols)], minlength=len(self.weight)) * self.weight
        return v / np.sqrt(v @ v)

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        symbols = self.letter[code_points(text or b"")]
        letters = int(np.count_nonzero(symbols))
        if not letters or not len(self.owner):
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ self.vector(symbols)
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[self.owner[best]], score, bool(score < SHARE * self.reach[best] * min(1.0, letters / SHORT))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` rows per language with a language, a text and no place among the held-out rows."""
    pool = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    pool = pool.filter(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("hash", F.shiftrightunsigned(F.xxhash64("id"), 32))
    # a language's smallest hashes lie below a bound that four times as many are expected to pass, so a common language's rows never meet in one task
    sizes = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumn("bound", (F.lit(float(1 << 32)) * 4 * sample / F.col("rows")).cast("long"))
    near = pool.select("id", "lang", "hash").join(F.broadcast(sizes), "lang").filter("hash <= bound")  # one row for each language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= sample).select("id").collect()
    # at most `sample` ids per language: small whatever the corpus
    rows = pool.filter(F.col("id").isin([r["id"] for r in chosen])).dropDuplicates(["id", "lang"]).collect() if chosen else []
    return train([(r["lang"], r["text"].encode("utf-8", "surrogatepass")) for r in sorted(rows, key=lambda r: (r["lang"], r["id"]))])


def train(rows: list[tuple[str, bytes]]) -> Model:
    """Fits the model on (language, text) pairs."""
    letter = lower_table()
    rows = [(lang, s) for lang, t in rows if (s := letter[code_points(t)]).any()]
    languages = sorted({lang for lang, _ in rows})
    seen = np.zeros(WIDTH, dtype=np.int64)
    top: set[int] = set()
    for lang in languages:
        own = np.zeros(WIDTH, dtype=np.int64)
        for s in (s for other, s in rows if other == lang):
            own[np.unique(gram_codes(s))] += 1
        seen += own
        top.update(int(c) for c in np.argsort(-own, kind="stable")[:FEATURES] if own[c])
    chosen = np.array(sorted(top), dtype=np.int64)
    feature = np.full(WIDTH, len(chosen), dtype=np.int32)
    feature[chosen] = np.arange(len(chosen))
    weight = 1 + np.log((1 + len(rows)) / (1 + np.append(seen[chosen], 0)))
    model = Model(letter, feature, weight, languages, np.zeros(0, int), np.zeros((0, len(weight))), np.zeros(0))
    owner, centroids, reach = [], [], []
    for k, lang in enumerate(languages):
        x = np.stack([model.vector(s) for other, s in rows if other == lang])
        found = clusters(x, CENTROIDS)
        usual = float(np.quantile((x @ np.stack([c for c, _ in found]).T).max(axis=1), QUANTILE))
        for c, inside in found:
            owner.append(k)
            centroids.append(c)
            reach.append(min(usual, float(np.quantile(inside @ c, QUANTILE))))  # a cluster of a few like texts isn't stricter than its language
    if owner:
        model.owner, model.centroids, model.reach = np.array(owner), np.stack(centroids), np.array(reach)
    return model


def clusters(x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spherical k-means from evenly spaced rows: (centroid, its rows), without empty ones."""
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    near = (x @ c.T).argmax(axis=1)
    return [(c[j], x[near == j]) for j in range(len(c)) if (near == j).any()]


def identified(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, rejected. Only the text decides."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES x CENTROIDS numbers for each pair of languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t) for t in texts(b, text_col)]
            yield from as_batches({
                id_col: (b.column(b.schema.get_field_index(id_col)), pa.int64()), "lang_pred": ([o[0] for o in out], pa.string()),
                "score": ([o[1] for o in out], pa.float64()), "rejected": ([o[2] for o in out], pa.bool_()),
            })

    return arrow_map(df, (id_col, text_col), run, f"`{id_col}` long, lang_pred string, score double, rejected boolean")


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are not rejected, with its own columns, judged row by row."""
    model = fit(df, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = [not m.predict(t)[2] for t in texts(b, text_col)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return arrow_map(df, df.columns, run, schema)
