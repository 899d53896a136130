"""Operator 5: near duplicates by fast similarity sketching, banding and exact verification.

Sketch: a set's elements are thrown into T bins in rounds. In round i < T every
element gets a hashed bin and the value i + u; in rounds T to 2T - 1 every
element goes to bin i - T. A bin keeps its smallest value. After one or two
rounds of a large set all bins are full; the last T rounds fill every bin of even
the smallest set, and the share of equal bins estimates the Jaccard similarity
with the concentration of T independent MinHashes.

Banding: groups of ROWS bins form BANDS buckets. Sets with similarity 0.8 share
a bucket with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, all but some five
in a million.

Verification: sets with equal fingerprints are one class from the start, so
copies cost one row each. In every bucket all classes are compared with its
leader on their full sets, the most central class, which shares the most buckets
with others; classes linked with it need no further pairs among themselves.

What remains are pairs of a bucket between components, which can be many where
a group holds many near misses. A bucket with few of them (``PAIRS`` a member at
most) is compared pair by pair. In the others every class x is known by its
differences from the leader, D(x) = the elements that only one of the two has.
Any set can stand for the leader, so a bucket whose leader lies in other buckets
too takes the most central of their leaders, and a class's differences serve
most of its buckets at once.
Since D(x) and D(y) differ exactly where x and y do, a link leaves them at most
(100 - percent) / (100 + percent) * (|x| + |y|) elements that only one has, and
so at least O in common; of two sets in one order with O common elements, the
first |D(x)| - O + 1 and |D(y)| - O + 1 share one. Elements that the leader lacks
come first in that order: near misses, which differ from the leader each in its
own way, seldom share one early. Such prefixes are exact, whatever the bucket's
size. Each (leader, element) again has a leader of its own before the remaining
pairs between components are compared.

Links are 100 * intersection >= percent * union on full sets; components are
their transitive closure.

Elements are 64-bit hashes of word shingles; words are `[^\\x20\\x09-\\x0D]+`
with A-Z lower-cased. A text with fewer words than a shingle is one shingle; one
without words (or null) has an empty set and is linked with nothing. Repeated
rows are links of similarity 1. Ids name rows: one id must not stand for two
texts. A row without an id takes part under a number made of its text, above all
ids below 2 ** 62; its own id stays null, and so does a component of such rows
alone, of which each has ``kept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, ascii_lower, mix64, packed, releasing, stored, texts

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Pairs between components for each member of a bucket up to which it is compared pair by pair; more go by differences. It decides about cost alone.
PAIRS = 16
#: Words whose hashes a worker keeps; on reaching it the store starts anew.
STORE_WORDS = 500_000
_U = np.uint64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > STORE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = ascii_lower(text or b"").split()  # bytes.split cuts at exactly the six ASCII white spaces
    if not words:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=_U, count=len(words))
    n = min(width, len(h))
    out = mix64(h[: len(h) - n + 1] + _U(n))
    for k in range(1, n):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set, for 4,096 bins at most: per bin round and hash of its smallest element."""
    out = np.zeros(bins, dtype=_U)
    empty = np.ones(bins, dtype=bool)
    n, at = len(elements), 0
    while empty.any() and at < bins:
        rounds = np.arange(at, min(bins, at + max(1, 4 * bins // n)), dtype=_U)
        at += len(rounds)
        h = mix64(elements[None, :] + mix64(rounds + _U(1))[:, None])
        where = (h >> _U(32)) * _U(bins) >> _U(32)
        # bin, then round, then hash in one sortable number
        key = np.sort((where << _U(48) | rounds[:, None] << _U(34) | h & _U(0xFFFFFFFF)).ravel())
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> _U(48) != key[:-1] >> _U(48)]))
        hit = (key[first] >> _U(48)).astype(np.int64)
        new = empty[hit]
        out[hit[new]] = key[first][new] & _U((1 << 48) - 1)
        empty[hit] = False
    for b in np.flatnonzero(empty):  # rounds T to 2T - 1
        out[b] = (mix64(elements + mix64(np.array([bins + b + 1], dtype=_U))).min() & _U(0xFFFFFFFF)) | _U((bins + b) << 34)
    return out


def buckets(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch(elements, bands * rows).reshape(bands, rows)
    h = mix64(np.arange(bands, dtype=_U) + _U(0xABCD))
    for k in range(rows):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + parts[:, k])
    return h.astype(np.int64)


def sketched(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row (id, text): id, n_shingles, fingerprint (of the whole set; null if empty), buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in texts(b, "text")]
            yield from as_batches({
                "id": (b.column(0), pa.int64()), "n_shingles": ([len(s) for s in sets], pa.int64()),
                "fingerprint": ([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "buckets": ([buckets(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
            })

    return arrow_map(df, ("id", "text"), run, "id long, n_shingles long, fingerprint binary, buckets array<long>")


def full_sets(df: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from as_batches({"id": (b.column(0), pa.int64()), "elements": ([shingles(t, width).tobytes() for t in texts(b, "text")], pa.binary())})

    return arrow_map(df, ("id", "text"), run, "id long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, x, y = (b.column(k).to_pylist() for k in range(4))
            good = []
            last, left = None, None
            for p, q in zip(x, y, strict=True):
                if p is not last:
                    last, left = p, np.frombuffer(p, dtype=_U)
                right = np.frombuffer(q, dtype=_U)
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * both >= percent * (len(left) + len(right) - both))
            mask = pa.array(good, pa.bool_())
            yield from as_batches({"a": (pa.array(a, pa.int64()).filter(mask), pa.int64()), "b": (pa.array(c, pa.int64()).filter(mask), pa.int64())})

    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return joined.mapInArrow(releasing(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b). Alternates large and small stars until nothing moves; each round's edges are a written table."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Each node's neighbours (large: the greater ones, small: the others and itself) are tied to the node's smallest neighbour."""
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        if not large:
            near = near.filter("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = near.join(least, "u")
        ends = tied.filter("v > u").select("v", "m") if large else tied.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        return ends.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    edges = stored(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sign = None
    while True:
        edges = stored(star(star(edges, True), False), replaces=edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


#: Rows without an id are numbered from here on, by a hash of their text.
NO_ID = 1 << 62


def _numbered(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")).bitwiseAND(NO_ID - 1) + F.lit(NO_ID))


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id)."""
    out = _classified(df, width, percent, id_col, text_col, bands, rows)
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(real("id").alias(id_col), "n_shingles", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _classified(df: DataFrame, width: int, percent: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``df``: id (a number for rows without one), n_shingles, component."""
    spark: SparkSession = df.sparkSession
    docs = df.select(_numbered(id_col, text_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    base = stored(sketched(docs, width, bands, rows))
    # rows with equal sets: the smallest id stands for the class
    classes = base.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias("rep"), F.min_by("buckets", "id").alias("buckets"), F.min("n_shingles").alias("n"))
    classes = stored(classes)
    member = _shared(classes.select(F.col("rep").alias("id"), "n", F.explode("buckets").alias("bucket")))
    member = stored(member.join(member.groupBy("id").agg(F.sum("size").alias("weight")), "id").drop("size"))
    sets = stored(full_sets(docs.join(member.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), width))

    state = _State(spark, sets, percent)
    state.compare(_with_leader(member.join(_leaders(member), "bucket")))
    still = stored(_open(state.placed(member), "bucket"))
    few, many = _by_pairs(still)
    apart = stored(_differences(many, sets, percent))
    state.add(apart.filter("linked").select(*_pair("leader", "leader_n", "id", "n")).select("a", "b").join(state.tried, ["a", "b"], "left_anti"))
    token = stored(_tokens(apart, percent))
    token = stored(_open(state.placed(token), "leader", "element"), replaces=token)
    state.compare(_between(few, "bucket", percent).unionByName(_token_leaders(token, percent)))
    token = stored(state.placed(token), replaces=token)
    state.compare(_between(_open(token, "leader", "element"), ("leader", "element"), percent, prefixes=True))

    joined = classes.select("fingerprint", "rep").join(state.component.withColumnRenamed("id", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("component"))
    return base.drop("buckets").join(joined, "fingerprint", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


class _State:
    """Links found so far, the pairs they were found among, and the components they make."""

    def __init__(self, spark: SparkSession, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.links = self.tried = spark.createDataFrame([], "a long, b long")
        self.component = spark.createDataFrame([], "id long, component long")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their components."""
        return rows.drop("component").join(self.component, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def compare(self, pairs: DataFrame) -> None:
        """Verifies pairs (a, b, n_a, n_b) whose sizes allow a link and that weren't tried before."""
        near_size = pairs.filter(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        fresh = stored(near_size.select("a", "b").distinct().join(self.tried, ["a", "b"], "left_anti"))
        self.tried = self.tried.union(fresh)
        self.add(verified(fresh, self.sets, self.percent))

    def add(self, links: DataFrame) -> None:
        """Links (a, b) that are new."""
        found = stored(links)
        if not found.isEmpty():
            self.links = self.links.union(found)
            self.component = components(self.links)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose bucket holds more than one class, with the bucket's size."""
    return rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket")


def _open(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys still hold more than one component."""
    several = rows.groupBy(*keys).agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select(*keys)
    return rows.join(several, list(keys), "left_semi")


def _leaders(member: DataFrame) -> DataFrame:
    """Every bucket's most central class."""
    lead = member.groupBy("bucket").agg(F.min_by(F.struct("id", "n", "weight"), F.struct(-F.col("weight"), F.col("id"))).alias("lead"))
    return lead.select("bucket", F.col("lead.id").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.weight").alias("leader_weight"))


def _pair(x: str, nx: str, y: str, ny: str) -> list[Column]:
    swap = F.col(x) > F.col(y)
    return [
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
        F.when(swap, F.col(ny)).otherwise(F.col(nx)).alias("n_a"), F.when(swap, F.col(nx)).otherwise(F.col(ny)).alias("n_b"),
    ]


def _with_leader(rows: DataFrame) -> DataFrame:
    return rows.filter("id != leader").select(*_pair("leader", "leader_n", "id", "n"))


def _by_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets with few pairs between components, and (leader, id, n) of the others."""
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    marked = rows.join(sizes.select("bucket", F.expr(f"members * members - squares > {2 * PAIRS} * members").alias("many")), "bucket")
    many = marked.filter("many").drop("many")
    return marked.filter("not many").drop("many"), _with_centre(many)


def _with_centre(rows: DataFrame) -> DataFrame:
    """(leader, id, n) of buckets' rows: a bucket's leader gives way to the most central one of all buckets that it lies in.

    One step only: a centre further away would differ more from the bucket's members.
    """
    leaders = stored(_leaders(rows))
    lying = rows.select("bucket", F.col("id").alias("lead")).join(leaders.select(F.col("leader").alias("lead")).distinct(), "lead")
    centre = lying.join(leaders, "bucket").groupBy("lead").agg(F.max_by("leader", F.struct("leader_weight", -F.col("leader"))).alias("centre"))
    moved = leaders.join(centre, F.col("leader") == F.col("lead")).select("bucket", F.col("centre").alias("leader"))
    return rows.join(moved, "bucket").filter("id != leader").select("leader", "id", "n").distinct()


def _differences(orbit: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Per class and leader all differences: leader, leader_n, id, n, d (their number), linked (the two), most (how many a link needs at most), elements.

    Of two classes in different components at least one, x, isn't linked with the
    leader l. With F(u, v) = (100 - percent) / (100 + percent) * (|u| + |v|), its
    D(x) has more than F(x, l) elements. A partner y that is linked with l thus
    needs (|D(y)| + F(x, y) - F(x, l)) / 2 + 1 elements at most. Of others, the
    larger difference set needs no more than F(x, y) + 1, with |y| * percent <= 100 * |x|.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leads, sizes, close, mosts, alls = [], [], [], [], []
            for p, q in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                lead, own = np.frombuffer(p, dtype=_U), np.frombuffer(q, dtype=_U)
                new, gone = np.setdiff1d(own, lead, assume_unique=True), np.setdiff1d(lead, own, assume_unique=True)
                d, n = len(new) + len(gone), len(own)
                linked = (100 + percent) * d <= (100 - percent) * (n + len(lead))
                if linked:
                    most = (d * (100 + percent) + (100 - percent) * (n - len(lead))) // (2 * (100 + percent)) + 1
                else:
                    most = (100 - percent) * (n + n * 100 // percent) // (100 + percent) + 1
                leads.append(len(lead))
                sizes.append(d)
                close.append(linked)
                mosts.append(most)
                alls.append(np.concatenate([new, gone]).astype(np.int64))
            yield from as_batches({
                "leader": (b.column(0), pa.int64()), "leader_n": (leads, pa.int64()), "id": (b.column(1), pa.int64()), "n": (b.column(2), pa.int64()),
                "d": (sizes, pa.int64()), "linked": (close, pa.bool_()), "most": (mosts, pa.int64()), "elements": (alls, pa.list_(pa.int64())),
            })

    joined = (
        orbit.join(sets.select("id", F.col("elements").alias("y")), "id")
        .join(sets.select(F.col("id").alias("leader"), F.col("elements").alias("x")), "leader")
        .select("leader", "id", "n", "x", "y")
    )
    return joined.mapInArrow(releasing(run), "leader long, leader_n long, id long, n long, d long, linked boolean, most long, elements array<long>")


def _tokens(found: DataFrame, percent: int) -> DataFrame:
    """The first elements of all differences, the rarest of the leader's group first: leader, element, at (from 1 on), id, n, d.

    Sizes of difference sets of a pair differ by F(x, y) at most, and none is below the
    group's smallest, so no class needs more than (|D(x)| - least |D(y)| + F(x, y)) / 2 + 1.

    What many classes share, such as the header of another template, comes last in this
    order, and classes that differ each in its own way don't meet at all.
    """
    far = F.expr(f"{100 - percent} * (n + n * 100 div {percent}) div {100 + percent}")
    low = found.groupBy("leader").agg(F.min("d").alias("low"))
    rows = found.join(low, "leader").withColumn("far", far)
    rows = rows.withColumn("most", F.least("most", F.expr("(d - greatest(low, d - far) + far) div 2 + 1"))).drop("low", "far")
    each = rows.select("leader", "id", "n", "d", "most", F.explode("elements").alias("element"))
    often = each.groupBy("leader", "element").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("leader", "id").orderBy("often", "element")
    ranked = each.join(often, ["leader", "element"]).withColumn("at", F.row_number().over(order))
    return ranked.filter("at <= most").drop("most", "often")


def _early(x: str, y: str, percent: int) -> Column:
    """Whether an element that two difference sets share at these places can be their first of enough common ones."""
    far = f"floor({100 - percent} * ({x}.n + {y}.n) / {100 + percent})"
    common = f"ceil(({x}.d + {y}.d - {far}) / 2)"
    return F.expr(f"{x}.at <= {x}.d - {common} + 1 and {y}.at <= {y}.d - {common} + 1")


def _token_leaders(token: DataFrame, percent: int) -> DataFrame:
    """Every (leader, element)'s classes with the one of them that differs least, where their components differ."""
    lead = token.groupBy("leader", "element").agg(F.min_by(F.struct("id", "n", "d", "at", "component"), F.struct("d", "id")).alias("lead")).select("leader", "element", "lead.*").alias("x")
    both = token.alias("y").join(lead, ["leader", "element"]).filter((F.col("x.component") != F.col("y.component")) & _early("x", "y", percent))
    return both.select(*_pair("x.id", "x.n", "y.id", "y.n"))


def _between(rows: DataFrame, keys: str | tuple[str, ...], percent: int, prefixes: bool = False) -> DataFrame:
    """Pairs of rows with equal keys that lie in different components and whose sizes allow a link."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    both = rows.alias("x").join(rows.alias("y"), keys).filter(
        (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    )
    if prefixes:
        both = both.filter(_early("x", "y", percent))
    return both.select(*_pair("x.id", "x.n", "y.id", "y.n"))


def keep_representatives(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their component, with its own columns; of repeated rows one."""
    kept = _classified(df, width, percent, id_col, text_col).filter("id = component").select("id").distinct()
    # partitioned and sorted by number already, so dropping repeated rows needs no shuffle of its own
    return packed(df, id=_numbered(id_col, text_col)).join(kept, "id", "left_semi").dropDuplicates(["id"]).select("row.*")
