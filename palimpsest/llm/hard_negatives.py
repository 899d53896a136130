"""Operator 12: hard negatives by norm-bucketed search.

Vectors become whole numbers, floor(scale * x) with x as double. An anchor's positives are its best rows of the same
label by inner product; for each positive, its hard negatives are the best rows of other labels whose score lies in
the window from ``low`` percent of the positive's score up to all of it.

Both are searches of anchors against all candidates, in blocks: anchors and candidates are dealt into groups of
bounded size by hash, every pair of groups is a cell, and a task streams a cell's candidates past its anchors in the
order of falling norm. A bucket is a run of candidates that are next to each other in this order. By Cauchy-Schwarz
no score in it exceeds the anchor's norm times the bucket's largest, so an anchor passes over a bucket, and all after
it, once that bound is below what it still needs: the lower limit of its windows, or its running kth best score.
The others' scores are one matrix product, and hits are merged into the running lists. Lists of a cell are merged
by anchor afterwards. The first search is dealt by label, so only rows of one label meet.

Integer scores are exact: products below 2^53 go through double arithmetic, others through Python's integers, and
scores beyond a long are held to its ends.

Rows without an id, label or vector, or with a null or non-finite component, take no part. Vectors of different
lengths don't meet. Rows that share an id are one candidate, with their best score; no positive has its anchor's
id, and an anchor's repeated rows are one anchor. Ties go to the smaller id. A window of a negative positive score
is empty. Anchors without a positive, and positives without a negative, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import prepare, stored

#: Anchors held by a task at a time, and candidates that pass them in one cell.
ANCHORS, CANDIDATES = 65_536, 262_144
#: Anchors in one matrix product; hits of a row in a bucket beyond which its best are cut out before merging; hits kept before a merge.
ROWS, MANY, PENDING = 512, 64, 200_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Relative error that sums of squares in doubles may have, with room.
_ROUND = 1 + 1e-9


def whole_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str, relabel: Column | None = None) -> DataFrame:
    """Rows that take part: id, label, q (array<long>), norm."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & finite)
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col(f"`{label_col}`") if relabel is None else relabel).cast("long").alias("label"), q.alias("q"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def exact_scores(a: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers; ``bound`` is above them all."""
    if bound < 1 << 53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    wide = a.astype(object) @ c.astype(object).T
    return np.array([[min(max(x, _LEAST), _MOST) for x in row] for row in wide], dtype=np.int64).reshape(wide.shape)


class Cell:
    """Anchors of one cell with their windows and running lists."""

    def __init__(self, anchors: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, keep: int, other_label: bool):
        self.ids, self.labels, self.q, self.norms = (anchors[k] for k in ("id", "label", "q", "norm"))
        self.low, self.high, self.keep, self.other = low, high, keep, other_label
        n, self.windows = low.shape
        self.score = np.full((n * self.windows, keep), _LEAST)
        self.best = np.full((n * self.windows, keep), _MOST)
        self.n = np.zeros(n * self.windows, dtype=np.int64)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending, self.over = 0, False

    def needed(self, least_id: int) -> np.ndarray:
        """Smallest score that still changes each list, if ids from ``least_id`` on have it."""
        last = self.score[:, -1]
        beaten = np.where(self.n == self.keep, last + ((least_id > self.best[:, -1]) & (last < _MOST)), _LEAST)
        return np.where(self.low > self.high, _MOST, np.maximum(self.low, beaten.reshape(self.low.shape)))

    def bucket(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, norm: float) -> None:
        """One bucket, sorted by id; ``norm`` is its largest. Buckets come in the order of falling norm."""
        if self.over:
            return
        need = self.needed(int(ids[0]))
        at_most = self.norms * norm * _ROUND + 1
        # a window is open as long as the bound reaches what it needs and its high end isn't below that
        alive = np.flatnonzero(((at_most[:, None] >= need.astype(np.float64)) & (need <= self.high)).any(axis=1))
        if not len(alive):
            self.over = not len(np.flatnonzero(((at_most[:, None] >= self.needed(_LEAST).astype(np.float64)) & (self.low <= self.high)).any(axis=1)))
            return
        for at in range(0, len(alive), ROWS):
            rows = alive[at : at + ROWS]
            s = exact_scores(self.q[rows], q, float(at_most[rows].max()))
            out = (labels[None, :] == self.labels[rows, None]) if self.other else (ids[None, :] == self.ids[rows, None])
            least, most = need[rows].min(axis=1), self.high[rows].max(axis=1)
            hit = (s >= least[:, None]) & (s <= most[:, None]) & ~out
            many = hit.sum(axis=1) > MANY
            for k in np.flatnonzero(many):  # of one row's many hits, each window's best alone
                own = np.flatnonzero(hit[k])
                for j in range(self.windows):
                    inside = own[(s[k, own] >= need[rows[k], j]) & (s[k, own] <= self.high[rows[k], j])]
                    self.add(*self.first(rows[k] * self.windows + j, s[k, inside], ids[inside]))
            r, c = np.nonzero(hit & ~many[:, None])
            found = s[r, c]
            for j in range(self.windows):
                inside = (found >= need[rows[r], j]) & (found <= self.high[rows[r], j])
                self.add(rows[r[inside]] * self.windows + j, found[inside], ids[c[inside]])
        self.merge()

    def first(self, key: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one list's hits the first ``keep`` with different ids, and ties of the last among those looked at."""
        if len(scores) > 4 * self.keep and len(np.unique(ids)) == len(ids):
            least = np.partition(scores, -self.keep)[-self.keep]
            above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)[: self.keep]  # ids rise along the bucket
            chosen = np.concatenate((above, ties))
            scores, ids = scores[chosen], ids[chosen]
        return np.full(len(ids), key), scores, ids

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(keys):
            self.hits.append((keys, scores, ids))
            self.pending += len(keys)
            if self.pending > PENDING:
                self.merge()

    def merge(self) -> None:
        if not self.hits:
            return
        keys, scores, ids = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        self.hits, self.pending = [], 0
        touched = np.unique(keys)
        old = np.arange(self.keep)[None, :] < self.n[touched, None]
        keys = np.concatenate((keys, np.repeat(touched, self.n[touched])))
        scores, ids = np.concatenate((scores, self.score[touched][old])), np.concatenate((ids, self.best[touched][old]))
        order = np.lexsort((~scores, ids, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        new = np.ones(len(keys), dtype=bool)  # an id's best score alone
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, scores, ids = keys[new], scores[new], ids[new]
        order = np.lexsort((ids, ~scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        place = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        kept = place < self.keep
        self.n[touched] = np.minimum(np.diff(np.append(starts, len(keys))), self.keep)
        self.score[keys[kept], place[kept]], self.best[keys[kept], place[kept]] = scores[kept], ids[kept]


def searched(anchors: DataFrame, rows: DataFrame, deal: list[str], groups: tuple[int, int], keep: int, other_label: bool) -> DataFrame:
    """Per list of each cell: id, version (of the anchor), window, found (array of structs score, id).

    ``anchors``: id, version, label, q, norm, low, high (arrays: one window each); ``rows``: id, label, q, norm. Both are dealt by
    the columns ``deal`` and by groups of anchors and of candidates.
    """
    prepare(rows)
    n_anchors, n_rows = groups
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    none = F.lit(None).cast("array<long>")
    left = anchors.select(F.lit(0).alias("kind"), "id", "version", "label", "q", "norm", "low", "high", *[F.col(c).alias(f"deal_{c}") for c in deal], group(n_anchors, 1).alias("a"), span(n_rows).alias("c"))
    right = rows.select(F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("version"), "label", "q", "norm", none.alias("low"), none.alias("high"), *[F.col(c).alias(f"deal_{c}") for c in deal], span(n_anchors).alias("a"), group(n_rows, 2).alias("c"))
    cell = F.struct(*[f"deal_{c}" for c in deal], F.size("q").alias("length"), "a", "c")
    both = left.unionByName(right).withColumn("cell", F.xxhash64(cell)).withColumn("exact", F.to_json(cell))
    placed = both.repartition("cell").sortWithinPartitions("cell", "exact", "kind", F.desc("norm"), "id").select("exact", "kind", "id", "version", "label", "q", "norm", "low", "high")

    def matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
        column = b.column(b.schema.get_field_index(name))
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), len(flat) // max(1, len(column)))

    def as_arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("id", "version", "label", "norm")} | {"q": matrix(b, "q")}

    found_type = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))

    def lists(cell: Cell, version: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.flatnonzero(cell.n)
        for at in range(0, len(keys), 10_000):
            part = keys[at : at + 10_000]
            kept = np.arange(cell.keep)[None, :] < cell.n[part, None]
            flat = pa.StructArray.from_arrays([pa.array(cell.score[part][kept]), pa.array(cell.best[part][kept])], fields=list(found_type.value_type))
            found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(cell.n[part]))), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ids[part // cell.windows]), pa.array(version[part // cell.windows]), pa.array((part % cell.windows).astype(np.int32)), found.cast(found_type)], names=["id", "version", "window", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, cell, version = None, [], None, None

        def opened() -> Cell | None:
            if not held:
                return None
            parts = [as_arrays(b) for b in held]
            joined = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            return Cell(joined, *(np.concatenate([matrix(b, k) for b in held]) for k in ("low", "high")), keep, other_label), joined["version"]

        for b in batches:
            names, kinds = b.column(0).to_pylist(), b.column(1).to_numpy()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1] or kinds[i] != kinds[i - 1]], len(names)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if names[x] != name:
                    if cell is not None:
                        yield from lists(cell, version)
                    name, held, cell, version = names[x], [], None, None
                part = b.slice(x, y - x)
                if kinds[x] == 0:
                    held.append(part)
                elif held or cell is not None:
                    if cell is None:
                        (cell, version), held = opened(), []
                    c = as_arrays(part)
                    order = np.argsort(c["id"], kind="stable")
                    cell.bucket(c["id"][order], c["label"][order], c["q"][order], float(c["norm"][0]))
        if cell is not None:
            yield from lists(cell, version)

    return placed.mapInArrow(run, "id long, version long, window int, found array<struct<score:long,id:long>>")


def merged(found: DataFrame, keep: int) -> DataFrame:
    """Per list: id, version, window, best: the first ``keep`` (score, id) over all cells, highest scores first, then smallest ids. A cell has ``keep`` at most; rows that share an id met in one cell."""
    flat = found.groupBy("id", "version", "window").agg(F.flatten(F.collect_list("found")).alias("found"))
    later = F.transform("found", lambda x: F.struct((-1 - x["score"]).alias("down"), x["id"].alias("id")))  # -1 - s falls as s rises, and never overflows
    ordered = F.array_sort(later)
    best = F.transform(F.slice(ordered, 1, keep), lambda x: F.struct((-1 - x["down"]).alias("score"), x["id"].alias("id")))
    return flat.select("id", "version", "window", best.alias("best"))


def hard_negatives(
    df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, relabel: Column | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors_held: int = ANCHORS, candidates_held: int = CANDIDATES,
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says by the columns id and label which rows are anchors; ``relabel`` replaces the label (by ``df``'s columns);
    ``low`` is the window's lower limit in percent of the positive's score.
    """
    spark = df.sparkSession
    rows = stored(whole_vectors(df, scale, id_col, vector_col, label_col, relabel))
    chosen = rows.filter(anchor).withColumn("version", F.xxhash64("label", "q")).dropDuplicates(["id", "version"])
    chosen = stored(chosen)
    n_anchors, n_rows = chosen.count(), rows.count()
    # cells enough for all cores, as long as anchors are sent fewer times than candidates
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // max(1, n_anchors))
    groups = max(1, -(-n_anchors // anchors_held)), max(1, spread, -(-n_rows // candidates_held))
    everything = chosen.withColumns({"low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_MOST))})
    near = merged(searched(everything, rows, ["label"], groups, positives, False), positives)
    near = stored(near.select("id", "version", F.col("best").alias("positives")))
    scores = F.col("positives.score")
    windows = chosen.join(near, ["id", "version"]).withColumns({"low": lower_limits("positives.score", low), "high": scores})
    missing = F.lit(positives) - F.size("low")  # every anchor has as many windows; those without a positive are empty
    windows = windows.withColumns({"low": F.concat("low", F.array_repeat(F.lit(_MOST), missing)), "high": F.concat("high", F.array_repeat(F.lit(_LEAST), missing))})
    far = merged(searched(windows, rows, [], groups, negatives, True), negatives)
    out = far.join(near, ["id", "version"]).select("id", F.get("positives", F.col("window")).alias("p"), F.posexplode("best").alias("k", "n"))
    return out.select(
        F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("k") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


def lower_limits(scores: str, low: int) -> Column:
    """Per score the smallest whole number that is at least ``low`` percent of it; for negative ones a limit that nothing reaches."""
    return F.expr(f"transform({scores}, s -> if(s < 0, {_MOST}L, {low} * (s div 100) + ({low} * (s % 100) + 99) div 100))")
