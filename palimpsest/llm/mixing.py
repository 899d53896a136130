"""Operator 2: mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources form a pattern. Patterns are
few, so a flow network over them is small whatever the corpus: the supply has
one edge per repetition to each pattern (capacity: the pattern's words; cost:
0 for the first use, 1 for the second, and so on, which is convex), patterns
feed the sources they belong to, and each source's capacity is its target. A
min-cost maximum flow gives the words to take from each pattern, so texts are
repeated only where new ones have run out.

A pattern's flow is so many whole repetitions and a rest. The rest is filled by
whole documents in the order of a seeded hash: a histogram of the hash finds the
boundary without sorting the corpus. Beyond it every document, in the same order,
is taken if it fits into what is left: histogram and boundary are found again for
those that still fit, until none does. So the words taken of a pattern stay below
its flow by less than its smallest document that isn't taken.

Null and empty texts have size 0 and are never taken; a null source is a source
of its own. Rows of one pattern with the same id, also those without one, share
their hash; rows of the same size too are taken or left alike.
Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, stored, texts

#: Patterns that the driver accepts; more would mean that sources aren't sources.
MAX_PATTERNS = 50_000
#: Bins of the hash per pattern, and documents beyond a boundary that are looked at one by one before the next histogram.
BINS, FILL = 4096, 200


def water_fill(sizes: list[int], weights: list[int], share: Fraction, cap: int) -> list[Fraction]:
    """Targets: ``share`` of all sizes by weight; at most cap * size each, the excess shared again by weight among the others."""
    out: list[Fraction | None] = [None] * len(sizes)
    rest = share * sum(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] > cap * sizes[i] * total}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            rest -= cap * sizes[i]
        open_ -= over
    return [x if x is not None else Fraction(0) for x in out]


class Network:
    """Successive shortest paths on a small graph with integer capacities."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            best: list[int | None] = [None] * len(self.out)
            via = [-1] * len(self.out)
            best[source], queue, queued = 0, deque([source]), {source}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.left[e] and (best[y] is None or best[x] + self.cost[e] < best[y]):
                        best[y], via[y] = best[x] + self.cost[e], e
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            if best[sink] is None:
                return
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            amount = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= amount
                self.left[e ^ 1] += amount


def pattern_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[int]:
    """Words to take of each pattern (its sources, its words), given the sources' quotas."""
    n, m = len(patterns), len(quotas)
    net = Network(n + m + 2)
    supply = [[net.edge(n + m, p, size, r) for r in range(repeats)] for p, (_, size) in enumerate(patterns)]
    for p, (members, size) in enumerate(patterns):
        for s in members:
            net.edge(p, n + s, repeats * size, 0)
    for s, q in enumerate(quotas):
        net.edge(n + s, n + m + 1, q, 0)
    net.run(n + m, n + m + 1)
    return [sum(net.left[e ^ 1] for e in edges) for edges in supply]


#: The seeded order of documents: their hash as a number from 0 on, then their id.
_ORDER = ("hash", "id")
_LAST = (1 << 63) - 1


def sized(df: DataFrame, id_col: str, text_col: str, sources_col: str, carry: str | None = None) -> DataFrame:
    """Per row: id, sources (its pattern), size (words of the whole text), and the column ``carry`` as it is."""
    names = (id_col, text_col, sources_col, *([carry] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from as_batches({
                "id": (b.column(0), pa.int64()), "sources": (b.column(2), pa.list_(pa.string())),
                "size": ([len((t or b"").split()) for t in texts(b, text_col)], pa.int64()),  # bytes.split cuts at exactly the six ASCII white spaces
                **({carry: (b.column(3), b.column(3).type)} if carry else {}),
            })

    kept = f", `{carry}` {df.schema[carry].dataType.simpleString()}" if carry else ""
    return arrow_map(df, names, run, "id long, sources array<string>, size long" + kept)


def by_code_point(names: set[str | None]) -> list[str | None]:
    """Python compares strings by code point; null comes last."""
    return [*sorted(n for n in names if n is not None), *[n for n in names if n is None]]


def first_fit(docs: DataFrame, gaps: dict[int, int], fill: int = FILL) -> tuple[list[tuple], list[tuple]]:
    """What closes the patterns' gaps if every document, in order, is taken where it fits into what is left.

    ``docs``: pattern, bin, hash, id, size. Returns spans (pattern, low and high end in the order, largest size), whose
    documents up to that size are all taken, and single ones (pattern, id). Each round takes what fits up to the first
    document that doesn't, then looks at the next ``fill``; what was passed over can't fit later, as gaps only shrink.
    """
    spark = docs.sparkSession
    order = Window.partitionBy("pattern").orderBy(*_ORDER)
    spans, chosen = [], []
    state: dict[int, tuple] = {p: (-1, None, gap) for p, gap in gaps.items()}

    def after(state: dict[int, tuple]) -> DataFrame:
        ends = spark.createDataFrame([(p, *x) for p, x in state.items()], "pattern int, end_hash long, end_id long, gap long")
        beyond = F.struct(*_ORDER) > F.struct(F.col("end_hash").alias("hash"), F.col("end_id").alias("id"))
        return docs.join(F.broadcast(ends), "pattern").filter((F.col("size") <= F.col("gap")) & beyond)

    while state:
        fitting = after(state)
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bin"))
        bins = fitting.groupBy("pattern", "bin", "gap").agg(F.sum("size").alias("words")).withColumn("upto", upto)
        found = bins.filter("upto > gap").groupBy("pattern").agg(F.min_by(F.struct("bin", (F.col("gap") - (F.col("upto") - F.col("words"))).alias("left")), "bin").alias("edge"))
        edges = {r["pattern"]: (r["edge"]["bin"], r["edge"]["left"]) for r in found.collect()}
        for p in state.keys() - edges.keys():  # all that fits is taken
            spans.append((p, *state[p][:2], _LAST, _LAST, state[p][2]))
        if not edges:
            break
        edge_df = spark.createDataFrame([(p, *e) for p, e in edges.items()], "pattern int, edge_bin int, left long")
        # the boundary bin holds one of BINS parts of a pattern: its documents are taken one by one; equal ids go together
        inner = fitting.join(F.broadcast(edge_df), "pattern").filter("bin = edge_bin").withColumn("upto", F.sum("size").over(order)).filter("upto <= left")
        last = {r["pattern"]: r for r in inner.groupBy("pattern").agg(F.max("upto").alias("used"), F.max(F.struct(*_ORDER)).alias("at")).collect()}
        following = {}
        for p, (edge_bin, left) in edges.items():
            end = tuple(last[p]["at"]) if p in last else ((edge_bin << 51) - 1, _LAST)
            spans.append((p, *state[p][:2], *end, state[p][2]))
            following[p] = (*end, left - (last[p]["used"] if p in last else 0))
        state = {p: x for p, x in following.items() if x[2]}
        if not state:
            break
        near: dict[int, dict[tuple, int]] = {}
        seen = Counter()
        for r in after(state).withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= fill).sort("pattern", *_ORDER).collect():
            units = near.setdefault(r["pattern"], {})
            units[r["hash"], r["id"]] = units.get((r["hash"], r["id"]), 0) + r["size"]
            seen[r["pattern"]] += 1
        state = {p: x for p, x in state.items() if p in near}
        for p, units in near.items():
            left = state[p][2]
            for (_, i), size in units.items():
                if size <= left:
                    left -= size
                    chosen.append((p, i))
            if left and seen[p] >= fill:
                state[p] = (*list(units)[-1], left)
            else:  # nothing follows
                del state[p]
    return spans, chosen


def mixed(
    df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", sources_col: str = "sources", carry: str | None = None,
) -> DataFrame:
    """Per row: id, sources, size, source_size and target (both of the row's first source), repeats (how often it is taken), taken (words).

    ``sources_col`` is an array of the sources that a document belongs to; none at all if null. ``carry`` names a column that
    comes out with each row, so that nothing has to be joined back by ids, which rows may share.
    ``weights`` repeat over the sources in code point order.
    """
    spark = df.sparkSession
    rows = stored(sized(df.withColumn(sources_col, F.coalesce(F.col(sources_col), F.array().cast("array<string>"))), id_col, text_col, sources_col, carry).withColumn("hash", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1)))
    found = rows.groupBy("sources").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["sources"]])
    sources = by_code_point({s for r in found for s in r["sources"]})
    place = {s: k for k, s in enumerate(sources)}
    sizes = [sum(r["words"] for r in found if s in r["sources"]) for s in sources]
    total = sum(r["words"] for r in found)
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(sources))], share * Fraction(total, max(1, sum(sizes))), repeats)
    flow = pattern_flow([(tuple(place[s] for s in r["sources"]), r["words"]) for r in found], [round(t) for t in targets], repeats)

    plan = []
    for k, (r, f) in enumerate(zip(found, flow, strict=True)):
        whole, rest = divmod(f, r["words"]) if r["words"] else (0, 0)
        first = place[r["sources"][0]] if r["sources"] else None
        plan.append((r["sources"], k, sizes[first] if first is not None else 0, float(targets[first]) if first is not None else 0.0, whole, rest))
    plan_df = spark.createDataFrame(plan, "sources array<string>, pattern int, source_size long, target double, whole long, rest long")
    # as many rows as patterns, MAX_PATTERNS at most
    rows = rows.withColumn("bin", F.shiftright("hash", 51).cast("int")).join(F.broadcast(plan_df), rows["sources"].eqNullSafe(plan_df["sources"])).drop(plan_df["sources"])

    spans, chosen = first_fit(rows.filter("size > 0").select("pattern", "bin", "hash", "id", "size"), {p[1]: p[5] for p in plan if p[5]})
    span_df = spark.createDataFrame(spans, "pattern int, low_hash long, low_id long, high_hash long, high_id long, most long")
    span_df = span_df.groupBy("pattern").agg(F.collect_list(F.struct("low_hash", "low_id", "high_hash", "high_id", "most")).alias("spans"))
    chosen_df = spark.createDataFrame(chosen, "chosen_pattern int, chosen_id long").distinct().withColumn("single", F.lit(True))
    out = rows.join(F.broadcast(span_df), "pattern", "left").join(F.broadcast(chosen_df), (F.col("pattern") == F.col("chosen_pattern")) & F.col("id").eqNullSafe(F.col("chosen_id")), "left")
    at = F.struct(*_ORDER)
    # fields get the row's own names, since structs are compared by type
    low, high = (lambda s, end=end: F.struct(s[f"{end}_hash"].alias("hash"), s[f"{end}_id"].alias("id")) for end in ("low", "high"))
    inside = F.exists("spans", lambda s: (at > low(s)) & (at <= high(s)) & (F.col("size") <= s["most"]))
    extra = F.when(F.coalesce(inside, F.lit(False)) | F.coalesce("single", F.lit(False)), 1).otherwise(0)
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + extra).cast("long")
    return out.select(F.col("id").alias(id_col), "sources", "size", "source_size", "target", times.alias("repeats"), (times * F.col("size")).alias("taken"), *([F.col(carry)] if carry else []))
