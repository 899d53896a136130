"""The corpus pipeline's stages against brute force."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm.common import stored
from tests.llm.test_operators import brute_components, texts_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF))
        held[name] = docs
        if name == "exact_dedup":
            last = {}
            for i, t in texts_of(before):
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
                last[key] = max(i, last.get(key, i))
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(last.values())
        if name == "minhash_near_dedup":
            want = {c for _, c in brute_components(texts_of(before), 5).values()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "source_mixing":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        if name != "sentencepiece":
            assert docs.columns == before.columns
    assert held["sentencepiece"].filter("not lossless").count() == 0 and held["sentencepiece"].count() == held["source_mixing"].count()


ROWS = [
    (1, "Der Hund läuft über die Straße und bellt die Katze an, die auf dem Zaun sitzt", "de", "a"), (1, "Der Hund läuft über die Straße und bellt die Katze an, die auf dem Zaun sitzt", "de", "a"),
    (2, "The dog runs over the street and barks at the cat that sits on the fence", "en", "b"), (3, "the dog runs over the street and barks at the CAT that sits on the fence", None, None),
    (None, "a row without an id has a text of its own", "en", "b"), (None, "a row without an id has a text of its own", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "wort " * 30_000, "de", "a"),
]


def test_stages_on_odd_rows(spark):
    """Repeated rows, nulls, an empty and a very long text, and columns with the operators' own names."""
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars int")
    for c in ("__id", "__digest", "__number", "repeats", "copy", "component"):
        docs = docs.withColumn(c, F.lit("own"))
    stages = dict(corpus_pipeline.STAGES)
    as_rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    named = stages["language_id"](spark, docs, SF)
    assert named.columns == docs.columns and {r["doc_id"] for r in named.collect()}.isdisjoint({4, 5})
    exact = stored(stages["exact_dedup"](spark, docs, SF))
    assert exact.columns == docs.columns and as_rows(exact) == sorted([(1, ROWS[0][1]), (3, ROWS[3][1]), (None, ROWS[4][1]), (5, ""), (6, ROWS[8][1])], key=str)
    near = stored(stages["minhash_near_dedup"](spark, docs, SF))
    assert near.columns == docs.columns and as_rows(near) == sorted([(1, ROWS[0][1]), (2, ROWS[2][1]), (None, ROWS[4][1]), (4, None), (5, ""), (6, ROWS[8][1])], key=str)
    mixed = stored(stages["source_mixing"](spark, near, SF))
    counts = Counter(as_rows(mixed))
    assert mixed.columns == docs.columns and set(counts.values()) <= {1, 2} and set(counts) <= set(as_rows(near)) and 2 in counts.values()
    out = stages["sentencepiece"](spark, mixed, SF).collect()
    assert len(out) == mixed.count() and all(r["lossless"] for r in out)
    twice = [r for r in out if r["n_pieces"] > 5 and counts[max((k for k in counts if k[0] == r["doc_id"]), key=str)] == 2]
    assert len({(r["doc_id"], r["ids_sha256"]) for r in twice}) > len(twice) // 2  # copies are sampled apart; short ones may agree by chance
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_mix_carries_rows(spark):
    """Rows that share an id, or have none, are taken each by its own plan: none is multiplied, none comes in for another."""
    rows = [(7, "w " * 100, "a"), (7, "x", "a"), (7, "y", "a"), (None, "v " * 60, "b"), (None, "u", "b"), (None, "u", "b"), *[(i, "t " * (i % 40), "c") for i in range(300)], (5, "other " * 9, "c")]
    docs = spark.createDataFrame([(i, t, None, s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumn("row", F.lit("own")).withColumn("sources", F.lit("own"))
    mixed = dict(corpus_pipeline.STAGES)["source_mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    kept = [(r["doc_id"], r["text"], r["source"]) for r in mixed.collect()]
    there, taken = Counter(rows), Counter(kept)
    assert set(taken) <= set(there) and all(n <= 2 * there[k] for k, n in taken.items())
    words = Counter()
    for _, t, s in kept:
        words[s] += len(t.split())
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    total = sum(sizes.values())
    assert all(words[s] <= 2 * sizes[s] for s in "abc") and abs(sum(words.values()) - 1.5 * total) <= 0.05 * total


def test_workers_take_batches_in_slices_and_give_memory_back(monkeypatch):
    """A worker goes on to later tasks: what a task took is released at its end, also where its reader stops early."""
    import pyarrow as pa

    from palimpsest.llm import common

    released = []
    monkeypatch.setattr(common, "_released", lambda: released.append(1))
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, a + n))}) for a, n in ((0, 7), (7, 0), (7, 3))]
    parts = list(common.releasing(lambda it: common.sliced(it, 3))(iter(batches)))
    assert [len(p) for p in parts] == [3, 3, 1, 3] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(10))
    assert len(released) == 1
    early = common.releasing(lambda it: common.sliced(it, 3))(iter(batches))
    next(early)
    early.close()
    assert len(released) == 2
