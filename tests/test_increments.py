"""What is kept up to date by batches, against what one pass over everything gives."""

import random

from pyspark.sql import functions as F

from palimpsest.functions.config import Settings
from palimpsest.operators import metrics
from palimpsest.plans import intervals, replay
from palimpsest.streaming import cube
from palimpsest.streaming.sessions import Sessions
from palimpsest.streaming.store import Memo, Store

from .test_intervals import REPORT, as_rows, said


def test_sessions_by_batches_equal_full_replay(spark, tmp_path):
    """Messages in two random cuts, with repeats, other contents for known places, rows that belong nowhere, and a batch that is run twice."""
    rng, settings = random.Random(5), Settings(mode="BALANCED")
    messages = said(spark)
    rows = messages.collect()
    cuts = [rng.randrange(2) for _ in rows]
    early, rest = ([tuple(r) for r, c in zip(rows, cuts, strict=True) if c == n] for n in range(2))
    late = [(*early[0][:2], "user", "another content for a known place", False), (None, 3, "user", "nobody's", False), (7, None, "user", "nowhere", False)]
    kept = Sessions(Store(spark, f"file://{tmp_path}"), settings)
    kept.advance(spark.createDataFrame(early + early[:3], messages.schema), 0)
    for _ in range(2):
        kept.advance(spark.createDataFrame(rest + early[:2] + late, messages.schema), 1)
    _, want = intervals.encoded(messages, replay.requests(messages), settings)
    want = as_rows(want, REPORT)
    assert as_rows(kept.answers(), REPORT) == want
    assert as_rows(kept.messages(), messages.columns) == as_rows(messages, messages.columns)
    for name, key in (("texts", ["key", "profile", "new"]), ("codes", ["key", *intervals.CONTEXT]), ("judgements", ["key", *intervals.CONTEXT, "pairs"])):
        made = kept.store.read(name)  # no text was worked on twice, and every batch added some
        assert made.count() == made.select(*key).distinct().count()
    assert kept.store.read("texts").select("batch").distinct().count() == 2
    kept.compact(2)
    assert as_rows(kept.answers(), REPORT) == want


def test_sessions_follow_a_stream(spark, tmp_path):
    """Files of messages as a stream, its query stopped and started again in between."""
    messages, settings = said(spark).filter("conv_id in (100001, 100002, 100004)"), Settings()
    kept = Sessions(Store(spark, f"file://{tmp_path}/store"), settings)
    assert kept.answers() is None and kept.messages() is None
    (tmp_path / "in").mkdir()
    arriving = spark.readStream.schema(messages.schema).parquet(f"file://{tmp_path}/in")
    for part in ("idx < 6", "idx >= 6"):
        messages.filter(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        kept.follow(arriving).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    _, want = intervals.encoded(messages, replay.requests(messages), settings)
    assert as_rows(kept.answers(), REPORT) == as_rows(want, REPORT)
    assert {r["batch"] for r in kept.store.read("messages").select("batch").distinct().collect()} == {0, 1}


EVENT = "ts double, model string, original_tokens long, encoded_tokens long, dict_overhead long, eff_overhead long, saved long, pct double, latency_ms double, fallback int, fallback_reason string, direction string, representation string"


def test_cube_equals_summaries(spark, tmp_path):
    """Events in any order of arrival, one batch run twice, with nulls; an empty cube; time filters; compaction."""
    rng = random.Random(3)
    event = lambda: (rng.randrange(9) * 1800.0, rng.choice(["a", "b", None]), rng.randrange(99), rng.randrange(99), rng.randrange(9), rng.randrange(9), rng.randrange(-9, 99), rng.choice([None, 0.5, 25.0]), rng.choice([None, 0.25, 2.0]), rng.randrange(2), rng.choice(["", "error:X", "not-worth-it", None]), rng.choice(["in", "in", "out"]), rng.choice(["terse", "passthrough"]))
    rows = [event() for _ in range(120)]
    events = spark.createDataFrame(rows, EVENT)
    store = Store(spark, f"file://{tmp_path}")
    assert cube.cube(store) is None
    for n, part in enumerate((rows[70:], rows[:30], rows[30:70], [])):
        for _ in range(1 + n % 2):
            cube.add(store, spark.createDataFrame(part, EVENT), n)
    want = {**metrics.summary(events).first().asDict()}
    for _ in range(2):
        got = metrics.rolled_up(cube.cube(store)).first().asDict()
        assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
        by_model = metrics.rolled_up(cube.cube(store), "model").filter("level = 1").select("model", "requests", "saved", "avg_pct")
        assert as_rows(by_model, by_model.columns) == as_rows(metrics.by_model(events), by_model.columns)
        by_both = metrics.rolled_up(cube.cube(store), "representation", "model")
        assert as_rows(by_both.filter("level = 1"), ["representation", "requests", "saved"]) == as_rows(metrics.by_representation(events), ["representation", "requests", "saved"])
        assert [r["requests"] for r in by_both.filter("level = 0").collect()] == [want["requests"]]
        recent = metrics.rolled_up(cube.cube(store, since_hour=2)).first()
        assert recent["requests"] == metrics.summary(events.filter("ts >= 7200")).first()["requests"]
        store.compact("cells", 3)
    empty = metrics.rolled_up(metrics.cells(events.limit(0))).first()
    assert empty["requests"] == 0 and empty["avg_latency_ms"] is None


def test_store_reads_what_was_finished(spark, tmp_path):
    """A batch that broke off is no batch; a memo computes each key once."""
    store = Store(spark, f"file://{tmp_path}")
    asked = []

    def make(missing):
        asked.append(sorted(r["key"] for r in missing.collect()))
        return missing.select("key", (F.col("key") * 10).alias("value"))

    for n, keys in enumerate(([1, 2], [2, 3], [3, 4])):
        got = Memo(store, n).filled("m", spark.createDataFrame([(k,) for k in keys], "key long"), ["key"], make)
        assert sorted((r["key"], r["value"]) for r in got.collect()) == [(k, 10 * k) for k in keys]
    assert asked == [[1, 2], [3], [4]]
    (tmp_path / "m" / "batch=2" / "_SUCCESS").unlink()
    assert sorted(r["key"] for r in store.read("m").collect()) == [1, 2, 3]
    store.compact("m", 2)
    assert sorted(r["key"] for r in store.read("m", 1).collect()) == [1, 2] and store.read("m").count() == 3
