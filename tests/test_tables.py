"""Dictionary, request, metrics and source operators on small tables."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import config, tokens
from palimpsest.functions.config import Settings
from palimpsest.operators import dictionary, folding, metrics
from palimpsest.plans import encode, replay
from palimpsest.sources import chat
from palimpsest.streaming import decoder, replies
from palimpsest.streaming.store import Store

MESSAGES = "conv_id long, idx long, role string, content string, has_tool_calls boolean"
RULES = "Please make sure that you preserve the existing functionality. Do not break existing functionality. Run the full test suite afterwards. Preserve all public APIs exactly as they are. Update the documentation to match. Do not modify unrelated files."


def test_mint(spark):
    rows = spark.createDataFrame([("g", "Deploy the staging cluster with care tonight", i) for i in range(5)] + [("g", "tiny clause once only", 9)], "scope string, clause string, seq long")
    table = dictionary.nursery(rows)
    assert {r["phrase"]: r["count"] for r in table.collect()} == {"deploy the staging cluster with care tonight": 5, "tiny clause once only": 1}
    minted = dictionary.mint(table, dictionary.seeds(spark, "g")).collect()
    assert [(r["code"], r["net"]) for r in minted] == [("K16", (13 - 2) * 10 - (13 + 6))]
    assert [r["phrase"] for r in dictionary.left_in_nursery(table, dictionary.mint(table, dictionary.seeds(spark, "g"))).collect()] == ["tiny clause once only"]


def test_import_twice(spark):
    seeds = dictionary.seeds(spark)
    pack = spark.createDataFrame([("global", "K201", "ship it", ["ship it"], None)], dictionary.ALIASES)
    once = dictionary.imported(seeds, pack)
    assert once.count() == 17 and dictionary.imported(once, pack).count() == 17


def conversation(spark, turns, conv=1):
    return spark.createDataFrame([(conv, i, r, c, False) for i, (r, c) in enumerate(turns)], MESSAGES)


def test_encode_never_larger_and_verified(spark):
    long = "\n".join([*["some words of no weight at all"] * 39, "error: cache miss was the bug"])
    m = conversation(spark, [("system", "be exact"), ("user", RULES), ("assistant", long), ("user", RULES + " Keep 3 copies.")])
    rows, req = encode.encode(replay.replayed(m, replay.requests(m)).drop("last_idx"), Settings())
    got = req.orderBy("req_no").collect()
    assert len(got) == 2 and all(r["encoded_tokens"] + r["eff_overhead"] <= r["original_tokens"] for r in got)
    out = encode.composed(rows, req).filter("req_no = 2").orderBy("idx").collect()
    assert [r["role"] for r in out].count("system") == 1 and out[0]["role"] == "system"
    assert "error: cache miss was the bug" in out[0]["content"] and len(out) < 4


def test_small_and_off_and_empty(spark):
    m = conversation(spark, [("user", "hi there"), ("user", None)])
    both = replay.replayed(m, replay.final_requests(m)).drop("last_idx")
    assert [r["state"] for r in encode.encode(both, Settings())[1].collect()] == ["small"]
    assert [r["state"] for r in encode.encode(both, Settings(mode="OFF"))[1].collect()] == ["off"]
    assert encode.encode(both.limit(0), Settings())[1].count() == 0


@pytest.mark.parametrize(("overhead", "cached", "effective"), [(15, True, 1), (15, False, 15), (30, True, 3)])
def test_effective_overhead(spark, overhead, cached, effective):
    assert spark.range(1).select(encode.effective_overhead(F.lit(overhead), F.lit(cached)).alias("x")).first()["x"] == effective


def test_metrics(spark):
    schema = "ts double, model string, original_tokens long, encoded_tokens long, dict_overhead long, eff_overhead long, saved long, pct double, latency_ms double, fallback int, representation string, direction string, fallback_reason string"
    e = spark.createDataFrame([
        (1.0, "m", 100, 60, 30, 3, 10, 10.0, 4.0, 0, "terse", "in", ""), (2.0, "m", 50, 50, 0, 0, 0, 0.0, 4.0, 1, "passthrough", "in", "error:RuntimeError"),
        (3.0, "m", 70, 70, 0, 0, 0, 0.0, 4.0, 1, "original", "in", "not-worth-it"), (4.0, "m", 80, 50, 0, 0, 30, 0.0, 0.0, 0, "", "out", ""),
    ], schema)
    s = metrics.summary(e).first()
    assert (s["saved"], s["saved_effective"]) == (10, 37) and s["error_pct"] == pytest.approx(100 / 3) and s["reverted_pct"] == pytest.approx(100 / 3)
    o = metrics.output_summary(e).first()
    assert (o["generated"], o["saved"]) == (50, 30)
    assert metrics.reductions(metrics.summary(e.limit(0))).first()["reduction_pct"] == 0


def test_config():
    assert config.load("{broken").mode == "MAX" and config.load('{"mode": "quick"}').mode == "BALANCED"
    assert config.load(config.save(Settings(mode="OFF"))) == Settings(mode="OFF")


def test_sources(spark):
    body = {"model": "m", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "user", "content": None}]}
    got = chat.chat_messages(chat.bodies(spark.createDataFrame([(1, json.dumps(body)), (2, "{broken")], "conv_id long, body string")), "openai").collect()
    assert [(r["conv_id"], r["content"]) for r in got] == [(1, "ab"), (1, "")]
    frames = spark.createDataFrame([("s", 0, 'data: {"choices":[{"delta":{"content":"K"}}]}'), ("s", 1, ": ping"), ("s", 2, "data: [DONE]")], "session string, seq long, frame string")
    assert [(r["delta"], r["done"]) for r in chat.sse_deltas(frames).orderBy("seq").collect()] == [("K", False), (None, True)]


def test_stream_query(spark, tmp_path):
    rows = [("a", 0, "first K", False), ("b", 0, "x ", False), ("a", 1, "12 then", False), ("b", 1, "OK1", False), ("a", 2, "", True), ("b", 2, "", True)]
    spark.createDataFrame(rows, "session string, seq long, delta string, done boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, seq long, delta string, done boolean").parquet(f"{tmp_path}/in")
    q = decoder.decode_stream(stream, {"K12": "fix all bugs found", "K1": "no"}).writeStream.format("memory").queryName("decoded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    out = {s: "".join(r["text"] for r in spark.table("decoded").filter(F.col("session") == s).orderBy("seq").collect()) for s in "ab"}
    assert out == {"a": "first fix all bugs found then", "b": "x OK1"}


def test_replies_by_batches(spark, tmp_path, monkeypatch):
    """Sessions cut over batches at any place, of which one is run again, say what decoding each whole reply would; what waits is that of open sessions alone."""
    monkeypatch.setattr(decoder, "SESSIONS", 3)
    known, originals = {"K1": "one", "K12": "twelve"}, {"0123456789abcdef": "ORIGINAL"}
    rng = random.Random(8)
    parts = ["K1", "K12", "K", "xK1", "K1x", " ", "_", "[", "[ref:0123456789abcdef 3L]", "[code:0123", "é"]
    want, batches = {}, [[], [], []]
    for n in range(25):
        text = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        pieces = [text[i : i + 3] for i in range(0, len(text), 3)]
        want[f"s{n}"] = "".join(decoder.decoded(pieces, known, originals))
        at = sorted(rng.choices(range(3), k=len(pieces) + 1))
        for seq, (batch, piece) in enumerate(zip(at, [*pieces, None], strict=True)):
            batches[batch].append((f"s{n}", seq, piece, piece is None))
    store = Store(spark, str(tmp_path))
    for number in (0, 1, 1, 2):
        batch = spark.createDataFrame(batches[number], "session string, seq long, delta string, done boolean")
        replies.advance(store, number, batch, known, originals)
        seen = {s for b in batches[: number + 1] for s, *_ in b}
        ended = {s for b in batches[: number + 1] for s, _, _, done in b if done}
        assert {r["session"] for r in store.one("held", number).collect()} == seen - ended
    assert {r["session"]: r["out"] for r in replies.said(store).collect()} == want


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs a local vocabulary")
def test_models_are_counted_with_their_vocabulary(spark):
    from tokenizers import Tokenizer

    said = [("qwen2.5:0.5b", "Hello there, world"), ("claude-sonnet", "x" * 34), ("qwen2.5", None), ("llama3", "y" * 34), (None, "")]
    rows = tokens.counted(spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "i int, model string, text string"), "text", "model", {"qwen2.5": (VOCABULARY, "hf")})
    got = {r["i"]: (r["profile"], r["tokens"], r["exact"]) for r in rows.collect()}
    size = len(Tokenizer.from_file(VOCABULARY).encode("Hello there, world", add_special_tokens=False).ids)
    assert got == {0: ("qwen2.5", size, True), 1: ("claude-est", 10, False), 2: ("qwen2.5", 0, True), 3: ("llama3", 10, False), 4: ("o200k", 0, False)}


def test_reply_frames(spark):
    frames = lambda rows: spark.createDataFrame(rows, "session string, seq long, frame string")
    sse = frames([("a", 0, ": ping"), ("a", 1, 'data: {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "K1"}}'), ("a", 2, 'data: {"type": "message_stop"}')])
    assert [(r["seq"], r["delta"], r["done"]) for r in chat.block_deltas(sse).orderBy("seq").collect()] == [(1, "K1", False), (2, None, True)]
    lines = frames([
        ("a", 0, '{"response": "so", "done": false}'), ("a", 1, '{"response": "", "done": true}'), ("b", 0, '{"response": "K", "done": false}'), ("b", 1, "no json"),
        ("c", 0, '{"response": "x"}'), ("c", 1, '{"error": "gone"}'),
    ])
    ended = chat.with_end(chat.ndjson_deltas(lines, "$.response")).filter("done")
    assert {(r["session"], r["seq"]) for r in ended.collect()} == {("a", 1), ("b", 1), ("c", 1)}


def test_old_turns_fold_to_repeats_and_summaries(spark):
    result, other = "result " * 70, "Plain words of a turn. " * 30
    said = [(1, n, i, role, text, False) for n in (1, 2) for i, (role, text) in enumerate([("system", "be brief"), ("tool", result), ("user", result), ("assistant", other), ("user", "go on"), ("user", "now then please")])]
    messages = spark.createDataFrame(said, "conv_id int, req_no int, idx int, role string, content string, has_tool_calls boolean")
    made = spark.createDataFrame([(1, 3, 3, 1, "short of it")], "conv_id int, start int, end int, since int, summary string")
    rows, _ = encode.encode(messages, Settings(history_style="folds"), summaries=made)
    plain = {(r["req_no"], r["idx"]): r["plain"] for r in rows.collect()}
    assert plain[1, 1].endswith("tool-result; expand on request]") and plain[1, 2].endswith(" tool unchanged from turn 1]")
    assert plain[1, 3] != "short of it" and plain[2, 3] == "short of it"
    due = folding.to_summarise(messages.withColumn("tokens", F.lit(100)).filter("idx < 5"), 500, 500)
    assert {r["idx"] for r in due.collect()} == {3}


def test_no_seed_dictionary_no_codes(spark):
    text = "Please run the full test suite afterwards and preserve all public APIs, keep 3 files. " * 3
    messages = spark.createDataFrame([(1, 1, 0, "user", text, False)], "conv_id int, req_no int, idx int, role string, content string, has_tool_calls boolean")
    rows, _ = encode.encode(messages, Settings(seed_dictionary=False))
    r = rows.first()
    assert r["plain"] == r["aliased"] and not re.search(r"\bK\d", r["aliased"])
