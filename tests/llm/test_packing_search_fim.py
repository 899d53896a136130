"""Packing, hard negatives and fill-in-middle against brute force, on odd tables and on the given ones."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import fill_middle, hard_negatives, packing, queries
from palimpsest.llm.queries import WORDS_FILE

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path(WORDS_FILE)

# --- 11: packing --------------------------------------------------------------------------------


def check_packing(pieces, docs, window):
    """Every id lies in one piece, sequences have no gaps and need no padding."""
    library = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(by_doc.pop(i), key=lambda p: p["start"])
        assert [p["start"] for p in own] == list(np.cumsum([0, *[p["length"] for p in own]])[:-1]) and sum(p["length"] for p in own) == len(ids)
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window and not at & (at - 1)
    return by_sequence


def test_packing_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    pieces = queries.op11_packing(spark, SF).collect()
    sequences = check_packing(pieces, docs, 4096)
    assert sum(sum(n for _, n in parts) < 4096 for parts in sequences.values()) <= 12  # the tail alone is short
    cut = Counter(p["doc_id"] for p in pieces)
    total = sum(p["length"] for p in pieces)
    assert sum(n - 1 for i, n in cut.items()) <= total // 4096 + 12


def test_packing_of_odd_rows(spark, messy):
    """Nulls, empties, a very long text, repeated rows and clashing names; small windows, so that most texts are cut."""
    distinct = messy.dropDuplicates(["doc_id"])
    docs = [(r["doc_id"], r["text"]) for r in distinct.select("doc_id", "text").collect()]
    for window in (4096, 8):
        check_packing(packing.packed_pieces(distinct, WORDS, window).collect(), docs, window)
    twice = packing.packed_pieces(messy, WORDS, 8)
    assert twice.agg(F.sum("length")).first()[0] == sum(len(Tokenizer.from_file(WORDS).encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in messy.collect())
    assert packing.packed_pieces(messy.limit(0), WORDS).count() == 0
    without = packing.packed_pieces(messy.withColumn("doc_id", F.lit(None).cast("long")), WORDS, 64)
    assert without.filter("doc_id is null").count() == without.count() > 0
    with pytest.raises(ValueError):
        packing.packed_pieces(messy, WORDS, 100)


def test_packing_keeps_ids(spark, messy):
    library = Tokenizer.from_file(WORDS)
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in messy.collect()}
    for p in packing.packed_pieces(messy.dropDuplicates(["doc_id"]), WORDS, 16, keep_ids=True).collect():
        assert p["ids"] == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]


def test_words_are_encoded_as_in_texts():
    """Ids of words laid end to end are the library's ids of the text, whatever its white space, marks and special strings."""
    library, words = Tokenizer.from_file(WORDS), packing.word_ids(WORDS)
    for t in ("It's  a TEST\x1cof spaces here\x85x", "é ́x ﬁ Ǆ İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "\x00 \x0b\x0c z\r\n", "数字123 ４５ \U0001f600ok", " ́", "don't we'LL 'S"):
        assert np.frombuffer(words.of(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_fill_is_closest():
    """The bitset's multiset against all multisets."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.arange(1, 14), 4, replace=False)}
        room = int(rng.integers(1, 30))
        found = packing.fill(counts, room)
        sums = [sum(k * t for k, t in zip(counts, times, strict=True)) for times in product(*(range(v + 1) for v in counts.values()))]
        assert sum(k * t for k, t in found) == max(s for s in sums if s <= room) and all(t <= counts[k] for k, t in found)


def test_plan_uses_every_rest_once():
    rng = np.random.default_rng(5)
    for window in (16, 64, 4096):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, window, 40), rng.integers(1, 100_000, 40), strict=True)} | {window - 1: 7, 1: 2}
        rows, windows, laid = packing.plan(counts, window)
        spans = defaultdict(list)
        for length, first, times, offset, sequence in rows:
            spans[length].append((first, times, offset, sequence))
        placed = laid
        for length, n in counts.items():
            own = sorted(spans[length])
            assert own[0][0] == 0
            for (first, times, _, sequence), nxt in zip(own, [*own[1:], (n,)], strict=True):
                assert nxt[0] > first and (not times or (nxt[0] - first) % times == 0)
                placed += length * (nxt[0] - first) if times else 0
        assert placed == windows * window + laid == sum(k * v for k, v in counts.items())
        assert len(rows) < 2000  # bounded by lengths, not by the millions of rests


# --- 12: hard negatives ------------------------------------------------------------------------


def brute_negatives(rows):
    """The contract, row by row."""
    rows = [(i, label, np.floor(256 * np.asarray(v, dtype=np.float64)).astype(object)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, q) for i, label, q in rows]
    out = set()
    for a, label, q in rows:
        if a % 100:
            continue
        scores = {}
        for i, other, v in rows:
            if len(v) == len(q):
                s = int(sum(int(x) * int(y) for x, y in zip(q, v, strict=True)))
                scores[i, other == label] = max(s, scores.get((i, other == label), s))
        near = sorted((-s, i) for (i, same), s in scores.items() if same and i != a)[:5]
        for s, p in near:
            far = sorted((-n, i) for (i, same), n in scores.items() if not same and 80 * -s <= 100 * n <= 100 * -s)[:5]
            out |= {(a, p, k, i, -s, -n) for k, (n, i) in enumerate(far, 1)}
    return out


def as_set(df):
    return [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def mined(df, **more):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, relabel=moved, **more)


def test_negatives_of_random_rows(spark):
    """Near vectors of a few centres, ties, hot vectors, several sizes of groups."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 6))
    rows = [(int(i), [float(x) for x in centres[i % 4] * rng.choice([0.3, 1, 2]) + rng.normal(size=6) * 0.3], int(rng.integers(0, 5))) for i in range(0, 1400)]
    rows += [(2000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25], i % 3) for i in range(400)]  # one vector, many rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_negatives(rows)
    assert len(want) > 100
    for held in ({}, {"anchors_held": 3, "candidates_held": 100}):
        got = as_set(mined(df, **held))
        assert set(got) == want and len(got) == len(want)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.1], 2), (3, [0.9, 0.1], 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (8, None, 2), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 2),
            (100, [-1.0, 0.0], 1), (200, [], 4), (201, [], 4), (202, [], 5), (300, [1e30, 1e30], 6), (303, [1e30, 1e30], 6), (302, [1e30, 1e30], 5), (400, [1.0, 2.0, 3.0], 7), (401, [1.0, 2.0, 3.0], 8), (0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("id", "norm", "cell", "kind", "q", "version"):
        df = df.withColumn(c, F.lit("own"))
    got = as_set(mined(df))
    tame = [r for r in rows if r[0] not in (300, 302, 303)]
    small = {r for r in got if r[0] != 300}
    assert small == brute_negatives(tame) and len(small) == len([r for r in got if r[0] != 300])
    assert sorted(r for r in got if r[0] == 300) == [(300, 303, k, i, 2**63 - 1, 2**63 - 1) for k, i in enumerate((0, 1, 2, 3, 302), 1)]  # scores beyond a long are held to its end
    assert mined(df.limit(0)).count() == 0


def test_limits_are_whole_numbers(spark):
    scores = [0, 1, 4, 5, 99, 100, 101, 12345, (1 << 62) + 3, -1]
    got = spark.createDataFrame([(scores,)], "s array<long>").select(hard_negatives.lower_limits("s", 80).alias("low")).first()["low"]
    assert got == [-(-80 * s // 100) if s >= 0 else 2**63 - 1 for s in scores]


def test_negatives_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall()
    got = queries.op12_hard_negatives(spark, SF)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == sorted(want) and want


# --- 13: fill in the middle ------------------------------------------------------------------------

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(i, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", " ", "a", " a ", "a b c", "ä ö\tü\n", "<P> inside", "x<S>", "数 字 \U0001f600 x", "\x85\x1c \x0b\x0c", "a  b   c    ", "word " * 50_000, "<", "<P", "P><M", None]


def test_fim_of_odd_rows(spark):
    rows = [(None if i % 41 == 0 else i, ODD[i % len(ODD)]) for i in range(320)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n", "form", "output", "id", "runs"):
        df = df.withColumn(c, F.lit("own"))
    out = fill_middle.transformed(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect())))
    assert got == sorted(str((i, *brute_fim(i, t), t or "")) for i, t in rows)
    assert {f for _, f, *_ in (brute_fim(i, t) for i, t in rows)} == {"plain", "spm", "psm"}
    assert fill_middle.transformed(df.limit(0)).count() == 0


def test_places_in_runs():
    for text, unit in product([t for t in ODD if t and len(t) < 1000], ("word", "char")):
        runs = fill_middle.Runs(text.encode(), unit)
        units = UNITS.findall(text) if unit == "word" else list(text)
        assert runs.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert runs.place(k) == (len(head.encode()), len(head)), (text, unit, k)


def test_places_from_stored_runs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD) if t is not None and len(t) < 1000], "doc_id long, text string")
    for unit in ("word", "char"):
        tables = fill_middle.class_runs(df, unit)
        asked = tables.select("doc_id", "runs", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
        for r in asked.select("doc_id", "k", fill_middle.cut_places(asked, F.col("k")).alias("at")).collect():
            units = UNITS.findall(ODD[r["doc_id"]]) if unit == "word" else list(ODD[r["doc_id"]])
            head = "".join(units[: r["k"]])
            assert r["at"] == ((len(head.encode()), len(head)) if r["k"] <= len(units) else None)


def test_fim_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op13_fill_middle']})").fetchall()
    assert sorted(map(tuple, queries.op13_fill_middle(spark, SF).select(names).collect())) == sorted(want)
