"""Operator 8: exact dedup with Patricia-trie owners.

Every task first feeds its own rows into a trie, so a text with a billion
copies leaves each task as one row. Those rows are dealt out by text length and
content hash; the receiving task inserts the full byte strings into a second
trie, and each terminal keeps the winning identifier and the number of copies.
Equality is decided on the bytes in the trie; the SHA-256 digest only carries a
terminal's verdict back to its rows.

When a trie outgrows its memory, subtrees move to a temporary file of the task,
and texts under a moved subtree follow it; each file then gets a trie of its own.

Nulls count as empty texts; rows with a null id take part, and their id never
wins over another. Repeated rows are copies like any others. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import pickle
import string
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, ascii_lower, packed, releasing, texts

#: Bytes of text that a trie holds before subtrees are spilled.
TRIE_BYTES = 64 << 20


class Node:
    """An edge label with what hangs below it. ``value`` is [owner, count] on terminals; ``spill`` is a file once the subtree has moved out."""

    __slots__ = ("children", "label", "spill", "value")

    def __init__(self, label: bytes, value: list | None = None):
        self.label, self.value, self.children, self.spill = label, value, {}, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling and halving over slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings with owners on terminal nodes."""

    def __init__(self, largest: bool = True, budget: int = TRIE_BYTES):
        self.root, self.largest, self.budget, self.held = Node(b""), largest, budget, 0

    def _merge(self, value: list, owner: int | None, count: int) -> None:
        if value[0] is None or owner is not None and (owner > value[0] if self.largest else owner < value[0]):
            value[0] = owner
        value[1] += count

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key, owner, count), node.spill)
                return
            if at == len(key):
                if node.value is None:
                    node.value = [None, 0]
                self._merge(node.value, owner, count)
                return
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:], [owner, count])
                node.children[key[at]] = child
                self.held += len(child.label) + 200
                if self.held > self.budget:
                    self._move_out()
                return
            n = len(child.label)
            if key.startswith(child.label, at):
                node, at = child, at + n
                continue
            k = _common(child.label, key[at : at + n])
            top = Node(child.label[:k])
            child.label = child.label[k:]
            top.children[child.label[0]] = child
            node.children[key[at]] = top
            self.held += 200
            node, at = top, at + k

    def _move_out(self) -> None:
        """Spills the root's subtrees, largest first, until half of the budget is free."""
        sizes = sorted(((sum(len(n.label) + 200 for n, _ in self._walk(c, b"")), k) for k, c in self.root.children.items() if c.spill is None), reverse=True)
        for size, k in sizes:
            child = self.root.children[k]
            # the new top has an empty label beyond its first byte, so every key with that byte reaches the file
            moved = Node(bytes([k]))
            moved.spill = tempfile.TemporaryFile()
            for n, prefix in self._walk(child, b""):
                if n.value is not None:
                    pickle.dump((prefix, n.value[0], n.value[1]), moved.spill)
            self.root.children[k] = moved
            self.held -= size
            if self.held < self.budget // 2:
                break

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[Node, bytes]]:
        stack = [(node, prefix)]
        while stack:
            n, p = stack.pop()
            p += n.label
            yield n, p
            stack += [(c, p) for c in n.children.values()]

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every distinct key with its owner and count; a spilled subtree is grouped by hash until it fits."""
        for n, key in self._walk(self.root, b""):
            if n.spill is not None:
                yield from _regroup(n.spill, self.largest, self.budget, 0)
            elif n.value is not None:
                yield key, *n.value


def _records(file) -> Iterator[tuple[bytes, int | None, int]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _regroup(file, largest: bool, budget: int, level: int) -> Iterator[tuple[bytes, int | None, int]]:
    """Tries over one spilled file; a file over the budget is dealt into 16 by a hash of the whole key. After eight dealings, into four thousand million parts, only a single huge text is still over it."""
    size = file.seek(0, 2)
    if size <= budget or level >= 8:
        trie = PatriciaTrie(largest, budget=1 << 62)
        for key, owner, count in _records(file):
            trie.insert(key, owner, count)
        file.close()
        yield from trie.items()
        return
    parts = [tempfile.TemporaryFile() for _ in range(16)]
    for record in _records(file):
        pickle.dump(record, parts[xxhash.xxh64_intdigest(record[0], seed=level) % 16])
    file.close()
    for part in parts:
        yield from _regroup(part, largest, budget, level + 1)


PARTIAL = "n_bytes long, hash long, data binary, owner long, copies long"
OWNERS = "text_sha256 string, keep_id long, group_size long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_tries(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, largest: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a task; a full trie is emptied early, and the receiving side merges."""

    def out(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for key, owner, count in trie.items():
            rows.append((key, owner, count))
            size += len(key)
            if size > 4 << 20:
                yield from batch(rows)
                rows, size = [], 0
        if rows:
            yield from batch(rows)

    def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [r[0] for r in rows]
        yield from as_batches({
            "n_bytes": ([len(k) for k in keys], pa.int64()),
            "hash": ([_signed(xxhash.xxh3_64_intdigest(k)) for k in keys], pa.int64()),
            "data": (keys, pa.binary()),
            "owner": ([r[1] for r in rows], pa.int64()),
            "copies": ([r[2] for r in rows], pa.int64()),
        })

    trie = PatriciaTrie(largest, budget=1 << 62)
    for b in batches:
        for i, t in zip(b.column(b.schema.get_field_index(id_col)).to_pylist(), texts(b, text_col), strict=True):
            trie.insert(ascii_lower(t or b""), i)
        if trie.held > budget:
            yield from out(trie)
            trie = PatriciaTrie(largest, budget=1 << 62)
    yield from out(trie)


def owner_tries(batches: Iterator[pa.RecordBatch], largest: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of the partitions dealt out by length and hash."""
    trie = PatriciaTrie(largest, budget)
    for b in batches:
        data, owners, copies = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("data", "owner", "copies"))
        for key, owner, count in zip(data, owners, copies, strict=True):
            trie.insert(key, owner, count)
    rows: list[tuple[str, int | None, int]] = []
    for key, owner, count in trie.items():
        rows.append((hashlib.sha256(key).hexdigest(), owner, count))
        if len(rows) >= 10_000:
            yield from _owner_batch(rows)
            rows = []
    if rows:
        yield from _owner_batch(rows)


def _owner_batch(rows: list[tuple[str, int | None, int]]) -> Iterator[pa.RecordBatch]:
    yield from as_batches({"text_sha256": ([r[0] for r in rows], pa.string()), "keep_id": ([r[1] for r in rows], pa.int64()), "group_size": ([r[2] for r in rows], pa.int64())})


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with the SHA-256 digest of its normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from as_batches({
                id_col: (b.column(b.schema.get_field_index(id_col)), pa.int64()),
                "text_sha256": ([hashlib.sha256(ascii_lower(t or b"")).hexdigest() for t in texts(b, text_col)], pa.string()),
            })

    return arrow_map(df, (id_col, text_col), run, f"`{id_col}` long, text_sha256 string")


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: its digest, the winning id and the number of rows."""
    partial = arrow_map(df, (id_col, text_col), lambda it: local_tries(it, id_col, text_col, largest, budget), PARTIAL)
    return partial.repartition("n_bytes", "hash").mapInArrow(releasing(lambda it: owner_tries(it, largest, budget)), OWNERS)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    found = owners(df, id_col, text_col, largest, budget)
    return (
        digests(df, id_col, text_col)
        .join(found, "text_sha256")
        .select(id_col, "keep_id", "group_size", F.coalesce(F.col(id_col) == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows of ``df`` that stay, with its own columns: one row for each text, also of repeated rows and of rows without an id."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    key = ["digest", "id", "no_id"]
    rows = packed(df, digest=F.sha2(lowered, 256), id=F.coalesce(id_, F.lit(0)), no_id=id_.isNull())
    kept = owners(df, id_col, text_col, largest).select(F.col("text_sha256").alias("digest"), F.coalesce("keep_id", F.lit(0)).alias("id"), F.col("keep_id").isNull().alias("no_id"))
    # a text's copies have different ids, so they spread; only repeated rows meet, dealt out already
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")
