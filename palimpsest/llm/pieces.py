"""Operator 7: SentencePiece segmentations sampled by forward filtering and backward sampling.

All segmentations of a word form a lattice whose edges are vocabulary pieces.
Forward filtering gives every node the total weight of the paths that reach it;
backward sampling then walks from the end, choosing each edge in proportion to
the weight behind it, so whole segmentations are drawn exactly in proportion to
their weight. A piece weighs (rank + 1) ** -theta, its vocabulary rank standing
for a Zipf law; a larger theta comes closer to the best segmentation.

No piece has a space mark after another character, so a text's lattice falls
apart before each word; a worker filters all distinct words of a block together,
as arrays. The probabilities are fixed 32-bit thresholds; occurrence number k of a row draws
its numbers from (seed, row key, k, step) by a counter-based hash. A
segmentation therefore depends on the row alone: not on batches, partitions or
reruns.

Characters outside the vocabulary, and a literal space mark, become byte pieces,
so decoding gives back every text exactly. Nulls count as empty and have no
pieces. A word without any break is handled in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, mix64, sliced, texts

SPACE = "▁"
#: Occurrences of words handled at once, which bounds a worker's tables.
BLOCK_WORDS = 250_000
#: Rows of a batch whose words are in memory at once.
SLICE = 100
_WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n+")
_NEVER = 0x110000  # stands for characters that no piece may cover
_U = np.uint64


class Lattice:
    """Piece lattices of many words at once, as arrays over the nodes of their prefix tree."""

    def __init__(self, path: str, theta: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.of_byte = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.raw = [t.replace(SPACE, " ").encode() for t in self.text]
        for b, i in self.of_byte.items():
            self.raw[i] = bytes([b])
        self.log_weight = -theta * np.log(np.arange(1, size + 1, dtype=np.float64))
        self.byte_weight = float(self.log_weight[-1])  # one of four at most, so vocabulary pieces win where there are any
        plain = {t: i for i, t in enumerate(self.text) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
        self.longest = max(map(len, plain))
        self.id_of = plain
        self._trie(plain)

    def _trie(self, pieces: dict[str, int]) -> None:
        """Sorted transitions (node << 21 | code point) -> node; the root's are a plain table."""
        nodes: dict[str, int] = {}
        found: list[int] = []
        for t, i in pieces.items():
            for n in range(1, len(t) + 1):
                if t[:n] not in nodes:
                    nodes[t[:n]] = len(found)
                    found.append(-1)
            found[nodes[t]] = i
        self.node_piece = np.array(found, dtype=np.int64)
        self.root = np.full(_NEVER + 1, -1, dtype=np.int64)
        keys, goal = [], []
        for t, k in nodes.items():
            if len(t) == 1:
                self.root[ord(t)] = k
            else:
                keys.append(nodes[t[:-1]] << 21 | ord(t[-1]))
                goal.append(k)
        order = np.argsort(np.array(keys))
        self.keys, self.goal = np.array(keys)[order], np.array(goal)[order]

    def _step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Trie states one character on; -1 where no piece goes on."""
        out = np.full(len(state), -1, dtype=np.int64)
        live = np.flatnonzero(state >= 0)
        key = state[live] << 21 | codes[live]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        out[live[hit]] = self.goal[at[hit]]
        return out

    def _forward(self, words: list[str]):
        """Forward filtering over the prefix tree of the words, which come longest first.

        Words share the nodes of common prefixes; node 0 is a word's start.
        Returns each word's last node, and by length and node the cumulative
        32-bit thresholds and the edges: node before << 22 | piece + 0x110002.
        """
        size = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        literal = codes == ord(SPACE)
        codes = np.where(codes == 32, ord(SPACE), codes)
        codes[literal] = _NEVER
        first = np.cumsum(size) - size
        alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        last = np.zeros(len(words), dtype=np.int64)
        inside = [np.zeros(1)]
        level = (np.zeros((1, 0), dtype=np.int64), np.zeros((1, 0), dtype=np.int64))
        nodes, total_nodes = [], 1
        low = 0  # the first node of the level before
        for p in range(1, int(size[0]) + 1):
            n = int(alive[p - 1])
            key, where = np.unique(last[:n] << 21 | codes[first[:n] + p - 1], return_inverse=True)
            parent, code = key >> 21, key & 0x1FFFFF
            last[:n] = total_nodes + where
            up_state, up_node = level[0][parent - low], level[1][parent - low]
            states, before = [self.root[code]], [parent]
            for k in range(up_state.shape[1]):
                state = self._step(up_state[:, k], code)
                if k + 1 < self.longest:
                    states.append(state)
                    before.append(up_node[:, k])
            while len(states) > 1 and (states[-1] < 0).all():
                states.pop()
                before.pop()
            state, node = np.stack(states, axis=1), np.stack(before, axis=1)
            piece = np.where(state >= 0, self.node_piece[state], -1)
            weight = np.where(piece >= 0, self.log_weight[piece], -np.inf)
            bare = piece[:, 0] < 0  # covered by bytes: -2 - code point
            piece[bare, 0] = -2 - np.where(code[bare] == _NEVER, ord(SPACE), code[bare])
            weight[bare, 0] = self.byte_weight
            held = np.concatenate(inside[-node.shape[1] - 1 :])
            start = total_nodes - len(held)
            score = weight + held[np.maximum(node - start, 0)]
            top = score.max(axis=1, keepdims=True)
            run = np.cumsum(np.exp(score - top), axis=1)
            whole = run[:, -1:]
            inside.append((top + np.log(whole))[:, 0])
            cut = np.where(run < whole, np.minimum(run / whole * 4294967296.0, 4294967295.0), 4294967295.0).astype(np.uint32)
            nodes.append((piece, node, cut))
            low, level = total_nodes, (state, node)
            total_nodes += len(key)
        width = max(x[0].shape[1] for x in nodes)
        cuts = [np.full(total_nodes, 4294967295, dtype=np.uint32) for _ in range(width)]
        edges = np.zeros((width, total_nodes), dtype=np.int64)
        at = 1
        for piece, node, cut in nodes:
            for k in range(cut.shape[1]):
                cuts[k][at : at + len(cut)] = cut[:, k]
                edges[k, at : at + len(cut)] = node[:, k] << 22 | piece[:, k] + 0x110002
            at += len(cut)
        return last, cuts, edges

    def _block(self, words: list[str], draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling: pieces of all occurrences in order, and how many each has."""
        distinct = sorted(set(words), key=len, reverse=True)
        last, cuts, edges = self._forward(distinct)
        place = dict(zip(distinct, last.tolist(), strict=True))
        at = np.array([place[w] for w in words], dtype=np.int64)
        active = np.argsort(at)  # neighbours in the table together
        at, draw = at[active], draw[active]
        depth = np.zeros(len(words), np.int64)
        steps = []
        while len(active):
            u = np.minimum(mix64(draw + _U(len(steps))) >> _U(32), _U(4294967294)).astype(np.uint32)
            edge = edges[0][at]
            left = np.flatnonzero(cuts[0][at] <= u)
            for k in range(1, len(cuts)):
                if not len(left):
                    break
                there = at[left]
                edge[left] = edges[k][there]
                left = left[cuts[k][there] <= u[left]]
            steps.append((active, (edge & 0x3FFFFF) - 0x110002))
            depth[active] += 1
            at = edge >> 22
            more = np.flatnonzero(at)
            active, at, draw = active[more], at[more], draw[more]
        bound = np.cumsum(depth)
        ids = np.empty(int(bound[-1]), np.int64)
        for k, (who, got) in enumerate(steps):
            ids[bound[who] - 1 - k] = got
        return ids, depth

    def split(self, text: str) -> list[str]:
        """The words of a text, with the space that the encoder puts in front; newlines have byte pieces alone and stand by themselves."""
        return _WORDS.findall(" " + text) if text else []

    def sample(self, rows: list[str], keys: list[int], seed: int) -> list[np.ndarray]:
        """The piece ids of each row; ``keys`` are 64-bit row keys."""
        words = [self.split(t) for t in rows]
        count = np.array([len(w) for w in words], dtype=np.int64)
        total = int(count.sum())
        if not total:
            return [np.zeros(0, np.int32) for _ in rows]
        row = np.repeat(np.arange(len(rows)), count)
        number = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        draw = mix64(np.array(keys, dtype=_U)[row] * _U(0x9E3779B97F4A7C15) + mix64(number.astype(_U) + _U(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)))
        flat = [w for ws in words for w in ws]
        blocks = [self._block(flat[a : a + BLOCK_WORDS], draw[a : a + BLOCK_WORDS]) for a in range(0, total, BLOCK_WORDS)]
        ids = np.concatenate([b[0] for b in blocks])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([b[1] for b in blocks]))])
        bounds = ends[np.concatenate([[0], np.cumsum(count)])]
        return [self._bytes(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece become their byte pieces."""
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            parts, at = [], 0
            for i in odd.tolist():
                parts += [ids[at:i], np.array([self.of_byte[b] for b in chr(-2 - int(ids[i])).encode("utf-8", "surrogatepass")])]
                at = i + 1
            ids = np.concatenate([*parts, ids[at:]])
        return ids.astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids, without the space that the encoder put in front."""
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:]


@cache
def lattice(path: str, theta: float) -> Lattice:
    return Lattice(path, theta)


def numbered_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "copy") -> DataFrame:
    """``df`` with the number of each row among rows with its id and text, from 0 on, so that copies can be sampled apart."""
    alike = Window.partitionBy(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))).orderBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(alike) - 1)


def sampled_pieces(
    df: DataFrame, path: str, seed: int = 0, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, copy_col: str | None = None
) -> DataFrame:
    """Per row: id, n_bytes, n_pieces, ids_sha256 (of the ids as 32-bit little-endian numbers), lossless (decoding gives back the text); with ``keep_ids`` piece_ids follows.

    A null id is keyed like the number 0. ``copy_col`` names an integer column with a
    row's number among its copies, which then is part of its key and of the result.
    """
    columns = (id_col, text_col, *([copy_col] if copy_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, theta)
        for b in sliced(batches, SLICE):
            keys = b.column(0).to_pylist()
            copies = b.column(2).to_pylist() if copy_col else [0] * len(keys)
            names = [f"{k or 0}/{c}" if c else str(k or 0) for k, c in zip(keys, copies, strict=True)]
            rows = [t or b"" for t in texts(b, text_col)]
            ids = model.sample([t.decode("utf-8", "surrogatepass") for t in rows], [xxhash.xxh64_intdigest(k, seed=seed) for k in names], seed)
            out = {
                id_col: (keys, pa.int64()), "n_bytes": ([len(t) for t in rows], pa.int64()), "n_pieces": ([len(x) for x in ids], pa.int64()),
                "ids_sha256": ([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()), "lossless": ([model.decode(x) == t for x, t in zip(ids, rows, strict=True)], pa.bool_()),
            }
            if copy_col:
                out[copy_col] = (copies, pa.int32())
            if keep_ids:
                out["piece_ids"] = (ids, pa.list_(pa.int32()))
            yield from as_batches(out)

    schema = f"`{id_col}` long, n_bytes long, n_pieces long, ids_sha256 string, lossless boolean" + (f", `{copy_col}` int" if copy_col else "") + (", piece_ids array<int>" if keep_ids else "")
    return arrow_map(df, columns, run, schema)


def decoded(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """Per row: id and the text of its piece ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, 1.0)
        for b in batches:
            rows = [model.decode(np.array(x or [], dtype=np.int32)).decode("utf-8", "surrogatepass") for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield from as_batches({id_col: (b.column(b.schema.get_field_index(id_col)), pa.int64()), "text": (rows, pa.string())})

    return arrow_map(df, (id_col, ids_col), run, f"`{id_col}` long, text string")
