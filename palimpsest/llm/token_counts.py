"""Operator 4: token counts by prefix dynamic programming.

For byte-level BPE, the encoding of every prefix of a word is known from its
last token alone: among the vocabulary entries that end at byte i, exactly one
is compatible with the last token of the prefix before it, so

    count[i] = count[i - len(last[i])] + 1

Two tokens are compatible when BPE turns their joined bytes back into just the
two. Words are cut by the tokenizer's own pre-tokenizer rule and never influence
each other, so counts of a text are running sums over its words.

That recurrence gives all counts here. A text is cut into words once; a worker
remembers the totals of words it has met, so a word's recurrence runs once for
many occurrences. Running sums over the totals give the count of every prefix
that ends with a word, and the recurrence of one word that of every prefix
inside it. Length limits, truncation and budgets are lookups; nothing is
encoded again, and no encoder is called. The candidates at a byte come from one
Aho-Corasick automaton over the vocabulary, so long words without any break take
time in proportion to their length.

Null and empty texts have no tokens. Special tokens' strings inside a text count
as one token, as the library treats them by default. Rows without an id are
counted like others.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, texts

#: Pairs of tokens whose compatibility, and words up to LONG_WORD characters whose totals a worker remembers; on reaching it a store starts anew.
STORE_PAIRS, STORE_WORDS, LONG_WORD = 500_000, 500_000, 200
#: The byte-level pre-tokenizer's pattern (a fixed value of this tokenizer family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these code points and common marks, Unicode versions differ in what is a letter; the vocabulary file's own library then cuts the text into words.
_UNSURE = re.compile("[^\x00-Կ‐-⁞₠-₿℀-⅏←-⋿　-。]")


def byte_letters() -> dict[str, int]:
    """The visible letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Totals(dict):
    """Tokens of each word met; ``table`` is a word's recurrence."""

    def __init__(self, special: frozenset[str], table):
        super().__init__()
        self.special, self.table = special, table

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.special else int(self.table(word)[-1])
        if len(word) <= LONG_WORD:
            if len(self) >= STORE_WORDS:
                self.clear()
            self[word] = n
        return n


class PrefixCounter:
    """Exact token counts at every prefix for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_letters()
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[as_bytes(a), as_bytes(b)] = k
        special = frozenset(t["content"] for t in spec["added_tokens"])
        # token 0 is the start of a word
        self.token = [b"", *(as_bytes(t) for t in spec["model"]["vocab"] if t not in special)]
        self.ends = ahocorasick.Automaton()
        for i, t in enumerate(self.token[1:], 1):
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.words = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.path, self.tokenizer = path, None
        self.pairs: dict[int, bool] = {}
        self.totals = _Totals(special, self.word)

    @property
    def library(self):
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE: the lowest-ranked pair is joined until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= STORE_PAIRS:
                self.pairs.clear()
            pair = [self.token[right]] if not left else [self.token[left], self.token[right]]
            known = self.pairs[left << 32 | right] = self.merge(b"".join(pair)) == pair
        return known

    def word(self, word: str) -> array:
        """count[i] for i = 0..bytes: tokens of each byte prefix of one word."""
        data = word.encode("utf-8", "surrogatepass").decode("latin-1")
        count, last = array("l", bytes(8 * (len(data) + 1))), array("l", bytes(8 * (len(data) + 1)))
        for at, (n, token) in self.ends.iter(data):
            if not last[at + 1] and self.compatible(last[at + 1 - n], token):
                count[at + 1], last[at + 1] = count[at + 1 - n] + 1, token
        return count

    def cut(self, text: str) -> list[str]:
        """The words of a text; special strings are words of their own."""
        if not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        at = 0
        for m in self.special.finditer(text):
            out += [*self._plain(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if _UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text)

    def measured(self, text: str) -> tuple[list[str], list[int]]:
        """The words of a text and the tokens of each."""
        words = self.cut(text)
        return words, list(map(self.totals.__getitem__, words))

    def table(self, text: str) -> np.ndarray:
        """The token count of every byte prefix, in the text's own segmentation into words; inside a special string it is one more than before it."""
        parts, total = [np.zeros(1, dtype=np.int32)], 0
        for w, n in zip(*self.measured(text), strict=True):
            raw = len(w.encode("utf-8", "surrogatepass"))
            inside = np.ones(raw) if w in self.totals.special else np.frombuffer(self.word(w), dtype=np.int64)[1:]
            parts.append((total + inside).astype(np.int32))
            total += n
        return np.concatenate(parts)

    def within(self, words: list[str], totals: list[int], budget: int) -> int:
        """Bytes of the longest prefix, cut after a whole character, with at most ``budget`` tokens in the text's own segmentation into words."""
        upto = np.cumsum(totals) if totals else np.zeros(0, dtype=np.int64)
        k = int(np.searchsorted(upto, budget, "right"))
        start = sum(len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words[:k])
        if k == len(words) or words[k] in self.totals.special:
            return start
        left = budget - (int(upto[k - 1]) if k else 0)
        raw = words[k].encode("utf-8", "surrogatepass")
        return start + max(i for i, n in enumerate(self.word(words[k])) if n <= left and (i == len(raw) or raw[i] & 0xC0 != 0x80))


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), fit_bytes (bytes of the longest prefix within ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n_bytes, n_tokens, fit = [], [], []
            for t in texts(b, text_col):
                words, totals = c.measured((t or b"").decode("utf-8", "surrogatepass"))
                n_bytes.append(len(t or b""))
                n_tokens.append(sum(totals))
                fit.append(n_bytes[-1] if n_tokens[-1] <= limit else c.within(words, totals, limit))
            yield from as_batches({
                id_col: (b.column(0), pa.int64()), "n_bytes": (n_bytes, pa.int64()), "n_tokens": (n_tokens, pa.int64()),
                "over_limit": ([n > limit for n in n_tokens], pa.bool_()), "fit_bytes": (fit, pa.int64()),
            })

    return arrow_map(df, (id_col, text_col), run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def prefix_tables(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and counts, the exact token count of every byte prefix from the empty one on, to be stored beside the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts(b, text_col), strict=True):  # a table is larger than its text: one row at a time
                yield from as_batches({id_col: ([i], pa.int64()), "counts": ([c.table((t or b"").decode("utf-8", "surrogatepass"))], pa.list_(pa.int32()))})

    return arrow_map(df, (id_col, text_col), run, f"`{id_col}` long, counts array<int>")


def within_budget(tables: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``prefix_tables``: id and n_bytes, the longest prefix within ``budget`` tokens, a lookup without the text (it may end inside a character)."""
    last = F.array_max(F.transform("counts", lambda n, i: F.when(n <= budget, i)))
    return tables.select(id_col, last.cast("long").alias("n_bytes"))
