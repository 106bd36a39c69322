"""BPE encoding and decoding over a contiguous rank array.

A word holds its part ids and the ranks of its adjacent pairs in two contiguous rows; the smallest rank is found by a scan, its
boundary is deleted, and the two neighbouring ranks are refreshed, until no pair can merge. Words of one byte length are worked
together as the rows of a matrix. Very long words (over ``LONG`` bytes) use a heap of pairs over a linked list, as a scan would be
quadratic there. Each task keeps the words it has met in a bounded memory.

One map-only pass: no shuffle. Null and empty texts have no ids. Special tokens that stand in a text are their own id, as in the
tokenizers library; decoding looks each id up and gives their string back, and bytes that are no UTF-8 become replacement signs. Long
texts are taken whole; a task works on about a million bytes at a time, or one text. Repeated rows and null ids each get their own
rows; an empty table gives none. Only the id and text columns are read, so that other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LONG = 96
MEMORY = 700_000
NONE = np.int64(1 << 40)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary with open-addressed lookup of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        ids: dict[str, int] = whole["model"]["vocab"]
        letters = byte_letters()
        self.bytes = {i: bytes(letters[c] for c in s) for s, i in ids.items() if all(c in letters for c in s)}
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.single = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.single[b] = ids[c]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in whole["model"]["merges"]]
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges) if a + b in ids}
        self.bits = max(4, (4 * len(self.rank) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), np.zeros(size, np.int64)
        self.probes = 1
        for (a, b), (r, i) in self.rank.items():
            key = a << 20 | b
            slot, tries = self._slot(key), 1
            while self.keys[slot] >= 0:
                slot, tries = (slot + 1) & (size - 1), tries + 1
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, r, i
            self.probes = max(self.probes, tries)

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table, or -1."""
        key = (left << 20 | right).ravel()
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == key, slot, -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out.reshape(left.shape)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.find(left, right)
        return np.where(at >= 0, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, places in by_length.items():
            if n == 0:
                for k in places:
                    out[k] = []
            elif n > LONG:
                for k in places:
                    out[k] = self._encode_long(words[k])
            else:
                for i in range(0, len(places), 1 << 14):
                    self._encode_equal([places[k] for k in range(i, min(i + (1 << 14), len(places)))], words, n, out)
        return out

    def _encode_equal(self, places: list[int], words: list[bytes], n: int, out: list) -> None:
        """Words of n bytes, one row each."""
        ids = self.single[np.frombuffer(b"".join(words[k] for k in places), np.uint8).reshape(-1, n)]
        where = np.array(places)
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:]) if n > 1 else np.zeros((len(ids), 0), np.int64)
        while len(where):
            width = ranks.shape[1]
            best = ranks.argmin(1) if width else np.zeros(len(where), np.int64)
            rows = np.arange(len(where))
            live = ranks[rows, best] < NONE if width else np.zeros(len(where), bool)
            for k, whole in zip(where[~live].tolist(), ids[~live].tolist(), strict=True):  # equally many merges: every column is a part
                out[k] = whole
            where, ids, ranks, best = where[live], ids[live], ranks[live], best[live]
            if not len(where):
                return
            rows = np.arange(len(where))
            merged = self.merged[self.find(ids[rows, best], ids[rows, best + 1])]
            keep = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            ids[rows, best] = merged
            ranks = np.take_along_axis(ranks, keep[:, : width - 1] if width > 1 else keep[:, :0], 1)
            if width > 1:
                for side in (best - 1, best):
                    ok = (side >= 0) & (side < width - 1)
                    r, c = rows[ok], side[ok]
                    ranks[r, c] = self.rank_of(ids[r, c], ids[r, c + 1])

    def _encode_long(self, word: bytes) -> list[int]:
        ids = [int(self.single[b]) for b in word]
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(self.rank[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            r = right[k]
            if not alive[k] or r < 0 or (ids[k], ids[r]) != pair:
                continue
            ids[k], alive[r], right[k] = self.rank[pair][1], False, right[r]
            if right[k] >= 0:
                left[right[k]] = k
            for a in (left[k], k):
                if a >= 0 and right[a] >= 0 and (p := (ids[a], ids[right[a]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], a, p))
        return [i for k, i in enumerate(ids) if alive[k]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Codec:
    """Encodes texts word by word, with a bounded memory of words."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = vocabulary(path)
        self.words = regex.compile(PATTERN).findall
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda t: [t]
        self.special = special
        self.ids: dict[str, bytes] = {}
        known = self.vocabulary.bytes
        self.decimal = _pool({i: b"%d," % i for i in known})
        self.raw = _pool(known)

    def cut(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.split(text)):
            out += [part] if k % 2 else self.words(part)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode words not met before."""
        special = self.vocabulary.special
        raw = [b"" if p in special else p.encode() for p in pieces]
        for p, ids in zip(pieces, self.vocabulary.encode_words(raw), strict=True):
            self.ids[p] = np.array([special[p]] if p in special else ids, np.int32).tobytes()

    def run(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut) - self.ids.keys()
        if len(self.ids) + len(new) > MEMORY:  # what this run needs is learnt anew
            self.ids.clear()
            new = set().union(*cut)
        self.learn(list(new))
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, pieces)), np.int32) for pieces in cut]

    def decimals(self, ids: list[np.ndarray]) -> list[memoryview]:
        """Decimal ids joined by commas."""
        return [line[:-1] for line in _spelled(self.decimal, ids)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts that ids stand for. Ids that the vocabulary lacks stand for nothing; bytes that are no UTF-8 become replacement signs."""
        return [str(raw, "utf-8", "replace") for raw in _spelled(self.raw, ids)]


def _pool(spelling: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all spellings one after another, where that of each id starts, and its length; ids beyond the last have none)."""
    size = np.zeros(max(spelling, default=0) + 2, np.int64)
    size[list(spelling)] = [len(x) for x in spelling.values()]
    return np.frombuffer(b"".join(spelling[i] for i in sorted(spelling)), np.uint8), np.cumsum(size) - size, size


def _spelled(pool: tuple[np.ndarray, np.ndarray, np.ndarray], ids: list[np.ndarray]) -> list[memoryview]:
    """Of each list of ids their spellings joined."""
    letters, start, size = pool
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    flat = np.where((flat < 0) | (flat >= len(size)), len(size) - 1, flat)
    n = size[flat]
    ends = np.append(0, np.cumsum(n))
    out = memoryview(letters[np.repeat(start[flat] - ends[:-1], n) + np.arange(ends[-1])].tobytes())
    at = ends[np.cumsum([0, *map(len, ids)])].tolist()
    return [out[a:b] for a, b in zip(at, at[1:])]


def text_runs(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Rows i..j-1 of a batch as Python strings, about ``most`` characters at a time."""
    from .common import slices, text_buffers

    texts = batch.column(column)
    for i, j in slices(text_buffers(texts)[1], most):
        yield i, j, [t or "" for t in texts.slice(i, j - i).to_pylist()]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the number of ids, and digests of the ids and of the text that they decode to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for i, j, texts in text_runs(batch, 1):
                ids = codec.run(texts)
                digests = [hashlib.sha256(line).hexdigest() for line in codec.decimals(ids)]
                back = [hashlib.sha256(text.encode()).hexdigest() for text in codec.decode(ids)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text").mapInArrow(work, SCHEMA)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for i, j, texts in text_runs(batch, 1):
                ids = codec.run(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text").mapInArrow(work, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per document the text that its ids stand for; null and empty lists give an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            ids = [np.asarray(x or (), np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode(ids), pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"cast({id_col} as long) as doc_id", f"{ids_col} as ids").mapInArrow(work, "doc_id long, text string")
