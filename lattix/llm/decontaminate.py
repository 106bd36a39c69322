"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters and digits. Fixed masks hash a window of words but ignore some of its positions, so a
substituted word leaves other windows whole. All windows of the test items are hashed into seeds; a bit filter of bounded size (two
probes) tells each training window apart in the task that reads the text, and only windows that pass travel: per text one row for
each stretch around its hits, with the stretch's words. Stretches of equal words and hits, told by a 128-bit digest, are one class:
copies of a text are looked up and verified once. Hits join seeds on the hash; each (class, item, diagonal) is then verified word by
word: the best run, where a match counts 1 and a substitution -2, must hold ``share`` of the item's words or ``enough`` words. The best
diagonal of each (class, item) is joined to the class's texts.

Items with fewer than ``least`` words are too short to tell and never leak. Null and empty texts hold no windows. Rows that share an
id, null included, leak together: one row for each (id, item), with the best run of any of them. Of equal runs the shorter, then the
first, is told. Very long texts are hashed whole, and of them only stretches around hits travel. An empty benchmark or corpus gives no
rows. Only the id and text columns are read, so that other columns may have any name. Frequent seeds, items, classes, and stretches of
many items are dealt over many tasks (``salted_join``). The result is a written table; all others are deleted when it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import NOT_ALNUM, cut, drop_written, is_word, mix, salted_join, slices, text_buffers, words

#: 1 is read, 0 ignored.
MASKS = ("11011011", "1110010111", "10111001101")
LEAST, SHARE, ENOUGH = 8, 0.5, 24
MAX_BITS = 28
_WORD = is_word(NOT_ALNUM)
_FACTORS = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(64)]


def seeds_of(hashed: np.ndarray, at: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows under a mask that lie in one row, and the word at which each starts."""
    n = len(hashed) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, number + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashed[k : k + n] * _FACTORS[k]
    ends = np.repeat(at[1:], np.diff(at))  # where the row of each word ends
    start = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
    return mix(out[start]), start


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def item_seeds(items: DataFrame, masks: tuple[str, ...], least: int) -> tuple[DataFrame, DataFrame]:
    """(items: item_id, words binary, n) and (seeds: hash, item, at). ``item`` numbers the rows, as ids may repeat or be null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for i, j in slices(at):
                hashed, ends = words(data, at, i, j, _WORD)
                seeds = [seeds_of(hashed, ends, m, k) for k, m in enumerate(masks)]
                out = []
                for k in range(j - i):
                    a, b = int(ends[k]), int(ends[k + 1])
                    row = []
                    if b - a >= least:
                        for h, s in seeds:
                            p, q = np.searchsorted(s, [a, b])
                            row += [{"hash": x, "at": y} for x, y in zip(h[p:q].view(np.int64).tolist(), (s[p:q] - a).tolist(), strict=True)]
                    out.append({"item": n, "item_id": batch.column(0)[i + k].as_py(), "words": hashed[a:b].tobytes(), "n": b - a, "seeds": row})
                    n += 1
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("words", pa.binary()), ("n", pa.int32()), ("seeds", pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))]))

    rows = cut(items.mapInArrow(work, "item long, item_id long, words binary, n int, seeds array<struct<hash: long, at: int>>"), "benchmark-seeds")
    return rows.select("item", "item_id", "words", "n"), rows.select("item", F.explode("seeds").alias("s")).select(F.col("s.hash").alias("hash"), "item", F.col("s.at").alias("at"))


def seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits with two probes for each seed; at most four partial ones reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(out, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": [out.tobytes()]})

    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in seeds.select("hash").coalesce(4).mapInArrow(work, "bits binary").collect():
        whole |= np.frombuffer(r["bits"], np.uint8)
    return whole


def find_leaks(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, share: float = SHARE, enough: int = ENOUGH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaking (document, item): doc_id, item_id, n_matched, n_item_words, n_run (length of the best run), first_word (where it starts in the document)."""
    table, seeds = item_seeds(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")), masks, least)
    n, longest = seeds.count(), table.agg(F.max("n")).first()[0] or 0
    bits = max(16, min(MAX_BITS, (1024 * n).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds, bits))  # at most 2^MAX_BITS bits, whatever the benchmark's size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, made = shared.value, TaskContext.get().partitionId() << 33
        kinds = pa.schema([("stretch", pa.int64()), ("k", pa.binary()), ("doc_id", pa.int64()), ("from_word", pa.int64()), ("words", pa.binary()), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))])
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for i, j in slices(at):
                hashed, ends = words(data, at, i, j, _WORD)
                found, places = [], []
                for number, mask in enumerate(masks):
                    h, s = seeds_of(hashed, ends, mask, number)
                    one, two = _probes(h, bits)
                    ok = np.flatnonzero(_has(bitmap, one))
                    ok = ok[_has(bitmap, two[ok])]
                    found.append(h[ok])
                    places.append(s[ok])
                h, s = np.concatenate(found), np.concatenate(places)
                if not len(s):
                    continue
                order = np.argsort(s, kind="stable")
                h, s = h[order], s[order]
                row = np.searchsorted(ends, s, "right") - 1
                cuts = np.flatnonzero((np.diff(s) > longest) | (np.diff(row) > 0)) + 1
                out = []
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)], strict=True):
                    k = int(row[a])
                    lo, hi = max(int(ends[k]), int(s[a]) - longest), min(int(ends[k + 1]), int(s[b - 1]) + longest + 64)
                    hits = [{"hash": x, "pos": y} for x, y in zip(h[a:b].view(np.int64).tolist(), (s[a:b] - lo).tolist(), strict=True)]
                    kind = hashlib.blake2b(hashed[lo:hi].tobytes(), digest_size=16)
                    kind.update((s[a:b] - lo).tobytes() + h[a:b].tobytes())
                    out.append({"stretch": made, "k": kind.digest(), "doc_id": batch.column(0)[i + k].as_py(), "from_word": lo - int(ends[k]), "words": hashed[lo:hi].tobytes(), "hits": hits})
                    made += 1
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stretches = cut(rows.mapInArrow(work, "stretch long, k binary, doc_id long, from_word long, words binary, hits array<struct<hash: long, pos: int>>"), "decontamination-stretches")
    kinds = cut(stretches.groupBy("k").agg(F.min_by(F.struct("words", "hits"), "stretch").alias("one")).select("k", "one.*"), "decontamination-kinds")
    hits = kinds.select("k", F.explode("hits").alias("h")).select("k", F.col("h.hash").alias("hash"), F.col("h.pos").alias("pos"))
    diagonals = salted_join(hits, seeds, "hash", "k").groupBy("k", "item", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count("*").alias("n_hits"))
    diagonals = cut(diagonals, "decontamination-diagonals")
    pairs = salted_join(diagonals, table.select("item", "item_id", F.col("words").alias("item_words")), "item", "k")
    pairs = salted_join(pairs, kinds.select("k", F.col("words").alias("doc_words")), "k", "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[], [], [], []]
            for shift, doc, item in zip(*(batch.column(c).to_pylist() for c in ("shift", "doc_words", "item_words")), strict=True):
                for c, v in zip(cols, best_run(np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64), shift), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("item_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["k", "item_id", "n_item_words", "n_matched", "n_run", "first_word"])

    checked = pairs.select("k", "item_id", "shift", "doc_words", "item_words").mapInArrow(verify, "k binary, item_id long, n_item_words long, n_matched long, n_run long, first_word long")
    leaks = checked.where((F.col("n_matched") >= least) & ((F.col("n_matched") >= enough) | (F.col("n_matched") >= share * F.col("n_item_words"))))
    best = F.max_by(F.struct("n_matched", "n_item_words", "n_run", "first_word"), F.struct("n_matched", -F.col("n_run"), -F.col("first_word"))).alias("b")
    classes = cut(leaks.groupBy("k", "item_id").agg(best).select("k", "item_id", "b.*"), "decontamination-classes")
    found = salted_join(stretches.select("k", "stretch", "doc_id", "from_word"), classes, "k", "stretch").withColumn("first_word", F.col("from_word") + F.col("first_word"))
    out = cut(found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*"), "decontamination-leaks")
    drop_written(docs.sparkSession, table, stretches, kinds, diagonals, classes)
    return out


def best_run(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """(item's words, matches in the best run, its length, its start in the document) with the item laid at ``shift``."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[lo:hi] == doc[lo + shift : hi + shift]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    lowest = np.minimum.accumulate(total)
    stop = int(np.argmax(total - lowest))
    start = int(np.argmax(total[: stop + 1] == lowest[stop]))
    return len(item), int(same[start:stop].sum()), stop - start, lo + shift + start
