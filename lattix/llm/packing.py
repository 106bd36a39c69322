"""Packing of documents into sequences of a fixed room by best-fit decreasing.

One pass encodes the texts and cuts them into pieces; only documents longer than a sequence are cut, and of those the first piece may be
short. Lengths are whole numbers up to the room, so the longest-first order over all documents is known from the count of each length. The
plan is made from these counts: a segment tree over the remaining rooms finds the tightest open sequences for a length in logarithmic
time, and equal documents are placed together, exactly where placing them one by one would: as many as fit into the tightest open
sequence, then into the next one of that room. Pieces find their place by their rank among all of their length, which is a count per task
and a prefix sum; no task sees all pieces, and what reaches the driver are room + 1 counts.

Null and empty texts hold the end id alone. Long texts are taken whole and cut. Repeated rows and null ids are documents of their own. An
empty table gives no pieces. Only the id and text columns are read, so that others may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .byte_words import ByteEncoder
from .common import cut, slices, text_buffers

END = 2
ROOM = 1024
#: Bits of a rank in the plan's keys.
RANK = 44


class Rooms:
    """A segment tree over the rooms 0..room: each node tells whether a sequence with a room below it is open."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.open = [0] * (2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        node = self.leaves + room
        self.open[node] = int(is_open)
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def tightest(self, least: int) -> int:
        """The smallest open room of ``least`` at least, or -1."""
        node = self.leaves + least
        if self.open[node]:
            return least
        while node > 1:  # up, until there is an open room to the right
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return -1
        while node < self.leaves:
            node = 2 * node + (not self.open[2 * node])
        return node - self.leaves


@dataclass
class Plan:
    """Where pieces go: those of one length from ``rank`` on go to sequences from ``first`` on, ``each`` to a sequence, from ``offset`` on."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = np.searchsorted((self.length << RANK) + self.rank, (length << RANK) + rank, "right") - 1
        nth = rank - self.rank[at]
        return self.first[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def best_fit_decreasing(counts: Mapping[int, int], room: int = ROOM) -> Plan:
    """Longest first, each piece into the open sequence of the least room that holds it, a new one where none does."""
    tree, held, made = Rooms(room), [[] for _ in range(room + 1)], 0
    rows = []

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            held[left].append((first, n))
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            left = tree.tightest(length)
            if left < 0:
                left, new = room, -(-n // (room // length))
                put(room, made, new)
                made += new
            first, there = held[left].pop()
            tree.mark(left, bool(held[left]))
            each = left // length
            used = min(there, -(-n // each))
            took = min(n, used * each)
            full = took // each
            rows.append((length, rank, first, each, room - left))
            put(left, first + used, there - used)
            put(left - each * length, first, full)
            put(left - took % each * length, first + full, used - full)
            rank, n = rank + took, n - took
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, made)


PIECES = "part long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document, with the task (part) that made each and its number among the task's pieces of its length. One map; to be written before it is used twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = ByteEncoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for i, j in slices(at, 1 << 20):
                rows = []
                for doc, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encode.run(data, at, i, j), strict=True):
                    raw = memoryview(np.append(ids, end_id).astype("<u4").tobytes())
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % room + 1, n + 1, room)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((part, seen[b - a], doc, piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 3 else pa.int64()) for k, c in enumerate(zip(*rows))], names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, PIECES)


def place_pieces(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """``pieces`` (PIECES, written) with sequence_id and offset."""
    per_task = pieces.groupBy("part", "length").count()
    plan = best_fit_decreasing({r["length"]: r["count"] for r in per_task.groupBy("length").agg(F.sum("count").alias("count")).collect()}, room)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    ranked = pieces.join(per_task.select("part", "length", before.alias("before")), ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.places(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place_pieces(cut(encode_pieces(docs, tokenizer, room, end_id, id_col, text_col), "pieces"), room)
