"""Importance resampling towards a target: hashed n-gram weights, and an exact draw by a merge of sorted runs.

Features are runs of 1 to 2 words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; a feature's bucket is its unsigned
crc32 modulo ``BUCKETS``. One pass counts buckets over all source and target texts; the gains are an array of BUCKETS whole numbers, and a
second pass looks each feature's gain up there. A document's score is the floored mean of its gains and a Gumbel number from its id.

The draw: each task of the second pass sorts its rows by falling score and id (a sort that may spill) and writes them as one run. Counts
per score, which are few as scores are whole and bounded, tell where to cut all runs into ranges of a bounded number of eligible rows.
A task merges what the runs hold of one range by a tournament tree and stops after the number that the draw still needs there; ranges
beyond the draw are not merged at all. A score with more rows than a range is cut by id, and an id with more rows than that by run.

Null and empty texts have no features and weigh 0. A null id is drawn after all others of its score and hashes as an empty text. Repeated
rows are documents of their own; where rows tie in score and id the earlier run goes first. Long texts are taken whole. Empty tables give
no rows; an empty target has no counts. Only the id and text columns are read, so that others may have any name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _LOWER, NOT_ALNUM, cut, drop_written, is_word, slices, text_buffers

BUCKETS = 10_000
MIN_WORDS = 20
#: Eligible rows of a range at most, but for rows that tie throughout.
MOST_RANGE = 1 << 17
#: Bytes of words whose crc32 is worked out in numpy; longer ones go to zlib.
WIDE = 64
NULL_ID = (1 << 63) - 1
_U = np.uint32


@lru_cache(maxsize=1)
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(the table of the reflected polynomial EDB88320, shifts): shifts[n, j, b] is what byte b at place j of a crc becomes after n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & _U(1), (step >> _U(1)) ^ _U(0xEDB88320), step >> _U(1))
    shifts = np.empty((WIDE + 1, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32) << (_U(8) * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, WIDE + 1):
        shifts[n] = step[shifts[n - 1] & _U(255)] ^ (shifts[n - 1] >> _U(8))
    return step, shifts


_WORD = is_word(NOT_ALNUM).astype(bool)


def features(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its row, words of each row) of the texts of rows i..j-1."""
    flat, starts = _LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]
    inside = _WORD[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])[: len(inside)]))
    stop = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])[: len(inside)])) + 1
    row = np.searchsorted(starts, first, "right") - 1
    crc, sizes = word_crcs(flat, first, stop), stop - first
    pair = np.flatnonzero(row[1:] == row[:-1])
    step, shifts = crc_tables()
    spaced = ~crc[pair]  # the first word and a space
    spaced = ~(step[(spaced ^ _U(32)) & _U(255)] ^ (spaced >> _U(8)))
    n = np.minimum(sizes[pair + 1], WIDE)
    both = crc[pair + 1] ^ shifts[n, 0, spaced & _U(255)] ^ shifts[n, 1, (spaced >> _U(8)) & _U(255)] ^ shifts[n, 2, (spaced >> _U(16)) & _U(255)] ^ shifts[n, 3, spaced >> _U(24)]
    for k in np.flatnonzero(sizes[pair + 1] > WIDE).tolist():
        w = pair[k] + 1
        both[k] = zlib.crc32(flat[first[w] : stop[w]].tobytes(), int(spaced[k]))
    return np.concatenate([crc, both]) % _U(BUCKETS), np.concatenate([row, row[pair]]), np.bincount(row, minlength=j - i)


def word_crcs(flat: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """crc32 of each word: one byte of all words at a time, longest words first."""
    step, _ = crc_tables()
    sizes = stop - first
    order = np.argsort(-np.minimum(sizes, WIDE), kind="stable")
    begin, left = first[order], np.minimum(sizes, WIDE)[order]
    held = np.full(len(first), 0xFFFFFFFF, np.uint32)
    live = len(held) - np.searchsorted(left[::-1], np.arange(1, WIDE + 1), "left")  # words of more than k bytes
    for k, n in enumerate(live.tolist()):
        if not n:
            break
        held[:n] = step[(held[:n] ^ flat[begin[:n] + k]) & _U(255)] ^ (held[:n] >> _U(8))
    out = np.empty(len(first), np.uint32)
    out[order] = ~held
    for w in np.flatnonzero(sizes > WIDE).tolist():
        out[w] = zlib.crc32(flat[first[w] : stop[w]].tobytes())
    return out


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket. Tasks send one number a bucket; BUCKETS numbers reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            for i, j in slices(at, 1 << 19):
                held += np.bincount(features(data, at, i, j)[0], minlength=BUCKETS)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], names=["bucket", "n"])

    sums = texts.select(F.col(text_col).alias("text")).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+BUCKETS) / ((s+1)(T+BUCKETS)))) of each bucket."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, weight long, score long, n_words long"


def score_documents(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, n_words of every document: one map over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for i, j in slices(at, 1 << 19):
                bucket, row, n_words = features(data, at, i, j)
                n = np.bincount(row, minlength=j - i)
                total = np.bincount(row, gain[bucket], j - i).astype(np.int64)  # whole numbers far below 2^53
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column(0).slice(i, j - i)
                score = weight + np.array([gumbel(k, seed) for k in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(score), pa.array(n_words)], names=["doc_id", "n_features", "weight", "score", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SCORED)


def tournament(runs: list[list[tuple]], want: int) -> list[tuple[int, int]]:
    """(run, place) of the least ``want`` keys over sorted runs, in order; of equal keys that of the earlier run.

    A tree of losers: each inner node holds the run that lost there, so that after a run moves on only its own path is played again.
    """
    k = len(runs)
    end = (math.inf,)
    head = [r[0] if r else end for r in runs]
    place = [0] * k
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if (head[b], b) < (head[a], a):
            a, b = b, a
        winners[node], losers[node] = a, b
    best = winners[1] if k > 1 else 0
    out = []
    while len(out) < want:
        out.append((best, place[best]))
        place[best] += 1
        head[best] = runs[best][place[best]] if place[best] < len(runs[best]) else end
        node = (best + k) // 2
        while node:
            other = losers[node]
            if (head[other], other) < (head[best], best):
                best, losers[node] = other, best
            node //= 2
    return out


Key = tuple[int, int, int]  # falling score, id, run


def range_starts(eligible: DataFrame, draws: int, places: int) -> tuple[list[Key], list[int]]:
    """(the least key of each range, rows before each) of the ranges that a draw of the first ``draws`` rows reaches, and of the one after.

    What is collected: counts per score, of which there are fewer than 120,000 (gains lie within 44,000 and Gumbel numbers between -3,200
    and 22,900); and for a score of more rows than a range, counts per stretch of ids between 127 quantiles, and per run of an id that is one.
    """
    size = max(1, min(MOST_RANGE, -(-draws // places)))
    cells = {(-s, -1, -1): n for s, n in eligible.groupBy("score").count().collect()}
    hot = [-k[0] for k, n in cells.items() if n > size]
    if hot:
        few = eligible.sparkSession.createDataFrame([(s,) for s in hot], "score long")
        rows = eligible.join(F.broadcast(few), "score")  # fewer than 120,000 scores
        marks = sorted(set(rows.agg(F.percentile_approx("place_id", [k / 128 for k in range(1, 128)], 10_000)).first()[0]))
        low = F.array_max(F.filter(F.array(*(F.lit(m) for m in marks)), lambda m: m <= F.col("place_id")))
        own = low == F.col("place_id")
        fine = rows.groupBy("score", F.coalesce(low + F.when(own, 0).otherwise(1), F.lit(-1)).alias("id"), F.when(own, F.col("run")).otherwise(-1).alias("run")).count()
        cells = {k: n for k, n in cells.items() if n <= size} | {(-r["score"], r["id"], r["run"]): r["count"] for r in fine.collect()}
    starts, before, held, total = [], [], size, 0
    for key in sorted(cells):
        if held + cells[key] > size:
            starts.append(key)
            before.append(total)
            held = 0
            if total >= draws:
                return starts, before
        held, total = held + cells[key], total + cells[key]
    return [*starts, (math.inf, 0, 0)], [*before, total]


def merge_runs(runs: DataFrame, draws: int, places: int) -> DataFrame:
    """Rows of ``runs`` (SCORED, and eligible, run, place_id; each run sorted) with their rank, null beyond the draw."""
    eligible = runs.where("eligible")
    starts, before = range_starts(eligible, draws, places)
    limit = starts[-1]
    names = ["doc_id", "n_features", "weight", "score"]
    key = (-F.col("score"), F.col("place_id"), F.col("run"))
    beyond = F.lit(False)
    if limit[0] != math.inf:
        beyond = F.struct(*(k.cast("long") for k in key)) >= F.struct(*(F.lit(v).cast("long") for v in limit))
    rest = runs.where(~F.col("eligible") | beyond).select(*names, F.lit(None).cast("long").alias("rank"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a batch holds of each range, in the run's order."""
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            keys = list(zip((-cols[2]).tolist(), cols[3].tolist(), cols[4].tolist(), strict=True))
            breaks = [0, *(k for k in range(1, len(keys)) if keys[k] < keys[k - 1] or keys[k][2] != keys[k - 1][2]), len(keys)]
            out = []
            for a, b in zip(breaks, breaks[1:]):
                while a < b:
                    r = bisect_right(starts, keys[a]) - 1
                    stop = bisect_left(keys, starts[r + 1], a, b)
                    out.append((r, a, stop))
                    a = stop
            lists = [pa.ListArray.from_arrays(pa.array([0, *np.cumsum([b - a for _, a, b in out])], pa.int32()), pa.concat_arrays([c.slice(a, b - a) for _, a, b in out])) for c in batch.columns[:4]] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in out], pa.int64()), pa.array([keys[a][2] for _, a, _ in out], pa.int64()), *lists], names=["range", "run", *names])

    def merge(group: pa.Table) -> pa.Table:
        r = group.column("range")[0].as_py()
        order = np.argsort(group.column("run").to_numpy(), kind="stable")
        group = group.take(pa.array(order)).combine_chunks()
        ids, scores = group.column("doc_id").to_pylist(), group.column("score").to_pylist()
        lists = [list(zip((-s for s in score), (NULL_ID if i is None else i for i in some), strict=True)) for some, score in zip(ids, scores, strict=True)]
        sizes = list(map(len, lists))
        want = min(sum(sizes), draws - before[r])
        base = np.cumsum([0, *sizes])
        rank = np.zeros(int(base[-1]), np.int64)
        for k, (run, place) in enumerate(tournament(lists, want)):
            rank[base[run] + place] = before[r] + k + 1
        flat = [group.column(n).combine_chunks().flatten() for n in names]
        return pa.Table.from_arrays([*flat, pa.array(rank, mask=rank == 0)], names=[*names, "rank"])

    chosen = eligible.where(~beyond).select(*names, "place_id", "run")
    kinds = ", ".join(f"{n} array<bigint>" for n in names)
    merged = chosen.mapInArrow(segments, f"range long, run long, {kinds}").groupBy("range").applyInArrow(merge, ", ".join(f"{n} long" for n in [*names, "rank"]))
    return rest.unionByName(merged)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: the first floor(percent * N / 100) of the N with at least ``min_words`` words, by falling score and rising id; others' ranks are null."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    scored = score_documents(docs, gain, seed, id_col, text_col)
    scored = scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("eligible"), F.spark_partition_id().cast("long").alias("run"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("place_id"))
    runs = cut(scored.sortWithinPartitions(F.desc("score"), "place_id"), "runs")
    draws = percent * runs.where("eligible").count() // 100
    return merge_runs(runs, draws, int(spark.conf.get("spark.sql.shuffle.partitions")))
