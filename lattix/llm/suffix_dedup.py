"""Suffix-array dedup: remove every byte that a repeated ``WINDOW``-byte string covers, over all documents, exactly.

Comparing suffixes of all shards with each other would grow with the square of the shards, so equal strings are brought together first:

1. Each window has one anchor, its leftmost minimal 32-byte hash, so equal windows have equal anchors at equal distance. A run of
   windows with one anchor is a context, some 285 bytes. Anchors are counted; a context whose anchor stands nowhere else cannot repeat
   and ends here. (A bit filter of bounded size tells it; what it lets through by chance only costs work.)
2. Contexts of equal bytes, told by a 128-bit digest of them, are counted as one. If there are two, all their windows repeat.
3. Of anchors with different contexts one copy of each goes to a bucket by anchor, as bytes. A bucket deals them by source text to
   shards; a shard sorts its suffixes by Larsson-Sadakane refinement in numpy and takes common prefixes by Kasai's bound, which tells
   the windows that repeat in it. Shards are merged by binary search: each window of one is looked up in the sorted windows of the
   others by its bytes, eight at a time, over ever smaller ranges.
4. An anchor of more than ``PIECE`` contexts is split over buckets. Their sorted windows meet as bytes in ranges of window values.
5. The repeated stretches of a document are joined to its text.

Hot passages cost rows in proportion to their places: counts are pre-aggregated, and contexts of very many places are told by their
count and broadcast (``spread_join``). Null and empty texts and those under ``WINDOW`` bytes keep everything. Repeated rows are copies
of each other: all their windows repeat. Documents are known by id and a hash of their text, so ids may repeat or be null. Very long
texts are cut into stretches of ``CHUNK`` bytes that overlap by a window, so only their bytes are held whole. An empty table gives no
rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, drop_written, mix, powers, slices, spread_join, text_buffers
from .decontaminate import _has, _probes, seed_filter

WINDOW, GRAM = 200, 32
PIECE = 8192
SHARD_BYTES, BUCKET_BYTES, CHUNK = 3 << 18, 3 << 19, 1 << 21
MAX_BITS = 28
#: Places of a text; Spark's strings are shorter.
_POSITION = np.uint64((1 << 31) - 1)
_KEY = ["doc_id", "th"]


def contexts(data: np.ndarray, at: np.ndarray, i: int, j: int, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, row from i, context's start in its row, its length) of rows i..j-1; a very long row by stretches."""
    if j - i > 1 or at[j] - at[i] <= CHUNK:
        yield _contexts(data[at[i] : at[j]], at[i : j + 1] - at[i], window, gram)
        return
    for begin in range(0, int(at[j] - at[i]) - window + 1, CHUNK):
        some = data[at[i] + begin : min(at[i] + begin + CHUNK + window - 1, at[j])]
        a, row, pos, size = _contexts(some, np.array([0, len(some)]), window, gram)
        yield a, row, pos + begin, size


def _contexts(flat: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(flat) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    up, down = powers(len(flat) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * up[: len(flat)])])
    grams = mix((total[gram:] - total[:-gram]) * down[: len(flat) - gram + 1])
    key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    span, low, width = window - gram + 1, key, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: n], low[span - width : span - width + n])
    anchor = (low[:n] & _POSITION).astype(np.int64)
    ends_at = np.repeat(starts[1:], np.diff(starts))
    ok = np.flatnonzero(np.arange(n) + window <= ends_at[:n])
    if not len(ok):
        return none, none, none, none
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(anchor[ok]) != 0) | (np.diff(ok) > 1)]))
    first, last = ok[edge], ok[np.append(edge[1:], len(ok)) - 1]
    row = np.searchsorted(starts, first, "right") - 1
    return grams[anchor[first]].view(np.int64), row, first - starts[row], last + window - first


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes (at least), by Larsson-Sadakane refinement from 8-byte keys (``words``)."""
    n = len(text)
    words = word_keys(text) if words is None else words
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    edge = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    rank[order] = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    h = 8
    while h < depth:
        # only groups of more than one suffix are sorted again, by the rank h bytes on
        sizes = np.diff(np.append(np.flatnonzero(edge), n))
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_):
            break
        some = order[open_]
        after = np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
        key = rank[some] * np.int64(n + 2) + after
        by = np.argsort(key, kind="stable")
        order[open_] = some[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        edge[open_] = fresh  # a group's first place is fresh as its rank is new
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        h *= 2
    return order


def word_keys(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded.data, strides=(1,)).astype(np.uint64)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, block: int = 256, words: np.ndarray | None = None) -> np.ndarray:
    """For each place of ``order`` the bytes in common with the suffix before it, counted up to ``most``.

    Kasai's bound: a suffix shares at least one byte less than the one that starts before it in the text, if ``order`` is by whole
    suffixes. Blocks of the text go in step, each keeping its own bound.
    """
    n = len(text)
    words = np.concatenate([word_keys(text) if words is None else words, np.zeros(most + 8, np.uint64)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    bound = np.zeros(-(-n // block), np.int64)
    for k in range(block):
        place = np.arange(k, n, block)
        h = np.maximum(bound[: len(place)] - 1, 0)
        other = before[place]
        live = np.flatnonzero((other >= 0) & (h < most))
        h[other < 0] = 0
        while len(live):
            x = words[place[live] + h[live]] ^ words[other[live] + h[live]]
            equal = np.full(len(live), 8, np.int64)
            some = x != 0
            equal[some] = (63 - np.frexp(x[some].astype(np.float64))[1] + 1) // 8 if some.any() else 0
            # a float rounds up at most to the next power of two, which can only hide one equal byte; it is looked at again below
            h[live] += equal
            live = live[(equal == 8) & (h[live] < most)]
        fix = np.flatnonzero((other >= 0) & (h < most) & (np.maximum(place, other) + h < n))
        fix = fix[text[place[fix] + h[fix]] == text[other[fix] + h[fix]]]
        while len(fix):
            h[fix] += 1
            fix = fix[(h[fix] < most) & (np.maximum(place[fix], other[fix]) + h[fix] < n)]
            fix = fix[text[place[fix] + h[fix]] == text[other[fix] + h[fix]]]
        h = np.minimum(h, np.minimum(most, n - np.maximum(place, np.maximum(other, 0))))
        shared[place] = h
        bound[: len(place)] = h
    return shared[order]


def repeated_windows(texts: list[bytes], window: int = WINDOW, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows in order of their bytes as places in the joined texts, whether each equals the one before; text and start of each)."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(flat)) - begin[row]
    valid = start + window <= sizes[row]
    words = word_keys(flat) if words is None else words
    order = suffix_array(flat, len(flat), words)  # in full: the bound of common_prefixes does not hold over ties
    lcp = common_prefixes(flat, order, window, words=words)
    at = np.flatnonzero(valid[order])
    if not len(at):
        return at, np.zeros(0, bool), at, at
    least = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1) if len(at) > 1 else np.zeros(0, np.int64)  # up to the last window, not past it
    same = np.concatenate([[False], least >= window])
    place = order[at]
    return place, same, row[place], start[place]


class Run:
    """A shard's windows in the order of their bytes. repeats: of each class of equal windows, whether it is known to repeat."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.words = window, word_keys(np.frombuffer(b"".join(texts), np.uint8))
        self.place, self.same, self.row, self.start = repeated_windows(texts, window, self.words)
        self.head = np.flatnonzero(~self.same)
        self.of = np.cumsum(~self.same) - 1
        self.repeats = np.diff(np.append(self.head, len(self.same))) > 1

    def word(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of the windows at sorted places ``at``; the last eight end with the window."""
        return self.words[self.place[at] + min(8 * k, self.window - 8)]


def _bound(run: Run, k: int, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """By binary search in each range low..high-1, whose windows are in order of their k-th word: the first that is not under (or, ``after``, that is over) the target."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        word = run.word(mid, k)
        up = word <= target[live] if after else word < target[live]
        low[live] = np.where(up, mid + 1, low[live])
        high[live] = np.where(up, high[live], mid)
        live = live[low[live] < high[live]]
    return low


def merge(a: Run, b: Run) -> None:
    """Look up each different window of ``b`` in ``a``; those found repeat in both."""
    if not len(a.place) or not len(b.place):
        return
    first = a.word(np.arange(len(a.place)), 0)
    target = b.word(b.head, 0)
    low, high = np.searchsorted(first, target, "left"), np.searchsorted(first, target, "right")
    left = np.flatnonzero(low < high)
    for k in range(1, -(-a.window // 8)):
        low, high, target = low[left], high[left], b.word(b.head[left], k)
        low, high = _bound(a, k, low, high, target, False), _bound(a, k, low, high, target, True)
        found = low < high
        low, high, left = low[found], high[found], left[found]
        wide = np.empty(len(b.head), np.int64)
        wide[left] = low
        low, wide = wide, np.empty(len(b.head), np.int64)
        wide[left] = high
        high = wide
    b.repeats[left] = True
    a.repeats[a.of[low[left]]] = True


def _stretches(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Sorted window starts as (start, length) of the bytes that they cover together."""
    cuts = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(p[0]), int(p[-1] - p[0]) + window) for p in np.split(starts, cuts)] if len(starts) else []


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, shard_bytes: int = SHARD_BYTES, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document; with ``texts`` also ``kept``, what is left of its text, and ``row``, a struct of its other columns."""
    rest = F.struct(*(F.col(c) for c in docs.columns if c != text_col)) if texts else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest.alias("row"))
    long_ones = rows.where(F.octet_length("text") >= window).drop("row")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            for i, j in slices(at):
                for a, *_ in contexts(data, at, i, j, window):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(a, return_counts=True)], names=["hash", "n"])

    anchors = cut(long_ones.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "repeated-anchors")
    bits = max(16, min(MAX_BITS, (16 * anchors.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(anchors, bits))  # at most 2^MAX_BITS bits

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            data, at = text_buffers(batch.column(2))
            view = memoryview(data)
            for i, j in slices(at):
                for a, row, pos, size in contexts(data, at, i, j, window):
                    one, two = _probes(a.view(np.uint64), bits)
                    ok = np.flatnonzero(_has(bitmap, one) & _has(bitmap, two))
                    if len(ok):
                        a, row, pos, size = a[ok], row[ok] + i, pos[ok], size[ok]
                        begin = at[row] + pos
                        k = [hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(k, pa.binary()), *(batch.column(c).take(pa.array(row)) for c in (0, 1)), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32))], names=["a", "k", *_KEY, "pos", "len"])

    places = cut(long_ones.mapInArrow(find, "a long, k binary, doc_id long, th long, pos int, len int"), "places")
    kinds = cut(places.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("a", *_KEY, "pos", "len")).alias("one")).select("k", "n", "one.*"), "contexts")
    full = spread_join(places.select("k", *_KEY, "pos", "len"), kinds.where("n > 1").select("k", F.col("n").alias("df")), "k").select(*_KEY, "pos", "len")

    # contexts to compare: one copy of each, with its bytes
    mixed = kinds.groupBy("a").agg(F.count("*").alias("df"), F.sum("len").alias("bytes")).where("df > 1")
    mixed = cut(mixed.withColumn("pieces", F.ceil(F.col("df") / piece)), "mixed-anchors")
    buckets = max(1, -(-(mixed.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    sole = spread_join(kinds, mixed, "a")
    home = F.when(F.col("pieces") > 1, F.xxhash64("a", F.pmod(F.xxhash64("k"), F.col("pieces")))).otherwise(F.pmod(F.xxhash64("a"), F.lit(buckets)))
    sole = sole.select(*_KEY, "pos", "len", home.alias("bucket"), (F.col("pieces") > 1).alias("split"), (F.col("n") > 1).alias("full"))
    wanted = sole.groupBy(*_KEY).agg(F.collect_list(F.struct("pos", "len", "bucket", "split", "full")).alias("parts"))
    null_safe = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    none = F.lit(None).cast(wanted.schema["parts"].dataType)
    touched = cut(full.select(*_KEY).distinct().withColumn("parts", none).unionByName(wanted).groupBy(*_KEY).agg(F.first("parts", ignorenulls=True).alias("parts")), "touched")
    texts_of = cut(rows.join(touched, null_safe(rows, touched)).select(rows["doc_id"], rows["th"], "text", "row", "parts"), "touched-texts")
    asked = texts_of.where("parts is not null").select(*_KEY, "text", "parts")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("bucket", pa.int64()), ("split", pa.bool_()), ("full", pa.bool_()), *((x, pa.int64()) for x in _KEY), ("pos", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            data, at = text_buffers(batch.column(2))
            for k, parts in enumerate(batch.column(3).to_pylist()):
                text = memoryview(data[at[k] : at[k + 1]])
                doc, th = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_pylist([{"bucket": p["bucket"], "split": p["split"], "full": p["full"], "doc_id": doc, "th": th, "pos": p["pos"], "bytes": bytes(text[p["pos"] : p["pos"] + p["len"]])} for p in parts], schema=kind)

    bits_of = asked.mapInArrow(pick, "bucket long, split boolean, full boolean, doc_id long, th long, pos int, bytes binary")

    def sort_bucket(table: pa.Table) -> pa.Table:
        split, full = (table.column(c).to_numpy(zero_copy_only=False) for c in ("split", "full"))
        ids, ths, pos, parts = table.column("doc_id").to_pylist(), table.column("th").to_numpy(), table.column("pos").to_numpy(), table.column("bytes").to_pylist()
        shards = max(2, -(-sum(map(len, parts)) // shard_bytes))
        dealt = [np.flatnonzero(ths.view(np.uint64) % np.uint64(shards) == s) for s in range(shards)]
        runs = [Run([parts[k] for k in some], window) for some in dealt]
        for k, run in enumerate(runs):
            for other in runs[:k]:
                merge(other, run)
        cols: list[list] = [[], [], [], [], []]
        for some, run in zip(dealt, runs, strict=True):
            twin, row = run.repeats[run.of], some[run.row]
            hit = np.flatnonzero(twin & ~full[row])
            hit = hit[np.lexsort((run.start[hit], row[hit]))]
            for p in np.split(hit, np.flatnonzero(np.diff(row[hit])) + 1) if len(hit) else ():
                r = int(row[p[0]])
                for begin, size in _stretches(run.start[p], window):
                    for c, x in zip(cols, (ids[r], int(ths[r]), int(pos[r]) + begin, size, None), strict=True):
                        c.append(x)
            # an anchor that is split over buckets: its different windows go on; len -1 marks one known to repeat
            for k in run.head[split[row[run.head]]] if len(run.head) else ():
                r, begin = int(row[k]), int(run.start[k])
                for c, x in zip(cols, (ids[r], int(ths[r]), int(pos[r]) + begin, -1 if twin[k] or full[r] else 0, parts[r][begin : begin + window]), strict=True):
                    c.append(x)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=[*_KEY, "pos", "len", "bytes"])

    sorted_ = cut(bits_of.groupBy("bucket").applyInArrow(sort_bucket, "doc_id long, th long, pos int, len int, bytes binary"), "sorted-buckets")
    shared_ones = sorted_.where("bytes is null").select(*_KEY, "pos", "len")
    ranges = sorted_.where("bytes is not null").repartitionByRange("bytes").sortWithinPartitions("bytes")
    merged = ranges.mapInArrow(_neighbours(window), "doc_id long, th long, pos int, len int")
    marks = cut(full.unionByName(shared_ones).unionByName(merged).groupBy(*_KEY).agg(F.collect_list(F.struct("pos", "len")).alias("marks")), "marks")
    drop_written(docs.sparkSession, anchors, places, kinds, mixed, sorted_)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(2))
            lists = batch.column(3)
            cols: list[list] = [[], [], [], [], []]
            for k in range(len(batch)):
                text = data[at[k] : at[k + 1]]
                gone = np.zeros(len(text) + 1, np.int32)
                spans = lists[k].values if lists[k].is_valid else None
                if spans is not None:
                    p, n = spans.field("pos").to_numpy(), spans.field("len").to_numpy()
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + n, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = text[~gone].tobytes()
                values = (len(text), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None)
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
            names = ["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], names=names)

    some = texts_of.join(marks, null_safe(texts_of, marks), "left").select(texts_of["doc_id"], "row", "text", "marks")
    zero = F.lit(0).cast("long")
    plain_row = [F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if texts else F.lit(None).cast("string")).alias("kept")]
    rest = rows.select("doc_id", "th", "row", *plain_row)
    rest = rest.join(touched, null_safe(rest, touched), "left_anti").drop("th")
    kinds = T.StructType([*some.select("doc_id", "row").schema.fields, *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
    out = some.mapInArrow(remove, kinds).unionByName(rest)
    return out if texts else out.drop("row", "kept")


def _neighbours(window: int):
    """Of windows in the order of their bytes, one from each bucket: those that equal the one before or after and were not known to repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.Table) -> pa.RecordBatch:
            raw = rows.column("bytes").to_pylist()
            equal = np.array([x == y for x, y in zip(raw, raw[1:])], bool)
            twin = np.concatenate([[False], equal]) | np.append(equal, False)
            out = rows.filter(pa.array(twin & (rows.column("len").to_numpy() == 0))).select([*_KEY, "pos"]).combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in out.columns), pa.array(np.full(len(out), window, np.int32))], names=[*_KEY, "pos", "len"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            raw = table.column("bytes").to_pylist()
            stop = next((k + 1 for k in range(len(raw) - 2, -1, -1) if raw[k] != raw[-1]), 0)  # the last value waits for the next batch
            if stop:
                yield settle(table.slice(0, stop))
            held = table.slice(stop)
        if held is not None and len(held):
            yield settle(held)

    return work
