"""Token-id files compressed by Re-Pair grammars.

Documents are encoded by the tokenizers library, dealt by id ranges and cut into shards in ascending id order. Each shard replaces
frequent pairs of ids by nonterminals, round by round, and stores the rules with the lengths they expand to, so that any run of a
document's ids is decoded without the rest of its shard. Pairs never span two documents. Shards are rows of a Parquet table:

    part, shard: order of the shard; n_ids, n_docs: totals; body: the grammar and its documents, see ``pack``.

The library is called for distinct words only: the vocabulary's pre-tokenizer cuts at word borders, and no merge crosses one. Texts
with characters outside plain Latin letters, or with special tokens, go to the library whole. Each task's memory of words is bounded;
words of plain texts are told apart by 64-bit hashes.

Null and empty texts hold the end id alone; null ids come first; rows that share an id are ordered by a hash of their text. A text longer
than ``SHARD_IDS`` makes a shard of its own. An empty table writes no shards. Only the id and text columns are read, so that other
columns may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from .common import _LOWER, mix, powers, shared_folder, slices, text_buffers

END = 1
SHARD_IDS = 1 << 20
#: Places where a pair must stand to get a rule: a rule takes the room of four symbols, and of places that overlap every other one is lost.
LEAST = 6
MEMORY = 1_000_000
NO_ID = -(1 << 62)
#: Fixed values of the vocabulary's pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Anything but printable ASCII, common white space and composed Latin letters; or the start of a special token.
UNUSUAL = "[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u0148\\u014a-\\u017e]|<\\|"


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 letter, 2 digit, 3 other sign, 4 not for the plain path."""
    out = np.full(256, 4, np.uint8)
    out[33:127] = 3
    out[[9, 10, 13, 32]] = 0
    out[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1
    out[48:58] = 2
    out[39] = 4  # an apostrophe may begin a contraction
    return out


_CLASS = _classes()
#: Pairs of bytes that take a text off the plain path: two signs among the letters, letters that change when normalised, special tokens.
_SLOW = np.zeros(1 << 16, bool)
_SLOW[[0xC397, 0xC3B7, 0xC4B0, 0xC4B1, 0xC589, 0xC5BF, 0x3C7C]] = True


class WordEncoder:
    """Plain texts are cut into words by byte classes and known words fetched by 64-bit hashes; other texts by the pattern, or whole."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.ends = np.zeros(size + 1, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.words, self.unusual = regex.compile(WORDS).findall, regex.compile(UNUSUAL).search
        self.known: dict[str | int, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: list, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                self.known.update(zip(keys[i : i + 4096], self.whole(some), strict=True))
                continue
            raw, at = ids.tobytes(), [0, *(stops * self.kind.itemsize).tolist()]
            self.known.update((w, raw[at[k] : at[k + 1]]) for k, w in enumerate(keys[i : i + 4096]))

    def run(self, data: np.ndarray, at: np.ndarray, i: int, j: int) -> list[bytes]:
        """Ids of the texts of rows i..j-1, as bytes of ``kind``."""
        flat, starts = data[at[i] : at[j]], at[i : j + 1] - at[i]
        kinds = _CLASS[flat]
        bad = np.concatenate([np.flatnonzero(kinds == 4), np.flatnonzero(_SLOW[(flat[:-1].astype(np.uint16) << 8) | flat[1:]])])
        slow = np.zeros(j - i, bool)
        slow[np.searchsorted(starts, bad, "right") - 1] = True
        out = self._plain(flat, starts, kinds, slow)
        if slow.any():
            rows = np.flatnonzero(slow).tolist()
            for k, ids in zip(rows, self._by_pattern([flat[starts[k] : starts[k + 1]].tobytes().decode() for k in rows]), strict=True):
                out[k] = ids
        return out

    def _plain(self, flat: np.ndarray, starts: np.ndarray, kinds: np.ndarray, slow: np.ndarray) -> list[bytes]:
        n = len(starts) - 1
        edge = np.concatenate([[True], kinds[1:] != kinds[:-1]])[: len(kinds)] | (kinds == 2)
        edge[starts[:-1][starts[:-1] < len(flat)]] = True
        first = np.flatnonzero(edge)
        stop = np.append(first[1:], len(flat))[: len(first)]
        row = np.searchsorted(starts, first, "right") - 1
        keep = (kinds[first] != 0) & ~slow[row]
        first, stop, row = first[keep], stop[keep], row[keep]
        if not len(first):
            return [b""] * n
        low = _LOWER[flat]
        up, down = powers(len(low) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(low)])])
        hashed = mix((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(hashed)
        ordered = hashed[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        where, inverse = order[new], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        keys = ordered[new].tolist()
        fresh = [k for k, h in enumerate(keys) if h not in self.known]
        if len(self.known) + len(fresh) > MEMORY:
            self.known.clear()
            fresh = list(range(len(keys)))
        raw = low.tobytes()
        self.learn([keys[k] for k in fresh], [raw[first[where[k]] : stop[where[k]]].decode() for k in fresh])
        found = [self.known[h] for h in keys]
        pool, sizes = np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begin = np.cumsum(sizes) - sizes
        counts = sizes[inverse]
        stops = np.cumsum(counts)
        ids = pool[np.repeat(begin[inverse] - stops + counts, counts) + np.arange(stops[-1])].tobytes()
        ends = np.append(0, stops)[np.searchsorted(row, np.arange(n + 1))] * self.kind.itemsize
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _by_pattern(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.unusual(t) else self.words(t.lower()) for t in texts]
        new = set().union(*(c for c in cut if c)) - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set().union(*(c for c in cut if c))
        self.learn(list(new), list(new))
        odd = iter(self.whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(odd) if c is None else b"".join(map(self.known.__getitem__, c)) for c in cut]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def re_pair(ids: np.ndarray, last: np.ndarray, symbols: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, its document ends, rules): rule k is the pair that symbol ``symbols + k`` stands for. ``ids`` are under ``symbols``; ``last`` marks each document's last id.

    Pairs are replaced frequent ones first, those within a sixteenth of the highest count together, until none stands ``least`` times.
    """
    seq, last, rules, made = ids.astype(np.uint32), last.copy(), [], 0
    while len(seq) > 1:
        wide = symbols + made > 1 << 16
        kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
        none = np.iinfo(kind).max  # no pair: of its symbols the last is not made yet
        keys = seq[:-1].astype(kind) << kind(shift) | seq[1:]
        keys[last[:-1]] = none
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        pairs, counts = ordered[edge], np.diff(np.append(edge, len(ordered)))
        if pairs[-1] == none:
            pairs, counts = pairs[:-1], counts[:-1]
        if not len(pairs) or counts.max() < least:
            break
        pairs = pairs[counts >= max(least, counts.max() // 16)]
        left, right = np.zeros(symbols + made, bool), np.zeros(symbols + made, bool)
        left[pairs >> kind(shift)], right[pairs & kind((1 << shift) - 1)] = True, True
        hit = np.flatnonzero(left[seq[:-1]] & right[seq[1:]])
        found, where = _places(pairs, keys[hit])
        hit, where = hit[found], where[found]
        # of overlapping places every other one is replaced, from the left
        begin = np.concatenate([[True], np.diff(hit) > 1])
        run = np.arange(len(hit)) - np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
        hit, where = hit[run % 2 == 0], where[run % 2 == 0]
        used = np.zeros(len(pairs), np.int64)  # a pair that others left no place for gets no rule now
        used[where] = 1
        pairs, number = pairs[used > 0], np.cumsum(used) - 1
        seq[hit] = symbols + made + number[where]
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([pairs >> kind(shift), pairs & kind((1 << shift) - 1)], 1).astype(np.int64))
        made += len(pairs)
    return seq, np.flatnonzero(last) + 1, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def _places(pairs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is among the sorted pairs, and which one): by a table of hashes; keys of slots that several pairs share are searched for."""
    kind, bits = pairs.dtype.type, 18
    odd, down = kind(0x9E3779B97F4A7C15 >> (64 - 8 * pairs.itemsize) | 1), kind(8 * pairs.itemsize - bits)
    slot, each = np.zeros(1 << bits, np.int32), np.arange(len(pairs), dtype=np.int32)
    of_pair, of_key = (pairs * odd) >> down, (keys * odd) >> down
    slot[of_pair] = each
    shared = np.zeros(1 << bits, bool)
    shared[of_pair[slot[of_pair] != each]] = True
    where = slot[of_key]
    found = pairs[where] == keys
    rest = np.flatnonzero(shared[of_key] & ~found)
    at = np.minimum(np.searchsorted(pairs, keys[rest]), len(pairs) - 1)
    found[rest], where[rest] = pairs[at] == keys[rest], at
    return found, where


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Ids that each rule expands to; rules only name earlier ones."""
    out = np.ones(first_symbol + len(rules), np.int64)
    done = 0
    while done < len(rules):  # a round's rules all name symbols of earlier rounds
        rest = rules[done:]
        stop = done + int(np.argmax(np.append((rest >= first_symbol + done).any(1), True)))
        out[first_symbol + done : first_symbol + stop] = out[rules[done:stop, 0]] + out[rules[done:stop, 1]]
        done = stop
    return out


HEAD = "<4sIIIQQ"


def symbol_kind(symbols: int) -> str:
    return "<u2" if symbols <= 1 << 16 else "<u4"


def pack(doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Head (magic, different ids, rules, documents, ids, symbols); the different ids; rules as pairs and their lengths; document ids; ends in ids and in symbols; symbols. Symbols are numbers of different ids, then rules; they take two bytes, or four where there are over 65,536 of them."""
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    names = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(names[-1]) + 1 if len(names) else 0, np.uint32)
    number[names] = np.arange(len(names))
    seq, stops, rules = re_pair(number[ids], last, len(names))
    lengths = expansion_lengths(rules, len(names))[len(names) :]
    kind = symbol_kind(len(names) + len(rules))
    head = struct.pack(HEAD, b"RPG2", len(names), len(rules), len(doc_ids), len(ids), len(seq))
    return b"".join([head, names.astype("<u4").tobytes(), rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), stops.astype("<u8").tobytes(), seq.astype(kind).tobytes()])


class Shard:
    """A packed shard, read without expanding it."""

    def __init__(self, body: bytes):
        magic, self.first, n_rules, n_docs, self.n_ids, n_symbols = struct.unpack_from(HEAD, body)
        if magic != b"RPG2":
            raise ValueError("not a packed shard")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        kind = symbol_kind(self.first + n_rules)
        self.names = take("<u4", self.first)
        self.rules = take(kind, 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate([np.ones(self.first, np.int64), take("<u4", n_rules)])
        self.doc_ids, self.ends, self.stops = take("<i8", n_docs), take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
        self.symbols = take(kind, n_symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        seq = symbols.astype(np.int64)
        while len(big := np.flatnonzero(seq >= self.first)):
            counts = np.ones(len(seq), np.int64)
            counts[big] = 2
            at = np.cumsum(counts) - counts
            out = np.repeat(seq, counts)
            pairs = self.rules[seq[big] - self.first]
            out[at[big]], out[at[big] + 1] = pairs[:, 0], pairs[:, 1]
            seq = out
        return self.names[seq]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop-1 of document k; only the symbols that cover them are expanded."""
        part = self.symbols[self.stops[k - 1] if k else 0 : self.stops[k]]
        ends = np.cumsum(self.lengths[part])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        before = int(ends[i - 1]) if i else 0
        return self.expand(part[i : j + 1])[start - before : stop - before]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END, parts: int | None = None) -> None:
    """Encode, order by id and write the shards below ``folder``. One shuffle, of texts by id range."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.select("doc_id").rdd.getNumPartitions())
    order = ["doc_id", F.xxhash64("text")]  # null and shared ids are split too
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        size, end = encode.kind.itemsize, np.array([end_id], encode.kind).tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        held_ids, held, count = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, count
            ids = np.frombuffer(b"".join(held), encode.kind)
            ends = np.cumsum([len(x) // size for x in held])
            body = pack(np.array(held_ids, np.int64), ids, ends)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([body], pa.binary())], names=["part", "shard", "n_ids", "n_docs", "body"])
            shard, count = shard + 1, 0
            held_ids.clear()
            held.clear()
            return out

        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for i, j in slices(at, 1 << 20):  # a word is looked up once in each
                for doc, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encode.run(data, at, i, j), strict=True):
                    held_ids.append(doc)
                    held.append(ids + end)
                    count += len(ids) // size + 1
                    if count >= SHARD_IDS:
                        yield flush()
        if held:
            yield flush()

    dealt.mapInArrow(work, "part long, shard long, n_ids long, n_docs long, body binary").write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, in the files' order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema("part long, shard long, n_ids long, n_docs long, body binary").parquet(folder)
    sizes = files.select("part", "shard", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("p"))
    w = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select("part", "shard", (F.sum("n_ids").over(w) - F.col("n_ids")).alias("s")).join(before, "part").select("part", "shard", (F.col("s") + F.col("p")).alias("start"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(body.as_buffer())
                ids = shard.expand(shard.symbols).astype("<u4")
                begin = np.concatenate([[0], shard.ends[:-1]])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), shard.ends.tolist(), strict=True)]
                n = len(begin)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(shard.doc_ids), pa.array(begin), pa.array(shard.ends - begin), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.select("part", "shard", "body").mapInArrow(work, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, folder, id_col, text_col)
    return read_token_files(docs.sparkSession, folder)
