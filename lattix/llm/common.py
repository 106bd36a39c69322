"""Shared helpers: table access, shared folders, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A-Z become a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER, np.uint8)
#: Word separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing, as bytes of UTF-8.
SPACES = bytes([*range(9, 14), 32])
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_R = 0x9E3779B97F4A7C15
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir (set here only where the session has none, as in local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_OPEN: list[list[str]] = []


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths of the tables that cut() writes within the block."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.pop()


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    for paths in _OPEN:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is frequent; there are fewer frequent keys than this.
SPREAD = 4096


def spread_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``keys`` (one row a key, its number of rows in ``df``) without a task for a frequent key: the fewer than SPREAD frequent keys are broadcast, the others shuffled."""
    limit = (keys.agg(F.sum("df")).first()[0] or 0) // SPREAD
    few = F.broadcast(keys.where(F.col("df") > limit))
    rest = rows.join(few.select(key), key, "left_anti").join(keys.where(F.col("df") <= limit), key)
    return rows.join(few, key).unionByName(rest)


def salted_join(rows: DataFrame, keys: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``keys`` on ``key`` without a task for a frequent key: its rows are dealt over places by a hash of column ``by``, and what ``keys`` holds of it is copied to each place. Places follow the key's share of all rows, so that there are fewer than 2 * SPREAD more. ``rows`` are read twice."""
    count = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    limit = max(1, (count.agg(F.sum("_rows")).first()[0] or 0) // SPREAD)
    hot = F.broadcast(count.where(F.col("_rows") > limit).select(key, F.ceil(F.col("_rows") / limit).cast("int").alias("_places")))  # fewer than SPREAD rows of two numbers
    places = F.coalesce("_places", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_place", F.pmod(F.xxhash64(by), places).cast("int")).drop("_places")
    copies = keys.join(hot, key, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), places - 1))).drop("_places")
    return dealt.join(copies, [key, "_place"]).drop("_place")


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    drop_folders(spark, {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()})


def drop_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders, those that are gone already too."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``most`` bytes, so that the working arrays stay small whatever the batch holds."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(r: int) -> np.ndarray:
        out = np.full(n, r, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_R), table(pow(_R, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n; few table sizes are kept."""
    size = 1 << max(18, int(n - 1).bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def is_word(separators: bytes) -> np.ndarray:
    out = np.ones(256, np.int8)
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of rows i..j-1, and where each row's words start in them."""
    n, sizes = j - i, np.diff(offsets[i : j + 1])
    flat = np.full(int(sizes.sum()) + n + 1, 32, np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64) + 1
    for k in range(n):
        flat[begin[k] : begin[k] + sizes[k]] = data[offsets[i + k] : offsets[i + k + 1]]
    flat = _LOWER[flat]
    step = np.diff(word[flat])
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    up, down = powers(len(flat) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * up[: len(flat)])])
    if len(ends) < len(starts):  # cannot be: the last byte is a separator
        ends = np.append(ends, len(flat))
    hashed = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return hashed, np.searchsorted(starts, begin)


def shingles(hashed: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words of a row (of the whole row where it is shorter), and the row of each."""
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    if not len(row):
        return np.zeros(0, np.uint64), row
    first = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
    out = np.zeros(len(row), np.uint64)
    for k in range(width):
        factor = _U(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
        part = padded[first + k]
        short = counts[row] <= k
        out += np.where(short, _U(0x5851F42D4C957F2D), part) * factor
    return mix(out), row


def with_row_hash(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a long that tells its rows apart by all their columns, nulls included, and that column's name. Only rows that are equal throughout share one."""
    name = "_row"
    while name in df.columns:
        name += "_"
    columns = [F.col(c) for c in df.columns]
    return df.withColumn(name, F.xxhash64(*columns, *(c.isNull() for c in columns))), name
