"""Scans and sinks: interval CSV, TextGrid, word vectors, WAV."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): each file's text in one row, so that the order of its lines is kept. For annotation files, which are small."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def parse_intervals(files: DataFrame, label_col: int = 0, onset_col: int = 1, offset_col: int | None = None) -> DataFrame:
    """(file, idx, onset, offset, label) from (file, value) of CSV texts with a header; columns by place.

    Label ``>`` means no label. Without an offset column an interval ends where the next begins, and the last one is dropped.
    """
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("_i", "_line")).where("_i > 0 and trim(_line) <> ''")
    most = max(label_col, onset_col, offset_col or 0) + 1
    cells = F.from_csv("_line", ", ".join(f"c{k} string" for k in range(most)), {"sep": ","})
    rows = lines.withColumn("_c", cells)
    label = F.coalesce(F.when(F.col(f"_c.c{label_col}") == ">", F.lit("")).otherwise(F.col(f"_c.c{label_col}")), F.lit(""))
    onset = F.col(f"_c.c{onset_col}").cast("double")
    w = Window.partitionBy("file").orderBy("_i")
    offset = F.lead(onset).over(w) if offset_col is None else F.col(f"_c.c{offset_col}").cast("double")
    out = rows.select("file", (F.row_number().over(w) - 1).alias("idx"), onset.alias("onset"), offset.alias("offset"), label.alias("label"))
    return out.where("offset is not null") if offset_col is None else out


def read_intervals(spark: SparkSession, path: str, label_col: int = 0, onset_col: int = 1, offset_col: int | None = None) -> DataFrame:
    return parse_intervals(whole_files(spark, path), label_col, onset_col, offset_col)


_TIER = re.compile(r"item \[\d+\]:")
_QUOTED = r'"((?:[^"]|"")*)"'
_INTERVAL = re.compile(rf"intervals \[\d+\]:?\s*xmin = (\S+)\s*xmax = (\S+)\s*text = {_QUOTED}")
_NAME = re.compile(rf"name = {_QUOTED}")


def textgrid_rows(value: str | None, tiers: set | None = None) -> Iterator[tuple]:
    """(tier, idx, xmin, xmax, text) of a long TextGrid text; of ``tiers`` only, where they are given."""
    for part in _TIER.split(value or "")[1:]:
        found = _NAME.search(part)
        tier = found[1].replace('""', '"') if found else None
        if tiers is None or tier in tiers:
            for k, found in enumerate(_INTERVAL.finditer(part)):
                yield tier, k, float(found[1]), float(found[2]), found[3].replace('""', '"')


#: Intervals that a task holds as rows at once.
ROW_BLOCK = 1 << 13


_GRID = {"file": pa.string(), "tier": pa.string(), "idx": pa.int32(), "xmin": pa.float64(), "xmax": pa.float64(), "text": pa.string()}


def textgrid_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of batches of (file, value), ROW_BLOCK of them at once: one text is held beside the batch that is read."""

    def intervals(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k in range(len(batch)):
            name = batch.column(0)[k].as_py()
            for row in textgrid_rows(batch.column(1)[k].as_py()):
                yield name, *row

    for batch in batches:
        rows = intervals(batch)
        while some := list(islice(rows, ROW_BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), _GRID.values(), strict=True)], names=list(_GRID))


def parse_textgrids(files: DataFrame) -> DataFrame:
    """(file, tier, idx, xmin, xmax, text) from (file, value) of long TextGrid texts."""
    return files.select("file", "value").mapInArrow(textgrid_batches, "file string, tier string, idx int, xmin double, xmax double, text string")


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    return parse_textgrids(whole_files(spark, path))


def phones(textgrids: DataFrame) -> DataFrame:
    """Named intervals of tier ``phones`` without one trailing digit."""
    from ..functions.scalar import strip_stress

    return words(textgrids, "phones").withColumn("text", strip_stress(F.col("text")))


def words(textgrids: DataFrame, tier: str = "words") -> DataFrame:
    return textgrids.where((F.col("tier") == tier) & (F.col("text") != "")).select("file", "idx", "text", F.col("xmin").alias("onset"), F.col("xmax").alias("offset"))


def textgrid_tiers(intervals: DataFrame) -> DataFrame:
    """(file, tier_no, tier, xmax, body) from (file, tier_no, tier, idx, onset, offset, label): one text per tier; it ends with its last row."""
    escaped = lambda c: F.regexp_replace(c, '"', '""')
    rows = F.array_sort(F.collect_list(F.struct("idx", "onset", "offset", "label")))
    g = intervals.groupBy("file", "tier_no", "tier").agg(rows.alias("_r"))
    pieces = F.transform("_r", lambda x, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n            xmin = "), x["onset"].cast("string"), F.lit("\n            xmax = "), x["offset"].cast("string"), F.lit('\n            text = "'), escaped(x["label"]), F.lit('"\n')))
    last = F.element_at("_r", -1)["offset"]
    head = F.concat(F.lit('        class = "IntervalTier"\n        name = "'), escaped(F.col("tier")), F.lit('"\n        xmin = 0\n        xmax = '), last.cast("string"), F.lit("\n        intervals: size = "), F.size("_r").cast("string"), F.lit("\n"))
    return g.select("file", "tier_no", "tier", last.alias("xmax"), F.concat(head, F.array_join(pieces, "")).alias("body"))


def textgrid_texts(intervals: DataFrame) -> DataFrame:
    """(file, value): one TextGrid text per file; its end is the largest end of its tiers."""
    tiers = F.array_sort(F.collect_list(F.struct("tier_no", "body")))
    g = textgrid_tiers(intervals).groupBy("file").agg(F.max("xmax").alias("_x"), tiers.alias("_t"))
    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), F.col("_x").cast("string"), F.lit("\ntiers? <exists>\nsize = "), F.size("_t").cast("string"), F.lit("\nitem []:\n"))
    items = F.array_join(F.transform("_t", lambda t, i: F.concat(F.lit("    item ["), (i + 1).cast("string"), F.lit("]:\n"), t["body"])), "")
    return g.select("file", F.concat(head, items).alias("value"))


def write_textgrids(intervals: DataFrame, path: str) -> None:
    """One folder ``file=<name>`` per file below path, each with one TextGrid text."""
    textgrid_texts(intervals).repartition("file").write.partitionBy("file").option("lineSep", "\n").text(path)


def csv_to_textgrid(spark: SparkSession, csv_paths: list[str], out_path: str, names: list[str], name: str = "out", label_col: int = 0, onset_col: int = 1, offset_col: int | None = None) -> None:
    """Interval CSVs as the tiers of one TextGrid; the shorter of paths and names decides."""
    parts = [read_intervals(spark, p, label_col, onset_col, offset_col).select(F.lit(name).alias("file"), F.lit(k).alias("tier_no"), F.lit(n).alias("tier"), "idx", "onset", "offset", "label") for k, (p, n) in enumerate(zip(csv_paths, names))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    write_textgrids(out, out_path)


def tier_per_label(intervals: DataFrame) -> DataFrame:
    """Each label as a tier of its own, in label order."""
    w = Window.partitionBy("file").orderBy("label")
    return intervals.withColumn("tier", F.col("label")).withColumn("tier_no", F.dense_rank().over(w) - 1)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) from lines of a word and its numbers; .parquet is a table kept before."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if not path.rstrip("/").endswith((".txt", ".vec", ".gz")):
        raise ValueError(f"unknown kind of vector file: {path}")
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(F.get(parts, F.lit(0)).alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<double>").alias("vec"))


def keep_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def decode_wav(content: bytes) -> tuple[int, list]:
    """(rate, samples from -1 to 1; a list per sample where there are more channels) of PCM."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    return rate, pcm_samples(raw, width, channels)


def pcm_samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples from -1 to 1, sample by channel, of PCM of ``width`` bytes."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - ((b[:, 2] >> 7) << 24)) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels)


def parse_wavs(files: DataFrame) -> DataFrame:
    """(path, sr, channels, samples array<array<double>>, sample by channel) from (path, content) of WAV files."""

    def work(batches):
        for pdf in batches:
            rows = [(p, r, x.shape[1], x.tolist()) for p, (r, x) in ((p, decode_wav(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True))]
            yield pd.DataFrame(rows, columns=["path", "sr", "channels", "samples"])

    return files.select("path", "content").mapInPandas(work, "path string, sr int, channels int, samples array<array<double>>")


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    return parse_wavs(spark.read.format("binaryFile").load(path))


def _little(number: Column, digits: int) -> Column:
    """A whole number as little-endian hex of so many digits; negative ones as their two's complement."""
    text = F.lpad(F.hex(F.pmod(number.cast("long"), F.lit(1 << 4 * digits))), digits, "0")
    return F.concat(*(F.substring(text, k + 1, 2) for k in range(digits - 2, -1, -2)))


def wav_contents(df: DataFrame, samples: str = "samples", sr: str = "sr", out: str = "content") -> DataFrame:
    """``df`` with the bytes of a WAV file of 16-bit samples of one channel, from an array of numbers within -1 to 1 (others are cut off). Expressions only."""
    rounded = F.transform(samples, lambda v: F.greatest(F.least(F.round(v * 32768), F.lit(32767.0)), F.lit(-32768.0)).cast("long"))
    size, rate = F.size(samples) * 2, F.col(sr)
    head = F.concat(F.lit("52494646"), _little(size + 36, 8), F.lit("57415645666D74201000000001000100"), _little(rate, 8), _little(rate * 2, 8), F.lit("0200100064617461"), _little(size, 8))
    return df.withColumn(out, F.unhex(F.concat(head, F.array_join(F.transform(rounded, lambda v: _little(v, 4)), ""))))


def write_rows(df: DataFrame, path: str) -> None:
    """A table, such as phones with their words, as CSV below ``path``, the columns' names in the first line of each file."""
    df.write.option("header", True).csv(path)
