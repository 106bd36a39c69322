"""TextGrid and WAV as data sources by format name, after ``register(spark)``.

``spark.read.format("textgrid").load(folder)`` gives (file, tier, idx, xmin, xmax, text), ``format("wav")`` gives (file, sr, channels,
start, samples), where ``samples`` are a block of frames, sample by channel, and ``start`` is the first one's number. ``file`` is the
path below the folder without its ending. Files are found below the folder, those whose names begin with ``_`` or ``.`` left out, and
dealt to partitions by their sizes: many small ones to a partition, and a WAV file of more than ``partitionBytes`` (option, 64 MB) to
several, each of which seeks to its own frames. Blocks hold ``blockFrames`` frames (option, 65536), so that no row grows with a
recording. Conditions on ``file`` end in the listing, conditions on ``tier`` skip the other tiers' intervals.

``df.write.format("textgrid").mode("append").save(folder)`` writes one file ``<file>.TextGrid`` for each row of (file, value), such as
``files.textgrid_texts`` makes, and ``format("wav")`` one ``<file>.wav`` for each row of (file, content), such as
``files.wav_contents`` makes. Tasks write below ``_temporary``; the commit moves what the successful attempts wrote, so that a task that
runs twice leaves one file. (A task that is killed while a job ends may leave its own below ``_temporary``, which readers pass over.) A name that stands twice, or that is there already, is refused; ``mode("overwrite")`` removes the files of
the kind first. A null value is an empty file; a null name is refused.

Paths may be of any file system that Arrow opens (local or mounted folders, HDFS, S3, Google's store); for others ``sources.files`` reads
through Spark's own readers. A folder without files gives no rows.
"""

from __future__ import annotations

import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .files import pcm_samples, textgrid_rows, textgrid_texts, wav_contents

PARTITION_BYTES, BLOCK_FRAMES = 64 << 20, 1 << 16


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str, ending: str) -> list[tuple[str, str, int]]:
    """(name below the folder without its ending, path, bytes) of the files of a kind, by name."""
    system, root = open_path(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.base_name.rpartition(".")[0], info.path, info.size)]
    out = []
    for x in system.get_file_info(fs.FileSelector(root, recursive=True)):
        name = x.path[len(root.rstrip("/")) + 1 :]
        if x.type == fs.FileType.File and name.lower().endswith(ending) and not any(p[0] in "_." for p in name.split("/")):
            out.append((name[: -len(ending)], x.path, x.size))
    return sorted(out)


@dataclass
class Files(InputPartition):
    """(name, path) of whole files, or one file's share: part ``k`` of ``n``."""

    files: list[tuple[str, str]]
    k: int = 0
    n: int = 1


def deal(files: list[tuple[str, str, int]], most: int, divisible: bool) -> list[Files]:
    """Files in order, those next to each other together up to ``most`` bytes (and 4096 files); with ``divisible`` a larger one in even shares."""
    out: list[Files] = []
    room = 0
    for name, path, size in files:
        if divisible and size > most:
            n = -(-size // most)
            out += [Files([(name, path)], k, n) for k in range(n)]
            room = 0
        elif out and size <= room and len(out[-1].files) < 4096:
            out[-1].files.append((name, path))
            room -= size
        else:
            out.append(Files([(name, path)]))
            room = most - size
    return out


class _Reader(DataSourceReader):
    ending, divisible = "", False
    #: Columns whose conditions are met here.
    pushed: tuple[str, ...] = ("file",)

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.pushed:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = list_files(self.path, self.ending)
        if "file" in self.wanted:
            files = [x for x in files if x[0] in self.wanted["file"]]
        return deal(files, self.most, self.divisible) or [Files([])]


class TextGridReader(_Reader):
    ending, pushed = ".textgrid", ("file", "tier")

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = open_path(self.path)
        for name, path in partition.files:
            with system.open_input_stream(path) as f:
                value = f.read().decode("utf-8", "replace")
            for row in textgrid_rows(value, self.wanted.get("tier")):
                yield (name, *row)


class WavReader(_Reader):
    ending, divisible = ".wav", True

    def __init__(self, options: dict):
        super().__init__(options)
        self.block = int(options.get("blockFrames", BLOCK_FRAMES))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(self.path)
        for name, path in partition.files:
            with system.open_input_file(path) as f, wave.open(f) as w:
                width, channels, rate, total = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
                blocks = -(-total // self.block)
                first, last = (blocks * k // partition.n for k in (partition.k, partition.k + 1))
                w.setpos(min(first * self.block, total))
                for start in range(first * self.block, min(last * self.block, total), self.block):
                    x = pcm_samples(w.readframes(min(self.block, total - start)), width, channels)
                    frames = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, channels), pa.int32()), pa.array(x.ravel()))
                    samples = pa.ListArray.from_arrays(pa.array([0, len(frames)], pa.int32()), frames)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([start], pa.int64()), samples], names=["file", "sr", "channels", "start", "samples"])


@dataclass
class Written(WriterCommitMessage):
    """(name in the folder, temporary path) of one attempt's files."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """One file for each row of (file, bytes or text)."""

    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite = path, ending, overwrite
        self.job = uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return f"{root.rstrip('/')}/_temporary/{self.job}"

    def write(self, iterator) -> Written:
        system, root = open_path(self.path)
        home, out = f"{self._temporary(root)}/{uuid.uuid4().hex}", []
        for k, (name, value) in enumerate(iterator):
            if name is None or not name or any(p in ("", ".", "..") or p[0] in "_." for p in name.split("/")):
                raise ValueError(f"not a name for a file: {name!r}")
            if not out:
                system.create_dir(home, recursive=True)
            with system.open_output_stream(f"{home}/{k}") as f:
                f.write(value.encode() if isinstance(value, str) else bytes(value or b""))
            out.append((name + self.ending, f"{home}/{k}"))
        return Written(out)

    def commit(self, messages) -> None:
        """Names are few against what the files hold, and only names come here."""
        system, root = open_path(self.path)
        made = sorted(x for m in messages if m is not None for x in m.files)
        names = [n for n, _ in made]
        there = {f"{n}{self.ending.lower()}" for n, *_ in list_files(self.path, self.ending.lower())} if system.get_file_info(root).type == fs.FileType.Directory else set()
        twice = {a for a, b in zip(names, names[1:]) if a == b}
        if not self.overwrite:
            twice |= {n for n in names if n[: -len(self.ending)] + self.ending.lower() in there}
        if twice:
            self._clean(system, root)
            raise ValueError(f"{len(twice)} files are named twice or are there already, such as {min(twice)!r}")
        if self.overwrite and there:
            for _, old, _ in list_files(self.path, self.ending.lower()):
                system.delete_file(old)
        for folder in {n.rpartition("/")[0] for n in names if "/" in n}:
            system.create_dir(f"{root.rstrip('/')}/{folder}", recursive=True)
        for name, path in made:
            system.move(path, f"{root.rstrip('/')}/{name}")
        self._clean(system, root)

    def abort(self, messages) -> None:
        system, root = open_path(self.path)
        self._clean(system, root)

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._temporary(root)).type == fs.FileType.Directory:
            system.delete_dir(self._temporary(root))
            above = self._temporary(root).rpartition("/")[0]
            if not system.get_file_info(fs.FileSelector(above)):
                system.delete_dir(above)


class TextGridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return "file string, tier string, idx int, xmin double, xmax double, text string"

    def reader(self, schema) -> DataSourceReader:
        return TextGridReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], ".TextGrid", overwrite)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "file string, sr int, channels int, start long, samples array<array<double>>"

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], ".wav", overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session; conditions reach Python sources only where the session allows it, so this is set too."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextGridSource)
    spark.dataSource.register(WavSource)


def save_textgrids(intervals: DataFrame, path: str, mode: str = "append") -> None:
    """One ``<file>.TextGrid`` per file from (file, tier_no, tier, idx, onset, offset, label)."""
    register(intervals.sparkSession)
    textgrid_texts(intervals).write.format("textgrid").mode(mode).save(path)


def save_wavs(waves: DataFrame, path: str, mode: str = "append") -> None:
    """One ``<file>.wav`` per row from (file, sr, samples)."""
    register(waves.sparkSession)
    wav_contents(waves).select("file", F.col("content")).write.format("wav").mode(mode).save(path)
