"""TextGrid and WAV by format name: round trips, partitions, pushed conditions, and the rules of names."""

from __future__ import annotations

import wave
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattix.sources import files, formats


def grid_rows(n: int = 5) -> list[tuple]:
    return [(f"s{f}/g {f}" if f % 2 else f"g{f}", t, ("phones", "words")[t], k, k * 0.5, k * 0.5 + 0.5, f'l"{f}é{k}' if k else "") for f in range(n) for t in range(2) for k in range(4)]


@pytest.fixture(scope="module")
def grids(spark):
    formats.register(spark)
    return spark.createDataFrame(grid_rows(), "file string, tier_no int, tier string, idx int, onset double, offset double, label string").repartition(3)


def wav(path: Path, x: np.ndarray, rate: int, width: int) -> None:
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((x + 128).astype(np.uint8).tobytes() if width == 1 else x.astype({2: "<i2", 4: "<i4"}[width]).tobytes())


def test_textgrids_by_format_name(spark, grids, tmp_path):
    home = str(tmp_path / "out")
    formats.save_textgrids(grids, home)
    assert sorted(str(p.relative_to(home)) for p in Path(home).rglob("*") if p.is_file()) == ["g0.TextGrid", "g2.TextGrid", "g4.TextGrid", "s1/g 1.TextGrid", "s3/g 3.TextGrid"]
    got = spark.read.format("textgrid").load(home)
    want = sorted((f, t, k, a, b, x) for f, _, t, k, a, b, x in grid_rows())
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, spark.read.format("textgrid").load("file://" + home).collect())) == want
    by_name = files.read_textgrids(spark, f"{home}/g2.TextGrid").drop("file")
    assert sorted(map(tuple, by_name.collect())) == sorted(x[1:] for x in want if x[0] == "g2")
    one = spark.read.format("textgrid").load(f"{home}/g4.TextGrid")
    assert sorted(map(tuple, one.collect())) == [x for x in want if x[0] == "g4"]
    small = spark.read.format("textgrid").option("partitionBytes", 1).load(home)
    assert small.rdd.getNumPartitions() == 5 and got.rdd.getNumPartitions() == 1


def test_conditions_reach_the_files(spark, grids, tmp_path):
    home = str(tmp_path / "out")
    formats.save_textgrids(grids, home)
    (tmp_path / "out" / "broken.TextGrid").mkdir()
    got = spark.read.format("textgrid").load(home)
    some = got.where(F.col("file").isin("g0", "g2", "none") & (F.col("tier") == "words") & (F.col("idx") > 1))
    assert sorted((r.file, r.tier, r.idx) for r in some.collect()) == [(f, "words", k) for f in ("g0", "g2") for k in (2, 3)]
    assert got.where("file = 'none'").count() == 0
    reader = formats.TextGridReader({"path": home})
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    left = list(reader.pushFilters([EqualTo(("file",), "g0"), In(("tier",), ("words", "x")), IsNotNull(("file",)), EqualTo(("idx",), 1)]))
    assert left == [IsNotNull(("file",)), EqualTo(("idx",), 1)]
    assert [p.files[0][0] for p in reader.partitions()] == ["g0"] and {r[1] for p in reader.partitions() for r in reader.read(p)} == {"words"}


@pytest.mark.parametrize("width,channels", [(2, 1), (1, 2), (4, 2)])
def test_wavs_in_shares_and_blocks_equal_the_whole(spark, tmp_path, width, channels):
    formats.register(spark)
    r = np.random.default_rng(width)
    top = 1 << (8 * width - 1)
    for name, n in (("long", 1003), ("b", 7), ("none", 0)):
        wav(tmp_path / f"{name}.WAV", r.integers(-top, top, (n, channels)), 8000 + n, width)
    (tmp_path / "_hidden.wav").write_bytes(b"x")
    whole = {Path(x.path).stem: (x.sr, x.channels, x.samples) for x in files.read_wavs(spark, f"{tmp_path}/[lbn]*").collect()}
    for most, block in ((600, 10), (1 << 20, 1 << 16), (64, 1003)):
        df = spark.read.format("wav").option("partitionBytes", most).option("blockFrames", block).load(str(tmp_path))
        got = {}
        for x in df.orderBy("file", "start").collect():
            assert len(x.samples) <= block and x.start == len(got.setdefault(x.file, (x.sr, x.channels, []))[2])
            got[x.file][2].extend(x.samples)
        assert got == {k: v for k, v in whole.items() if v[2]}
    assert spark.read.format("wav").option("partitionBytes", 600).load(str(tmp_path)).rdd.getNumPartitions() > 2


def test_names_and_modes(spark, tmp_path):
    formats.register(spark)
    home = tmp_path / "out"
    rows = lambda *names: spark.createDataFrame([(n, "x") for n in names], "file string, value string").repartition(2)
    save = lambda df, mode="append": df.write.format("textgrid").mode(mode).save(str(home))
    names = lambda: sorted(str(p.relative_to(home)) for p in home.rglob("*"))
    save(rows("a", "b"))
    save(rows("c"))
    assert names() == ["a.TextGrid", "b.TextGrid", "c.TextGrid"]
    for bad in (("d", "d"), ("e", "a"), ("../f",), ("",), (None,), ("/g",), ("_h",)):
        with pytest.raises(Exception):
            save(rows(*bad))
        assert names() == ["a.TextGrid", "b.TextGrid", "c.TextGrid"], bad
    (home / "kept.txt").write_text("x")
    save(rows("a"), "overwrite")
    assert names() == ["a.TextGrid", "kept.txt"]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert spark.read.format("textgrid").load(str(empty)).count() == 0
    with pytest.raises(Exception):
        spark.read.format("wav").load(str(tmp_path / "missing")).count()


def test_textgrids_are_parsed_in_blocks():
    n = 2 * files.ROW_BLOCK + 5
    body = "".join(f'        intervals [{k + 1}]:\n            xmin = {k}\n            xmax = {k + 1}\n            text = "a{k}"\n' for k in range(n))
    text = f'item []:\n    item [1]:\n        class = "IntervalTier"\n        name = "words"\n{body}'
    made = list(files.textgrid_batches([pa.RecordBatch.from_pydict({"file": ["f", "g", "h"], "value": [text, None, text]})]))
    assert max(map(len, made)) <= files.ROW_BLOCK
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert rows == [(f, "words", k, float(k), float(k + 1), f"a{k}") for f in "fh" for k in range(n)]
