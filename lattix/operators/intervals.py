"""Joins of points and intervals with intervals.

A range predicate alone makes Spark compare every pair. ``range_join`` deals both sides by keys and time bins of several widths, each
LEVEL_STEP times the one before: an interval goes to the narrowest bins that are as wide as it, of which it touches two at most, whatever
its length; a point looks into its one bin of every width that is in use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from .timeseries import series_places

LEVEL_STEP = 4


def bin_level(length: Column, bin_width: float) -> Column:
    """The least level whose bins, LEVEL_STEP ** level * bin_width wide, are as wide as ``length``."""
    return F.greatest(F.ceil(F.log(float(LEVEL_STEP), length / F.lit(float(bin_width)))), F.lit(0).cast("long")).cast("int")


def _binned(points: DataFrame, intervals: DataFrame, t: str, onset: str, offset: str, bin_width: float, keys: Sequence[str], how: str) -> DataFrame:
    """Points, once for each level, with the intervals that hold them; a left join gives a row without an interval for each level that has none.

    Both sides are shuffled and sorted: the planner doesn't see how many rows an array or a sequence in the caller's plan makes of one, and
    would broadcast intervals that no driver holds.
    """
    spans = intervals.where(F.col(onset) <= F.col(offset)).withColumn("_level2", F.coalesce(bin_level(F.col(offset) - F.col(onset), bin_width), F.lit(0)))
    levels = sorted(r[0] for r in spans.select("_level2").distinct().collect()) or [0]  # as many as there are orders of magnitude
    width = F.lit(float(bin_width)) * F.pow(F.lit(float(LEVEL_STEP)), F.col("_level2"))
    first, last = (F.floor(F.col(c) / width) for c in (onset, offset))
    b = spans.withColumn("_bin2", F.explode(F.sequence(first, last))).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    own = F.lit(float(bin_width)) * F.pow(F.lit(float(LEVEL_STEP)), F.col("_level"))
    a = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", F.floor(F.col(t) / own))
    on = (F.col("_level") == F.col("_level2")) & (F.col("_bin") == F.col("_bin2")) & F.col(t).between(F.col(onset), F.col(offset))
    for k in keys:
        on &= F.col(k) == F.col(f"_r_{k}")
    return a.join(b.hint("merge"), on, how).drop("_level", "_bin", *(f"_r_{k}" for k in keys))


def range_join(points: DataFrame, intervals: DataFrame, t: str, onset: str, offset: str, bin_width: float, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs with onset <= t <= offset and equal keys; ``left`` keeps points without an interval. ``bin_width`` is that of the narrowest bins: about the length of short intervals."""
    if how == "inner":
        return _binned(points, intervals, t, onset, offset, bin_width, keys, how).drop("_level2", "_bin2")
    if how != "left":
        raise ValueError(f"inner or left, not {how}")
    found = _binned(points.withColumn("_row", F.monotonically_increasing_id()), intervals, t, onset, offset, bin_width, keys, how)
    w = Window.partitionBy("_row")
    hits, nth = F.count("_level2").over(w), F.row_number().over(w.orderBy(F.col("_level2").desc_nulls_last()))
    kept = found.withColumn("_hits", hits).withColumn("_nth", nth).where(F.col("_level2").isNotNull() | ((F.col("_hits") == 0) & (F.col("_nth") == 1)))
    return kept.drop("_level2", "_bin2", "_row", "_hits", "_nth")


def containment_join(phones: DataFrame, words: DataFrame, bin_width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Each phone with the first word (by idx) that holds it; a phone without a word is an error.

    ``phones`` and ``words``: keys, idx, text, onset, offset. Words with empty text count for nothing, in the index too.
    """
    p = phones.where("text <> ''").select(*keys, F.col("idx").alias("_p"), F.col("text").alias("phoneme"), F.col("onset").alias("phoneme_absolute_onset"), F.col("offset").alias("phoneme_absolute_offset"))
    w = series_places(words.where("text <> ''"), keys, ["idx"], "word_index")
    w = w.select(*keys, F.col("text").alias("word"), F.col("onset").alias("word_absolute_onset"), F.col("offset").alias("word_absolute_offset"), F.col("word_index").cast("int").alias("word_index"))
    # the phone's onset lies in the word: one bin, then the offset is checked; phones without a word stay, so that they are not joined again
    near = _binned(p, w, "phoneme_absolute_onset", "word_absolute_onset", "word_absolute_offset", bin_width, keys, "left")
    names = ["word", "word_absolute_onset", "word_absolute_offset", "word_index"]
    holds = F.col("phoneme_absolute_offset") <= F.col("word_absolute_offset")
    own = ["phoneme", "phoneme_absolute_onset", "phoneme_absolute_offset"]
    held = F.min_by(F.when(holds, F.struct(*names)), F.when(holds, F.col("word_index"))).alias("_w")
    out = near.groupBy(*keys, "_p").agg(*(F.first(c).alias(c) for c in own), held)
    found = F.when(F.col("_w").isNull(), F.raise_error(F.concat(F.lit("no word holds phone "), F.col("phoneme"))).cast(out.schema["_w"].dataType)).otherwise(F.col("_w"))
    out = out.withColumn("_w", found)
    begin = F.col("_w.word_absolute_onset")
    return out.select(*keys, "phoneme", "phoneme_absolute_onset", "phoneme_absolute_offset", *(F.col(f"_w.{n}").alias(n) for n in names), (F.col("phoneme_absolute_onset") - begin).alias("phoneme_relative_onset"), (F.col("phoneme_absolute_offset") - begin).alias("phoneme_relative_offset"))


def grid(spark: SparkSession, n: int, sr: float = 100) -> DataFrame:
    """t_idx 0..n-1 and t = t_idx / sr."""
    return spark.range(n).select(F.col("id").alias("t_idx"), (F.col("id") / F.lit(float(sr))).alias("t"))


def time_length(intervals: DataFrame, offset: str = "offset", sr: float = 100) -> int:
    """Samples up to the last offset, which itself is cut."""
    return int((intervals.agg(F.max(F.floor(F.col(offset) * F.lit(float(sr))))).first()[0]) or 0)


def samples_of(intervals: DataFrame, onset: str, offset: str, n: int, sr: float) -> Column:
    """The samples k < n with onset <= k/sr <= offset, computed from the bounds: the grid itself is not joined.

    Rounding of the product is made good by trying one sample more on each side and checking the division.
    """
    rate = F.lit(float(sr))
    low = F.greatest(F.floor(F.col(onset) * rate) - 1, F.lit(0).cast("long"))
    high = F.least(F.floor(F.col(offset) * rate) + 1, F.lit(n - 1).cast("long"))
    near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.filter(near, lambda k: (k / rate >= F.col(onset)) & (k / rate <= F.col(offset)))


def onehot_long(intervals: DataFrame, n: int, sr: float = 100, onset_feature: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """keys, t_idx, label: one row for each sample that an interval of the label covers (its first one alone with ``onset_feature``).

    With ``onset_feature`` an interval between two samples marks the next one; past the end that is an error.
    """
    inside = samples_of(intervals, "onset", "offset", n, sr)
    if onset_feature:
        rate = F.lit(float(sr))
        near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.ceil(F.col("onset") * rate) + k)
        after = F.array_min(F.filter(near, lambda k: (k / rate >= F.col("onset")) & (k >= 0)))
        first = F.coalesce(F.array_min(inside), after)
        checked = F.when(first < n, first).otherwise(F.raise_error(F.lit("an onset lies past the end")).cast("long"))
        return intervals.select(*keys, checked.alias("t_idx"), "label").distinct()
    return intervals.select(*keys, F.explode(inside).alias("t_idx"), "label").distinct()


def onehot_wide(intervals: DataFrame, labels: Sequence[str], n: int, sr: float = 100, onset_feature: bool = False) -> DataFrame:
    """t_idx and one 0/1 column for each label, for all samples; other labels are ignored."""
    spark = intervals.sparkSession
    marked = onehot_long(intervals.where(F.col("label").isin(list(labels))), n, sr, onset_feature)
    wide = marked.groupBy("t_idx").pivot("label", list(labels)).agg(F.max(F.lit(1)))
    return grid(spark, n, sr).select("t_idx").join(wide, "t_idx", "left").fillna(0, list(labels))


def sorted_labels(intervals: DataFrame) -> list[str]:
    """The distinct labels: the columns of a wide table, so few."""
    return [r[0] for r in intervals.select("label").distinct().orderBy("label").collect()]


def last_writer(intervals: DataFrame, value: str, order: str, n: int, sr: float, zero: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Every sample with the value of the last interval (by ``order``) that covers it, or ``zero``."""
    spark = intervals.sparkSession
    covered = intervals.select(*keys, F.explode(samples_of(intervals, "onset", "offset", n, sr)).alias("t_idx"), order, value)
    last = covered.groupBy(*keys, "t_idx").agg(F.max_by(value, order).alias(value))
    every = grid(spark, n, sr).select("t_idx")
    if keys:
        every = intervals.select(*keys).distinct().withColumn("t_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return every.join(last, [*keys, "t_idx"], "left").withColumn(value, F.coalesce(value, zero))


def onset_raster(onsets: DataFrame, n: int, sr: float = 100, onset: str = "onset") -> DataFrame:
    """t_idx, value: 1 on samples within [onset, onset + 1/sr]: two where an onset lies on the grid."""
    spans = onsets.select(F.col(onset).alias("onset"), (F.col(onset) + 1 / F.lit(float(sr))).alias("offset"))
    marked = spans.select(F.explode(samples_of(spans, "onset", "offset", n, sr)).alias("t_idx")).distinct().withColumn("value", F.lit(1))
    return grid(onsets.sparkSession, n, sr).select("t_idx").join(marked, "t_idx", "left").fillna(0, ["value"])
