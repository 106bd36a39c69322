"""Statistics per target, and the sums per group from which linear models follow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def correlation(x: str, y: str) -> Column:
    """Pearson r within [-1, 1]; NaN where a side is constant (Spark's own division would be an error there)."""
    flat = (F.var_pop(x) == 0) | (F.var_pop(y) == 0) | (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) == 0)
    cov = F.covar_pop(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = cov / F.when(flat, F.lit(1.0)).otherwise(spread)
    return F.when(flat, F.lit(float("nan"))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlate_columns(df: DataFrame, target: str, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, target).agg(correlation(x, y).alias("r"))


def scores(df: DataFrame, target: str, truth: str = "y", prediction: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """mse, r2 and r of a group. r2 pools the squared errors and the squares around each target's own mean over all targets; r flattens all targets into one."""
    y, p, n = F.col(truth), F.col(prediction), F.count("*").cast("double")
    per = df.where(y.isNotNull() & p.isNotNull()).groupBy(*keys, target).agg(
        n.alias("n"), F.sum((p - y) ** 2).alias("e"), F.avg(y).alias("my"), F.avg(p).alias("mp"),
        (F.var_pop(y) * n).alias("yy"), (F.var_pop(p) * n).alias("pp"), (F.covar_pop(y, p) * n).alias("yp"),
    )
    total = F.sum("n")

    def around(within: str, a: str, b: str) -> Column:
        """The products around the means of all targets together: those within targets, and those of the targets' means."""
        return F.sum(within) + F.sum(F.col("n") * F.col(a) * F.col(b)) - F.sum(F.col("n") * F.col(a)) * F.sum(F.col("n") * F.col(b)) / total

    sums = per.groupBy(*keys).agg((F.sum("e") / total).alias("mse"), (1 - F.try_divide(F.sum("e"), F.sum("yy"))).alias("r2"), around("yy", "my", "my").alias("_a"), around("pp", "mp", "mp").alias("_b"), around("yp", "my", "mp").alias("_c"))
    flat = (F.col("_a") <= 0) | (F.col("_b") <= 0)
    r = F.when(flat, F.lit(float("nan"))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c") / F.sqrt(F.when(flat, F.lit(1.0)).otherwise(F.col("_a") * F.col("_b"))))))
    return sums.select(*keys, "mse", "r2", r.alias("r"))


def mse_per_target(df: DataFrame, target: str, truth: str = "y", prediction: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, target).agg(F.avg((F.col(prediction) - F.col(truth)) ** 2).alias("mse"))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, norm): the population standard deviation, 1 where it is 0."""
    one = df.agg(*(F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("s")).alias(c) for c in columns))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.mean").alias("mean"), F.when(F.col(f"{c}.s") == 0, 1.0).otherwise(F.col(f"{c}.s")).alias("norm")) for c in columns))).alias("x"))
    return long.select("x.*")


def standardise(df: DataFrame, columns: Sequence[str], demean: bool = True, scale: bool = True) -> DataFrame:
    """Columns less their mean, over their population standard deviation. The statistics are one row."""
    one = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    rows = df.join(F.broadcast(one))
    def made(c: str) -> Column:
        x = F.col(c) - F.col(f"_m_{c}") if demean else F.col(c)
        return (x / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) if scale else x).alias(c)

    return rows.select(*(F.col(c) for c in df.columns if c not in columns), *(made(c) for c in columns))


def zscore_cells(df: DataFrame, column: str) -> DataFrame:
    """Array cells of numbers less the mean of all numbers, over their sample standard deviation (1 where that is 0). The statistics are one row."""
    one = df.select(F.explode(column).alias("v")).agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    spread = F.when(F.coalesce("_s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))
    return df.join(F.broadcast(one)).withColumn(column, F.transform(column, lambda v: (v - F.col("_m")) / spread)).select(*df.columns)


def balance_groups(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Each group of feature columns scaled to the same Frobenius norm, the whole one over the root of the number of groups; an all-zero group stays."""
    norms = df.agg(*(F.sqrt(F.sum(reduce(lambda a, b: a + b, (F.col(c) * F.col(c) for c in cols)))).alias(g) for g, cols in groups.items()))
    share = F.sqrt(reduce(lambda a, b: a + b, (F.col(g) * F.col(g) for g in groups)) / len(groups))
    sizes = norms.select(*(F.when(F.col(g) == 0, 1.0).otherwise(F.col(g) / share).alias(f"_g_{g}") for g in groups))
    home = {c: g for g, cols in groups.items() for c in cols}
    rows = df.join(F.broadcast(sizes))  # one row
    return rows.select(*((F.col(c) / F.col(f"_g_{home[c]}")).alias(c) if c in home else F.col(c) for c in df.columns))


def usable_targets(df: DataFrame, target: str, y: str) -> DataFrame:
    """(target, usable): false where a value is NaN or null, or all are equal."""
    bad = F.max(F.isnan(y) | F.col(y).isNull())
    return df.groupBy(target).agg((~bad & (F.stddev_pop(F.when(~F.isnan(y), F.col(y))) != 0)).alias("usable"))


def error_moments(errors: DataFrame, row: str, target: str, model: str, error: str = "e") -> DataFrame:
    """(target, i, j, p): the mean over rows of e_i * e_j for all models i, j. One grouping by row and target, no self join."""
    cell = errors.groupBy(row, target).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(error).alias("e")))).alias("_es"))
    pairs = cell.select(target, F.explode("_es").alias("a"), "_es").select(target, "a", F.explode("_es").alias("b"))
    return pairs.groupBy(target, F.col("a.m").alias("i"), F.col("b.m").alias("j")).agg(F.avg(F.col("a.e") * F.col("b.e")).alias("p"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def global_range(df: DataFrame, column: str) -> DataFrame:
    """low and high over all array cells."""
    return df.agg(F.min(F.array_min(column)).alias("low"), F.max(F.array_max(column)).alias("high"))


def char_error_rate(df: DataFrame, truth: str, heard: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.levenshtein(heard, truth)).alias("edits"), F.sum(F.char_length(truth)).alias("chars")).withColumn("cer", F.try_divide("edits", "chars"))


def word_distance(truth: str, heard: str) -> int:
    """Edit distance of two word sequences. A row of the distance table follows from the one before in whole: an insertion is a running minimum once each cell's place is taken off."""
    a, b = ([w for w in x.split(" ") if w] for x in (truth, heard))
    known = {w: k for k, w in enumerate({*a, *b})}
    codes, places = np.array([known[w] for w in b], np.int64), np.arange(len(b) + 1)
    row = places.copy()
    for i, w in enumerate(a):
        made = np.minimum(row[1:] + 1, row[:-1] + (codes != known[w]))
        row = np.minimum.accumulate(np.concatenate([[i + 1], made]) - places) + places
    return int(row[-1])


def word_errors(truth: Column, heard: Column) -> Column:
    """``word_distance`` of two columns of words between blanks; null where either is null."""

    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else word_distance(a, b) for a, b in zip(x, y, strict=True)], dtype="Int64")

    return F.pandas_udf(work, "long")(truth, heard)


def word_error_rate(df: DataFrame, truth: str, heard: str, keys: Sequence[str] = ()) -> DataFrame:
    n = F.size(F.filter(F.split(F.trim(truth), " +"), lambda w: w != ""))
    return df.groupBy(*keys).agg(F.sum(word_errors(F.col(truth), F.col(heard))).alias("edits"), F.sum(n).alias("words")).withColumn("wer", F.try_divide("edits", "words"))


def scores_of_usable(df: DataFrame, target: str, truth: str = "y", prediction: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, target, r): targets that hold a NaN or null, or are constant, over all keys score 0."""
    good = usable_targets(df, target, truth)
    r = correlate_columns(df.where(~F.isnan(truth)), target, truth, prediction, keys)
    rows = df.select(*keys, target).distinct().join(good, target)
    scored = rows.join(r, [*keys, target], "left")
    return scored.select(*keys, target, F.when(F.col("usable") & ~F.isnan("r"), F.col("r")).otherwise(0.0).alias("r"))
