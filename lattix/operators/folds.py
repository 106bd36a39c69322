"""Fold labels: near-equal contiguous parts, stratified parts, and leave-one-group-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.ranking import with_group_index


def _equal_parts(i: Column, n: Column, parts: int) -> Column:
    """The part of place i among n rows in ``parts`` near-equal parts."""
    small, extra = F.floor(n / parts), n % parts
    edge = extra * (small + 1)
    return F.when(i < edge, F.floor(i / (small + 1)) + 1).otherwise(extra + F.floor((i - edge) / F.greatest(small, F.lit(1))) + 1).cast("int")


def subdivide(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = (), out: str = "fold") -> DataFrame:
    """1-based labels of n contiguous parts in order; the first parts take the remainder.

    With keys each group is divided on its own. Places come from ranges, so that no task sees all rows or a large group.
    """
    return with_group_index(df, keys, order, "_i", "_n").withColumn(out, _equal_parts(F.col("_i"), F.col("_n"), n)).drop("_i", "_n")


def shuffled(row_id: str, seed: int) -> Column:
    """An order that depends on the row and the seed alone."""
    return F.xxhash64(F.col(row_id), F.lit(seed))


def partition_within_labels(df: DataFrame, label: str | Sequence[str], row_id: str, fractions: int | Sequence[float], seed: int | None = None, shuffle: bool = False, out: str = "fold") -> DataFrame:
    """Stratified 1-based parts: per label floor(count * fraction) rows each, the remainder dealt one by one from the first part.

    Several columns make one label. A whole number k means k equal parts. Fractions may sum to less than 1 (the rest is dealt round) or more (the last parts are cut short).
    """
    rows, order = df, [row_id]
    if shuffle:
        rows, order = df.withColumn("_o", shuffled(row_id, seed or 0)), ["_o", row_id]
    rows = with_group_index(rows, [label] if isinstance(label, str) else label, order, "_i", "_n")
    i, n = F.col("_i"), F.col("_n")
    if isinstance(fractions, int):
        return rows.withColumn(out, _equal_parts(i, n, fractions)).select(*df.columns, out)
    k = len(fractions)
    floors = [F.floor(n * F.lit(float(f))).cast("long") for f in fractions]
    rest = F.greatest(n - sum(floors[1:], floors[0]), F.lit(0).cast("long"))
    ends, total = [], F.lit(0).cast("long")
    for j, size in enumerate(floors):
        total = total + size + F.floor(rest / k).cast("long") + (rest % k > j).cast("long")
        ends.append(total)
    label_of = F.lit(k)
    for j in range(k - 2, -1, -1):
        label_of = F.when(i < ends[j], F.lit(j + 1)).otherwise(label_of)
    return rows.withColumn(out, label_of.cast("int")).select(*df.columns, out)


#: Folds up to which their list is sent to every task.
MOST_FOLDS = 100_000


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """Every row for every fold (a group's value), with is_test: rows times folds, as asked for. Models use per-group factors instead. Over MOST_FOLDS groups are refused."""
    folds = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(MOST_FOLDS + 1).collect()]
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"over {MOST_FOLDS} groups are too many folds for every row")
    table = df.sparkSession.createDataFrame([(sorted(folds),)], T.StructType([T.StructField("_f", T.ArrayType(df.schema[group].dataType))]))
    return df.join(F.broadcast(table)).withColumn("fold", F.explode("_f")).drop("_f").withColumn("is_test", F.col(group) == F.col("fold"))  # one row of a checked size


def folds_from_lists(df: DataFrame, tests: DataFrame, row_id: str, folds: int) -> DataFrame:
    """Every row for every fold 0..folds-1, with is_test where ``tests`` (row_id, fold) lists it. A row may be listed in several folds or in none. One join on the row, whatever the number of folds."""
    listed = tests.groupBy(row_id).agg(F.collect_set("fold").alias("_f"))
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return df.join(listed, row_id, "left").withColumn("fold", every).withColumn("is_test", F.coalesce(F.array_contains("_f", F.col("fold")), F.lit(False))).drop("_f")
