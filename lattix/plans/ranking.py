"""Places of rows in an order, over all rows or within groups, without a task that holds all rows or a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

#: Rows that a range holds, about; there are at most MOST_RANGES ranges, whose least keys are kept as literals.
RANGE_ROWS = 1 << 20
MOST_RANGES = 1 << 13
#: Sampled keys for each range.
SAMPLES = 32


def splitters(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> list[tuple]:
    """The least keys of all ranges but the first, ascending and distinct: quantiles of a sample, taken once. SAMPLES keys a range reach the driver, at most."""
    keys = df.select(*order)
    total = keys.count()
    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    ranges = min(ranges, MOST_RANGES)
    if total < 2 or ranges < 2:
        return []
    some = keys if total <= SAMPLES * ranges else keys.sample(SAMPLES * ranges / total, 7).limit(2 * SAMPLES * ranges)
    ordered = [tuple(r) for r in some.orderBy(*order).collect()]
    marks = [ordered[k * len(ordered) // ranges] for k in range(1, ranges)] if ordered else []
    return [m for k, m in enumerate(marks) if k == 0 or m != marks[k - 1]]


def range_of(df: DataFrame, order: Sequence[str], marks: Sequence[tuple]) -> Column:
    """The number of marks up to a row's key, by a binary search over literals: the same for every plan that asks. Nulls come first and NaN last, as in a sort."""
    if not marks:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in order]
    table = F.array(*(F.struct(*(F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(m, kinds, strict=True)))) for m in marks))
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    steps = F.array(*(F.lit(1 << b) for b in range(len(marks).bit_length() - 1, -1, -1)))

    def search(key: Column) -> Column:
        def move(at: Column, step: Column) -> Column:
            return F.when((at + step <= len(marks)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), move)

    return F.get(F.transform(F.array(key), search), F.lit(0))  # a variable, so that the key is made once a row and not once a step


def with_group_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, size: str | None = None, ranges: int | None = None) -> DataFrame:
    """0-based places of rows within their group (all rows, without keys) in an order, and with ``size`` the group's number of rows.

    Rows are dealt by ranges of (keys, order) whose bounds are literals, numbered in their range, and moved up by what earlier ranges hold of
    the group. Only groups that lie in several ranges need that; a range begins and ends with one of these at most, so what is broadcast
    has two rows a range. ``df`` is read three times and must give the same rows each time; where keys and order do not tell rows apart,
    their places are some order of them.
    """
    cols = [*keys, *order]
    ranged = df.withColumn("_part", range_of(df, cols, splitters(df, cols, ranges)))
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spread = counts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(whole).alias("_all"), "_n")
    spread = spread.where("_all > _n").drop("_n")
    here = Window.partitionBy("_part", *keys)
    made = ranged.withColumn("_at", F.row_number().over(here.orderBy(*order)) - 1)
    if size:
        made = made.withColumn("_here", F.count("*").over(here))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    made = made.join(F.broadcast(spread), on, "left").withColumn(out, (F.col("_at") + F.coalesce("_ahead", F.lit(0))).cast("long"))
    if size:
        made = made.withColumn(size, F.coalesce("_all", "_here").cast("long"))
    return made.select(*df.columns, out, *([size] if size else []))


def with_global_index(df: DataFrame, order: Sequence[str], out: str, ranges: int | None = None) -> DataFrame:
    """0-based places in the order of all rows."""
    return with_group_index(df, [], order, out, ranges=ranges)
