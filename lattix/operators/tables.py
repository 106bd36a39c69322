"""Operators on observation tables: filters, ordered concatenation, replication, and reshaping of nested cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.ranking import with_group_index


def filter_at(df: DataFrame, at: Sequence[Mapping[str, object]]) -> DataFrame:
    """Rows that fit all values of a mapping, for each mapping in turn: a row that fits two shows twice. ``at_idx`` tells which."""
    fits = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in spec.items()), F.lit(True)), F.lit(i)) for i, spec in enumerate(at))))
    return df.withColumn("at_idx", F.explode(fits))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys that stand in several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def usable_rows(df: DataFrame, at: Mapping[str, object], columns: Sequence[str]) -> DataFrame:
    """Rows that fit all values of a mapping (a hemisphere, say) and hold a number, no null or NaN, in each of the columns."""
    fits = [F.col(k) == F.lit(v) for k, v in at.items()]
    numbers = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    return df.where(reduce(lambda a, b: a & b, [*fits, *numbers], F.lit(True)))


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"{list(keys)} do not identify rows")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def levels_differ(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(variable, level, side) for each level of a shared variable that only one side has."""
    def levels(df: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("variable"), F.col(k).cast("string").alias("level")) for k in keys)))
        return df.select(pairs.alias("p")).select("p.*").distinct()

    x, y = levels(a), levels(b)
    on = (F.col("x.variable") == F.col("y.variable")) & F.col("x.level").eqNullSafe(F.col("y.level"))
    only = [l.alias("x").join(r.alias("y"), on, "left_anti").withColumn("side", F.lit(s)) for l, r, s in ((x, y, "left"), (y, x, "right"))]
    return only[0].unionByName(only[1])


def concatenate_by_variables(df: DataFrame, variables: Sequence[str], data: str = "data", fold_mask: bool = False) -> DataFrame:
    """Cells of ``data`` joined end to end, by each variable in turn in its order, over rows that agree in the other columns.

    Nested sorting by one variable after another equals one sort by the last variable, then the one before, and so on. With ``fold_mask`` a
    column ``<variable>_mask`` for the last variable says which level each sample came from. Rows with a null key are left out.
    """
    require_columns(df, [*variables, data])
    ids = [c for c in df.columns if c not in (*variables, data)]
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ids), F.lit(True)))
    order = [*reversed(variables)]
    cells = F.array_sort(F.collect_list(F.struct(*order, data)))
    out = [F.flatten(F.transform(cells, lambda x: x[data])).alias(data)]
    if fold_mask:
        name = order[0]
        out.append(F.flatten(F.transform(cells, lambda x: F.transform(x[data], lambda _: x[name]))).alias(f"{name}_mask"))
    return (rows.groupBy(*ids) if ids else rows.groupBy()).agg(*out)


def concatenate_rows(df: DataFrame, variables: Sequence[str], within: Sequence[str], data: str = "data", out: str = "place") -> DataFrame:
    """What ``concatenate_by_variables`` joins, as rows of one sample each: the other columns, data, the last variable as ``<variable>_mask``, and the 0-based place in the joined series.

    ``within`` orders the samples of a cell. Places come from ranges of all rows, so a group of any size is many tasks. Rows with a null key
    are left out.
    """
    require_columns(df, [*variables, *within, data])
    ids = [c for c in df.columns if c not in (*variables, *within, data)]
    order = [*reversed(variables), *within]
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ids), F.lit(True)))
    return with_group_index(rows, ids, order, out).select(*ids, data, F.col(order[0]).alias(f"{order[0]}_mask"), out)


def place_digest(value: Column, place: Column) -> Column:
    """A sum over rows that tells a series by its values and their places: 60 bits of the MD5 of each place and value. Sums of parts of a series add up to the sum of the whole."""
    text = F.concat_ws(":", place.cast("string"), F.coalesce(value.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    low, middle, high = (F.sum(F.shiftright(bits, k).bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(20,0)") for k in (0, 20, 40))  # sums of longs cost less than sums of decimals
    return ((high * F.lit(1 << 20) + middle) * F.lit(1 << 20) + low).cast("string")


def digest_concatenated(df: DataFrame, variables: Sequence[str], within: Sequence[str], data: str = "data", fold_mask: bool = False) -> DataFrame:
    """A digest of each series that ``concatenate_by_variables`` would make, and with ``fold_mask`` of its mask: sums that each task begins and a shuffle of one row a task and group ends."""
    rows = concatenate_rows(df, variables, within, data)
    ids, name = rows.columns[:-3], rows.columns[-2]
    sums = [place_digest(F.col(data), F.col("place")).alias(data), *([place_digest(F.col(name), F.col("place")).alias(name)] if fold_mask else [])]
    return (rows.groupBy(*ids) if ids else rows.groupBy()).agg(*sums)


def replicate_data_feature(feature_df: DataFrame, data_df: DataFrame, check_levels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features, data) with the same rows: a full outer join on the shared id columns, split again. Levels of shared variables must agree."""
    require_columns(data_df, ["data"])
    require_columns(feature_df, ["feature"])
    require_unique(data_df, [c for c in data_df.columns if c != "data"])
    common = [c for c in data_df.columns if c in feature_df.columns and c not in ("data", "feature")]
    if check_levels and not levels_differ(data_df, feature_df, common).isEmpty():
        raise ValueError("the levels of shared variables differ")
    both = data_df.join(feature_df, common, "full")
    return both.drop("data"), both.drop("feature")


def expand_nested(df: DataFrame, column: str) -> DataFrame:
    """A nested array to one row per number, with 0-based d1_index, d2_index, ...; other columns first, then the value, then the indices."""
    depth, kind = 0, df.schema[column].dataType
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    others = [c for c in df.columns if c != column]
    out, indices = df, []
    for d in range(1, depth + 1):
        out = out.select(*others, *indices, F.posexplode(column).alias(f"d{d}_index", column))
        indices.append(f"d{d}_index")
    return out.select(*others, column, *indices)


def pivot_cell(df: DataFrame, column: str, time_stamp: str | None = None) -> DataFrame:
    """A cell of samples to rows (time_stamp, diff); without times the place stands for it."""
    times = F.col(time_stamp) if time_stamp else F.transform(F.col(column), lambda _, i: i.cast("double"))
    others = [c for c in df.columns if c not in (column, time_stamp)]
    return df.select(*others, F.explode(F.arrays_zip(times.alias("time_stamp"), F.col(column).alias("diff"))).alias("_z")).select(*others, "_z.time_stamp", "_z.diff")


def stack_rows(*frames: DataFrame) -> DataFrame:
    """All rows of all tables, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def to_strf(coefficients: Column, lag_num: int) -> Column:
    """Intercept-first, lag-major coefficients to feature by lag."""
    body = F.slice(coefficients, 2, F.size(coefficients) - 1)
    n = F.floor(F.size(body) / lag_num).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda f: F.transform(F.sequence(F.lit(0), F.lit(lag_num - 1)), lambda lag: F.get(body, lag * n + f)))


def split_strf(df: DataFrame, strf: str, feature_nums: Sequence[int], feature_names: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """Blocks of features as rows: group_by, feature_name, STRF."""
    starts = [sum(feature_nums[:k]) for k in range(len(feature_nums))]
    blocks = df.select(*group_by, *(F.slice(strf, s + 1, n).alias(name) for s, n, name in zip(starts, feature_nums, feature_names, strict=True)))
    return blocks.unpivot(list(group_by), list(feature_names), "feature_name", "STRF")


def mean_arrays(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The elementwise mean of array cells of a group."""
    long = df.select(*keys, F.posexplode(column).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda p: p["_x"]).alias(column))


def normalise_by_max(column: Column) -> Column:
    """An array divided by its largest element; as it is where that is 0."""
    top = F.array_max(column)
    return F.when(top == 0, column).otherwise(F.transform(column, lambda x: x / F.when(top == 0, F.lit(1.0)).otherwise(top)))


def lag_rows(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, lag, TRF, max_lag): an array cell as rows, with the place of its first largest element."""
    top = (F.array_position(column, F.array_max(column)) - 1).cast("int").alias("max_lag")
    return df.select(*keys, top, F.posexplode(column).alias("lag", "TRF")).select(*keys, "lag", "TRF", "max_lag")


def mean_lines(df: DataFrame, x: str, y: str, facets: Sequence[str] = (), hues: Sequence[str] = (), average: bool = True) -> DataFrame:
    """Mean of y per facet, hue and x, and with ``average`` over all hues too (null hues, is_average 1), in one pass."""
    full = [*facets, *hues, x]
    if not average:
        return df.groupBy(*full).agg(F.avg(y).alias(y), F.lit(0).alias("is_average"))
    sets = [[F.col(c) for c in full], [F.col(c) for c in (*facets, x)]]
    if not hues:
        return df.groupBy(*full).agg(F.avg(y).alias(y), F.lit(1).alias("is_average"))
    return df.groupingSets(sets, *full).agg(F.avg(y).alias(y), F.grouping(hues[0]).cast("int").alias("is_average"))
