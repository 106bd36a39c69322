"""Streaming forms of the lag and island operators, with bounded state per series.

Rows of a series must come in order between micro-batches; inside one they are sorted. A row whose order value is not after the last
one seen is late and left out, so results do not depend on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_lags(df: DataFrame, key: str, order: str, value: str, lag_num: int) -> DataFrame:
    """key, order, lags: the value and its lag_num - 1 predecessors, zeros before the start. State: lag_num - 1 values and the last order value."""
    kind, at = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, past = state.get if state.exists else (None, [0.0] * (lag_num - 1))
        past, rows = list(past), []
        for t, x in pd.concat(list(batches)).sort_values(order)[[order, value]].itertuples(index=False, name=None):
            if last is not None and float(t) <= last:
                continue
            last = float(t)
            rows.append((k[0], t, [float(x), *past]))
            past = [float(x), *past][: lag_num - 1]
        state.update((last, past))
        yield pd.DataFrame(rows, columns=[key, order, "lags"])

    return df.select(key, order, value).groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, `{order}` {at}, lags array<double>", "last double, past array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_islands(df: DataFrame, key: str, t_idx: str, label: str, sr: float = 100) -> DataFrame:
    """key, label, onset, offset of each run of one label over consecutive samples, once the run has ended."""
    kind = df.schema[key].dataType.simpleString()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, first, last = state.get if state.exists else (None, -1, -1)
        rows = []
        for t, x in pd.concat(list(batches)).sort_values(t_idx)[[t_idx, label]].itertuples(index=False, name=None):
            if first >= 0 and t <= last:
                continue
            if first < 0 or x != name or t != last + 1:
                if first >= 0 and name is not None:
                    rows.append((k[0], name, first / sr, last / sr))
                name, first = x, int(t)
            last = int(t)
        state.update((name, first, last))
        yield pd.DataFrame(rows, columns=[key, label, "onset", "offset"])

    return df.select(key, t_idx, label).groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, `{label}` string, onset double, offset double", "name string, first long, last long", "append", GroupStateTimeout.NoTimeout)
