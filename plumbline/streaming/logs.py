"""Stateful stream versions of the change log and the ratchet; one value of state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_log(stream: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """Rows whose ``key`` differs from the one before in their part; in a micro-batch rows are taken in ``order``.

    The state of a part is its last key.
    """
    columns = [part, order, key]
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in columns)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        last = state.get[0] if state.exists else None
        before = rows[key].shift(1)
        changed = rows[key].ne(before) & ~(rows[key].isna() & before.isna())
        first = rows[key].iloc[0]
        changed.iloc[0] = not state.exists or not (first == last or (pd.isna(first) and pd.isna(last)))
        state.update((None if pd.isna(rows[key].iloc[-1]) else rows[key].iloc[-1],))
        yield rows.loc[changed, columns]

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(*columns).groupBy(part).applyInPandasWithState(step, kinds, f"last {kind}", "append", GroupStateTimeout.NoTimeout)


def running_ratchet(stream: DataFrame, key: str, metric: str, allowed: float = 0.0) -> DataFrame:
    """key, metric, best of values above the lowest one seen before by more than ``allowed``; the state is the lowest."""
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, out = (state.get[0] if state.exists else None), []
        for pdf in batches:
            for value in pdf[metric].astype(float):
                if best is not None and value > best + allowed:
                    out.append((group[0], value, best))
                best = value if best is None else min(best, value)
        state.update((best,))
        yield pd.DataFrame(out, columns=[key, metric, "best"])

    return stream.select(key, metric).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {metric} double, best double", "low double", "append", GroupStateTimeout.NoTimeout
    )
