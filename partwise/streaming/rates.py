"""A sliding-window rate limiter over a stream, and a stateless stream split."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limited(events: DataFrame, key: str, time: str, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """key, time, allowed: at most `most` allowed events in any half-open window; refused ones don't count. The state of a
    key is its last `most` times at most, and ends with the window."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for batch in batches:
            batch = batch.sort_values(time)
            allowed = []
            for t in batch[time].map(pd.Timestamp.timestamp):
                recent = [x for x in recent if t - x < seconds]
                allowed.append(len(recent) < most)
                recent += [t] * allowed[-1]
            yield pd.DataFrame({key: k[0], time: batch[time], "allowed": allowed})
        state.update((recent,))
        state.setTimeoutDuration(int(seconds * 1000))

    return events.select(key, time).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, {time} timestamp, allowed boolean", "recent array<double>", "append", "ProcessingTimeTimeout"
    )


def stream_split(rows: DataFrame, key: str, names: Sequence[str], ratios: Sequence[int], seed: int = 42) -> DataFrame:
    """rows with split by a hash of the key alone: stateless, equal in batch and stream; shares hold on average."""
    total, u = float(sum(ratios)), F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, run = None, 0.0
    for name, r in zip(names[:-1], ratios[:-1], strict=True):
        run += r / total
        out = F.when(u < run, name) if out is None else out.when(u < run, name)
    return rows.withColumn("split", out.otherwise(names[-1]))
