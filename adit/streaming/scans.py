"""Streams: scans that move, and running trial metrics."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from adit.operators.sweep import trial_metrics


def moving(scans: DataFrame, speed: float) -> DataFrame:
    """Of a stream (run_id, t, x, y, z) the scans whose speed from the one seen before reaches ``speed``.

    The state of a run is its last scan, also where that was left out. Scans of
    a batch are taken in order of t; one that is older than the state is late and goes.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("t")
        last = state.get if state.exists else None
        out = []
        for row in f.itertuples(index=False):
            now = (row.t, row.x, row.y, row.z)
            if last is not None and row.t < last[0]:
                continue
            if last is None or row.t - last[0] <= 1e-6 or np.linalg.norm(np.subtract(now[1:], last[1:])) / (row.t - last[0]) >= speed:
                out.append((key[0], *now))
            last = now
        if last is not None:
            state.update(tuple(map(float, last)))
        yield pd.DataFrame(out, columns=["run_id", "t", "x", "y", "z"])

    kind = scans.schema["run_id"].dataType.simpleString()
    return scans.groupBy("run_id").applyInPandasWithState(step, f"run_id {kind}, t double, x double, y double, z double", "t double, x double, y double, z double", "append", "NoTimeout")


def running_metrics(reps: DataFrame, penalty: float = 100.0) -> DataFrame:
    """Trial metrics of a stream of repetitions, for update or complete mode."""
    return trial_metrics(reps, penalty)
