"""Digests and drift of a stream, one window after the other.

Every task digests its rows of a micro-batch by window and column first, so what is shuffled to a window's state is one t-digest a
task and window, however many rows a window has. The state of a (window, column) is its digest so far; when the watermark passes
the window's end, a timer gives out the digest with its largest relative difference of quantiles from a reference, and
clears the state. Rows later than that are dropped. State and timers are in the query's checkpoint, so a restarted query
goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkprep.errors import InvalidConfig
from sparkprep.profile.sketches import compress, severity_of, steps

_STATE = "means array<double>, weights array<double>, low double, high double, n long"
_PART = f"start_ms long, column string, {_STATE}"
OUT = f"start timestamp, column string, {_STATE}, statistic double, severity string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def digest_quantiles(means: np.ndarray, weights: np.ndarray, low: float, high: float, at: Sequence[float]) -> np.ndarray:
    """Interpolated between the middles of centroids."""
    place = np.concatenate([[0.0], np.cumsum(weights) - weights / 2, [weights.sum()]]) / weights.sum()
    return np.interp(at, place, np.concatenate([[low], means, [high]]))


def relative_difference(reference: np.ndarray, current: np.ndarray) -> float:
    """The largest of the quantiles' differences, relative to the reference; 1 where only that is zero."""
    zero = np.abs(reference) <= np.finfo(float).eps
    return float(np.max(np.where(zero, np.abs(current) > np.finfo(float).eps, np.abs(current - reference) / np.where(zero, 1, np.abs(reference))), initial=0.0))


class WindowDigests(StatefulProcessor):
    def __init__(self, width_ms: int, reference: dict[str, np.ndarray], at: list[float], threshold: float, compression: float):
        self.width, self.reference, self.at, self.threshold, self.compression = width_ms, reference, at, threshold, compression

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.digest = handle, handle.getValueState("digest", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[0]) + self.width
        if end <= timerValues.getCurrentWatermarkInMs():
            return iter(())  # the window has been given out
        held = list(self.digest.get() or ()) if self.digest.exists() else []
        if not held:
            self.handle.registerTimer(end)
        parts = [held] if held else []
        for frame in rows:
            parts += [[r.means, r.weights, r.low, r.high, r.n] for r in frame.itertuples(index=False)]
        means, weights = compress(np.concatenate([np.asarray(p[0], float) for p in parts]), np.concatenate([np.asarray(p[1], float) for p in parts]), self.compression)
        self.digest.update((means.tolist(), weights.tolist(), float(min(p[2] for p in parts)), float(max(p[3] for p in parts)), int(sum(p[4] for p in parts))))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        means, weights, low, high, n = self.digest.get()
        self.digest.clear()
        reference = self.reference.get(key[1])
        statistic = None if reference is None else relative_difference(reference, digest_quantiles(np.asarray(means), np.asarray(weights), low, high, self.at))
        severity = None if statistic is None else severity_of(statistic, self.threshold)
        yield pd.DataFrame({"start": [pd.Timestamp(int(key[0]), unit="ms")], "column": [key[1]], "means": [list(means)], "weights": [list(weights)], "low": [low], "high": [high], "n": [n], "statistic": [statistic], "severity": [severity]})


def windowed_drift(stream: DataFrame, time: str, columns: Sequence[str], width_ms: int, reference: DataFrame | None = None, late: str = "1 hour", threshold: float = 0.1, compression: float = 100.0) -> DataFrame:
    """A row per closed window and column: its t-digest, and the drift from a reference, quantiles (column, q, value) of an earlier table.

    Nulls and values that aren't finite are left out, and so are rows without a time. The session's state store becomes RocksDB, which timers
    need."""
    if width_ms < 1 or not columns:
        raise InvalidConfig("a width of a millisecond at least, and one column")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    known = {}
    for r in reference.collect() if reference is not None else ():  # some quantiles a column
        known.setdefault(r["column"], {})[r["q"]] = r["value"]
    at = sorted(next(iter(known.values()))) if known else steps()
    quantiles = {c: np.array([x[q] for q in at]) for c, x in known.items()}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    start = F.floor(F.unix_millis(time) / F.lit(width_ms)).cast("long") * F.lit(width_ms)
    rows = stream.select(F.col(time).cast("timestamp").alias(time), *(c for c in columns if c != time)).withWatermark(time, late).select(start.alias("start_ms"), F.explode(cells).alias("c")).select("start_ms", "c.column", "c.value")
    rows = rows.filter(F.col("start_ms").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for key, x in batch.groupby(["start_ms", "column"])["value"]:
                v = x.to_numpy(float)
                old = held.get(key, [np.zeros(0), np.zeros(0), np.inf, -np.inf, 0])
                means, weights = compress(np.concatenate([old[0], v]), np.concatenate([old[1], np.ones(len(v))]), compression)
                held[key] = [means, weights, min(old[2], v.min()), max(old[3], v.max()), old[4] + len(v)]
        if held:
            yield pd.DataFrame([(*k, m.tolist(), w.tolist(), a, b, n) for k, (m, w, a, b, n) in held.items()], columns=["start_ms", "column", "means", "weights", "low", "high", "n"])

    digests = rows.mapInPandas(local, _PART).groupBy("start_ms", "column")
    return digests.transformWithStateInPandas(WindowDigests(width_ms, quantiles, at, threshold, compression), OUT, outputMode="append", timeMode="EventTime")
