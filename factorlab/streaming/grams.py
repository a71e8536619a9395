"""Running Gram statistics of a stream of samples. An extension of ours: batches add up, as the statistics are sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.algebra import gram


class RunningGram:
    """YA', AA' and the squared norm of the samples (y, a) seen so far; model-sized, on the driver."""

    def __init__(self) -> None:
        self.seen: dict[int, tuple[dict, dict, float]] = {}

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Takes a micro-batch in; an epoch that comes again replaces what it gave before."""
        square = F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v)
        pick = lambda left, right: {(r["i"], r["j"]): r["value"] for r in gram(batch, left, right).collect()}
        self.seen[epoch] = pick("y", "a"), pick("a", "a"), batch.agg(F.sum(square)).first()[0] or 0.0

    def _total(self, k: int) -> np.ndarray:
        cells: dict = {}
        for parts in self.seen.values():
            for at, v in parts[k].items():
                cells[at] = cells.get(at, 0.0) + v
        out = np.zeros(tuple(max(x) + 1 for x in zip(*cells, strict=True))) if cells else np.zeros((0, 0))
        for at, v in cells.items():
            out[at] = v
        return out

    @property
    def s_ya(self) -> np.ndarray:
        return self._total(0)

    @property
    def s_aa(self) -> np.ndarray:
        return self._total(1)

    @property
    def yy(self) -> float:
        return sum(parts[2] for parts in self.seen.values())

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a query that adds every micro-batch of a stream of (y ARRAY<DOUBLE>, a ARRAY<DOUBLE>)."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_cells(stream: DataFrame, time: str, row: str, value: str | None = None, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(row, window, value) of a stream: sums (or counts) per feature and tumbling window, with a watermark for late data."""
    measure = F.sum(value).cast("double") if value else F.count("*").cast("double")
    return stream.withWatermark(time, late).groupBy(F.col(row).alias("row"), F.window(time, width).alias("window")).agg(measure.alias("value"))
