"""Windows and gap sessions on streams: watermarks bound the state, late rows beyond them are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per key and event-time window; zone-less times are taken as UTC."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def gap_sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Sessions per key that a gap ends, by Spark's session windows; emitted when the watermark passes their end."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def aberrant_sessions(windows: DataFrame, time: str = "time", late: str = "10 minutes", idle_ms: int = 3_600_000, gap: int = 30_000) -> DataFrame:
    """Runs of aberrant windows per sample and contig from a stream of ``sample, chrom, start, end, change`` and an event time.

    Windows must come in position order per key.  The state of a key is the last window's change and the open run.  A run is emitted
    when a window ``gap`` bases past its end comes, and otherwise by a timer: once the watermark is ``idle_ms`` past the key's last window
    the open run is emitted and the key's state deleted, so neither the last run of a key nor state of finished keys stays behind.
    """
    from ..operators.copynumber import LOWER, UPPER

    def side(change: float | None) -> int:
        return 0 if change is None else 1 if change >= UPPER else -1 if change <= LOWER else 0

    def update(key, frames, state):
        import pandas as pd

        last, start, end, n, seen_ms = state.get if state.exists else (0, -1, -1, 0, 0)
        out = []
        if state.hasTimedOut:
            out, seen = [(*key, start, end, n)] if n else [], False
            state.remove()
        else:
            seen = state.exists
            for pdf in frames:
                for s, e, c, t in pdf.sort_values(["start", "end"])[["start", "end", "change", "_ms"]].itertuples(index=False):
                    now = side(None if pd.isna(c) else c)
                    if n and s - end >= gap:
                        out.append((*key, start, end, n))
                        n = 0
                    if now and (now == last or not seen):
                        start, end, n = (int(s), int(e), 1) if not n else (start, int(e), n + 1)
                    last, seen, seen_ms = now, True, max(seen_ms, int(t))
            state.update((last, start, end, n, seen_ms))
            # fires when the watermark reaches the last window's time and ``idle_ms``
            state.setTimeoutTimestamp(max(seen_ms + idle_ms - 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["sample", "chrom", "start", "end", "n"])

    timed = windows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("_ms", F.unix_millis(time))
    return timed.groupBy("sample", "chrom").applyInPandasWithState(update, "sample string, chrom string, start long, end long, n long", "last int, start long, end long, n long, seen long", "append", "EventTimeTimeout")
