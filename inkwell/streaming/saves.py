"""Save events to sessions: a run starts once no save came for a while, with all files saved since."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.query import StreamingQuery


def sessions(events: DataFrame, gap_ms: int, by: str = "workspace", at: str = "ts", file: str = "file_path") -> DataFrame:
    """Batch form. A gap above gap_ms starts a session: (by, session, start, end, saves, last_file, files)."""
    order = W.partitionBy(by).orderBy(at, file)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    rows = events.withColumn("session", F.sum(F.when(gap > gap_ms * 1000, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(by, "session").agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("saves"), F.max_by(file, F.struct(at, file)).alias("last_file"), F.array_sort(F.collect_set(file)).alias("files"),
    )


def debounced(events: DataFrame, gap_ms: int, late: str = "10 seconds", by: str = "workspace", at: str = "ts", file: str = "file_path") -> DataFrame:
    """Streaming form: (by, start, fires, files); a session is out once the watermark has passed its end."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    window = F.session_window(at, f"{gap_ms} milliseconds").alias("w")
    out = events.groupBy(by, window).agg(F.collect_set(file).alias("files"), F.count("*").alias("saves"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("fires"), F.array_sort("files").alias("files"), "saves")


def run_on_saves(stream: DataFrame, refresh: Callable[[list[str]], None], gap_ms: int, checkpoint: str, by: str = "workspace", file: str = "file_path", **trigger) -> StreamingQuery:
    """Call refresh with the files of each batch's finished sessions. Batches follow each other, so runs never overlap and saves made meanwhile wait for the next."""

    def batch(df: DataFrame, _: int) -> None:
        files = [r[0] for r in df.select(F.explode("files")).distinct().toLocalIterator()]
        if files:
            refresh(sorted(files))

    writer = debounced(stream, gap_ms, by=by, file=file).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
