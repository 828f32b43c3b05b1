"""Pages that keep arriving: chunk, drop what is known, append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.chunking import crawl_chunks
from docmill.schema import CrawlChunks


def latest_fetches(stream: DataFrame, time_col: str, key_cols: list[str], late: str = "90 days") -> DataFrame:
    """Each key once: repeated deliveries within the watermark go, rows that are later than it too."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(key_cols)


def ingest_chunks(stream: DataFrame, read_seen: Callable[[], DataFrame | None], append: Callable[[DataFrame], None], checkpoint: str, id_col: str = "url", text_col: str = "content", strategy: CrawlChunks | None = None, available_now: bool = True) -> StreamingQuery:
    """Chunks of the arriving texts whose hash the sink doesn't hold yet.

    ``read_seen`` gives the sink's hashes (column ``hash``), anew for each micro-batch, so a batch that
    is run again after a failure adds nothing twice; ``append`` adds chunks to the sink.
    """

    def batch(df: DataFrame, _: int) -> None:
        append(crawl_chunks(df, strategy, id_col, text_col, across=True, seen=read_seen()))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def events_per_window(stream: DataFrame, time_col: str, width: str = "1 day", late: str = "7 days", by: list[str] | None = None) -> DataFrame:
    """Arrivals counted by tumbling windows of event time, late ones up to the watermark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *(by or [])).agg(F.count(F.lit(1)).alias("arrivals"))
