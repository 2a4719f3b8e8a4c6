"""Log lines at any size: numbering and neighbourhood work in bounded groups.

A log may hold a third of all lines, so nothing here sorts one whole log in one
task. Numbering adds a per-minute running offset to a rank inside the minute;
neighbourhood windows run over fixed-size chunks that carry a few lines of their
neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_LINES = 4096


def number_lines(events: DataFrame, ts: str, tie: str) -> DataFrame:
    """Add ``line_no`` (0-based, by ts then tie) per ``log_id``; drops ts and tie.

    The offset window holds one row per (log, minute), so its size follows the
    calendar and not the number of lines.
    """
    slotted = events.withColumn("_slot", F.unix_seconds(F.col(ts).cast("timestamp")).cast("long") / 60)
    slotted = slotted.withColumn("_slot", F.floor("_slot"))
    before = Window.partitionBy("log_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy("log_id", "_slot").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy("log_id", "_slot").orderBy(ts, tie))
    return (
        slotted.withColumn("_rank", rank)
        .join(offsets, ["log_id", "_slot"])
        .withColumn("line_no", F.col("_offset") + F.col("_rank") - 1)
        .drop("_slot", "_rank", "_offset", ts, tie)
    )


def split_lines(logs: DataFrame, text: str = "text", newline: str = "\n") -> DataFrame:
    """One row per line of a bounded log text (sources cap a log's bytes)."""
    keep = [c for c in logs.columns if c != text]
    return logs.select(*keep, F.posexplode(F.split(F.col(text), newline, -1)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def with_chunks(lines: DataFrame, halo: int) -> DataFrame:
    """Each line in its own chunk and, near a border, also in the next one.

    ``_chunk`` is the group to window over; a row counts only where
    ``_own`` is true.
    """
    own = F.floor(F.col("line_no") / CHUNK_LINES)
    spots = F.array_distinct(
        F.array(own, F.floor((F.col("line_no") - halo) / CHUNK_LINES), F.floor((F.col("line_no") + halo) / CHUNK_LINES))
    )
    return lines.withColumn("_chunk", F.explode(spots)).withColumn("_own", F.col("_chunk") == own)


def chunk_window() -> Window:
    return Window.partitionBy("log_id", "_chunk").orderBy("line_no")
