"""Log, archive, trace and evidence files as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUL_SCAN_BYTES = 8192
IMAGE_SUFFIXES = r"(?i)\.(png|jpe?g|tiff?|bmp|gif|webp)$"
NON_FAILURES = ("success", "skipped", "neutral")


def _binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def decode_utf8(content: Column) -> Column:
    """Bytes as text; broken sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_logs(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = None, remote: bool = False) -> tuple[DataFrame, DataFrame]:
    """(logs, rejects), whole logs by default.

    With ``max_bytes`` a longer local log is refused; a fetched one keeps its tail and says so.
    """
    raw = _binary(spark, path, glob)
    big = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    kept = raw if remote else raw.filter(~big)
    body = F.when(big, F.substring("content", -(max_bytes or 0), max_bytes or 0)).otherwise(F.col("content")) if remote else F.col("content")
    logs = kept.select(F.col("path").alias("log_id"), decode_utf8(body).alias("text"), (big if remote else F.lit(False)).alias("fetch_truncated"))
    rejects = raw.filter(F.lit(not remote) & big).select("path", F.lit("log file too large").alias("reason"))
    return logs, rejects


_ENTRY_SCHEMA = "path string, entry string, text string, reason string"


def unzip_entries(archives: DataFrame, suffixes: tuple[str, ...], max_entry_bytes: int | None = None) -> DataFrame:
    """One row per wanted archive entry ``(path, entry, text, reason)``; what cannot be read is a row with a reason.

    Entries leave one by one. A broken entry, or one longer than ``max_entry_bytes`` (a guard
    against crafted archives; none by default), costs itself only; a broken archive is one row.
    """
    def entries(path: str, blob: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(blob))
        except Exception as exc:  # noqa: BLE001 - a broken archive is a reject, never a failed job
            yield path, None, None, type(exc).__name__
            return
        with archive:
            names = sorted(m.filename for m in archive.infolist() if m.filename.endswith(suffixes))
            if not names:
                yield path, None, None, "no entries"
            for name in names:
                try:
                    with archive.open(name) as stream:
                        data = stream.read() if max_entry_bytes is None else stream.read(max_entry_bytes + 1)
                    long = max_entry_bytes is not None and len(data) > max_entry_bytes
                    yield path, name, None if long else data.decode("utf-8", "replace"), "entry over the size bound" if long else None
                except Exception as exc:  # noqa: BLE001
                    yield path, name, None, type(exc).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("path", "entry", "text", "reason")
        for batch in batches:
            for path, blob in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for row in entries(path, blob.as_py()):
                    yield pa.RecordBatch.from_pydict({c: pa.array([x], pa.string()) for c, x in zip(columns, row, strict=True)})

    return archives.select("path", "content").mapInArrow(run, _ENTRY_SCHEMA)


def ci_jobs(pages: DataFrame) -> DataFrame:
    """Failed jobs with their failed step names from ``(run_id, text)`` job listings."""
    schema = "jobs array<struct<id:bigint,name:string,conclusion:string,steps:array<struct<name:string,conclusion:string>>>>"
    jobs = pages.select("run_id", F.explode(F.from_json("text", schema)["jobs"]).alias("j")).select("run_id", "j.*")

    def failed(c: Column) -> Column:
        return c.isNotNull() & ~c.isin(*NON_FAILURES)

    steps = F.transform(F.filter("steps", lambda s: failed(s["conclusion"])), lambda s: s["name"])
    return jobs.filter(failed(F.col("conclusion"))).select("run_id", "id", "name", "conclusion", steps.alias("failed_steps"))


def failed_job_entries(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Archive entries of the failed jobs' folders; all entries of a run where none matches.

    ``entries``: (run_id, entry, text); ``jobs``: (run_id, name).
    """
    folder = F.when(F.contains("entry", F.lit("/")), F.substring_index("entry", "/", 1)).otherwise("")
    rows = entries.withColumn("_folder", folder)
    names = jobs.select("run_id", F.col("name").alias("_folder")).distinct()
    matched = rows.join(names, ["run_id", "_folder"], "left_semi")
    unmatched_runs = rows.select("run_id").distinct().join(matched.select("run_id").distinct(), "run_id", "left_anti")
    return matched.unionByName(rows.join(unmatched_runs, "run_id", "left_semi")).drop("_folder")


def run_logs(entries: DataFrame) -> DataFrame:
    """One bounded text per run: entries in name order, each under a header."""
    piece = F.concat(F.lit("===== "), F.col("entry"), F.lit(" =====\n"), F.col("text"))
    return entries.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("entry", piece.alias("p")))).alias("_p")
    ).select(F.col("run_id").alias("log_id"), F.array_join(F.transform("_p", lambda x: x["p"]), "\n").alias("text"))


def trace_events(entries: DataFrame) -> DataFrame:
    """NDJSON lines of trace archives: ``(trace_id, entry, line_no, line)``, blank and broken lines skipped."""
    lines = entries.filter(F.col("text").isNotNull()).select(
        F.col("path").alias("trace_id"), "entry", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNotNull())


def read_evidence(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Evidence files as ``(path, text, skip_reason, truncated)``; every file, and whole, by default.

    ``truncated`` is true when a bound the caller set left something out: a file longer than
    ``max_bytes`` (its scan cannot count as complete), or files beyond ``max_files``.
    """
    raw = _binary(spark, path)
    if max_files is not None:
        if not isinstance(max_files, int) or isinstance(max_files, bool) or max_files < 1:
            raise ValueError("max_files must be 1 or more")
        chosen = raw.select("path").orderBy("path").limit(max_files)
        more = raw.select("path").limit(max_files + 1).agg((F.count("*") > max_files).alias("_more"))
        raw = raw.join(chosen, "path", "left_semi").join(F.broadcast(more))
    else:
        raw = raw.withColumn("_more", F.lit(False))
    return classify_evidence(raw.select("path", F.col("length"), "content", "_more"), max_bytes)


def classify_evidence(raw: DataFrame, max_bytes: int | None = None) -> DataFrame:
    nul = F.expr(f"position(X'00' IN substring(content, 1, {NUL_SCAN_BYTES})) > 0")
    reason = F.when(F.col("path").rlike(IMAGE_SUFFIXES), "ocr_unavailable").when(nul, "binary")
    more = F.col("_more") if "_more" in raw.columns else F.lit(False)
    body = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    cut = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    return raw.select("path", F.when(reason.isNull(), decode_utf8(body)).alias("text"), reason.alias("skip_reason"), (cut | more).alias("truncated"))
