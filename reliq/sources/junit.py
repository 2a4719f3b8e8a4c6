"""JUnit XML reports to runs and cases.

One pass over each file's XML events in Python turns it into raw strings; all
rules (numbers, times, totals, names) are column expressions on top.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliq.functions import text as X
from reliq.functions import times
from reliq.operators.search import materialize

#: Bytes of a report handed to the XML parser at once.
XML_PIECE = 1 << 20
#: Reports, and about the bytes of them, whose rows are handed back at once.
FILES_PER_BATCH, BATCH_BYTES = 1024, 4 << 20

_COUNTS = "tests string, failures string, errors string, skipped string"
SHRED_SCHEMA = (
    "path string, modified timestamp_ntz, reason string, root_name string, first_suite_name string, "
    f"times array<string>, root_counts struct<{_COUNTS.replace(' string', ':string')}>, "
    f"top_counts array<struct<{_COUNTS.replace(' string', ':string')}>>, "
    "cases array<struct<position:int,classname:string,name:string,file:string,line:string,time:string,"
    "status:string,message:string,type:string,trace:string>>"
)


class _Report:
    """SAX-style events of one report, kept as flat lists of attributes."""

    OUTCOMES = {"error": 0, "failure": 1, "skipped": 2}
    STATUS = ("error", "failed", "skipped", "passed")

    def __init__(self):
        self.path: list[tuple[str, int]] = []  # (tag, suite index or -1) of the open elements
        self.root: dict[str, str] = {}
        self.root_tag = ""
        self.suites: list[tuple[int, dict]] = []  # (depth, attributes)
        self.cases: list[dict] = []
        self.case: dict | None = None
        self.text_at = -1  # depth of the outcome element whose leading text is being read

    def start(self, tag, attrs):
        depth = len(self.path)
        if depth == 0:
            self.root_tag, self.root = tag, attrs
        self.text_at = -1
        suite = -1
        if tag == "testsuite":
            suite = len(self.suites)
            self.suites.append((depth, attrs))
        elif tag == "testcase" and depth > 0:
            parent_tag, parent_suite = self.path[-1]
            self.case = {"suite": parent_suite, "under_root": depth == 1, "attrs": attrs, "outcome": (3, {}, ""), "depth": depth}
            self.cases.append(self.case)
        elif self.case is not None and depth == self.case["depth"] + 1 and tag in self.OUTCOMES:
            rank = self.OUTCOMES[tag]
            if rank < self.case["outcome"][0]:
                self.case["outcome"] = (rank, attrs, "")
                self.text_at = depth
        self.path.append((tag, suite))

    def text(self, data):
        if self.text_at >= 0 and len(self.path) == self.text_at + 1:
            rank, attrs, text = self.case["outcome"]
            self.case["outcome"] = (rank, attrs, text + data)

    def end(self, tag):
        self.path.pop()
        self.text_at = -1
        if self.case is not None and len(self.path) == self.case["depth"]:
            self.case = None

    def row(self) -> dict:
        if self.suites:
            placed = sorted((c for c in self.cases if c["suite"] >= 0), key=lambda c: c["suite"])
        else:
            placed = [c for c in self.cases if c["under_root"]]
        in_place = bool(placed)
        placed = placed or self.cases
        if self.root_tag not in ("testsuite", "testsuites") and not self.suites and not placed:
            raise ValueError(f"not a JUnit XML document (root=<{self.root_tag}>)")
        rows = []
        for i, c in enumerate(placed):
            attrs, (rank, outcome, text) = c["attrs"], c["outcome"]
            holder = (self.suites[c["suite"]][1] if c["suite"] >= 0 else self.root) if in_place else {}
            rows.append({
                "position": i, "classname": attrs.get("classname"), "name": attrs.get("name"),
                "file": (attrs.get("file") or "").strip() or holder.get("file"), "line": attrs.get("line"), "time": attrs.get("time"),
                "status": self.STATUS[rank], "message": outcome.get("message"), "type": outcome.get("type"), "trace": text or None,
            })
        keys = ("tests", "failures", "errors", "skipped")
        top = 0 if self.root_tag == "testsuite" else 1
        return {
            "reason": None, "root_name": self.root.get("name"),
            "first_suite_name": self.suites[0][1].get("name") if self.suites else None,
            "times": [self.root.get("timestamp")] + [a.get("timestamp") for _, a in self.suites],
            "root_counts": {k: self.root.get(k) for k in keys},
            "top_counts": [{k: a.get(k) for k in keys} for d, a in self.suites if d == top],
            "cases": rows,
        }


def _refuse(*_):
    raise ValueError("DTD is not allowed")


def _shred_one(content: bytes) -> dict:
    """Raw strings of one report, or the reason why the whole file is refused."""
    try:
        report = _Report()
        parser = expat.ParserCreate()
        parser.StartDoctypeDeclHandler = _refuse  # fires before any entity expands
        parser.StartElementHandler, parser.EndElementHandler = report.start, report.end
        parser.CharacterDataHandler = report.text
        parser.buffer_text = True
        for at in range(0, len(content), XML_PIECE):
            parser.Parse(content[at:at + XML_PIECE], False)
        parser.Parse(b"", True)
        return report.row()
    except (ValueError, expat.ExpatError) as exc:
        return {"reason": str(exc)[:200]}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``FILES_PER_BATCH`` reports; a part ends with the report that fills ``BATCH_BYTES``."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column("content")).to_pylist()):
        size += n or 0
        if size >= BATCH_BYTES or i + 1 - start == FILES_PER_BATCH:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def shred(files: DataFrame) -> DataFrame:
    """``(path, modificationTime, length, content)`` rows to one raw row per file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHRED_SCHEMA))

    own = pa.schema([f for f in schema if f.name not in ("path", "modified")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                rows = pa.RecordBatch.from_pylist([_shred_one(content) for content in part.column("content").to_pylist()], schema=own)
                yield pa.RecordBatch.from_arrays([part.column("path"), part.column("modified"), *rows.columns], schema=schema)

    slim = files.select(
        "path", F.col("modificationTime").cast("timestamp_ntz").alias("modified"), "content")
    return slim.mapInArrow(run, SHRED_SCHEMA)


def to_number(text: Column) -> Column:
    """A finite double, else null (Java's ``3f`` and ``0x`` forms are no numbers here)."""
    plain = X.strip(text)
    ok = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(ok, plain).try_cast("double")
    return F.when(F.abs(value) != float("inf"), value)


def to_int(text: Column) -> Column:
    return to_number(text).try_cast("bigint")


def _total(key: str, statuses: tuple[str, ...]) -> Column:
    """Sum over the top suites when all carry the key, else the root's value, else counted cases."""
    values = F.transform("top_counts", lambda s: to_int(s[key]))
    whole = (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull())
    summed = F.when(whole, F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v))
    counted = F.size(F.filter("cases", lambda c: c["status"].isin(*statuses))).cast("bigint")
    return F.coalesce(summed, to_int(F.col("root_counts")[key]), counted)


@dataclass
class Reports:
    """The three outcomes of one shred; a file is in both tables or among the rejects."""

    shredded: DataFrame
    ingested_at: Column
    batch: str

    @cached_property
    def rejects(self) -> DataFrame:
        return self.shredded.filter(F.col("reason").isNotNull()).select("path", "reason")

    @cached_property
    def _good(self) -> DataFrame:
        return self.shredded.filter(F.col("reason").isNull()).withColumn("run_id", F.xxhash64("path", F.lit(self.batch)))

    def _run_ts(self) -> Column:
        reported = F.get(F.filter(F.transform("times", times.parse_ts), lambda t: t.isNotNull()), 0).cast("timestamp_ntz")
        return F.coalesce(reported, F.date_trunc("second", "modified").cast("timestamp_ntz"))

    def _run_date(self) -> Column:
        """Day of the run's effective time: both histories are partitioned by it."""
        return F.coalesce(self._run_ts(), self.ingested_at.cast("timestamp_ntz")).cast("date")

    @cached_property
    def runs(self) -> DataFrame:
        run_ts = self._run_ts()
        file_name = F.substring_index("path", "/", -1)
        return self._good.select(
            "run_id",
            F.coalesce(X.clean(F.col("root_name")), X.clean(F.col("first_suite_name")), file_name).alias("suite_name"),
            self.ingested_at.cast("timestamp_ntz").alias("ingested_at"),
            run_ts.alias("run_timestamp"),
            F.coalesce(run_ts, self.ingested_at.cast("timestamp_ntz")).alias("effective_ts"),
            _total("tests", ("passed", "failed", "error", "skipped")).alias("total"),
            _total("failures", ("failed",)).alias("failures"),
            _total("errors", ("error",)).alias("errors"),
            _total("skipped", ("skipped",)).alias("skipped"),
            F.col("path").alias("source_file"),
            self._run_date().alias("run_date"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        c = self._good.select("run_id", self._run_date().alias("run_date"), F.explode("cases").alias("c")).select("run_id", "run_date", "c.*")
        return c.select(
            # Orders cases inside a run; not a join key.
            F.shiftleft("run_id", 20).bitwiseOR(F.col("position").cast("bigint")).alias("case_id"),
            "run_id",
            X.clean(F.col("classname")).alias("classname"),
            F.coalesce(X.clean(F.col("name")), F.lit("<unknown>")).alias("name"),
            X.clean(F.col("file")).alias("file_path"),
            to_int(F.col("line")).alias("line_number"),
            "status",
            (to_number(F.col("time")) * 1000).alias("duration_ms"),
            X.clean(F.col("message")).alias("failure_message"),
            X.clean(F.col("type")).alias("failure_type"),
            X.clean(F.col("trace")).alias("stack_trace"),
            "run_date",
        )


def files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def read_junit(spark: SparkSession, path: str, ingested_at, batch: str) -> Reports:
    """All reports under ``path``, shredded once. ``ingested_at`` is a datetime; ``batch`` names this ingest."""
    return Reports(materialize(shred(files(spark, path)), "junit"), F.lit(ingested_at), batch)


def synthetic_runs(cases: DataFrame, ingested_at, suite_name: str = "burn-in") -> tuple[DataFrame, DataFrame]:
    """Runs and cases from rows ``(run_key, run_time text, name, …)``: burn-in results as normal history.

    Counts come from the case statuses; a row without a readable time is refused
    by the caller's filter on ``effective_ts``.
    """
    wanted = {"classname": "string", "file_path": "string", "status": "string", "line_number": "bigint", "duration_ms": "double",
              "failure_message": "string", "failure_type": "string", "stack_trace": "string"}
    full = cases.select("run_key", "run_time", "name", *[
        (F.col(c) if c in cases.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])
    stamped = full.withColumn("status", F.coalesce("status", F.lit("passed"))).withColumn(
        "run_timestamp", times.parse_ts(F.col("run_time")).cast("timestamp_ntz")).withColumn(
        "run_id", F.xxhash64(F.lit("synthetic"), F.col("run_key").cast("string")))
    runs = stamped.groupBy("run_id", "run_key", "run_timestamp").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "skipped").alias("skipped"),
    ).select(
        "run_id", F.lit(suite_name).alias("suite_name"), F.lit(ingested_at).cast("timestamp_ntz").alias("ingested_at"), "run_timestamp",
        F.col("run_timestamp").alias("effective_ts"), "total", "failures", "errors", "skipped",
        F.concat(F.lit(f"synthetic://{suite_name}/"), F.col("run_key").cast("string")).alias("source_file"), F.col("run_timestamp").cast("date").alias("run_date"))
    # Repeated results of one test in one run are told apart by their order.
    same = Window.partitionBy("run_id", "name", "classname", "file_path").orderBy("status", "duration_ms", "failure_message", "failure_type", "stack_trace", "line_number")
    out = stamped.withColumn("_nth", F.row_number().over(same)).select(
        F.xxhash64("run_id", "name", "classname", "file_path", "_nth").alias("case_id"), "run_id", "classname", "name", "file_path", "line_number",
        "status", "duration_ms", "failure_message", "failure_type", "stack_trace", F.col("run_timestamp").cast("date").alias("run_date"))
    return runs, out
