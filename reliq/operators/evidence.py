"""PII findings over a table of texts, and the clean-and-complete gate.

Matches become rows with their position, found by running sums over segment
lengths; only match texts and lengths are shuffled, by document, never the
documents themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliq.checks import require_detector_types
from reliq.functions import pii

_CONTEXT = "_word"


def _segments(docs: DataFrame, key: str, text: str, detectors) -> DataFrame:
    """Segment rows of all detectors from one pass over the documents."""
    jobs = [(d.name, d, d.pattern) for d in detectors]
    jobs += [(_CONTEXT, d, pii.PASSPORT_WORD) for d in detectors if d.name == "passport"]
    parts = F.array(*[
        F.struct(F.lit(name).alias("type"), F.lit(d.every_start).alias("every"), pii.fenced(F.col(text), p, d.every_start, d.gate).alias("p"))
        for name, d, p in jobs
    ])
    hit = docs.select(F.col(key).alias("_key"), F.explode(F.filter(parts, lambda x: F.size(x["p"]) > 1)).alias("_x"))
    exploded = hit.select("_key", "_x.type", "_x.every", F.posexplode("_x.p").alias("_i", "_s"))
    is_match = F.col("_i") % 2 == 1
    counts = ~is_match | ~F.col("every")
    newlines = F.length("_s") - F.length(F.replace("_s", F.lit("\n"), F.lit("")))
    return exploded.select(
        "_key", "type", "_i",
        F.when(is_match, F.col("_s")).alias("raw"),
        F.length("_s").alias("_len"),
        F.when(counts, F.length("_s")).otherwise(0).alias("_step"),
        F.when(counts, newlines).otherwise(0).alias("_nl"),
    )


def findings(docs: DataFrame, key: str = "path", text: str = "text", types=None,
             detectors: tuple[pii.Detector, ...] = pii.DETECTORS) -> DataFrame:
    """``(key, type, start, end, line, preview, raw)``: non-overlapping, offsets in characters.

    ``raw`` is for in-place masking inside a job; drop it before anything leaves.
    """
    detectors = pii.check_detectors(detectors)
    chosen = require_detector_types(types, [d.name for d in detectors])
    picked = [d for d in detectors if chosen is None or d.name in chosen]
    rows = _segments(docs, key, text, picked)
    so_far = Window.partitionBy("_key", "type").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.repartition("_key")
        .withColumn("start", F.coalesce(F.sum("_step").over(so_far), F.lit(0)))
        .withColumn("line", F.coalesce(F.sum("_nl").over(so_far), F.lit(0)) + 1)
        .filter(F.col("raw").isNotNull())
        .withColumn("end", F.col("start") + F.col("_len"))
        .select("_key", "type", "start", "end", "line", "raw")
    )
    placed = _near_passport_word(placed)
    valid = reduce(lambda c, d: c.when(F.col("type") == d.name, d.valid(F.col("raw"))), picked, F.when(F.lit(False), F.lit(False)))
    checked = placed.filter(valid)
    single = _earliest_first(checked)
    rank = reduce(lambda c, d: c.when(F.col("type") == d.name, d.priority), picked, F.when(F.lit(False), F.lit(0)))
    claimed = _claim(single.withColumn("_rank", rank), sorted(d.priority for d in picked))
    preview = reduce(lambda c, d: c.when(F.col("type") == d.name, d.mask(F.col("raw"))), picked, F.when(F.lit(False), F.lit("")))
    return claimed.select(F.col("_key").alias(key), "type", "start", "end", "line", preview.alias("preview"), "raw")


def _near_passport_word(rows: DataFrame) -> DataFrame:
    """Passport tokens stay only within 30 characters after a passport word."""
    # A word counts from its end, a token from its start: the last word that ends before the token decides.
    is_word = F.col("type") == _CONTEXT
    before = Window.partitionBy("_key").orderBy(F.when(is_word, F.col("end")).otherwise(F.col("start")), ~is_word).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("type") == _CONTEXT, F.col("end"))).over(before)
    near = rows.withColumn("_seen", seen)
    good = (F.col("type") != "passport") | F.coalesce(
        (F.col("start") >= F.col("_seen")) & (F.col("end") <= F.col("_seen") + pii.PASSPORT_WINDOW), F.lit(False))
    return near.filter((F.col("type") != _CONTEXT) & good).drop("_seen")


def _clusters(rows: DataFrame, *group: str) -> DataFrame:
    """Number the groups of spans that overlap each other, directly or through others."""
    by_start = Window.partitionBy(*group).orderBy("start", F.desc("end"))
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)
    return rows.withColumn("_new", fresh).withColumn("_cluster", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


_SPAN = "struct<start:bigint,end:bigint,line:bigint,type:string,raw:string>"


def _earliest_first(rows: DataFrame) -> DataFrame:
    """Per detector, take valid spans left to right, each from the end of the last one taken."""
    grouped = _clusters(rows, "_key", "type").groupBy("_key", "type", "_cluster").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "line", "type", "raw"))).alias("_c"))
    taken = F.expr(
        f"aggregate(_c, cast(array() as array<{_SPAN}>), "
        f"(a, s) -> if(size(a) > 0 and s.start < element_at(a, -1).end, a, array_append(a, cast(s as {_SPAN}))))")
    return grouped.select("_key", F.explode(taken).alias("_s")).select("_key", "_s.*")


def _claim(rows: DataFrame, ranks: list[int]) -> DataFrame:
    """Drop spans inside others, then let the surest claim first (``ranks`` from sure to unsure) where spans still overlap."""
    one = rows.groupBy("_key", "start", "end").agg(F.min(F.struct("_rank", "type", "raw", "line")).alias("_m")).select(
        "_key", "start", "end", "_m.*")
    wider = Window.partitionBy("_key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = one.withColumn("_w", F.max("end").over(wider)).filter(F.col("_w").isNull() | (F.col("end") > F.col("_w"))).drop("_w")
    # What is left overlaps without nesting, so starts and ends have one order; spans of one detector are apart. Detector by detector,
    # a span needs only its nearest neighbours among those taken so far. All windows share one shuffle and one sort.
    swept = outer.withColumn("_taken", F.col("_rank") == F.lit(ranks[0] if ranks else 0))
    order = "OVER (PARTITION BY _key ORDER BY start)"
    for rank in ranks[1:]:
        before = F.expr(f"lag(if(_taken, end, NULL)) IGNORE NULLS {order}")
        after = F.expr(f"lead(if(_taken, start, NULL)) IGNORE NULLS {order}")
        free = (F.coalesce(before, F.col("start")) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
        swept = swept.withColumn("_taken", F.col("_taken") | ((F.col("_rank") == rank) & free))
    return swept.filter("_taken").select("_key", "start", "end", "line", "type", "raw")


def _splice(text, spans):
    body = F.transform(spans, lambda s: F.concat(
        F.substring(text, (s["from"] + 1).cast("int"), (s["start"] - s["from"]).cast("int")), s["preview"]))
    rest = F.substring(text, (F.element_at(spans, -1)["end"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(body, ""), rest)).otherwise(text)


def mask_columns(docs: DataFrame, key: str, columns: list[str], types=None) -> DataFrame:
    """Replace every finding in the text columns by its preview; ``masked`` lists the columns that had any.

    One findings pass covers all columns. ``docs`` is read twice: materialise it
    first when it is expensive to compute.
    """
    field = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("t")) for c in columns])).alias("_x")
    long = docs.select(key, field).select(F.struct(F.col(key).alias("k"), F.col("_x.f").alias("f")).alias("_id"), F.col("_x.t").alias("_t"))
    found = findings(long, "_id", "_t", types)
    last = Window.partitionBy("_id").orderBy("start")
    spans = found.withColumn("from", F.coalesce(F.lag("end").over(last), F.lit(0))).groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "from", "end", "preview"))).alias("_s"))
    per_key = spans.groupBy(F.col("_id.k").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_id.f").alias("f"), "_s"))).alias("_m"))
    joined = docs.join(per_key, key, "left")
    out = [_splice(F.col(c), F.coalesce(F.try_element_at("_m", F.lit(c)), F.array())).alias(c) if c in columns else F.col(c) for c in docs.columns]
    return joined.select(*out, F.coalesce(F.map_keys("_m"), F.array().cast("array<string>")).alias("masked"))


def mask_pii(docs: DataFrame, key: str, text: str = "text", types=None) -> DataFrame:
    """``mask_columns`` for one column; ``masked`` says whether it had a finding."""
    return mask_columns(docs, key, [text], types).withColumn("masked", F.size("masked") > 0)


def scan_summary(docs: DataFrame, found: DataFrame, corpus: str, key: str = "path") -> DataFrame:
    """Per corpus: files, skipped, findings, clean and complete.

    ``docs`` has ``corpus``, ``key`` and, from the evidence source, ``skip_reason`` and ``truncated``.
    """
    per_doc = found.groupBy(key).agg(F.count("*").alias("_n"))
    flags = docs.join(per_doc, key, "left")
    skipped = F.col("skip_reason").isNotNull()
    return flags.groupBy(corpus).agg(
        F.count_if(~skipped).alias("scanned_files"),
        F.count_if(skipped).alias("skipped_files"),
        F.sum(F.coalesce("_n", F.lit(0))).alias("findings"),
        (F.sum(F.coalesce("_n", F.lit(0))) == 0).alias("clean"),
        F.every(~skipped & ~F.col("truncated")).alias("complete"),
    )


def findings_by_type(docs: DataFrame, found: DataFrame, corpus: str, key: str = "path") -> DataFrame:
    return found.join(docs.select(key, corpus), key).groupBy(corpus, "type").agg(F.count("*").alias("n"))


def top_findings(found: DataFrame, limit: int) -> DataFrame:
    """The report's first findings in (path, position) order."""
    return found.drop("raw").orderBy("path", "start").limit(limit)


def gate(tickets: DataFrame, evidence: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per ticket: ok only when every path it names was scanned, is clean and complete.

    ``evidence``: (ticket_id, path); ``scans``: (path, clean, complete). A path
    without a scan fails; a ticket without evidence passes.
    """
    checked = evidence.join(scans, "path", "left")
    per = checked.groupBy("ticket_id").agg(
        F.count("*").alias("checked_paths"),
        F.count_if(~F.coalesce("clean", F.lit(True))).alias("dirty_paths"),
        F.count_if(~F.coalesce("complete", F.lit(True))).alias("incomplete_paths"),
        F.count_if(F.col("clean").isNull()).alias("errors"),
    )
    zero = F.lit(0)
    return tickets.select("ticket_id").join(per, "ticket_id", "left").select(
        "ticket_id",
        *[F.coalesce(c, zero).alias(c) for c in ("checked_paths", "dirty_paths", "incomplete_paths", "errors")],
    ).withColumn("ok", (F.col("dirty_paths") + F.col("incomplete_paths") + F.col("errors")) == 0)
