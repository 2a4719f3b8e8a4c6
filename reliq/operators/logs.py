"""Log reduction: triage excerpts and CI log blocks for every log at once.

Input is one row per line: ``(log_id, line_no, line)`` plus columns that are
constant per log. Context windows run over chunks with a small overlap (see
``lines``), and only bounded tops (the last 200 parts, the blocks that can fit a
size cap) are gathered per log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliq.functions import loglines as L
from reliq.operators.lines import chunk_window, with_chunks
from reliq.operators.search import materialize

# Excerpt and block bounds.
BEFORE, AFTER = 8, 12
CHAR_CAP, LINE_CAP = 12_000, 200
COLLAPSE_FROM = 3
LOW_SIGNAL_LINES = 60
BLOCK_CONTEXT = 40
BLOCK_CAP_BYTES = 15 * 1024
BLOCK_TAIL_LINES, BLOCK_TAIL_BYTES = 60, 4096
MIN_CLIP_BYTES = 512
MIN_BLOCK_BYTES = 14  # "[lines 1-1]", a newline, an empty line, the separator


def _context(lines: DataFrame, before: int, after: int) -> DataFrame:
    """Lines near a hit, flagged where an island (merged window) and a run of equal lines start and end."""
    w = chunk_window()
    near = w.rowsBetween(-after, before)
    marked = (
        with_chunks(lines, max(before, after) + 1)
        .withColumn("_keep", F.max("hit").over(near))
        .withColumn("_prev_keep", F.coalesce(F.lag("_keep").over(w), F.lit(False)))
        .withColumn("_next_keep", F.coalesce(F.lead("_keep").over(w), F.lit(False)))
        .withColumn("_same_prev", F.coalesce(F.lag("line").over(w) == F.col("line"), F.lit(False)))
        .withColumn("_same_next", F.coalesce(F.lead("line").over(w) == F.col("line"), F.lit(False)))
    )
    return marked.filter(F.col("_own") & F.col("_keep")).select(
        "log_id", "line_no", "line", "hit",
        (~F.col("_prev_keep")).alias("island_start"),
        (~F.col("_next_keep")).alias("island_end"),
        (~F.col("_prev_keep") | ~F.col("_same_prev")).alias("run_start"),
        (~F.col("_next_keep") | ~F.col("_same_next")).alias("run_end"),
    )


def _last(df: DataFrame, n: int, *carry: str) -> DataFrame:
    order = Window.partitionBy("log_id").orderBy(F.desc("line_no"))
    return df.select("log_id", "line_no", *carry).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n)


def log_stats(lines: DataFrame) -> DataFrame:
    """Lines, bytes (newlines between lines counted) and hits per log."""
    return lines.groupBy("log_id").agg(
        F.count("*").alias("original_lines"),
        (F.sum(F.octet_length("raw_line")) + F.count("*") - 1).alias("original_bytes"),
        F.count_if("hit").alias("hit_count"),
    )


def log_excerpts(lines: DataFrame, before: int = BEFORE, after: int = AFTER, char_cap: int = CHAR_CAP,
                 line_cap: int = LINE_CAP, low_signal_lines: int = LOW_SIGNAL_LINES) -> DataFrame:
    """``(log_id, excerpt, stats…, low_signal)`` for every log.

    Equal lines that follow each other form runs. The k-th last run start and
    the k-th last run end belong together, so the last ``line_cap`` runs come
    from two bounded tops, however long a run or a log is.
    """
    lines = lines.select(
        "log_id", "line_no", F.col("line").alias("raw_line"), L.strip_ansi(F.col("line")).alias("line")
    ).withColumn("hit", L.is_failure_line(F.col("line")))
    stats = log_stats(lines)
    kept = materialize(_context(lines.drop("raw_line"), before, after).select("log_id", "line_no", "line", "island_start", "run_start", "run_end").filter(
        "run_start OR run_end"), "excerpt-lines")
    starts = _last(kept.filter("run_start"), line_cap + 1, "line", "island_start")
    ends = _last(kept.filter("run_end"), line_cap + 2).select("log_id", F.col("line_no").alias("end_no"), "_k")
    # One bounded array per log: at most line_cap + 1 starts and line_cap + 2 ends.
    runs = starts.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("_k", "line_no", "line", "island_start")), asc=False).alias("_s"))
    tails = ends.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "end_no"))).alias("_e"))

    def parts(s):
        end = F.col("_e")[s["_k"]]
        before_end = F.col("_e")[s["_k"] + 1]
        n = end - s["line_no"] + 1
        gap = F.when(
            s["island_start"] & before_end.isNotNull(), F.array(L.omitted_marker(s["line_no"] - before_end - 1))
        ).otherwise(F.array().cast("array<string>"))
        body = (
            F.when(n >= COLLAPSE_FROM, F.array(s["line"], L.repeat_marker(n - 1)))
            .when(n == 2, F.array(s["line"], s["line"]))
            .otherwise(F.array(s["line"]))
        )
        return F.concat(gap, body)

    built = (
        runs.join(tails, "log_id")
        .withColumn("_parts", F.flatten(F.transform("_s", parts)))
        .withColumn("_cut", F.size("_parts") > line_cap)
        .withColumn("_text", F.array_join(F.when(
            F.col("_cut"), F.slice("_parts", -line_cap, line_cap)).otherwise(F.col("_parts")), "\n"))
        .withColumn("_long", F.length("_text") > char_cap)
        .select(
            "log_id",
            F.when(F.col("_cut") & ~F.col("_long"), F.concat(F.lit(L.TRUNCATION_NOTE + "\n"), F.col("_text")))
            .otherwise(L.cap_tail(F.col("_text"), char_cap)).alias("excerpt"),
            (F.col("_cut") | F.col("_long")).alias("truncated"),
        )
    )
    quiet = stats.filter(F.col("hit_count") == 0).select("log_id", "original_lines")
    tail = (
        lines.select("log_id", "line_no", "line").join(quiet, "log_id")
        .filter(F.col("line_no") >= F.col("original_lines") - low_signal_lines)
        .groupBy("log_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_text"))
        .select("log_id", L.cap_tail(F.col("_text"), char_cap).alias("excerpt"), (F.length("_text") > char_cap).alias("truncated"))
    )
    return stats.join(built.unionByName(tail), "log_id").select(
        "log_id", "excerpt", "original_bytes", "original_lines", "hit_count", "truncated",
        (F.col("hit_count") == 0).alias("low_signal"),
        F.when(F.col("hit_count") == 0, 0).when(F.col("excerpt") == "", 0)
        .otherwise(F.size(F.split("excerpt", "\n", -1))).alias("excerpt_lines"),
        F.when(F.col("hit_count") == 0, 0).otherwise(F.length("excerpt")).alias("excerpt_chars"),
    )


def failure_context(lines: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Line-level view of the excerpt windows: kept lines with island and run borders."""
    cleaned = lines.select("log_id", "line_no", L.strip_ansi(F.col("line")).alias("line"))
    return _context(cleaned.withColumn("hit", L.is_failure_line(F.col("line"))), before, after)


def _with_block(kept: DataFrame) -> DataFrame:
    """Add ``block_start``: the island's first line, carried across chunks by per-chunk maxima."""
    chunk = F.floor(F.col("line_no") / 4096)
    marked = kept.withColumn("_chunk", chunk).withColumn("_start", F.when(F.col("island_start"), F.col("line_no")))
    inside = Window.partitionBy("log_id", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("log_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = marked.groupBy("log_id", "_chunk").agg(F.max("_start").alias("_m")).withColumn(
        "_carry", F.max("_m").over(earlier)).drop("_m")
    return (
        marked.withColumn("_here", F.max("_start").over(inside))
        .join(carry, ["log_id", "_chunk"])
        .withColumn("block_start", F.coalesce("_here", "_carry"))
        .drop("_chunk", "_start", "_here", "_carry")
    )


def log_blocks(lines: DataFrame, context: int = BLOCK_CONTEXT, cap_bytes: int = BLOCK_CAP_BYTES) -> DataFrame:
    """CI log text per log: merged ±context blocks, repeated blocks dropped, 15 KB at most.

    A block is compared by an order-aware fingerprint that adds up over its lines
    (two 64-bit hashes), so a block of any length needs no gathering. Of the
    blocks of one size only the first ``cap / size`` can ever be kept, because a
    size that failed once fails for good; that bounds the greedy pass per log.
    """
    lines = lines.select("log_id", "line_no", F.octet_length("line").alias("_raw"), L.clean_ci_line(F.col("line")).alias("line"))
    lines = lines.withColumn("hit", L.is_anchor_line(F.col("line")))
    stats = lines.groupBy("log_id").agg(
        F.count("*").alias("n_lines"), (F.sum("_raw") + F.count("*") - 1).alias("bytes_raw"), F.count_if("hit").alias("anchor_count"))
    kept = _with_block(_context(lines.drop("_raw"), context, context))
    norm = F.trim(F.regexp_replace(F.regexp_replace("line", r"(?iU)\b[0-9a-f]{6,}\b", "<h>"), r"(?U)\d+", "<n>"))
    rel = F.col("line_no") - F.col("block_start")
    blocks = (
        kept.withColumn("_norm", norm)
        .groupBy("log_id", "block_start")
        .agg(
            F.max("line_no").alias("block_end"),
            F.sum(F.octet_length("line") + 1).alias("_bytes"),
            F.bit_xor(F.xxhash64(rel, F.col("_norm"))).alias("_f1"),
            F.bit_xor(F.xxhash64(F.col("_norm"), rel, F.lit(1))).alias("_f2"),
        )
        .withColumn("_head", F.concat(F.lit("[lines "), (F.col("block_start") + 1).cast("string"), F.lit("-"),
                                      (F.col("block_end") + 1).cast("string"), F.lit("]")))
        # header, newline, the lines joined by newlines, two for the separator
        .withColumn("size", F.octet_length("_head") + F.col("_bytes") + 2)
        .withColumn("_len", F.col("block_end") - F.col("block_start"))
    )
    distinct = blocks.groupBy("log_id", "_f1", "_f2", "_len").agg(
        F.min(F.struct("block_start", "block_end", "size", "_head")).alias("_b"), F.count("*").alias("_copies")
    ).select("log_id", "_b.*", "_copies")
    by_size = Window.partitionBy("log_id", "size").orderBy("block_start")
    # The constant bound lets Spark cut the groups before the shuffle; the exact one depends on the size.
    candidates = distinct.filter(F.col("size") <= cap_bytes).withColumn("_k", F.row_number().over(by_size)).filter(
        F.col("_k") <= cap_bytes // MIN_BLOCK_BYTES).filter(F.col("_k") <= F.floor(F.lit(cap_bytes) / F.col("size")))
    totals = distinct.groupBy("log_id").agg(
        F.count("*").alias("_distinct"), F.sum(F.col("_copies") - 1).alias("blocks_dropped_duplicate"),
        F.min(F.struct("block_start", "block_end", "size", "_head")).alias("_first"))
    per_log = candidates.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("block_start", "block_end", "size", "_head"))).alias("_c"))
    state = "struct<used:bigint,kept:array<struct<block_start:bigint,block_end:bigint,size:bigint,_head:string>>>"
    chosen = (
        totals.join(per_log, "log_id", "left")
        .withColumn("_clip", (F.col("_first.size") > cap_bytes) & F.lit(cap_bytes - 2 > MIN_CLIP_BYTES))
        .withColumn("_kept", F.expr(
            f"aggregate(coalesce(_c, array()), cast(named_struct('used', 0L, 'kept', array()) as {state}), "
            f"(a, b) -> if(a.used + b.size > {cap_bytes}, a, "
            f"cast(named_struct('used', a.used + b.size, 'kept', array_append(a.kept, b)) as {state}))).kept"))
        .withColumn("_kept", F.when(F.col("_clip"), F.array("_first")).otherwise(F.col("_kept")))
    )
    picked = chosen.select("log_id", "_clip", F.explode("_kept").alias("_b")).select("log_id", "_clip", "_b.*")
    # A clipped block needs no more lines than the cap has bytes.
    bodies = (
        kept.join(picked, ["log_id", "block_start"]).filter(F.col("line_no") - F.col("block_start") < cap_bytes)
        .groupBy("log_id", "block_start", "_clip", "_head")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_t"))
        .withColumn("_t", F.concat_ws("\n", "_head", "_t"))
        .withColumn("_t", F.when(F.col("_clip"), F.concat(_utf8_head(F.col("_t"), cap_bytes - 2), F.lit("\n[... block truncated to fit size cap ...]"))).otherwise(F.col("_t")))
        .groupBy("log_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_start", "_t"))), lambda x: x["_t"]).alias("_pieces"))
    )
    found = (
        chosen.join(bodies, "log_id")
        .withColumn("blocks_kept", F.size("_kept"))
        .withColumn("blocks_dropped_cap", F.when(F.col("_clip"), F.col("_distinct")).otherwise(F.col("_distinct") - F.size("_kept")))
        .withColumn("note", F.when(F.col("blocks_dropped_cap") > 0, F.concat(
            F.col("blocks_dropped_cap").cast("string"), F.lit(" additional failure block(s) omitted to stay under the size cap"))).otherwise(""))
        .withColumn("_pieces", F.when(F.col("note") != "", F.array_append("_pieces", F.concat(F.lit("[... "), F.col("note"), F.lit(" ...]")))).otherwise(F.col("_pieces")))
        .select("log_id", F.array_join("_pieces", "\n\n").alias("text"), "blocks_kept", "blocks_dropped_duplicate", "blocks_dropped_cap", "note")
    )
    quiet = stats.filter(F.col("anchor_count") == 0)
    tail = (
        lines.join(quiet.select("log_id", "n_lines"), "log_id").filter(F.col("line_no") >= F.col("n_lines") - BLOCK_TAIL_LINES)
        .groupBy("log_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_t"))
        .select("log_id", _utf8_tail(F.col("_t"), BLOCK_TAIL_BYTES).alias("text"))
        .withColumn("blocks_kept", F.when(F.col("text") != "", 1).otherwise(0))
        .withColumn("blocks_dropped_duplicate", F.lit(0).cast("long"))
        .withColumn("blocks_dropped_cap", F.lit(0).cast("long"))
        .withColumn("note", F.lit("no failure anchors found; returning log tail"))
        .select("log_id", "text", "blocks_kept", "blocks_dropped_duplicate", "blocks_dropped_cap", "note")
    )
    return stats.drop("n_lines").join(found.unionByName(tail), "log_id").withColumn("bytes_filtered", F.octet_length("text"))


def _utf8_head(text, n_bytes: int):
    """The first ``n_bytes`` bytes as text; a character cut in two is left out."""
    return F.regexp_replace(_decoded(F.substring(F.encode(text, "UTF-8"), 1, n_bytes)), "\ufffd+$", "")


def _utf8_tail(text, n_bytes: int):
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(raw) > n_bytes, _decoded(F.substring(raw, -n_bytes, n_bytes))).otherwise(text)


def _decoded(raw):
    return F.make_valid_utf8(raw.cast("string"))
