"""Exact dedup on native expressions only: 128-bit content hash, bytes compared inside groups.

Method: rows are grouped by the MD5 of their text together with the text itself, so equal hashes with different bytes fall
apart. Copies collapse before the shuffle; a hot group reaches the reducers as one row per task. The groups, without texts,
then meet the rows in one join on the hash alone, which adaptive execution may split for a hot hash.

Defined cases: a null text reads as empty; a null id never wins against another id; of several rows with the winning id
exactly one is kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliq.llm.store import free_name, stored


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``, dropped ones too.

    ``keep`` is ``smallest`` or ``largest``: whose id stays in each group of equal texts.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("hash", digest(F.col("text")))
    texts = rows.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(texts.groupBy("hash").agg(
        F.count("*").alias("texts"), best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "groups")
    slim = rows.select("doc_id", "hash", F.unhex(F.sha2("text", 256)).alias("sha"))
    found = slim.join(groups.filter("texts = 1").drop("texts"), "hash")
    collided = groups.filter("texts > 1").select("hash")
    if not collided.isEmpty():
        apart = rows.join(collided, "hash", "left_semi").join(texts, ["hash", "text"])
        found = found.unionByName(apart.withColumn("sha", F.unhex(F.sha2("text", 256))).select(found.columns))
    # Identical rows are counted and dealt out again, so that one of them can stay.
    counted = found.groupBy("doc_id", "sha", "keep_id", "group_size").agg(F.count("*").cast("int").alias("times"))
    return counted.select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The row of each group of equal texts that stays, all columns unchanged (of several with its id, any one)."""
    # a null id comes last in either order
    rank = F.struct(F.col(id_col).isNull(), id_col) if keep == "smallest" else F.struct(F.col(id_col).isNotNull(), id_col)
    pick = {"smallest": F.min_by, "largest": F.max_by}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    missing = free_name(docs, "_null")  # the one field of the row that is no column
    groups = docs.select(F.struct(*rest, F.col(text_col).isNull().alias(missing)).alias("_row"), rank.alias("_rank"), text.alias("_text"), content_hash(text).alias("_hash")).groupBy(
        "_hash", "_text").agg(pick("_row", "_rank").alias("_row"))
    whole = F.when(~F.col("_row").getField(missing), F.col("_text"))
    return groups.select(*(whole.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
