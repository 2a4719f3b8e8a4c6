"""Literal substrings over text columns: an index of the pieces of the distinct texts.

Names, messages and traces repeat over runs, so the index holds every distinct text once, and for it the distinct pieces of three
characters. A needle meets the postings of its rarest piece only; what is found is verified by ``contains``. Shorter needles are pieces
of one or two characters, which the distinct texts give as they are read: stored, they would be more than half of the postings. Hits on
texts then meet the distinct combinations of a row's texts, and these the rows, by hashes. Nothing has a special meaning in a needle,
``%`` and ``_`` included; case counts.

Two batch tables in a ``Store``: ``<name>_texts`` (text_key, text, batch) and ``<name>_pieces`` (piece, text_key), partitioned by a hash
of the piece. A batch brings only texts that no earlier batch holds; a repeated batch replaces itself.
"""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliq.functions.text import bind
from reliq.operators.search import materialize
from reliq.session import run_dir
from reliq.sources.tables import Store

#: Characters of a piece at most; folders of pieces.
LENGTH, BUCKETS = 3, 16
_TEXTS, _PIECES = "text_key binary, text string, batch bigint", "piece string, text_key binary, bucket int"


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def pieces(text: Column, length: int) -> Column:
    """Distinct runs of ``length`` characters of a text."""
    def runs(chars: Column) -> Column:
        last = F.size(chars) - length
        spots = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(spots, lambda i: F.concat(*(F.get(chars, i + k) for k in range(length)))))

    return bind(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), runs)


def short_pieces(text: Column) -> Column:
    return F.flatten(F.array(*(pieces(text, n) for n in range(1, LENGTH))))


def combination(columns: list[str]) -> Column:
    """128 bits that stand for the texts of all columns of a row, nulls included; each text is led by its length, so none runs into the next."""
    texts = [F.col(c).cast("string") for c in columns]
    return text_key(F.concat(*(F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts)))


def _bucket(piece: str) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def distinct_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(text_key, text) of every text in the columns, once."""
    texts = rows.select(F.explode(F.array_compact(F.array(*(F.col(c).cast("string") for c in columns)))).alias("text")).distinct()
    return texts.select(text_key(F.col("text")).alias("text_key"), "text")


class LiteralIndex:
    def __init__(self, store: Store, name: str = "literals"):
        self.store, self.name = store, name

    def add(self, rows: DataFrame, columns: list[str], batch: int) -> None:
        """The texts of new rows; those that earlier batches hold are left out."""
        texts, number = f"{self.name}_texts", f"{batch:010d}"
        fresh = distinct_texts(rows, columns)
        if any(b != number for b in self.store.batches(texts)):
            known = self.store.read(texts).filter(F.col("batch") != batch).select("text_key")
            fresh = fresh.join(known, "text_key", "left_anti")
        self.store.append(texts, fresh.withColumn("batch", F.lit(batch).cast("long")), number)
        written = self.store.batch(texts, number)
        posted = written.select("text_key", F.explode(pieces(F.col("text"), LENGTH)).alias("piece")).withColumn("bucket", _bucket("piece"))
        dealt = posted.repartition("bucket", F.crc32("text_key") % 8).sortWithinPartitions("bucket", "piece")
        self.store.append(f"{self.name}_pieces", dealt, number, partition_by=("bucket",))

    def texts(self) -> DataFrame:
        return self.store.read(f"{self.name}_texts").select("text_key", "text")

    def postings(self) -> DataFrame:
        return self.store.read(f"{self.name}_pieces", schema=_PIECES)

    def matching_texts(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """(needle, text_key) for every text that holds the needle; empty and null needles match nothing."""
        # Written once: of known size, so that it is sent to the pieces of the texts, whose number Spark cannot foresee, and never these to it.
        asked = materialize(needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct(), "needles")
        short = asked.filter(F.char_length("needle") < LENGTH)
        contained = self.texts().select("text_key", F.explode(short_pieces(F.col("text"))).alias("needle")).join(short, "needle").select("needle", "text_key")
        wanted = asked.filter(F.char_length("needle") >= LENGTH).select("needle", F.explode(pieces(F.col("needle"), LENGTH)).alias("piece")).withColumn("bucket", _bucket("piece"))
        vocabulary = wanted.select("bucket", "piece").distinct()
        posted = self.postings().join(vocabulary, ["bucket", "piece"], "left_semi")
        often = posted.groupBy("piece").agg(F.count("*").alias("n"))
        # a needle with a piece that no text holds matches nothing: its count of 0 is the least
        rarest = wanted.join(often, "piece", "left").groupBy("needle").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "bucket", "piece")).alias("r")).filter("r.n > 0").select("needle", "r.bucket", "r.piece")
        candidates = rarest.join(posted, ["bucket", "piece"]).select("needle", "text_key")
        verified = candidates.join(self.texts(), "text_key").filter(F.contains("text", "needle")).select("needle", "text_key")
        return verified.unionByName(contained)

    def matching_rows(self, needles: DataFrame, rows: DataFrame, columns: list[str], key: list[str], needle: str = "needle") -> DataFrame:
        """(needle, key columns) for every row that holds the needle in one of ``columns``, once per row."""
        keyed = rows.withColumn("_texts", combination(columns))
        keys = F.array_distinct(F.array_compact(F.array(*(text_key(F.col(c).cast("string")) for c in columns))))
        distinct = keyed.select("_texts", *columns).distinct().select("_texts", F.explode(keys).alias("text_key"))
        # Written once: what reads the matches in several ways joins it to the rows' keys only.
        hits = materialize(distinct.join(self.matching_texts(needles, needle), "text_key").groupBy("_texts").agg(F.collect_set("needle").alias("_needles")), "literal-hits")
        # Lists of few different needles are far smaller in their files than in memory, so these sizes must not decide on a broadcast.
        return keyed.select("_texts", *key).join(hits.hint("merge"), "_texts").select(F.explode("_needles").alias("needle"), *key)


def build(rows: DataFrame, columns: list[str]) -> LiteralIndex:
    """An index of one batch in this application's folder."""
    spark = rows.sparkSession
    index = LiteralIndex(Store(spark, f"{run_dir(spark)}/literals-{uuid.uuid4().hex}"))
    index.add(rows, columns, 1)
    return index
