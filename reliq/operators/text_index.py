"""A stored inverted index over documents: each document is tokenised once, searches read postings.

Batch tables in a ``Store``:

- ``<name>_documents``: (doc_id, doc_len, terms, batch, gone), one row per document and batch; a removal is a row with ``gone``;
- ``<name>_postings``: (bucket, token, block, doc_id, tf, doc_len, batch), partitioned by ``bucket``, a hash of the token, and sorted by
  token and block inside. A block is one share of a batch's documents (about ``BLOCK_DOCS``); large batches spread the blocks of a
  bucket over several tasks and files, so a token that is everywhere is not one group;
- ``<name>_blocks``: (bucket, token, level, batch, n, uses, max_tf, min_len), a token's postings by level, the logarithm of tf: ``max_tf`` and
  ``min_len`` bound what any of them can score, so that a search opens the postings of few tokens;
- the newest batch of a document counts. ``add`` with a batch number that exists replaces that batch, so a retried load does no harm.

Readers drop superseded and removed documents by a join, unless the index has a single batch and nothing was removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliq.functions import text as X
from reliq.session import run_dir
from reliq.sources.tables import Store

#: Folders of postings, and documents of a batch that share a block.
BUCKETS, BLOCK_DOCS = 32, 64


def bucket(token: str = "token"):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def counted(tokens: str):
    """(token, tf) of a sorted array: the lengths of its runs, without a shuffle."""
    at = F.sequence(F.lit(0), F.size(tokens) - 1)
    starts = F.when(F.size(tokens) > 0, F.filter(at, lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))).otherwise(F.array().cast("array<int>"))
    return X.bind(starts, lambda s: F.transform(s, lambda i, j: F.struct(
        F.get(tokens, i).alias("token"), (F.coalesce(F.get(s, j + 1), F.size(tokens)) - i).alias("tf"))))


class TextIndex:
    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        self._tables: dict[str, tuple[DataFrame, int]] = {}

    # --- writing --------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, columns: list[str], batch: int, id_col: str = "doc_id") -> None:
        """New and changed documents, one row per id; their texts are the columns, joined by blanks."""
        self.add_tokens(docs.select(F.col(id_col).alias("doc_id"), X.index_tokens(F.concat_ws(" ", *columns)).alias("tokens")), batch)

    def add_tokens(self, docs: DataFrame, batch: int) -> None:
        """``add`` for documents (doc_id, tokens) that were tokenised before; an id may be a struct."""
        rows = docs.select("doc_id", F.array_sort("tokens").alias("tokens"))
        self._add(rows.select("doc_id", F.size("tokens").alias("doc_len"), counted("tokens").alias("terms")), batch)

    def _add(self, rows: DataFrame, batch: int) -> None:
        """Documents (doc_id, doc_len, terms) as a batch; postings are made from the written documents in one shuffle."""
        documents, number = f"{self.name}_documents", f"{batch:010d}"
        self.store.append(documents, rows.select("doc_id", "doc_len", "terms", F.lit(batch).cast("long").alias("batch"), F.lit(False).alias("gone")), number)
        written = self.store.batch(documents, number)
        blocks = max(1, -(-written.count() // BLOCK_DOCS))
        shares = max(1, min(64, blocks // 1024))  # tasks per folder, so that none holds a whole bucket of a large batch
        block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
        posted = written.select("doc_id", "doc_len", block.alias("block"), F.inline("terms")).withColumn("bucket", bucket()).withColumn(
            "share", F.pmod("block", F.lit(shares)))
        dealt = posted.repartition(BUCKETS * shares, "bucket", "share").sortWithinPartitions("bucket", "token", "block").select(
            "bucket", "token", "block", "doc_id", "tf", "doc_len", F.lit(batch).cast("long").alias("batch"))
        postings, blocks_table = f"{self.name}_postings", f"{self.name}_blocks"
        self.store.append(postings, dealt, number, partition_by=("bucket",))
        # a token's postings lie in few files, so these combine before the shuffle
        stats = self.store.batch(postings, number, self._schema(written)).withColumn("level", F.floor(F.log2("tf")).cast("int")).groupBy(
            "bucket", "token", "level", "batch").agg(
            F.count("*").alias("n"), F.sum("tf").alias("uses"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))
        self.store.append(blocks_table, stats, number)
        self._tables.clear()

    def remove(self, ids: DataFrame, batch: int, id_col: str = "doc_id") -> None:
        """Documents that count no longer; ``batch`` is newer than theirs."""
        rows = ids.select(F.col(id_col).alias("doc_id")).distinct().select(
            "doc_id", F.lit(0).alias("doc_len"), F.array().cast("array<struct<token:string,tf:int>>").alias("terms"), F.lit(batch).cast("long").alias("batch"), F.lit(True).alias("gone"))
        self.store.append(f"{self.name}_documents", rows, f"{batch:010d}")
        self._tables.clear()

    # --- reading --------------------------------------------------------------------------------------------------

    def _read(self, table: str) -> tuple[DataFrame, int]:
        """A table and its number of batches, listed once until this object writes."""
        if table not in self._tables:
            name = f"{self.name}_{table}"
            schema = self._schema(self._read("documents")[0]) if table == "postings" else None
            self._tables[table] = self.store.read(name, schema=schema), len(self.store.batches(name))
        return self._tables[table]

    @staticmethod
    def _schema(documents: DataFrame) -> str:
        """Of the postings; their folders may hold no file."""
        return f"token string, block int, doc_id {documents.schema['doc_id'].dataType.simpleString()}, tf int, doc_len int, batch bigint, bucket int"

    @property
    def _layered(self) -> bool:
        return self._read("documents")[1] > 1

    def documents(self) -> DataFrame:
        """(doc_id, doc_len, batch) of the documents that count."""
        rows = self._read("documents")[0].select("doc_id", "doc_len", "batch", "gone")
        if not self._layered:
            return rows.select("doc_id", "doc_len", "batch")
        newest = rows.groupBy("doc_id").agg(F.max_by(F.struct("doc_len", "batch", "gone"), "batch").alias("r"))
        return newest.filter("NOT r.gone").select("doc_id", "r.doc_len", "r.batch")

    def _of(self, table: str, tokens: DataFrame | None) -> DataFrame:
        rows = self._read(table)[0]
        if tokens is None:
            return rows
        wanted = tokens.select("token").distinct().withColumn("bucket", bucket())
        return rows.join(wanted, ["bucket", "token"], "left_semi")

    def blocks(self, tokens: DataFrame | None = None) -> DataFrame:
        """(bucket, token, level, batch, n, uses, max_tf, min_len), of all tokens or of those in ``tokens.token``; superseded documents still count."""
        return self._of("blocks", tokens)

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """(bucket, token, block, batch, doc_id, tf, doc_len) of documents that count."""
        rows = self._of("postings", tokens)
        return rows.join(self.documents().select("doc_id", "batch"), ["doc_id", "batch"], "left_semi") if self._layered else rows

    def frequency(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, df): documents that hold the token."""
        if self._layered:
            return self.postings(tokens).groupBy("token").agg(F.count("*").alias("df"))
        return self.blocks(tokens).groupBy("token").agg(F.sum("n").alias("df"))

    def stats(self) -> DataFrame:
        """One row: (n_docs, avg_len)."""
        return self.documents().agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))

    def gaps(self, ids: DataFrame) -> DataFrame:
        """Ids without a posting: not in the index, removed, or without a token."""
        return ids.join(self.documents().filter("doc_len > 0").select("doc_id"), "doc_id", "left_anti")

    def uses(self) -> DataFrame:
        """(token, df, uses): documents that hold the token, and how often all of them do."""
        if self._layered:
            return self.postings().groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))
        return self.blocks().groupBy("token").agg(F.sum("n").alias("df"), F.sum("uses").alias("uses"))

    def compact(self) -> None:
        """All batches as one, for an index whose writers rest: superseded and removed documents go."""
        batches = self.store.batches(f"{self.name}_documents")
        if len(batches) < 2:
            return
        batch = int(batches[-1]) + 1
        live = self.documents().select("doc_id", "batch")
        rows = self._read("documents")[0].join(live, ["doc_id", "batch"], "left_semi").select("doc_id", "doc_len", "terms")
        fresh = f"{self.name}_compact"
        TextIndex(self.store, fresh)._add(rows, batch)
        for table in ("documents", "postings", "blocks"):
            self.store.take_over(f"{fresh}_{table}", f"{self.name}_{table}")
        self._tables.clear()


def build(docs: DataFrame, columns: list[str], id_col: str = "doc_id", name: str = "docs") -> TextIndex:
    """An index of one batch in this application's folder."""
    spark: SparkSession = docs.sparkSession
    index = TextIndex(Store(spark, f"{run_dir(spark)}/index-{uuid.uuid4().hex}"), name)
    index.add(docs, columns, 1, id_col)
    return index
