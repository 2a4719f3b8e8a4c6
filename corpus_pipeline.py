"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokenising; each stage written before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
``documents``. Lost executors cost a stage's unfinished tasks only: what came before lies in the shared folder.

Defined cases, for all stages: null texts read as empty; ids may be null or repeated; further columns of any name stay as they are,
but for the last stage, which returns its own; an empty table gives an empty table; very long texts are processed whole. Language ID
rejects what it cannot name, null and empty texts among it. Exact dedup treats null and empty texts as equal; of rows with the id that
stays one is kept. Near dedup keeps rows without an id and repeated rows of the id that stays. The mixture gives equal texts equal rates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliq.llm import bpe, exact_dedup, langid, mixing, queries, simhash
from reliq.llm.store import free_name, stored


def _prefix(docs: DataFrame) -> str:
    """Underscores that lead added columns, so many that they clash with none of ``docs``."""
    prefix = "_"
    while any(free_name(docs, prefix + name) != prefix + name for name in ADDED):
        prefix += "_"
    return prefix


#: Columns that operators add to a stage's own, behind a prefix.
ADDED = ("lang_pred", "score", "cross_entropy", "n_signs", "rejected", "n_tokens", "posterior", "rate", "copy")


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB: by Spark's setting, 64 MB, an executor holds some of them several times, beside its heap.

    A stage is executed after its function has returned, so the setting stays.
    """
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= most:
        spark.conf.set(name, str(most))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language model accepts them; the models learn from the rows' own labels, as in the query."""
    _small_batches(spark)
    model = langid.fit(docs, queries.remainder(3) == 0, queries.remainder(3) == 2)
    prefix = _prefix(docs)
    return langid.predict(model, docs, docs.columns, prefix=prefix).filter(~F.col(f"{prefix}rejected")).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: five-word shingles, a similarity of about 0.8 or more."""
    _small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=5)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as their rate says: its floor, and once more for that share of ids; rate 0 drops a row.

    Rows that are most likely clean have a rate of 1 or more; only the others are thinned.
    """
    _small_batches(spark)
    labels = queries.domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = _prefix(docs)
    mixed = mixing.mix(docs, labels, queries.TARGETS, docs.columns, prefix=prefix, whole="clean")
    times = mixing.copies(F.col(f"{prefix}rate"), "doc_id")
    kept = mixed.filter(times > 0)
    return kept.select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(f"{prefix}copy")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian unsigned 32-bit integers, and the digest of what they decode to."""
    _small_batches(spark)
    ranks = public_tokenizers.path(queries.RANKS)
    both = bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixture", mix_domains),
    ("byte_bpe", tokenize),
]

#: Language models and rates are learned, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
