"""Text search over documents: term predicates, BM25 top-k, duplicate candidates.

``docs`` tables carry ``doc_id`` and text columns. Queries come as a table, all
answered in one job. No join pairs every query with every document: term
predicates join on the rarest term, and BM25 opens only the postings of those terms
without which no document can reach the top k (an exact bound, not a cut-off).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq import checks
from reliq.functions import text as X
from reliq.operators import text_index
from reliq.operators.text_index import TextIndex
from reliq.session import run_dir

# The published BM25 constants and the floor for terms in over half of the documents.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
SEED_POSTINGS = 2_000


# A private-use character as a term of its own between columns, so that no phrase crosses them.
_EDGE = "\ue000"


def term_text(*columns: str) -> Column:
    """Folded terms of the columns as one text, single-spaced with a space at both ends."""
    joined = X.fold(F.concat_ws(f" {_EDGE} ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(joined, rf"[^\p{{L}}\p{{N}}{_EDGE}]+", " ")), F.lit(" "))


def text_match(terms: Column, all_of=(), any_of=(), none_of=(), phrase: str | None = None, prefix: str | None = None) -> Column:
    """Predicate over a ``term_text`` column, from plain words; cannot be malformed."""
    def has(words: str) -> Column:
        return F.contains(terms, F.lit(f" {' '.join(_terms(words))} ")) if _terms(words) else F.lit(False)

    parts = [has(w) for w in all_of] + [~has(w) for w in none_of]
    if any_of:
        parts.append(reduce(lambda a, b: a | b, [has(w) for w in any_of]))
    if phrase is not None:
        parts.append(has(phrase))
    if prefix is not None:
        stem = " ".join(_terms(prefix))
        parts.append(F.contains(terms, F.lit(f" {stem}")) if stem else F.lit(False))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def _terms(words: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", words.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


def phrases(text: Column) -> Column:
    """The words of a query, each as the phrase of terms it is made of (``test_login`` is two terms)."""
    words = F.split(X.fold(text), r"\s+")
    spaced = F.transform(words, lambda w: F.trim(F.regexp_replace(w, r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.filter(spaced, lambda w: w != ""))


def all_terms_join(queries: DataFrame, query_id: str, docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(query_id, key) of documents whose ``terms`` text holds every phrase of ``queries.phrases``.

    Only keys travel with the tokens. Each query joins on its rarest term and checks its phrases
    on the texts it found, so a term that is everywhere does not pair everything.
    """
    tokens = F.array_distinct(F.split(F.trim(F.col(terms)), " "))
    wanted = queries.filter(F.size("phrases") > 0).select(
        query_id, "phrases", F.explode(F.array_distinct(F.flatten(F.transform("phrases", lambda p: F.split(p, " "))))).alias("_token")
    )
    vocabulary = wanted.select("_token").distinct()
    posted = docs.select(key, F.explode(tokens).alias("_token")).join(vocabulary, "_token", "left_semi")
    frequency = posted.groupBy("_token").agg(F.count("*").alias("_df"))
    anchors = wanted.join(frequency, "_token", "left").groupBy(query_id).agg(
        F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("n"), "_token")).alias("_rarest"), F.first("phrases").alias("phrases")
    ).withColumn("_token", F.col("_rarest._token")).drop("_rarest")
    found = anchors.join(posted, "_token").join(docs.select(key, terms), key)
    return found.filter(
        F.forall("phrases", lambda p: F.contains(F.col(terms), F.concat(F.lit(" "), p, F.lit(" "))))
    ).select(query_id, key)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back: used by several branches, safe if executors go."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def query_terms(queries: DataFrame) -> DataFrame:
    """Terms per query with their number of uses."""
    return queries.select("query_id", F.explode(X.index_tokens(F.col("text"))).alias("token")).groupBy(
        "query_id", "token").agg(F.count("*").alias("qtf"))


def index_of(docs: DataFrame | TextIndex, columns: list[str]) -> TextIndex:
    """``docs`` itself if it is an index, else a new one over its columns."""
    return docs if isinstance(docs, TextIndex) else text_index.build(docs, columns)


def _impact(tf: str, doc_len: str) -> Column:
    """What a posting adds per unit of its term's weight; grows with tf, falls with the document's length."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(doc_len) / F.col("avg_len")))


def bm25_top(queries: DataFrame, docs: DataFrame | TextIndex, columns: list[str], k: int) -> DataFrame:
    """The k best documents per query: ``(query_id, doc_id, score, rank)``, any term may match.

    First the postings of each query's rarest terms give it a score that its k-th document reaches for certain. What a query's
    weakest terms can add up to at most stays below that score: a document that is found by these terms alone is no candidate, so
    only the other terms' postings are opened. Candidates that can still reach the score are then looked up in the weak terms.
    """
    return best_by_terms(materialize(query_terms(queries), "terms"), index_of(docs, columns), k)


def best_by_terms(terms: DataFrame, index: TextIndex, k: int, frequency: DataFrame | None = None) -> DataFrame:
    """``bm25_top`` for stored terms (query_id, token, qtf); ``frequency`` (token, df) stands in for the index's own.

    What is written on the way has a known size, so that Spark can send a few terms or candidates to the postings instead of moving these.
    """
    frequency = index.frequency(terms) if frequency is None else frequency
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    stats = F.broadcast(index.stats())
    highest = index.blocks(terms).join(stats).groupBy("token").agg(F.max(_impact("max_tf", "min_len")).alias("highest"))
    weighted = materialize(terms.join(frequency, "token").join(highest, "token").join(stats).select(
        "query_id", "token", "df", "avg_len", (F.col("qtf") * idf).alias("weight"), (F.col("qtf") * idf * F.col("highest")).alias("most")).withColumn(
        "bucket", text_index.bucket()), "weights")
    on = ["bucket", "token"]
    postings = index.postings(weighted).select(*on, "doc_id", "tf", "doc_len")
    points = F.col("weight") * _impact("tf", "doc_len")

    def best(df: DataFrame, n: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    rare_first = Window.partitionBy("query_id").orderBy("df", "token")
    seeds = weighted.withColumn("_read", F.sum("df").over(rare_first)).withColumn("_pos", F.row_number().over(rare_first)).filter(
        (F.col("_read") <= SEED_POSTINGS) | (F.col("_pos") == 1)).select("query_id", *on, "weight", "avg_len")
    seeded = seeds.join(postings, on).groupBy("query_id", "doc_id").agg(F.sum(points).alias("score"))
    # less by more than summing in another order, and rounding below, can change
    floor = best(seeded, k).filter(F.col("rank") == k).select("query_id", (F.col("score") * (1 - 1e-9) - 2e-9).alias("floor"))
    weakest = Window.partitionBy("query_id").orderBy("most", "token")
    split = materialize(weighted.join(floor, "query_id", "left").withColumn("_sum", F.sum("most").over(weakest)).withColumn(
        "weak", F.coalesce(F.col("_sum") < F.col("floor"), F.lit(False))).withColumn(
        "rest", F.coalesce(F.max(F.when(F.col("weak"), F.col("_sum"))).over(Window.partitionBy("query_id")), F.lit(0.0))).drop("_sum"), "split-terms")
    opened = split.filter("NOT weak").select("query_id", *on, "weight", "avg_len", "rest", "floor").join(postings, on)
    found = opened.groupBy("query_id", "doc_id").agg(F.sum(points).alias("points"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))
    candidates = materialize(found.filter("floor IS NULL OR points + rest >= floor").select("query_id", "doc_id", "points", "rest"), "candidates")
    # What candidates have already is certain too, and mostly more than the first floor.
    sure = best(candidates.withColumnRenamed("points", "score"), k).filter(F.col("rank") == k).select("query_id", (F.col("score") * (1 - 1e-9) - 2e-9).alias("sure"))
    near = materialize(candidates.join(sure, "query_id", "left").filter("sure IS NULL OR points + rest >= sure").select("query_id", "doc_id", "points"), "near")
    weak = near.select("query_id", "doc_id").join(split.filter("weak").select("query_id", *on, "weight", "avg_len"), "query_id")
    added = weak.join(postings, [*on, "doc_id"]).select("query_id", "doc_id", points.alias("points"))
    total = near.unionByName(added).groupBy("query_id", "doc_id").agg(F.round(F.sum("points"), 9).alias("score"))
    return best(total, k).select("query_id", "doc_id", "score", "rank")


def search(queries: DataFrame, docs: DataFrame | TextIndex, columns: list[str], limit: int = 5) -> DataFrame:
    return bm25_top(queries, docs, columns, checks.clamp(limit, 1, checks.MAX_SEARCH_LIMIT, 5))


def search_contains(docs: DataFrame, text: str, columns: list[str], limit: int = 5) -> DataFrame:
    """One query without an index: rank by how many of its words occur anywhere, then newest."""
    import re

    words = [w.lower() for w in re.findall(r"\w+", text or "")]
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    score = sum((F.contains(F.col("_hay"), F.lit(w)).cast("int") for w in words), F.lit(0))
    hits = docs.withColumn("_hay", haystack).withColumn("score", score).filter(F.col("score") > 0).drop("_hay")
    return hits.orderBy(F.desc("score"), F.desc("updated"), "doc_id").limit(checks.clamp(limit, 1, checks.MAX_SEARCH_LIMIT, 5))


def find_duplicates(queries: DataFrame, docs: DataFrame, columns: list[str], limit: int = 5,
                    overlap_columns: tuple[str, ...] = ("summary", "body"), index: TextIndex | None = None) -> DataFrame:
    """BM25 pool of three times ``limit``, re-ranked by the share of the query's words found."""
    limit = checks.clamp(limit, 1, checks.MAX_DUPLICATE_LIMIT, 5)
    pool = bm25_top(queries, index or docs, columns, limit * 3)
    words = queries.select("query_id", X.long_word_set(F.col("text")).alias("_q"))
    # Only pool documents get a word set: the pool has at most 3 * limit rows per query.
    texts = docs.select("doc_id", F.concat_ws(" ", *overlap_columns).alias("_t")).join(pool.select("doc_id").distinct(), "doc_id", "left_semi")
    bodies = texts.select("doc_id", X.long_word_set(F.col("_t")).alias("_d"))
    scored = pool.join(words, "query_id").join(bodies, "doc_id").select(
        "query_id", "doc_id", F.col("rank").alias("pool_rank"), F.round(X.overlap_ratio(F.col("_q"), F.col("_d")), 9).alias("_s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_s"), "pool_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "query_id", "doc_id", F.round("_s", 3).alias("score"), "rank")
