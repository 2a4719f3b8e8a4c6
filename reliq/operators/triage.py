"""Triage parts: learned patterns, prior lookup, classification."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliq.checks import require_iso
from reliq.functions import signatures as S
from reliq.functions import taxonomy as T
from reliq.functions import text as X
from reliq.operators import search

SAMPLE_CHARS = 4000
RETENTION_DAYS = 180
MAX_PER_PROJECT = 500
FUZZY_POOL = 10
#: Wanted signatures and patterns of a block at most, and patterns of one where there are few.
ASKED_BLOCK, PATTERN_BLOCK, LEAST_BLOCK = 1 << 16, 1 << 15, 1 << 10


def sign(excerpts: DataFrame) -> DataFrame:
    """Add the signature and the telling words of each excerpt."""
    return (
        excerpts.withColumn("_norm", S.normalize_failure(F.col("excerpt")))
        .withColumn("signature", S.failure_signature(F.col("_norm")))
        .withColumn("tokens", S.fuzzy_tokens(F.col("_norm")))
        .drop("_norm")
    )


def classify(excerpts: DataFrame, categories=T.CATEGORIES, classifier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Category per ``log_id``: the plugged classifier where its answer is valid, else the rules.

    ``classifier`` gets the excerpts and returns ``(log_id, category, confidence)``
    for any of them, optionally with ``evidence``.
    """
    ruled = excerpts.withColumn("_r", T.classify(F.col("excerpt"), categories))
    if classifier is None:
        return ruled.select("*", "_r.*").drop("_r")
    answers = classifier(excerpts)
    keys = [c.key for c in categories]
    score = F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(T.UNKNOWN_CONFIDENCE))
    score = F.when(F.isnan(score) | (F.abs(score) == float("inf")), T.UNKNOWN_CONFIDENCE).otherwise(score)
    usable = answers.filter(F.col("category").isin(*keys)).select(
        "log_id", F.col("category").alias("_c"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("_s"),
        (F.col("evidence") if "evidence" in answers.columns else F.lit(None).cast("string")).alias("_e"))
    usable = usable.dropDuplicates(["log_id"])
    valid = F.col("_c").isNotNull()
    return ruled.join(usable, "log_id", "left").select(
        *excerpts.columns,
        F.coalesce("_c", "_r.category").alias("category"),
        F.coalesce("_s", "_r.confidence").alias("confidence"),
        F.when(valid, F.col("_e")).otherwise(F.col("_r.evidence")).alias("evidence"),
        F.when(valid, "plugged").otherwise("heuristic").alias("method"),
    )


def observations(triaged: DataFrame) -> DataFrame:
    """Results worth learning: signed, and not a rule guess on a log without a signal."""
    return triaged.filter(F.col("signature").isNotNull() & ~(F.col("low_signal") & (F.col("method") == "heuristic")))


def record_patterns(stored: DataFrame | None, observed: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """The pattern table after a batch of ``(project, signature, category, excerpt, seen_at, log_id)``.

    The batch combines map-side into one row per (project, signature); the last
    observation (by time, then log) gives category and sample.
    """
    last = F.struct("seen_at", "log_id")
    batch = observed.groupBy("project", "signature").agg(
        F.count("*").alias("n"), F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi"),
        F.max(F.struct(last.alias("o"), "category", F.substring("excerpt", 1, sample_chars).alias("sample"))).alias("b"))
    return merge_patterns(stored, batch.select(
        "project", "signature", "b.category", F.col("n").alias("occurrences"), F.col("lo").alias("first_seen"), F.col("hi").alias("last_seen"), "b.sample"))


def merge_patterns(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The pattern table after a batch in the same form; the batch's category, sample and last time count, if they are not null."""
    if stored is None:
        return batch
    return stored.alias("s").join(batch.alias("b"), ["project", "signature"], "full_outer").select(
        "project", "signature",
        F.coalesce("b.category", "s.category").alias("category"),
        (F.coalesce("s.occurrences", F.lit(0)) + F.coalesce("b.occurrences", F.lit(0))).alias("occurrences"),
        F.coalesce("s.first_seen", "b.first_seen").alias("first_seen"),
        F.coalesce("b.last_seen", "s.last_seen").alias("last_seen"),
        F.coalesce("b.sample", "s.sample").alias("sample"),
    )


def prune_patterns(patterns: DataFrame, now, retention_days: int = RETENTION_DAYS, max_per_project: int | None = MAX_PER_PROJECT) -> DataFrame:
    """Drop old patterns, then all but the most recently seen of each project (none with ``None``)."""
    cutoff = require_iso(now, "now") - timedelta(days=retention_days)
    recent = patterns.filter(F.col("last_seen") >= F.lit(cutoff))
    if max_per_project is None:
        return recent
    newest = Window.partitionBy("project").orderBy(F.desc("last_seen"), "signature")
    return recent.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= max_per_project).drop("_k")


def prior_patterns(signed: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each log's known pattern: same signature, else a similar one of its project.

    ``signed`` has log_id, project, signature, tokens. The similar match is sought
    once per distinct (project, signature), among all stored patterns of the
    project, by BM25 over shared words; the first of the ten best with two
    shared words (one, if the query has only one) is taken.
    """
    known = patterns.select("project", "signature", "category", "occurrences")
    exact = signed.join(known, ["project", "signature"]).select(
        "log_id", F.col("category").alias("prior_category"), F.col("occurrences").alias("prior_occurrences"),
        F.col("signature").alias("prior_signature"), F.lit(False).alias("fuzzy"))
    missed = signed.filter(F.col("signature").isNotNull()).join(
        known.select("project", "signature"), ["project", "signature"], "left_anti")
    wanted = missed.groupBy("project", "signature").agg(F.first("tokens").alias("tokens"))
    wanted = wanted.select("project", F.col("signature").alias("wanted"), "tokens")
    similar = similar_patterns(wanted, patterns)
    fuzzy = (
        missed.select("log_id", "project", F.col("signature").alias("wanted"))
        .join(similar, ["project", "wanted"])
        .select("log_id", F.col("category").alias("prior_category"), F.col("occurrences").alias("prior_occurrences"),
                F.col("signature").alias("prior_signature"), F.lit(True).alias("fuzzy"))
    )
    return exact.unionByName(fuzzy)


def similar_patterns(wanted: DataFrame, patterns: DataFrame, pool: int = FUZZY_POOL) -> DataFrame:
    """``(project, wanted, signature, category, occurrences)``: the similar pattern per wanted signature.

    The ``pool`` best by BM25 come from blocks: those of a project's wanted signatures meet those of its patterns (``nearest``), and a block
    gives at most ``pool`` patterns for a signature, however many share a word with it. Word frequencies count over all projects.
    """
    docs = search.materialize(patterns.select("project", "signature", X.index_tokens(F.coalesce("sample", F.lit(""))).alias("_t")).select(
        "project", "signature", F.size("_t").alias("doc_len"), F.array_join("_t", " ").alias("text")), "pattern-tokens")
    # A query word may hold several index terms (snake_case); each counts as a term.
    split = F.array_distinct(F.flatten(F.transform("tokens", lambda w: F.split(w, "_"))))
    terms = search.materialize(wanted.filter(F.col("project").isNotNull()).select(
        "project", "wanted", F.explode(F.filter(split, lambda w: w != "")).alias("token")), "terms")
    # Counted before the join: the counts of words are far fewer than the words of all patterns.
    frequency = docs.select(F.explode(F.array_distinct(F.split("text", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    stats = F.broadcast(docs.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len")))
    weight = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(search.MIN_IDF))
    heavy_first = F.sort_array(F.collect_list(F.struct((-weight).alias("w"), "token")))
    asked = terms.join(frequency, "token").join(stats).groupBy("project", "wanted").agg(heavy_first.alias("_t"), F.first("avg_len").alias("avg_len")).select(
        "project", "wanted", "avg_len", F.array_join("_t.token", " ").alias("terms"), F.transform("_t.w", lambda w: -w).alias("weights"))
    ranked = nearest(search.materialize(asked, "weights"), docs, pool)
    words = patterns.select("project", "signature", "category", "occurrences", S.sample_tokens(S.normalize_failure(F.col("sample"))).alias("_words"))
    close = (
        ranked.join(wanted, ["project", "wanted"]).join(words, ["project", "signature"])
        .filter(F.size(F.array_intersect("tokens", "_words")) >= F.least(F.lit(2), F.size("tokens")))
    )
    return close.groupBy("project", "wanted").agg(F.min_by(F.struct("signature", "category", "occurrences"), "rank").alias("m")).select(
        "project", "wanted", "m.*")


def nearest(asked: DataFrame, docs: DataFrame, pool: int) -> DataFrame:
    """(project, wanted, signature, rank): the ``pool`` patterns of the same project with the highest BM25 scores.

    ``asked`` (project, wanted, avg_len, terms, weights) and ``docs`` (project, signature, doc_len, text) are written tables. Every row of
    either goes to all blocks of the other's rows in its project, so that the work grows with their product and what is moved does not.
    """
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    rows = min(PATTERN_BLOCK, max(LEAST_BLOCK, -(-docs.count() // tasks)))
    sizes = search.materialize(asked.groupBy("project").agg(F.count("*").alias("a")).join(docs.groupBy("project").agg(F.count("*").alias("d")), "project").select(
        "project", F.ceil(F.col("a") / ASKED_BLOCK).alias("a"), F.ceil(F.col("d") / rows).alias("d")), "blocks")
    zero, one = F.lit(0).cast("long"), F.lit(1)
    left = asked.join(sizes, "project").select(
        *asked.columns, F.pmod(F.xxhash64("wanted"), "a").alias("at"), F.explode(F.sequence(zero, F.col("d") - one)).alias("dt"))
    right = docs.join(sizes, "project").select(
        *docs.columns, F.explode(F.sequence(zero, F.col("a") - one)).alias("at"), F.pmod(F.xxhash64("signature"), "d").alias("dt"))

    def meet(a: pa.Table, d: pa.Table) -> pa.Table:
        return best_of_block(a, d, pool)

    key = ["project", "at", "dt"]
    left, right = left.repartition(2 * tasks, *key), right.repartition(2 * tasks, *key)  # few rows of a lot of work each
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "project string, wanted string, signature string, score double")
    order = Window.partitionBy("project", "wanted").orderBy(F.desc("score"), "signature")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool).select("project", "wanted", "signature", "rank")


def best_of_block(asked: pa.Table, docs: pa.Table, pool: int) -> pa.Table:
    """(project, wanted, signature, score): the ``pool`` best patterns of one block for each signature of another; ties in the order of patterns."""
    queries: list[np.ndarray] = []
    places: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    if asked.num_rows and docs.num_rows:
        docs = docs.sort_by("signature")
        per_query = pc.split_pattern(asked.column("terms").combine_chunks(), " ")
        vocabulary = pc.unique(per_query.flatten())
        block = _Postings(docs, vocabulary, asked.column("avg_len")[0].as_py())
        term = pc.index_in(per_query.flatten(), value_set=vocabulary).to_numpy()
        weight = asked.column("weights").combine_chunks().flatten().to_numpy()
        ends = np.cumsum(pc.list_value_length(per_query).to_numpy())
        for i, (start, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
            place, score = block.best(term[start:end], weight[start:end], pool)
            if len(place):
                queries.append(np.full(len(place), i))
                places.append(place)
                scores.append(score)
    nothing = [np.zeros(0, np.int64)]
    query, place = np.concatenate(queries or nothing), np.concatenate(places or nothing)
    return pa.table({"project": asked.column("project").take(query), "wanted": asked.column("wanted").take(query),
                     "signature": docs.column("signature").take(place), "score": np.concatenate(scores or [np.zeros(0)])})


class _Postings:
    """The postings of one block of patterns for the words that are asked for, by word, then place."""

    #: Patterns whose words are looked up at once, and those, about, whose scores tell when to stop.
    STEP, SOME = 1024, 64

    def __init__(self, docs: pa.Table, vocabulary: pa.Array, avg_len: float):
        n, self.rows = len(vocabulary), docs.num_rows
        parts = []
        for at in range(0, self.rows, self.STEP):
            words = pc.split_pattern(docs.column("text").slice(at, self.STEP).combine_chunks(), " ")
            term = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy().astype(np.int64)
            place = np.repeat(np.arange(at, at + len(words)), pc.list_value_length(words).to_numpy())
            parts.append(np.unique((place * n + term)[term >= 0], return_counts=True))
        key, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        place, term = np.divmod(key, n)
        order = np.argsort(term, kind="stable")
        self.place, tf = place[order].astype(np.int32), tf[order]
        length = docs.column("doc_len").to_numpy()[self.place]
        self.impact = tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / avg_len))
        held = np.bincount(term, minlength=n)
        self.end = np.cumsum(held)
        self.start = self.end - held
        self.highest = np.zeros(n)
        if len(key):
            self.highest[held > 0] = np.maximum.reduceat(self.impact, self.start[held > 0])
        self.sum = np.zeros(self.rows)  # of the query at hand

    def best(self, terms: np.ndarray, weights: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and rounded scores of the ``pool`` best; terms come heaviest first, and every sum is made in this order.

        Once the terms that are left cannot lift a pattern from nothing to the pool, they are looked up for those only that they can.
        """
        there = self.end[terms] > self.start[terms]
        terms, weights = terms[there], weights[there]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        most = weights * self.highest[terms]
        rest = np.append(np.cumsum(most[::-1])[::-1][1:], 0.0)
        some = np.zeros(0, np.int32)  # patterns with the heaviest words: the pool's last of these is a score that the pool's last of all reaches
        read, least, at = 0.0, 0.0, 0
        for at, t in enumerate(terms):
            place = self.place[self.start[t]:self.end[t]]
            self.sum[place] += weights[at] * self.impact[self.start[t]:self.end[t]]
            if len(some) < self.SOME:
                some = np.union1d(some, place[:self.SOME])
            read += most[at]
            if read > rest[at] and len(some) >= pool:
                # less by more than rounding below can change
                least = np.partition(self.sum[some], len(some) - pool)[len(some) - pool] * (1 - 1e-9) - 2e-9
                if rest[at] < least:
                    break
        near = np.flatnonzero(self.sum > max(least - rest[at], 0.0))
        score = self.sum[near]
        self.sum[:] = 0.0
        if len(near) > 4 * pool:
            least = max(least, np.partition(score, len(near) - pool)[len(near) - pool] * (1 - 1e-9) - 2e-9)
            near, score = near[score + rest[at] >= least], score[score + rest[at] >= least]
        for t, w in zip(terms[at + 1:], weights[at + 1:], strict=True):
            place = self.place[self.start[t]:self.end[t]]
            spot = np.minimum(np.searchsorted(place, near), len(place) - 1)
            held = place[spot] == near
            score[held] += w * self.impact[self.start[t] + spot[held]]
        score = np.round(score, 9)
        top = np.lexsort((near, -score))[:pool]
        return near[top], score[top]
