"""Mixing to target weights by soft membership.

A naive Bayes classifier, learned from a table of labelled documents over hashed words, predicts each document's domain
posteriors; its log-odds per word are tempered, so that membership stays soft for long texts. Then a nonnegative rate is fitted
for every document so that the expected tokens of domain k, sum of rate * tokens * posterior_k, match the targets: projected
gradient descent on the least squares ||A r - t||^2 in the norm of (A D A^T)^-1, D = 1 / tokens, in which a step of length one
is exact as long as no rate meets the bound r >= 0. D leaves out rows at that bound, unless the step before made the fit worse.
One step per round over a small written table: tasks add up the domains' totals, the driver holds a few numbers per domain and
round, and tasks replay the rounds to get a row's rate.

Defined cases: null and empty texts have no tokens and the prior as posterior; rates of equal texts are equal; a domain without
targets has target weight 0, one that no document belongs to cannot be met; with no labelled row every posterior is uniform;
ids may be null or repeated; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliq.llm.store import free_name, id_text, slices, stored, utf8, words_of, worker_keeps

#: Labelled rows learned from at most (those with the smallest hashed ids), cells of hashed words, rounds of descent.
LABELLED_ROWS, CELLS, ROUNDS = 20_000, 1 << 16, 25
#: A text's log-odds grow with the number of its words to this power.
TEMPER = 0.5
#: Bytes of text that a worker holds at once.
_PART = 1 << 20


class _Cells(dict):
    def __init__(self, cells: int):
        self.cells = cells

    def __missing__(self, word: bytes) -> int:
        cell = xxhash.xxh32_intdigest(word) % self.cells
        if len(word) < 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = cell
        return cell


def _cells_of(text: bytes, cells: int) -> np.ndarray:
    known = worker_keeps(("cells", cells), lambda: _Cells(cells))
    words = words_of(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def learn_domains(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, log word probabilities: cells x domains) from at most ``rows`` labelled documents; labels: (doc_id, domain)."""
    spark = docs.sparkSession
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select(F.col("doc_id").cast("long"), "domain").groupBy("doc_id").agg(
        F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    known = F.broadcast(spark.createDataFrame(chosen, "doc_id long, domain string"))  # ``rows`` at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, len(domains)), np.int64)
        texts = np.zeros(len(domains), np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text", _PART)):
            for text, domain in zip(utf8(batch.column("text")), batch.column("domain").to_pylist(), strict=True):
                k = domains.index(domain)
                total[:, k] += np.bincount(_cells_of(text, cells), minlength=cells)
                texts[k] += 1
        cell, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, np.full(len(domains), -1))), pa.array(np.append(k, np.arange(len(domains)))),
                                          pa.array(np.append(total[cell, k], texts))], ["cell", "domain", "n"])

    found = id_text(docs, id_col, text_col).join(known, "doc_id").mapInArrow(count, "cell long, domain long, n long").groupBy("cell", "domain").agg(F.sum("n").alias("n"))
    counts, texts = np.zeros((cells, len(domains))), np.zeros(len(domains))
    for cell, k, n in found.toPandas().itertuples(index=False):
        if cell < 0:
            texts[k] = n
        else:
            counts[cell, k] = n
    return np.log((texts + 1) / (texts.sum() + len(domains))), np.log((counts + 0.5) / (counts.sum(0) + 0.5 * cells))


def _memberships(texts: list[bytes], prior: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, posteriors) of texts."""
    n, p = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(prior)))
    for i, text in enumerate(texts):
        own = _cells_of(text, len(words))
        odds = prior + (words[own].sum(0) * len(own) ** (TEMPER - 1) if len(own) else 0)
        share = np.exp(odds - odds.max())
        n[i], p[i] = len(own), share / share.sum()
    return n, p


def posteriors(docs: DataFrame, prior: np.ndarray, words: np.ndarray, text_col: str = "text") -> DataFrame:
    """(n_tokens, posterior: array<double>) of every row; tokens are words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", _PART)):
            n, p = _memberships(utf8(batch.column("text")), prior, words)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], ["n_tokens", "posterior"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, posterior array<double>")


def _least_rates(posterior: np.ndarray, whole: int | None) -> np.ndarray:
    """1 for rows that belong most likely to the domain at place ``whole``, else 0."""
    return np.zeros(len(posterior)) if whole is None else (posterior[:, whole] >= posterior.max(1, initial=0)).astype(np.float64)


def _rates(posterior: np.ndarray, steps: list[np.ndarray], whole: int | None = None) -> np.ndarray:
    rate, least = np.ones(len(posterior)), _least_rates(posterior, whole)
    for step in steps:
        rate = np.maximum(rate - posterior @ step, least)
    return rate


def fit_rates(members: DataFrame, weights: list[float], rounds: int = ROUNDS, tolerance: float = 1e-4, whole: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, expected totals, targets) for rows (n_tokens, posterior): the steps give every row's rate.

    Ends when every domain's total is within ``tolerance`` of all tokens; the best rates found count. Rows of the domain ``whole``
    keep a rate of 1 or more; the targets may then be out of reach, and the fit also ends after three rounds without a better one.
    """
    k = len(weights)

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(2 * k + k * k)
            for rows in batches:
                if len(rows):
                    p, n = np.stack(rows["posterior"]), rows["n_tokens"].to_numpy(np.float64)
                    rate = _rates(p, steps, whole)
                    free = (rate > _least_rates(p, whole)) | (not steps)
                    out += np.concatenate([(n * rate) @ p, n @ p, ((p * (n * free)[:, None]).T @ p).ravel()])
            yield pd.DataFrame({"at": range(len(out)), "x": out})

        out = np.zeros(2 * k + k * k)
        for r in members.mapInPandas(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r.at] = r.x
        return out[:k], out[k:2 * k], out[2 * k:].reshape(k, k)

    now, mass, gram = totals([])
    target = np.array(weights, np.float64) / max(sum(weights), 1e-300) * mass.sum()
    full, steps, best, waited = gram, [], ([], now), 0

    def gap(x: np.ndarray) -> float:
        return float(np.abs(x - target).max())

    for _ in range(rounds):
        if gap(best[1]) <= tolerance * max(mass.sum(), 1):
            break
        metric = gram if gap(now) <= gap(best[1]) else full
        steps = [*steps, np.linalg.pinv(metric, rcond=1e-10, hermitian=True) @ (now - target)]
        now, _, gram = totals(steps)
        waited = 0 if gap(now) < 0.99 * gap(best[1]) else waited + 1
        if gap(now) < gap(best[1]):
            best = steps, now
        if whole is not None and waited == 3:
            break
    return best[0], best[1], target


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text",
        prefix: str = "", labelled_rows: int = LABELLED_ROWS, cells: int = CELLS, rounds: int = ROUNDS, whole: str | None = None) -> DataFrame:
    """The columns named in ``keep``, then n_tokens, posterior and rate (with ``prefix``) for every row.

    Posteriors are in the order of ``weights``; labels: (doc_id, domain). Texts are read for the fit, and again for the answer, so that no row is joined.
    Rows that most likely belong to the domain ``whole`` keep a rate of 1 or more, whatever the targets.
    """
    prior, words = learn_domains(docs, labels, list(weights), id_col, text_col, labelled_rows, cells)
    members = stored(posteriors(docs, prior, words, text_col), "memberships")
    place_whole = None if whole is None else list(weights).index(whole)
    steps, _, _ = fit_rates(members, list(weights.values()), rounds, whole=place_whole)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for every in batches for part in slices(every, every.schema.field(place).name, _PART)):
            n, p = _memberships(utf8(batch.column(place)), prior, words)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n), pa.array(list(p), pa.list_(pa.float64())),
                                              pa.array(_rates(p, steps, place_whole))], [f.name for f in schema.fields])

    answers = T.StructType.fromDDL("n_tokens long, posterior array<double>, rate double").fields
    schema = T.StructType(docs.select(*keep).schema.fields + [T.StructField(prefix + f.name, f.dataType) for f in answers])
    # the text travels once
    place = list(keep).index(text_col) if text_col in keep else len(keep)
    extra = [] if text_col in keep else [F.col(text_col).cast("string").alias(free_name(docs, "_text"))]
    return docs.select(*keep, *extra).mapInArrow(rated, schema)


def copies(rate, *key) -> F.Column:
    """Whole number of copies whose expectation is ``rate``: its floor, and one more for the fraction of keys with small hashes."""
    share = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + F.when(share < rate - F.floor(rate), 1).otherwise(0)).cast("int")
