"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are scored letter run by letter run, lower-cased, each framed by a boundary sign. Counts of 1- to ``ORDER``-grams come from a
bounded sample of labelled rows and add up in Spark. Every order is one sorted array of 64-bit gram hashes over all languages
beside two matrices, one column per language: the discounted probability of a gram, and the weight it gives to the shorter
context when it is one itself. The lowest cross-entropy per character wins. Rejection is calibrated on labelled rows outside
that sample: a text whose best cross-entropy lies above their quantile, widened for short texts, is rejected.

Defined cases: a text that is null or has no letter is ``und``, rejected, with score 0; rows without text or label are not
learned from; ties go to the language first in order; ids may be null or repeated; an empty table gives an empty table; with
nothing to learn from, every text is ``und``; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reliq.llm.store import free_name, slices, worker_keeps

ORDER, DISCOUNT = 4, 0.75
#: Labelled rows per language that the models, and the calibration, learn from at most: those with the smallest hashed ids.
FIT_ROWS, CALIBRATION_ROWS = 500, 400
#: Sampled ids that are broadcast at most; beyond it the sample is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Distinct letter runs a worker remembers; beyond it forgets all and goes on. New ones scored at once.
REMEMBERED, _WORDS = 100_000, 8192
#: Rejection: this quantile of the calibration rows' cross-entropy, times the slack.
QUANTILE, SLACK = 0.999, 1.15

RUNS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    #: per order: sorted gram hashes, probabilities and context weights (last row: not found)
    hashes: list[np.ndarray]
    prob: list[np.ndarray]
    weight: list[np.ndarray]
    base: float
    #: natural-log cross-entropy per character above which a text is rejected, and its spread for one character
    limit: float = float("inf")
    spread: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each place; places before n - 1 hold no gram."""
    h = np.full(len(codes), np.uint64(n))
    for back in range(n - 1, -1, -1):
        shifted = np.zeros_like(codes)
        shifted[back:] = codes[:len(codes) - back] if back else codes
        h = (h ^ shifted) * _MIX
        h ^= h >> np.uint64(29)
    return h


def letter_runs(text: str) -> list[str]:
    return RUNS.findall(text.lower())


def _gram_counts(words: Counter) -> Counter:
    """Counts of all 1- to ORDER-grams of framed words; a gram is predicted at its last sign."""
    grams: Counter = Counter()
    for word, times in words.items():
        framed = f" {word} "
        for end in range(2, len(framed) + 1):
            for n in range(1, min(ORDER, end) + 1):
                grams[framed[end - n:end]] += times
    return grams


def build(counts: dict[str, dict[str, int]]) -> Model:
    """Models from gram counts per language."""
    langs = sorted(counts)
    signs = {g for c in counts.values() for g in c if len(g) == 1}
    prob = [defaultdict(lambda: [0.0] * len(langs)) for _ in range(ORDER)]
    weight = [defaultdict(lambda: [1.0] * len(langs)) for _ in range(ORDER)]
    for at, lang in enumerate(langs):
        grams = counts[lang]
        left: Counter = Counter(g[1:] for g in grams if len(g) > 1)
        by_order: list[dict[str, int]] = [{} for _ in range(ORDER)]
        for g, n in grams.items():
            # continuation counts below the highest order; grams at a word's start have no left neighbour
            by_order[len(g) - 1][g] = n if len(g) == ORDER or (len(g) > 1 and g[0] == " ") else max(left[g], 1)
        for order, own in enumerate(by_order):
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, n in own.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            for g, n in own.items():
                prob[order][g][at] = max(n - DISCOUNT, 0) / total[g[:-1]]
            for context, n in total.items():
                # the empty context has one row of its own, see score()
                (weight[order - 1] if order else weight[0])[context][at] = DISCOUNT * kinds[context] / n
    hashes, probs, weights = [], [], []
    for order in range(ORDER):
        grams = [g for g in set(prob[order]) | set(weight[order]) if len(g) == order + 1]
        keys = np.array([int(_gram_hashes(_codes(g), len(g))[-1]) for g in grams], np.uint64)
        place = np.argsort(keys)
        p = np.zeros((len(grams) + 1, len(langs)), np.float32)
        w = np.ones((len(grams) + 1, len(langs)), np.float32)
        for row, at in enumerate(place):
            p[row], w[row] = prob[order].get(grams[at], p[-1]), weight[order].get(grams[at], w[-1])
        hashes.append(keys[place])
        probs.append(p)
        weights.append(w)
    model = Model(langs, hashes, probs, weights, 1 / (len(signs) + 1))
    model.weight.append(np.array([weight[0][""] if "" in weight[0] else [1.0] * len(langs)], np.float32))
    return model


def score_words(model: Model, words: list[str]) -> np.ndarray:
    """Per word: log-probability in each language, then the number of signs scored."""
    out = np.zeros((len(words), len(model.langs) + 1))
    if not words:
        return out
    codes = _codes(f" {' '.join(words)} ")
    n = len(codes)
    bounds = np.flatnonzero(codes == np.uint64(32))
    since = np.arange(n) - np.maximum.accumulate(np.where(codes == np.uint64(32), np.arange(n), 0))
    # a boundary sign is predicted from the word before it
    since[bounds[1:]] = np.diff(bounds)
    p = np.full((n, len(model.langs)), model.base)
    last = None
    for order in range(ORDER):
        known = model.hashes[order]
        h = _gram_hashes(codes, order + 1)
        at = np.searchsorted(known, h)
        at[(at >= len(known)) | (known[np.minimum(at, max(len(known) - 1, 0))] != h if len(known) else True)] = len(known)
        fits = since >= order
        weight = model.weight[ORDER] if last is None else model.weight[order - 1][np.concatenate(([len(model.hashes[order - 1])], last[:-1]))]
        p = np.where(fits[:, None], model.prob[order][at] + weight * p, p)
        last = at
    logs = np.log(np.maximum(p, 1e-12))
    out[:, :-1] = np.add.reduceat(logs, bounds[:-1] + 1, axis=0)
    out[:, -1] = np.diff(bounds)
    return out


class _Memory:
    """Letter run to its row of scores."""

    def __init__(self, model: Model):
        self.model, self.place, self.rows = model, {}, np.zeros((0, len(model.langs) + 1))

    def totals(self, texts: list[str]) -> np.ndarray:
        runs = [letter_runs(t) for t in texts]
        new = list({r for rs in runs for r in rs if r not in self.place})
        if len(self.place) + len(new) > REMEMBERED:
            self.place, self.rows = {}, self.rows[:0]
            new = list({r for rs in runs for r in rs})
        if new:
            base = len(self.rows)
            self.place.update(zip(new, range(base, base + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *(score_words(self.model, new[i:i + _WORDS]) for i in range(0, len(new), _WORDS))])
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, rs in enumerate(runs):
            if rs:
                out[i] = self.rows[np.fromiter(map(self.place.__getitem__, rs), np.int64, len(rs))].sum(axis=0)
        return out


#: Bytes of text that a worker holds, and characters that it scores, at once.
_PART = 1 << 20


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _PART:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def predict(model: Model, docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", prefix: str = "") -> DataFrame:
    """The columns named in ``keep``, then lang_pred, score, cross_entropy, n_signs and rejected (with ``prefix``) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_keeps(("language", model.key), lambda: _Memory(model))
        for batch in (part for whole in batches for part in slices(whole, whole.schema.field(place).name, _PART)):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            totals = np.concatenate([memory.totals(part) for _, part in _parts(texts)]) if texts else np.zeros((0, len(model.langs) + 1))
            signs = totals[:, -1]
            lettered = np.array([n > 0 and any(map(str.isalpha, t)) for n, t in zip(signs, texts, strict=True)], bool) & (len(model.langs) > 0)
            mean = totals[:, :-1] / np.maximum(signs, 1)[:, None]
            if len(model.langs):
                best = mean.argmax(axis=1)
                top = mean[np.arange(len(mean)), best]
                share = 1 / np.exp((mean - top[:, None]) * np.minimum(signs, 40)[:, None]).sum(axis=1)
            else:
                best, top, share = (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)))
            names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            limit = model.limit + 4 * model.spread / np.sqrt(np.maximum(signs, 1))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(np.where(lettered, share, 0.0)),
                pa.array(np.where(lettered, -top, 0.0)), pa.array(signs.astype(np.int64)), pa.array(~lettered | (-top > limit))],
                [f.name for f in schema.fields])

    answers = "lang_pred string, score double, cross_entropy double, n_signs long, rejected boolean"
    kept = docs.select(*keep).schema.fields
    schema = T.StructType(kept + [T.StructField(prefix + f.name, f.dataType) for f in T.StructType.fromDDL(answers).fields])
    # the text travels once
    place = list(keep).index(text_col) if text_col in keep else len(keep)
    extra = [] if text_col in keep else [F.col(text_col).cast("string").alias(free_name(docs, "_text"))]
    return docs.select(*keep, *extra).mapInArrow(run, schema)


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, text, lang) of at most ``rows`` labelled rows per language."""
    labelled = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    place = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).distinct().withColumn(
        "place", F.xxhash64("doc_id")).withColumn("n", F.row_number().over(place)).filter(F.col("n") <= rows).select("doc_id", "lang")
    spark = docs.sparkSession
    ids = chosen.limit(BROADCAST_ROWS + 1).toPandas()
    known = F.broadcast(spark.createDataFrame(ids, "doc_id long, lang string")) if len(ids) <= BROADCAST_ROWS else chosen
    texts = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return texts.join(known, ["doc_id", "lang"], "left_semi")


def fit(docs: DataFrame, learn: Column, calibrate: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Models learned from rows where ``learn`` holds; the rejection limit from rows where ``calibrate`` holds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words[lang].update(letter_runs(text))
        for lang, own in words.items():
            grams = _gram_counts(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams.keys(), pa.string()),
                                              "n": pa.array(grams.values(), pa.int64())})

    sample = _sample(docs, id_col, text_col, lang_col, learn, fit_rows)
    counted = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for batch in counted.toArrow().to_batches():
        for lang, gram, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
            counts[lang][gram] = n
    model = build(counts)
    held = _sample(docs, id_col, text_col, lang_col, calibrate, calibration_rows)
    seen = predict(model, held, ()).filter("lang_pred <> 'und'").select("cross_entropy", "n_signs").toPandas()
    if len(seen):
        typical = float(np.median(seen["cross_entropy"]))
        model.limit = SLACK * float(np.quantile(seen["cross_entropy"], QUANTILE))
        model.spread = float(np.std((seen["cross_entropy"] - typical) * np.sqrt(seen["n_signs"]).clip(upper=20)))
    return model
