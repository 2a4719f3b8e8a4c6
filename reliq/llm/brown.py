"""Language-model scoring with Brown class-based bigrams.

Words belong to classes; a text's probability is the product of class transitions and of each word's emission from its class,
mixed with a little of the unigram base. Classes come from exchange clustering in two steps. First the most frequent words, and
groups of all others by their last letters, move in rounds, each unit to the class that raises the likelihood of the class bigrams
most. Then every other word of the training text leaves its group: by its own neighbours it takes the class in which its bigrams
are most likely. Only words that were never learned from have the class of their group.

Documents are packed into blocks that hold each distinct word once, in the order of its CRC-32. A block sends its words, with their
training counts, to the words' ranges of that order; the ranges find the frequent ones. Unit bigrams add up per unit. Exchange
runs in rounds: Spark recomputes the units' class profiles, a table of fixed size, and the moves of a third of the units are settled
on that. Then blocks send the words with their neighbours' classes, the ranges add these up and answer with count and class, and
the class bigrams are counted anew from the words' own classes.

Defined cases: a null text reads as empty (one end token); a null id counts as the empty text when rows are split into training
and held out; nothing to learn from gives the uniform smoothing alone; ids may be repeated (each row is a document); an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliq.llm.store import BLOCK_BYTES, packing, stored, unpack, utf8, words_of

#: Frequent words that move in all rounds, groups that stand for the other words meanwhile, classes, rounds of exchange.
FREQUENT, GROUPS, CLASSES, ROUNDS = 2048, 511, 48, 6
#: Weight of the class model beside the unigram base, and of the class frequencies in its transitions.
CLASS_WEIGHT, PRIOR = 0.95, 2.0
#: Distinct words in one range, and distinct words taken to be in one byte when ranges are laid out (size only).
RANGE_WORDS, WORDS_PER_BYTE = 200_000, 1 / 40


def _tokens(text: bytes) -> list[bytes]:
    return words_of(text.lower())


def _shut(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _open(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _joined(words: list[bytes]) -> bytes:
    return _shut(b" ".join(words))


def _split(data: bytes) -> list[bytes]:
    return _open(data).split()


class _Block:
    """Whole documents as numbers of the block's distinct words; an end follows every document."""

    def __init__(self, docs: bytes, line: bytes):
        table = unpack(docs)
        self.ids, self.learned = table.column("doc_id").combine_chunks(), table.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        self.line, self.lengths = np.frombuffer(_open(line), "<i4"), table.column("n").to_numpy() + 1
        self.stops = np.cumsum(self.lengths)
        self.learns = np.repeat(self.learned, self.lengths)

    def spelled(self, of: np.ndarray, end: int) -> np.ndarray:
        """Every token's value by its word's, ``end`` for the ends; an end stands before every text."""
        out = np.full(int(self.lengths.sum()), end)
        is_word = np.ones(len(out), bool)
        is_word[self.stops - 1] = False
        out[is_word] = of[self.line]
        return out

    def counts(self, words: int) -> np.ndarray:
        own = self.spelled(np.arange(words), words)
        return np.bincount(own[self.learns], minlength=words + 1)[:words]


def tokenized(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, docs, words, line) for rows (doc_id, text, learn): blocks of whole documents, their distinct words, and the texts as numbers of these."""
    packed = packing(block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packed(batches):
            table = unpack(batch.column("data")[0].as_py())
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            lines = [np.zeros(0, "<i4")]
            for text in utf8(table.column("text")):
                own = _tokens(text)
                lines.append(np.fromiter(map(number.__getitem__, own), "<i4", len(own)))
            words = sorted(number, key=zlib.crc32)
            place = np.zeros(len(words), "<i4")
            place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
            docs = pa.table({"doc_id": table.column("doc_id"), "n": pa.array([len(x) for x in lines[1:]], pa.int64()), "learn": table.column("learn")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs)
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "docs": [sink.getvalue().to_pybytes()], "words": [_joined(words)],
                                              "line": [_shut(place[np.concatenate(lines)].tobytes())]})

    return rows.mapInArrow(run, "block long, docs binary, words binary, line binary")


def _ranges(words: list[bytes], ranges: int) -> list[tuple[int, slice]]:
    """Ranges of CRC-32 that hold some of the words, which are in its order, and their places."""
    part = (np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(ranges)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(part, prepend=np.uint64(ranges)))
    return [(int(part[i]), slice(i, j)) for i, j in itertools.pairwise([*starts.tolist(), len(words)])]


def group_of(word: bytes, groups: int) -> int:
    return zlib.crc32(word[-3:]) % groups


def exchange(forward: np.ndarray, backward: np.ndarray, own: np.ndarray, classes: np.ndarray, moving: np.ndarray, fixed: int) -> np.ndarray:
    """New classes after the ``moving`` units each took the best class, one after the other.

    forward, backward: class profiles of the units (right and left neighbours); own: bigrams of a unit with itself. The class
    ``fixed`` keeps its one member.
    """
    k = forward.shape[1]
    n = np.zeros((k, k))
    np.add.at(n, classes, forward)

    def part(x):
        return x * np.log(np.maximum(x, 1e-300))

    classes = classes.copy()
    for u in moving:
        old = classes[u]
        if old == fixed or not (forward[u].sum() + backward[u].sum()):
            continue
        right, left = forward[u].copy(), backward[u].copy()
        right[old] -= own[u]
        left[old] -= own[u]
        n[old] -= right
        n[:, old] -= left
        n[old, old] -= own[u]
        rows, columns = n.sum(1), n.sum(0)
        gain = (part(n + right) - part(n)).sum(1) + (part(n + left[:, None]) - part(n)).sum(0)
        diagonal = np.diag(n)
        gain += part(diagonal + right + left + own[u]) - part(diagonal + right) - part(diagonal + left) + part(diagonal)
        gain -= part(rows + right.sum() + own[u]) - part(rows) + part(columns + left.sum() + own[u]) - part(columns)
        gain[fixed] = -np.inf
        new = int(gain.argmax())
        if gain[new] <= gain[old] + 1e-9:
            new = old
        classes[u] = new
        n[new] += right
        n[:, new] += left
        n[new, new] += own[u]
    return classes


def best_classes(left: np.ndarray, right: np.ndarray, transitions: np.ndarray, fixed: int, prior: float = PRIOR) -> np.ndarray:
    """Of each word (rows; its neighbours' classes counted) the class in which its bigrams are most likely, all others' classes as they are."""
    tokens = transitions.sum(0)
    share = (tokens + 1e-9) / (tokens.sum() + 1e-9 * len(tokens))
    step = np.log((transitions + prior * share[None, :]) / (transitions.sum(1)[:, None] + prior))
    gain = left @ step + right @ step.T - left.sum(1)[:, None] * np.log(tokens + 0.5)[None, :]
    gain[:, fixed] = -np.inf
    return gain.argmax(1)


class ClassModel:
    """Everything a task needs to score, except the words' counts."""

    def __init__(self, frequent, groups, classes, transitions, types, tokens, kinds, weight, prior):
        self.frequent, self.groups, self.classes = frequent, groups, classes
        self.tokens, self.kinds, self.weight = tokens, kinds, weight
        self.class_tokens, self.class_types = transitions.sum(0), types
        share = (self.class_tokens + 1e-9) / (self.class_tokens.sum() + 1e-9 * len(types))
        self.step = (transitions + prior * share[None, :]) / (transitions.sum(1)[:, None] + prior)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.kinds + 1))

    def chances(self, previous: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        emission = (counts + 0.5) / (self.class_tokens[classes] + 0.5 * (self.class_types[classes] + 1))
        return self.weight * self.step[previous, classes] * emission + (1 - self.weight) * self.base(counts)


def brown_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, groups: int = GROUPS,
                 classes: int = CLASSES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row; scores are log10 probabilities.

    ``learn`` reads ``doc_id`` and says which rows are learned from; every row is scored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(tokenized(rows.withColumn("learn", F.coalesce(learn, F.lit(False))), block_bytes), "blocks")
    ranges = max(1, math.ceil(blocks.count() * block_bytes * WORDS_PER_BYTE / RANGE_WORDS))
    units, end = frequent + groups + 1, frequent + groups

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block, words = _Block(row.docs, row.line), _split(row.words)
                counts = block.counts(len(words))
                words = [words[i] for i in np.flatnonzero(counts)]
                counts = counts[counts > 0]
                own = _ranges(words, ranges)
                yield pd.DataFrame({"part": [p for p, _ in own], "words": [_joined(words[at]) for _, at in own],
                                    "counts": [_shut(counts[at].astype("<i8").tobytes()) for _, at in own], "docs": 0})
                yield pd.DataFrame({"part": [0], "words": [_joined([])], "counts": [_shut(b"")], "docs": [int(block.learned.sum())]})

    def add_up(asked: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        for words, raw in zip(asked["words"], asked["counts"], strict=True):
            for w, n in zip(_split(words), np.frombuffer(_open(raw), "<i8").tolist(), strict=True):
                seen[w] += n
        top = sorted(seen, key=lambda w: (-seen[w], w))[:frequent]
        return pd.DataFrame({"tokens": [sum(seen.values())], "docs": [int(asked["docs"].sum())], "kinds": [len(seen)], "top": [top], "top_counts": [[seen[w] for w in top]]})

    facts = stored(blocks.select("docs", "words", "line").mapInPandas(ask, "part int, words binary, counts binary, docs long").groupBy("part").applyInPandas(
        add_up, "tokens long, docs long, kinds long, top array<binary>, top_counts array<long>"), "word-counts")
    words_total, n_docs, n_kinds = (x or 0 for x in facts.agg(F.sum("tokens"), F.sum("docs"), F.sum("kinds")).first())
    best = facts.select(F.explode(F.arrays_zip("top", "top_counts")).alias("x")).select("x.top", "x.top_counts").orderBy(F.desc("top_counts"), "top").limit(frequent)
    common = [bytes(r.top) for r in best.collect()]
    n_kinds += n_docs > 0

    def units_of(words: list[bytes]) -> np.ndarray:
        known = dict(zip(common, range(len(common)), strict=True))
        return np.array([known[w] if w in known else frequent + group_of(w, groups) for w in words], np.int64)

    def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(units * units, np.int64)
        for batch in batches:
            for row in batch.itertuples():
                block = _Block(row.docs, row.line)
                line = block.spelled(units_of(_split(row.words)), end)
                before = np.concatenate(([end], line[:-1]))
                seen += np.bincount((before * units + line)[block.learns], minlength=units * units)
        table = seen.reshape(units, units)
        for at in range(0, units, 256):
            hit = [u for u in range(at, min(at + 256, units)) if table[u].any() or table[:, u].any()]
            yield pd.DataFrame({"unit": hit, "after": [zlib.compress(table[u].astype("<i8").tobytes(), 1) for u in hit],
                                "before": [zlib.compress(table[:, u].astype("<i8").tobytes(), 1) for u in hit]})

    def summed(own: pd.DataFrame) -> pd.DataFrame:
        both = [sum(np.frombuffer(zlib.decompress(x), "<i8") for x in own[c]) for c in ("after", "before")]
        return pd.DataFrame({"unit": own["unit"].iloc[:1], "after": [zlib.compress(both[0].tobytes(), 1)], "before": [zlib.compress(both[1].tobytes(), 1)]})

    pairs = stored(blocks.select("docs", "words", "line").mapInPandas(bigrams, "unit int, after binary, before binary").groupBy("unit").applyInPandas(
        summed, "unit int, after binary, before binary"), "bigrams")

    def profiles(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit: neighbours by class on the right and left, and bigrams with itself. units x classes numbers."""
        def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                after, before = ([np.frombuffer(zlib.decompress(x), "<i8") for x in batch[c]] for c in ("after", "before"))
                yield pd.DataFrame({"unit": batch["unit"], "right": [np.bincount(of, x, classes + 1) for x in after],
                                    "left": [np.bincount(of, x, classes + 1) for x in before], "own": [x[u] for u, x in zip(batch["unit"], after, strict=True)]})

        right, left, own = np.zeros((units, classes + 1)), np.zeros((units, classes + 1)), np.zeros(units)
        got = pairs.mapInPandas(profile, "unit int, right array<double>, left array<double>, own double").toPandas()
        if len(got):
            at = got["unit"].to_numpy()
            right[at], left[at], own[at] = np.stack(got["right"]), np.stack(got["left"]), got["own"]
        return right, left, own

    member = np.arange(units) % classes
    member[end] = classes
    for r in range(rounds):
        member = exchange(*profiles(member), member, np.arange(r % 3, units, 3), classes)
    of_units = np.zeros((classes + 1, classes + 1))
    np.add.at(of_units, member, profiles(member)[0])

    # Every other word of the training text gets a class of its own.
    sides = 2 * (classes + 1)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block, words = _Block(row.docs, row.line), _split(row.words)
                own_units = units_of(words)
                line, number = block.spelled(member[own_units], classes), block.spelled(np.arange(len(words)), len(words))
                rest = np.flatnonzero(block.learns & (np.append(own_units, 0) >= frequent)[number])
                # the token before, and the one after: an end ends every text
                cells = np.concatenate([number[rest] * sides + np.where(rest > 0, line[rest - 1], classes), number[rest] * sides + classes + 1 + line[rest + 1]])
                cells, n = np.unique(cells, return_counts=True)
                counts, borders = block.counts(len(words)), np.searchsorted(cells, np.arange(len(words) + 1) * sides)
                own = _ranges(words, ranges)
                inside = [slice(borders[at.start], borders[at.stop]) for _, at in own]
                yield pd.DataFrame({
                    "part": [p for p, _ in own], "block": row.block, "words": [_joined(words[at]) for _, at in own], "counts": [_shut(counts[at].astype("<i8").tobytes()) for _, at in own],
                    "cells": [_shut((cells[x] - at.start * sides).astype("<i8").tobytes()) for x, (_, at) in zip(inside, own, strict=True)],
                    "times": [_shut(n[x].astype("<i8").tobytes()) for x in inside]})

    def settle(asked: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        places, cells, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for words, own_cells, own_times in zip(asked["words"], asked["cells"], asked["times"], strict=True):
            at = np.array([number.setdefault(w, len(number)) for w in _split(words)], np.int64)
            own = np.frombuffer(_open(own_cells), "<i8")
            places.append(at)
            cells.append(at[own // sides] * sides + own % sides)
            times.append(np.frombuffer(_open(own_times), "<i8"))
        counts = [np.frombuffer(_open(x), "<i8") for x in asked["counts"]]
        total = np.bincount(np.concatenate(places), np.concatenate(counts), len(number)).astype("<i8")
        own_units = units_of(list(number))
        of = member[own_units].astype("<i2")
        cells, times = np.concatenate(cells), np.concatenate(times)
        order = np.argsort(cells, kind="stable")
        cells, times = cells[order], times[order]
        for start in range(0, len(number), 20_000):
            stop = min(start + 20_000, len(number))
            x = slice(*np.searchsorted(cells, (start * sides, stop * sides)))
            around = np.bincount(cells[x] - start * sides, times[x], (stop - start) * sides).reshape(stop - start, sides)
            moved = (own_units[start:stop] >= frequent) & (total[start:stop] > 0)
            of[start:stop][moved] = best_classes(around[moved, :classes + 1], around[moved, classes + 1:], of_units, classes)
        answers = pd.DataFrame({"block": asked["block"], "part": asked["part"], "counts": [_shut(total[at].tobytes()) for at in places], "classes": [_shut(of[at].tobytes()) for at in places]})
        types = pd.DataFrame({"block": [-1], "part": asked["part"].iloc[:1].to_numpy(), "types": [np.bincount(of[total > 0], minlength=classes + 1).tolist()]})
        return pd.concat([answers.assign(types=None), types.assign(counts=b"", classes=b"")])[["block", "part", "counts", "classes", "types"]]

    answers = stored(blocks.select("block", "docs", "words", "line").mapInPandas(describe, "part int, block long, words binary, counts binary, cells binary, times binary").groupBy(
        "part").applyInPandas(settle, "block long, part int, counts binary, classes binary, types array<long>"), "word-classes")

    def place(block_rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if block_rows.empty:
            return pd.DataFrame([], columns=["docs", "line", "counts", "classes", "bigrams"])
        told = told.sort_values("part")
        block = _Block(block_rows["docs"].iloc[0], block_rows["line"].iloc[0])
        counts, of = (b"".join(map(_open, told[c])) for c in ("counts", "classes"))
        line = block.spelled(np.frombuffer(of, "<i2"), classes)
        before = np.concatenate(([classes], line[:-1]))
        seen = np.bincount((before * (classes + 1) + line)[block.learns], minlength=(classes + 1) ** 2)
        return pd.DataFrame({"docs": block_rows["docs"], "line": block_rows["line"], "counts": [_shut(counts)], "classes": [_shut(of)], "bigrams": [seen.tolist()]})

    placed = stored(blocks.select("block", "docs", "line").groupBy("block").cogroup(answers.filter("block >= 0").select("block", "part", "counts", "classes").groupBy("block")).applyInPandas(
        place, "docs binary, line binary, counts binary, classes binary, bigrams array<long>"), "placed")
    transitions, types = np.zeros((classes + 1) ** 2), np.zeros(classes + 1)
    for out, found in ((transitions, placed.select(F.posexplode("bigrams").alias("g", "n"))), (types, answers.filter("block < 0").select(F.posexplode("types").alias("g", "n")))):
        for r in found.groupBy("g").agg(F.sum("n").alias("n")).collect():
            out[r.g] = r.n
    types[classes] = n_docs > 0
    model = ClassModel(common, groups, member, transitions.reshape(classes + 1, classes + 1), types, words_total + n_docs, n_kinds, CLASS_WEIGHT, PRIOR)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = _Block(row.docs, row.line)
                c = block.spelled(np.frombuffer(_open(row.counts), "<i8"), n_docs).astype(np.float64)
                of = block.spelled(np.frombuffer(_open(row.classes), "<i2"), classes)
                previous = np.concatenate(([classes], of[:-1]))
                lengths, starts = block.lengths, block.stops - block.lengths
                score10 = np.add.reduceat(np.log10(model.chances(previous, of, c)), starts)
                yield pd.DataFrame({
                    "doc_id": block.ids.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "held_out": ~block.learned, "n_tokens": lengths,
                    "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": int(model.tokens), "base_score": np.add.reduceat(np.log10(model.base(c)), starts),
                    "score": score10, "perplexity": 10 ** np.minimum(-score10 / lengths, 300)})

    return placed.select("docs", "line", "counts", "classes").mapInPandas(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
