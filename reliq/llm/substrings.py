"""Substring dedup by level-wise doubling: words covered by a window of words that also starts elsewhere are removed.

Windows repeated at one length alone are extended to twice that length (the last step to the wanted length), until no candidates
survive. A window is a candidate at a length if both halves of it, which may overlap, were repeated at the length before.

Documents are packed into compressed blocks. At each level a block hashes its candidate windows and sends every distinct hash
once, cut to few bytes on the early levels (which may only keep too many) and whole on the last. Hashes are dealt by their
leading bits into ranges of bounded size; a range answers each block with one bit per hash: seen in another block or not. So a
passage that a third of the documents share is one hash per block. Words and windows have 64-bit hashes.

Defined cases: null and empty texts have no words; texts shorter than the window keep all; overlapping repeats within one
document count; ids may be null or repeated (each row is a document); an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliq.llm.store import BLOCK_BYTES, id_text, pack, stored, unpack, utf8, words_of

#: Hashes in one range, and words taken to be in one block when ranges are laid out (a matter of size, not of results).
RANGE_HASHES, WORDS_PER_BYTE = 1 << 19, 1 / 6
#: Bytes of a hash that are sent besides its range on the early levels.
SHORT = 3
_A, _B, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            if len(self) > 500_000:
                self.clear()
            self[word] = h
        return h


_WORDS = _WordHashes()


def levels(window: int, first: int) -> list[int]:
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on; the last ``length - 1`` places have none."""
    if length == 1:
        return _mixed(words)
    half = (length + 1) // 2
    one = window_hashes(words, half)
    two = one if half == length - half else window_hashes(words, length - half)
    n = max(len(words) - length + 1, 0)
    return _mixed(one[:n] * _A + (two[half:half + n] ^ _B) * _M1)


class Block:
    """The words of one block of documents, as hashes, with each place's distance to the end of its document."""

    def __init__(self, data: bytes):
        table = unpack(data)
        self.ids = table.column("doc_id").combine_chunks()
        self.words = [words_of(t) for t in utf8(table.column("text"))]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        n = int(self.counts.sum())
        self.hashes = np.fromiter(map(_WORDS.__getitem__, itertools.chain.from_iterable(self.words)), np.uint64, n)
        self.left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(n)

    def candidates(self, length: int, alive: np.ndarray | None, before: int) -> np.ndarray:
        """Places where a window of ``length`` may be repeated, given the repeated windows of length ``before``."""
        fits = self.left >= length
        if alive is not None:
            both = alive.copy()
            shift = length - before
            both[:len(both) - shift] &= alive[shift:]
            both[len(both) - shift:] = False
            fits &= both
        return np.flatnonzero(fits)

    def keys(self, places: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct leading bits of the hashes at the places, each place's row among them, and how often each occurs."""
        h = window_hashes(self.hashes, length)[places] >> np.uint64(64 - bits)
        return np.unique(h, return_inverse=True, return_counts=True)

    def repeated(self, length: int, places: np.ndarray, bits: int, answer: np.ndarray) -> np.ndarray:
        """Per place whether the window that starts there also starts elsewhere."""
        keys, row, times = self.keys(places, length, bits)
        if len(answer) != len(keys):
            raise ValueError("a block and its answers do not fit")
        alive = np.zeros(len(self.hashes), bool)
        alive[places] = ((times > 1) | answer)[row]
        return alive


def _bits(last: bool, range_bits: int) -> int:
    return 64 if last else min(64, range_bits + 8 * SHORT)


def _questions(block: int, keys: np.ndarray, bits: int, range_bits: int) -> Iterator[tuple]:
    """(range, block, n, hashes) for one block's sorted keys; hashes without the range's bits, in as many bytes as they need."""
    own_bits = bits - range_bits
    ranges = (keys >> np.uint64(own_bits)).astype(np.int64) if range_bits else np.zeros(len(keys), np.int64)
    width = math.ceil(own_bits / 8)
    cut = np.flatnonzero(np.diff(ranges)) + 1
    raw = (keys if not range_bits else keys & np.uint64((1 << own_bits) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    for lo, hi in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)])), strict=True):
        if hi > lo:
            yield int(ranges[lo]), block, int(hi - lo), raw[lo:hi].tobytes()


def _values(raw: bytes, n: int) -> np.ndarray:
    width = len(raw) // n
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One range: which hashes came from more than one block."""
    values = [_values(raw, n) for raw, n in zip(rows["hashes"], rows["n"], strict=True)]
    distinct, times = np.unique(np.concatenate(values), return_counts=True)
    several = distinct[times > 1]
    bits = []
    for v in values:
        at = np.searchsorted(several, v)
        hit = np.zeros(len(v), bool)
        fits = at < len(several)
        hit[fits] = several[at[fits]] == v[fits]
        bits.append(np.packbits(hit).tobytes())
    return pd.DataFrame({"block": rows["block"], "part": rows["part"], "n": rows["n"], "seen": bits})


def _told(answers: pd.DataFrame, level: int) -> np.ndarray:
    own = answers[answers["level"] == level].sort_values("part")
    parts = [np.unpackbits(np.frombuffer(seen, np.uint8))[:n].astype(bool) for seen, n in zip(own["seen"], own["n"], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


_QUESTION = "part int, block long, n int, hashes binary"


def remove_repeats(docs: DataFrame, window: int = 35, first: int = 18, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept: the remaining words joined by blanks) for every row."""
    def finish(block: Block, alive: np.ndarray | None) -> pa.RecordBatch:
        edge = np.zeros(len(block.hashes) + 1, np.int64)
        if alive is not None:
            starts = np.flatnonzero(alive)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
        stays = np.cumsum(edge[:-1]) == 0
        kept, removed, at = [], [], 0
        for words in block.words:
            own = stays[at:at + len(words)]
            kept.append(b" ".join(itertools.compress(words, own.tolist())))
            removed.append(int(len(words) - own.sum()))
            at += len(words)
        return pa.RecordBatch.from_arrays([block.ids, pa.array(block.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                          ["doc_id", "n_words", "n_removed", "kept"])

    return _over_blocks(docs, window, first, id_col, text_col, block_bytes, finish, "doc_id long, n_words long, n_removed long, kept string")


def _over_blocks(docs, window, first, id_col, text_col, block_bytes, finish, schema) -> DataFrame:
    blocks = stored(pack(id_text(docs, id_col, text_col), block_bytes), "blocks")
    total = blocks.count()
    range_bits = max(0, math.ceil(math.log2(max(total * block_bytes * WORDS_PER_BYTE / RANGE_HASHES, 1))))
    steps = levels(window, first)

    def alive_after(block: Block, answers: pd.DataFrame, done: int) -> np.ndarray | None:
        alive, before = None, 0
        for level in range(done):
            places = block.candidates(steps[level], alive, before)
            alive = block.repeated(steps[level], places, _bits(level == len(steps) - 1, range_bits), _told(answers, level))
            before = steps[level]
        return alive

    def ask(block_id: int, data: bytes, answers: pd.DataFrame, level: int) -> pd.DataFrame:
        block = Block(data)
        places = block.candidates(steps[level], alive_after(block, answers, level), steps[level - 1] if level else 0)
        bits = _bits(level == len(steps) - 1, range_bits)
        keys, _, _ = block.keys(places, steps[level], bits)
        return pd.DataFrame(list(_questions(block_id, keys, bits, range_bits)), columns=["part", "block", "n", "hashes"])

    def going_on(level: int):
        def go_on(block_rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            return ask(int(block_rows["block"].iloc[0]), block_rows["data"].iloc[0], told, level)
        return go_on

    answers = None
    for level in range(len(steps)):
        if answers is None:
            def start(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in rows:
                    for block_id, data in zip(part["block"], part["data"], strict=True):
                        yield ask(block_id, data, None, 0)

            questions = blocks.mapInPandas(start, _QUESTION)
        else:
            questions = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(going_on(level), _QUESTION)
        found = stored(questions.groupBy("part").applyInPandas(_answer, "block long, part int, n int, seen binary").withColumn("level", F.lit(level)), f"repeats-{steps[level]}")
        answers = found if answers is None else answers.unionByName(found)

    def end(block_rows: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(block_rows.column("data")[0].as_py())
        return pa.Table.from_batches([finish(block, alive_after(block, told.to_pandas(), len(steps)))])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(end, schema)
