"""SentencePiece BPE with byte fallback: whole texts to ids and back, by vectorised merge rounds.

A text, with the dummy blank in front, falls into words (blanks, then other characters) that no piece crosses. The distinct words
of a batch that the worker does not know yet lie in one flat numpy array of symbols. Each round finds the lowest pair rank of every
segment (``minimum.reduceat``), merges its leftmost occurrences at once, looks up the new neighbours, and drops what is finished;
it ends when no pair is left. Ranks follow the scores, equal scores are equal ranks. Merging all occurrences at once equals merging
one by one unless a merge makes a pair that comes before the next occurrence: a segment then stops behind that merge and goes on in
the next round. Segments end between characters that are neighbours in no piece, so long words fall apart too.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 reads as a blank, as in the library; characters
without a piece become byte pieces; ids may be null or repeated; an empty table gives an empty table; other columns are not read.
Models with a normaliser, user-defined or unused pieces, white space as suffix or another algorithm are refused. ``decode`` reads
ids that encode valid text; bytes that are none become U+FFFD.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliq.llm.store import id_text, slices

#: Fixed values of the model format: the blank's sign, piece types, and the model type BPE.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Above every rank: "these two do not merge".
NEVER = np.int64(1 << 40)
#: Distinct words, and their characters, that a worker remembers; beyond it forgets all and goes on.
REMEMBERED, REMEMBERED_CHARS = 200_000, 8_000_000
#: Characters after which a word is cut at the next place that no piece crosses.
LONG = 1 << 16
#: Text bytes that are encoded together, ids that are decoded together.
PART_BYTES, STEP = 1 << 20, 1 << 18

WORDS = re.compile(" *[^ ]+| +")
#: Left symbol * SHIFT + right symbol is a pair; symbols are ids, or (number of pieces + code point).
SHIFT = np.int64(1 << 21)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = number() if size is None else size
        yield tag >> 3, data[at:at + size]
        at += size


class Model:
    """A model file: pieces, ranks of all pairs that merge, and what each id decodes to."""

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("a BPE model with byte fallback, without user-defined pieces, is needed")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("a model that leaves texts as they are is needed")
        self.dummy = bool(normalizer.get(3, 1))
        self.n = len(pieces)
        own = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        if BLANK not in own or any(BLANK in piece.lstrip(BLANK) for piece in own):
            raise ValueError("a model whose pieces have blanks in front only is needed")
        scores = np.array([score for _, score, _ in pieces])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.n  # of a code point
        for piece, i in own.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

        def symbol(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else own.get(part)

        pairs, bigrams = {}, set()
        for piece, i in own.items():
            bigrams.update(map("".join, zip(piece, piece[1:])))
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * int(SHIFT) + right] = i
        order = sorted(pairs)
        self.keys = np.array([*order, 1 << 62], np.int64)
        self.merged = np.array([*map(pairs.get, order), 0], np.int64)
        self.ranks = np.append(rank[self.merged[:-1]], NEVER).astype(np.int64)
        self.bigrams = bigrams
        self.bigram_keys = np.array(sorted(ord(b[0]) * int(SHIFT) + ord(b[1]) for b in bigrams) + [1 << 62], np.int64)
        #: ids of the 256 bytes
        self.byte = np.array([i for i, (_, _, kind) in enumerate(pieces) if kind == BYTE], np.int64)
        if [pieces[i][0] for i in self.byte] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("a model with one piece for every byte is needed")
        byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte)}
        texts = [byte_of.get(i, b"" if kind == CONTROL else piece.replace(BLANK, " ").encode()) for i, (piece, _, kind) in enumerate(pieces)]
        self.row = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(x) for x in texts])
        self.start = np.cumsum(self.length) - self.length

    # --- merging --------------------------------------------------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NEVER where they do not merge."""
        keys = left * SHIFT + right
        at = np.searchsorted(self.keys, keys)
        same = self.keys[at] == keys
        return np.where(same, self.ranks[at], NEVER), self.merged[at]

    def ids(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words are not empty and have BLANK for blanks."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        last = np.append(word[1:] != word[:-1], True)  # of its segment
        keys = points[:-1] * SHIFT + points[1:]
        last[:-1] |= self.bigram_keys[np.searchsorted(self.bigram_keys, keys)] != keys
        done = self._rounds(self.symbol[points], last)
        place = np.flatnonzero(done >= 0)
        symbols, word = done[place], word[place]
        foreign = symbols >= self.n
        if foreign.any():  # characters without a piece: their UTF-8 bytes
            encoded = [chr(x - self.n).encode() for x in symbols[foreign].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[foreign] = [len(x) for x in encoded]
            symbols, word, was = np.repeat(symbols, times), np.repeat(word, times), np.repeat(foreign, times)
            symbols[was] = self.byte[np.frombuffer(b"".join(encoded), np.uint8)]
        return np.split(symbols.astype(np.int32), np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def _rounds(self, symbol: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The symbol that stays at each place, -1 where one was merged into its left neighbour; ``last``: ends of segments."""
        out = np.full(len(symbol), -1, np.int64)
        place = np.arange(len(symbol))
        rank, merged = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], merged[inner] = self._pairs(symbol[inner], symbol[inner + 1])
        first = np.append(True, last[:-1])
        while len(symbol):
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(symbol)))
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low != NEVER, sizes)
            if not live.all():  # compaction
                out[place[~live]] = symbol[~live]
                symbol, rank, merged, place, first = (x[live] for x in (symbol, rank, merged, place, first))
                sizes, low = sizes[low != NEVER], low[low != NEVER]
                if not len(symbol):
                    break
            segment = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == low[segment])
            # of overlapping occurrences the leftmost, then every second
            begins = np.append(True, np.diff(at) != 1)
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]
            beside = np.append(False, np.diff(at) == 2)  # directly behind the one before
            new, mine = merged[at], segment[at]
            # the neighbours, as they are when the occurrences before have merged
            left = np.where(beside, at - 2, at - 1)
            has_left = (left >= 0) & (segment[left] == mine)
            left_symbol = np.where(beside, np.append(0, new[:-1]), symbol[left])
            right = np.minimum(at + 2, len(symbol) - 1)
            has_right = (at + 2 < len(symbol)) & (segment[right] == mine)
            left_rank, left_merged = self._pairs(left_symbol, new)
            right_rank, right_merged = self._pairs(new, symbol[right])
            left_rank, right_rank = np.where(has_left, left_rank, NEVER), np.where(has_right, right_rank, NEVER)
            # a pair that comes before the next occurrence ends this round for its segment
            ahead = np.minimum(left_rank, right_rank) <= low[mine]
            earlier = np.cumsum(ahead) - ahead
            fresh = np.append(True, mine[1:] != mine[:-1])
            kept = earlier == np.maximum.accumulate(np.where(fresh, earlier, 0))
            at, new, left, has_left = at[kept], new[kept], left[kept], has_left[kept]
            symbol[at], rank[at], merged[at] = new, right_rank[kept], right_merged[kept]
            rank[left[has_left]], merged[left[has_left]] = left_rank[kept][has_left], left_merged[kept][has_left]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, rank, merged, place, first = (x[stay] for x in (symbol, rank, merged, place, first))
        return out

    # --- texts ----------------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Parts that no piece crosses; blanks as blanks."""
        text = text.replace(BLANK, " ")
        found = WORDS.findall(" " + text if self.dummy and text else text)
        return found if len(text) <= LONG else [part for word in found for part in self._cut(word)]

    def _cut(self, word: str) -> Iterator[str]:
        at = 0
        while len(word) - at > LONG:
            stop = at + LONG
            while stop < len(word) and word[stop - 1:stop + 1].replace(" ", BLANK) in self.bigrams:
                stop += 1
            yield word[at:stop]
            at = stop
        if at < len(word):
            yield word[at:]

    def text_of(self, ids: np.ndarray) -> str:
        """The text of ids; the dummy blank is taken off."""
        out = []
        for at in range(0, len(ids), STEP):
            some = ids[at:at + STEP]
            length = self.length[some]
            place = np.cumsum(length) - length
            out.append(self.row[np.repeat(self.start[some] - place, length) + np.arange(length.sum())].tobytes())
        text = b"".join(out)
        return (text[1:] if self.dummy and text[:1] == b" " else text).decode("utf-8", "replace")


class _Memory(dict):
    """Word to its ids as native 32-bit integers."""

    def __init__(self, model: Model):
        self.model, self.chars = model, 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if not new:
            return
        if len(self) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
            self.chars, new = 0, list(words)
        self.chars += sum(map(len, new))
        self.update(zip(new, (x.tobytes() for x in self.model.ids([w.replace(" ", BLANK) for w in new])), strict=True))


_LOADED: dict[int, _Memory] = {}


def _memory(data: bytes) -> _Memory:
    """This worker's model and memory; kept between tasks."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Memory(Model(data))
    return _LOADED[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES,
           with_decoded: bool = False) -> DataFrame:
    """(doc_id, ids: array<int>), without begin and end; on request also ``decoded``, the text of these ids.

    The model file's content travels with the tasks.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(data)
        for batch in batches:
            for part in slices(batch, "text", part_bytes):
                split = [memory.model.words(text or "") for text in part.column("text").to_pylist()]
                memory.learn({w for words in split for w in words})
                ids = [np.frombuffer(b"".join(map(memory.__getitem__, words)), np.int32) for words in split]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else np.zeros(0, np.int32))]
                if with_decoded:
                    columns.append(pa.array(map(memory.model.text_of, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * with_decoded)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows with ids; null ids decode to the empty text."""
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _memory(data).model
        for batch in batches:
            texts = [model.text_of(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded string")
