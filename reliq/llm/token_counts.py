"""Token counts of whole texts: Arrow batches go in, only lengths come out.

Method: each task cuts its texts into parts of about ``batch_bytes`` and encodes every part's distinct units in one batch
call. Long texts are split at safe boundaries: before a run of ASCII white space, where the byte-level pattern always starts a
new piece, so the units' counts add up to the text's count. Equal units are encoded once per worker while they stay in a
bounded memory. Texts with other white space, and vocabularies without that pattern, are encoded whole.

Defined cases: null and empty texts have 0 tokens; ids may be null or repeated; special strings inside a text count as the
library counts them by default; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reliq.llm.store import id_text, slices

#: Text bytes that are encoded by one call.
BATCH_BYTES = 1 << 20
#: Distinct units that a worker remembers; beyond it forgets all and goes on.
REMEMBERED = 400_000

UNITS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space at which the vocabularies' pattern may look across a boundary.
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def units_of(text: str) -> list[str]:
    """The text in parts that tokenise by themselves."""
    return [text] if OTHER_SPACE.search(text) else UNITS.findall(text)


def _splits_safely(model: dict) -> bool:
    """Whether pieces always begin before a run of white space in this vocabulary."""
    pre = model.get("pre_tokenizer") or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) for t in model.get("added_tokens", []))
    return plain and not model.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def _tokenizers_lengths(data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(data.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], _splits_safely(json.loads(data))


def _sentencepiece_lengths(data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False


_LOADED: dict[int, tuple] = {}


def _loaded(kind: str, data: bytes):
    """Encoder and memory of this worker process; kept between tasks."""
    key = hash(data)
    if key not in _LOADED:
        lengths, safe = (_sentencepiece_lengths if kind == "model" else _tokenizers_lengths)(data)
        _LOADED[key] = lengths, safe, {}
    return _LOADED[key]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    ``vocabulary`` is a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file on the driver; its content travels with the tasks.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    kind = vocabulary.rsplit(".", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, safe, memory = _loaded(kind, data)
        for batch in batches:
            for part in slices(batch, "text", batch_bytes):
                texts = [x or "" for x in part.column("text").to_pylist()]
                split = [units_of(x) if safe else [x] if x else [] for x in texts]
                new = list({u for units in split for u in units if u not in memory})
                if len(memory) + len(new) > REMEMBERED:
                    memory.clear()
                    new = list({u for units in split for u in units})
                memory.update(zip(new, lengths(new), strict=True))
                counts = pa.array([sum(map(memory.__getitem__, units)) for units in split], pa.int64())
                sizes = pc.fill_null(pc.binary_length(part.column("text")).cast(pa.int64()), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, counts, pc.greater(counts, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
