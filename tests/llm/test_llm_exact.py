"""Exact dedup, token counts, BPE and substring dedup against brute force."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reliq.llm import bpe, exact_dedup, substrings, token_counts

SCHEMA = "doc_id long, text string, hash string, keep_id long, block int"
RANKS = public.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "the cat", "the cat", "  two  blanks\n\n\nand lines ", "it's we'll DON'T", "naïve ñandú 東京 🙂", "x" * 3000, "ab " * 5000,
       "1234 567", "tab\tand\x0bvt\x1cfs\x85nel\xa0nbsp em    end", "<|endoftext|> <|endoftext|>x", "!!\x1cbar", "a\xa0  b"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 7, 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_exact_groups(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, ODD), keep="largest").collect()}
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for i, t in enumerate(ODD):
        groups[t or ""].append(i)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_compares_bytes_when_hashes_collide(spark):
    df = docs(spark, ["aa", "bb", "aa", "c", None])
    got = exact_dedup.exact_duplicates(df, digest=lambda t: F.octet_length(t).cast("string").cast("binary"))
    assert rows(got, "doc_id", "keep_id", "group_size", "kept") == [(0, 0, 2, True), (1, 1, 1, True), (2, 0, 2, False), (3, 3, 1, True), (4, 4, 1, True)]


def test_exact_repeated_rows_null_ids_and_empty_table(spark):
    df = docs(spark, ["a", "a", "a", "b", "b"], [1, 1, None, None, None])
    got = exact_dedup.exact_duplicates(df).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 5
    assert all(r.keep_id == 1 for r in got if r.group_size == 3)
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([(1, "a"), (None, "b")], key=str)
    assert exact_dedup.drop_exact_duplicates(docs(spark, [None, ""]), keep="largest").collect() == [(1, "", "x", 7, 3)]


def test_exact_is_native(spark):
    plan = exact_dedup.exact_duplicates(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, name):
    model = Tokenizer.from_file(public.path(name))
    model.no_truncation()
    got = rows(token_counts.token_counts(docs(spark, ODD), public.path(name), batch_bytes=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False)), n > 512) for i, t in enumerate(ODD)]
    assert got == want
    assert token_counts.token_counts(docs(spark, []), public.path(name)).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(token_counts.token_counts(docs(spark, ODD), path), "doc_id", "n_tokens")
    assert got == [(i, len(model.encode(t or ""))) for i, t in enumerate(ODD)]


def test_units_tokenise_by_themselves():
    model = Tokenizer.from_file(public.path("byte_bpe_50k.json"))

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from("ab'st 1!\n\t\r\x0b\x1c\x85\xa0 é東"), max_size=30))
    def check(text):
        assert sum(len(model.encode(u, add_special_tokens=False)) for u in token_counts.units_of(text)) == len(model.encode(text, add_special_tokens=False))

    check()


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("frequent", [3, 1000])
def test_bpe_round_trip(spark, library, frequent):
    both = bpe.decode(bpe.encode(docs(spark, ODD), RANKS, public.PATTERN, part_bytes=50, frequent=frequent), RANKS).collect()
    assert len(both) == len(ODD)
    for r in both:
        text = ODD[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    whole = bpe.encode(docs(spark, ODD), RANKS, public.PATTERN, frequent=frequent, with_decoded=True).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in whole) == sorted((r.doc_id, r.ids, r.decoded) for r in both)
    assert bpe.encode(docs(spark, []), RANKS, public.PATTERN).count() == 0


def test_ids_do_not_depend_on_the_sampled_words(spark, library, monkeypatch):
    for rows in (1, 10 ** 9):  # nearly no text sampled, all texts counted
        monkeypatch.setattr(bpe, "SAMPLE_ROWS", rows)
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs(spark, ODD), RANKS, public.PATTERN, frequent=50).collect()}
        assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(ODD)}


def test_frequent_words_are_counted_over_all_texts(spark):
    import regex

    counts = Counter(w for t in ODD for w in regex.findall(public.PATTERN, t or "") if len(w.encode()) <= bpe.WORD_BYTES)
    got = [(r.word, r.n) for r in bpe.frequent_words(docs(spark, ODD), public.PATTERN, 5).collect()]
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:5]


def test_bpe_fold_equals_library(ranks, library):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=40))
    def check(text):
        ids = [i for unit in token_counts.units_of(text) for w in __import__("regex").findall(public.PATTERN, unit) for i in bpe.fold_word(w.encode(), ranks)]
        assert ids == library.encode_ordinary(text)

    check()


def test_bpe_expressions(spark, ranks, library):
    words = ["a", " the", "Thtionoues", "erreoror", "é", "東京", "aaaaaaaaaaaa", "xyzzyx" * 4, "\n\n", None, "", "Thtionoues"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.word: list(r.ids) for r in bpe.encode_words(df, "w", ranks).collect()}
    assert got == {w: (library._encode_single_piece(w) if w else []) for w in words}
    ids = spark.createDataFrame([(w, i) for w, i in got.items() if w], "w string, ids array<int>")
    assert all(bytes(r.b) == r.w.encode() for r in ids.select("w", bpe.joined_pieces(F.col("ids"), ranks).alias("b")).collect())


def test_rank_map_is_a_few_strings(spark, ranks):
    """The driver serializes the literal with every stage: one string per cell, not objects per token."""
    row = spark.range(1).select(bpe.rank_map(ranks).alias("m"))
    assert row.schema["m"].dataType.simpleString() == "array<string>"
    cells = row.first().m
    assert len(cells) == bpe.CELLS < len(ranks) / 8
    assert sum(c.count(";") for c in cells) == len(ranks)


def brute_windows(texts, window):
    words = [(t or "").encode().split() for t in texts]
    starts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        yield len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()


@pytest.mark.parametrize(("window", "first"), [(35, 18), (8, 1), (5, 5), (7, 2)])
def test_substrings(spark, window, first):
    rng = np.random.default_rng(window)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "a a a a a a a a a a a a", passage, "x " + passage + " y", passage[:100], "z " * 100] + [" ".join(rng.choice(["a", "b", "c"], 40)) for _ in range(20)]
    got = rows(substrings.remove_repeats(docs(spark, texts), window, first, block_bytes=200), "doc_id", "n_words", "n_removed", "kept")
    assert got == [(i, *x) for i, x in enumerate(brute_windows(texts, window))]
    assert substrings.remove_repeats(docs(spark, []), window, first).count() == 0


def test_substring_hash_ranges_are_whole():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    for bits, range_bits in ((64, 0), (64, 5), (29, 5), (24, 0)):
        cut = np.unique(keys >> np.uint64(64 - bits))
        parts = list(substrings._questions(1, cut, bits, range_bits))
        back = itertools.chain.from_iterable((v + (p << (bits - range_bits)) for v in map(int, substrings._values(raw, n))) for p, _, n, raw in parts)
        assert list(back) == cut.tolist()
