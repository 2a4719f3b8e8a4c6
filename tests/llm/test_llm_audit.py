"""Filter interaction audit against a replay of every order, and SentencePiece against its library."""

from itertools import permutations
from math import factorial

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reliq.llm import filter_audit, sentence_pieces
from reliq.llm.queries import PIECES

MODEL = public_tokenizers.path(PIECES)
DOCS = "doc_id long, text string, lang string, part string, words int, good int, hash string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return sentence_pieces._Memory(sentence_pieces.Model(f.read()))


def test_paths_are_counted():
    for k in range(1, 6):
        forward, backward = filter_audit.path_counts(k)
        assert forward[-1] == backward[0] == factorial(k)
        assert all(forward[s] * backward[s] == sum(s in states for states in _walks(k)) for s in range(1 << k))
        assert sum(n for _, _, n in filter_audit.lattice_edges(k)) == k * factorial(k)


def _walks(k):
    for order in permutations(range(k)):
        state, states = 0, [0]
        for f in order:
            state |= 1 << f
            states.append(state)
        yield states


def _fails(text, copy):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {x for x, bad in {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": copy}.items() if bad}


def test_audit_equals_a_replay(spark):
    long_text = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long_text, "en"), (2, long_text, "en"), (2, long_text, "de"), (None, long_text, "en"), (3, None, "en"), (4, "", None), (5, "A# " * 300, ""),
        (6, "a " * 300, "de"), (7, long_text + " $", "de"), (8, "ÄÖ|\tü\n" * 400, "en"), (9, "a " * 300, "en"), (1, long_text, "en"), (10, "x", "de"), (11, None, None)]
    docs = spark.createDataFrame([(*r, "p", 1, 0, "h") for r in rows], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, None, 1), (6, 1, None), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    fields = filter_audit.text_fields(docs, labels)
    got = filter_audit.audit(fields, filter_audit.quality_filters(), F.col("part"), F.col("good"), F.col("toxic"))
    assert len({(r.part, r.filter_order, r.step) for r in got.collect()}) == got.count() == 3 * 120 * 5

    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {1, 2, 6, 9}, {2, 5, 9}
    made = [(lang or "", i, _fails(text or "", i is not None and i > first[text or ""])) for i, text, lang in rows]
    want = {}
    for part in ("en", "de", ""):
        own, total = [(i, f) for p, i, f in made if p == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                out = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                want[part, order, step] = [len(left), len(out), sum(x in f for _, f in own) - len(out), sum(f == {x} for _, f in own),
                                           sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
                total[x] = total.get(x, 0) + len(out)
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                want[part, order, step].append(total[x])
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()} == want
    shares = filter_audit.shapley_values(fields, filter_audit.quality_filters(), F.col("part")).collect()
    assert {(r.part, r["filter"], r.removals) for r in shares} == {(p, o[s - 1], v[-1]) for (p, o, s), v in want.items()}


def test_audit_of_nothing_and_of_other_filters(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fields = filter_audit.text_fields(empty, labels)
    assert filter_audit.audit(fields, filter_audit.quality_filters(), F.col("part"), F.col("good"), F.col("toxic")).collect() == []
    rows = spark.createDataFrame([(1, True, None), (2, True, True), (3, None, True)], "id long, x boolean, y boolean")
    got = filter_audit.audit(rows, {"x": F.col("x"), "y": F.col("y")}, F.lit(None), F.lit(None), F.lit(True)).collect()
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.toxic_lost, r.shapley) for r in got) == [
        ("", "xy", 1, 1, 2, 0, 2, 3), ("", "xy", 2, 0, 1, 1, 1, 3), ("", "yx", 1, 1, 2, 0, 2, 3), ("", "yx", 2, 0, 1, 1, 1, 3)]
    with pytest.raises(ValueError, match="1 to 7"):
        filter_audit.audit(rows, {}, F.lit(None), F.lit(None), F.lit(None))


PARTS = ["a", "b", "the", "in", " ", "  ", "\t", "\n", "▁", "é", "ß", "日本", "😀", "\0", "<s>", "<0x41>", "12", "--", "\r\n", "​", "�", "   ", "ing"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=30), max_size=8))
def test_merge_rounds_equal_the_library(library, model, texts):
    split = [model.model.words(x) for x in texts]
    model.learn({w for words in split for w in words})
    for text, words in zip(texts, split, strict=True):
        want = library.encode(text)
        ids = [int(i) for w in words for i in memoryview(model[w]).cast("i")]
        assert ids == want
        assert model.model.text_of(sentence_pieces.np.array(ids, int)) == library.decode(want)


def test_long_words(library, model, monkeypatch):
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzABC0123") for _ in range(20_000)), "ab" * 9000 + " " * 300 + "日" * 999, "x" * 30_000]
    for long in (sentence_pieces.LONG, 64):
        monkeypatch.setattr(sentence_pieces, "LONG", long)
        for text in texts:
            words = model.model.words(text)
            assert "".join(words) == " " + text
            model.clear()
            model.learn(set(words))
            assert [i for w in words for i in memoryview(model[w]).cast("i")] == library.encode(text)


def test_texts_of_a_table(spark, library):
    texts = [None, "", " ", "Hello  world\n", "Grüße ▁ 日本 😀", "a" * 5000, "Hello  world\n", "no break　space"]
    docs = spark.createDataFrame([(i if i != 5 else None, t, [1], "d") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string")
    encoded = sentence_pieces.encode(docs, MODEL, part_bytes=16, with_decoded=True)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        row = rows[i if i != 5 else None]
        assert row.ids == library.encode(t or "") and row.decoded == library.decode(row.ids) == (t or "").replace("▁", " ")
    again = {r.doc_id: r.decoded for r in sentence_pieces.decode(encoded, MODEL).collect()}
    assert again == {i: r.decoded for i, r in rows.items()}
    assert sentence_pieces.encode(docs.limit(0), MODEL, with_decoded=True).collect() == []


def test_other_models_are_refused():
    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    unigram = field(1, field(1, b"a")) + field(2, bytes([3 << 3, 1]))
    with pytest.raises(ValueError, match="BPE"):
        sentence_pieces.Model(unigram)
