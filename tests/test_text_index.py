"""The stored inverted index: batches, removals, compaction, and searches against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from reliq.operators import search, text_index
from reliq.sources.tables import Store

DOCS = "doc_id string, title string, body string"


def brute(queries, docs, k):
    tokens = {d: re.findall(r"\w+", t.lower()) for d, t in docs.items()}
    avg = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = {}
    for q, text in queries.items():
        scores = Counter()
        for w, uses in Counter(re.findall(r"\w+", text.lower())).items():
            idf = max(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5)), search.MIN_IDF)
            for d, t in tokens.items():
                if (tf := t.count(w)):
                    scores[d] += uses * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        ranked = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]
        out[q] = [(d, round(scores[d], 6)) for d in ranked]
    return out


def found(spark, index, queries, k):
    asked = spark.createDataFrame(list(queries.items()), "query_id int, text string")
    out = {q: [] for q in queries}
    for r in sorted(search.bm25_top(asked, index, [], k).collect(), key=lambda r: r["rank"]):
        out[r.query_id].append((r.doc_id, round(r.score, 6)))
    return out


@pytest.fixture()
def words():
    draw = random.Random(5)
    return lambda n: " ".join(draw.choice("the of login failed timeout db ui retry x1 x2 x3 x4 x5 x6".split() + ["the"] * 9) for _ in range(n))


def test_batches_removals_and_compaction(spark, tmp_path, words, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 7)  # many blocks
    monkeypatch.setattr(search, "SEED_POSTINGS", 10)
    index = text_index.TextIndex(Store(spark, str(tmp_path)), "docs")
    docs = {f"d{i}": words(3 + i % 40) for i in range(150)}
    queries = {1: "the login x1", 2: "the the of", 3: "x3 x4 timeout", 4: "nowhere", 5: words(30)}

    def add(part, batch):
        index.add(spark.createDataFrame([(d, t[: len(t) // 2], t[len(t) // 2:]) for d, t in part.items()], DOCS), ["title", "body"], batch)

    def halves(d):
        return d[: len(d) // 2] + " " + d[len(d) // 2:]

    add(docs, 1)
    assert found(spark, index, queries, 5) == brute(queries, {d: halves(t) for d, t in docs.items()}, 5)

    changed = {f"d{i}": words(5) for i in range(0, 150, 10)} | {"new": "x1 x1 x1", "empty": ""}
    add(changed, 2)
    add(changed, 2)  # a repeated batch replaces itself
    index.remove(spark.createDataFrame([("d7",), ("d11",), ("d7",)], "doc_id string"), 3)
    live = {d: halves(t) for d, t in (docs | changed).items() if d not in ("d7", "d11")}
    want = brute(queries, live, 5)
    assert found(spark, index, queries, 5) == want
    assert {r.doc_id for r in index.gaps(spark.createDataFrame([("d7",), ("d1",), ("empty",), ("never",)], "doc_id string")).collect()} == {"d7", "empty", "never"}
    df = {r.token: (r.df, r.uses) for r in index.uses().collect()}
    assert df["the"] == (sum("the" in t.split() for t in live.values()), sum(t.split().count("the") for t in live.values()))

    index.compact()
    assert index.store.batches("docs_documents") == [f"{4:010d}"]
    assert found(spark, index, queries, 5) == want
    add({"d7": "login again"}, 5)
    assert found(spark, index, {1: "again"}, 5)[1][0][0] == "d7"


def test_an_index_of_nothing(spark, tmp_path):
    index = text_index.TextIndex(Store(spark, str(tmp_path)), "docs")
    index.add(spark.createDataFrame([], DOCS), ["title", "body"], 1)
    assert found(spark, index, {1: "the"}, 5) == {1: []}
    index.add(spark.createDataFrame([("a", None, None), ("b", "Émile", None)], DOCS), ["title", "body"], 2)
    assert [d for d, _ in found(spark, index, {1: "emile"}, 5)[1]] == ["b"]


def test_similar_patterns_equal_brute_force(spark):
    """One word is everywhere; the pool of ten is ranked over all words, and only a pattern that shares two of them is taken."""
    import math
    import random

    from reliq.operators import search, triage

    dice = random.Random(3)
    vocabulary = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    stored = [(f"p{i % 2}", f"s{i:03d}", "data", i, " ".join(["common", *dice.sample(vocabulary, dice.randrange(0, 6))])) for i in range(300)]
    stored += [(None, "nowhere", "data", 1, "common wordaa"), ("p0", "silent", "data", 1, None)]
    asked = [(f"p{i % 3}", f"w{i}", ["common", *dice.sample(vocabulary, dice.randrange(0, 4)), "snake_" + dice.choice(vocabulary)][: dice.randrange(1, 5)]) for i in range(60)]
    asked += [("p0", "empty", []), (None, "lost", ["common"])]
    patterns = spark.createDataFrame(stored, "project string, signature string, category string, occurrences int, sample string")
    got = triage.similar_patterns(spark.createDataFrame(asked, "project string, wanted string, tokens array<string>"), patterns)

    texts = {(p, s): (t or "").split() for p, s, _, _, t in stored}
    average = sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for w in {*vocabulary, "common"}}
    expected = set()
    for project, wanted, tokens in asked:
        terms = {w for t in tokens for w in t.split("_")}
        scores = []
        for (p, signature), text in texts.items():
            shared = terms & set(text)
            if p == project and p is not None and shared:
                score = sum(max(math.log((len(texts) - df[w] + 0.5) / (df[w] + 0.5)), search.MIN_IDF) * text.count(w) * 2.2
                            / (text.count(w) + 1.2 * (0.25 + 0.75 * len(text) / average)) for w in shared)
                scores.append((-round(score, 9), signature))
        near = [s for _, s in sorted(scores)[:10] if len(set(tokens) & set(texts[project, s])) >= min(2, len(tokens))]
        if near:
            expected.add((project, wanted, near[0]))
    assert {(r.project, r.wanted, r.signature) for r in got.collect()} == expected and len(expected) > 20


def test_similar_patterns_write_no_pairs_and_blocks_agree_with_one_search(spark, monkeypatch):
    """Every pattern shares its words with every failure: what is written stays as long as the tables, and ties keep the order of signatures."""
    from reliq.operators import triage

    stored = [(f"p{i % 2}", f"s{i:03d}", "data", i, " ".join([f"alpha{i % 3}", f"beta{i % 5}"] * (1 + i % 2) + ["gamma"] * (i % 4))) for i in range(240)]
    asked = [(f"p{i % 2}", f"w{i}", [f"alpha{i % 3}", f"beta{i % 5}", "gamma"]) for i in range(60)]
    patterns = spark.createDataFrame(stored, "project string, signature string, category string, occurrences int, sample string")
    wanted = spark.createDataFrame(asked, "project string, wanted string, tokens array<string>")
    whole = triage.similar_patterns(wanted, patterns).collect()
    written = []
    keep = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    for name, n in (("ASKED_BLOCK", 7), ("PATTERN_BLOCK", 16), ("LEAST_BLOCK", 16)):
        monkeypatch.setattr(triage, name, n, raising=False)
    assert sorted(triage.similar_patterns(wanted, patterns).collect()) == sorted(whole) and len(whole) == 60
    assert max(t.count() for t in written) <= 240


def test_terms_that_cannot_reach_the_best_are_not_opened(spark, tmp_path, monkeypatch):
    index = text_index.TextIndex(Store(spark, str(tmp_path)), "docs")
    docs = {f"d{i}": "the of " + "x1 " * (i % 50 == 0) + f"w{i}" for i in range(400)}
    index.add(spark.createDataFrame([(d, t, "") for d, t in docs.items()], DOCS), ["title", "body"], 1)
    assert index.blocks().filter("token = 'the'").count() == 1  # by token, whatever the number of documents
    seen = {}
    keep = search.materialize

    def watched(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(search, "materialize", watched)
    assert found(spark, index, {1: "the of x1"}, 3) == brute({1: "the of x1"}, {d: t + " " for d, t in docs.items()}, 3)
    assert seen["candidates"].count() == 8  # those with x1, not all 400
