"""Language ID, class language model and mixing: brute force, sums that must hold, held-out results."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reliq.llm import brown, langid, mixing, queries, simhash, store

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double, rate double, _text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, 2.0, "x") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_models_are_distributions():
    counts = {"aa": Counter("ab"), "bb": Counter()}
    for lang, words in (("aa", Counter({"ab": 3, "abba": 2})), ("bb", Counter({"ba": 5, "bb": 1}))):
        counts[lang] = dict(langid._gram_counts(words))
    model = langid.build(counts)
    signs = ["a", "b", " "]
    for history in ("", "a", "ab", "bb"):
        # chance of each next sign after " " + history, as a difference of word prefixes
        total = np.zeros(2)
        for sign in signs:
            if sign == " " and not history:
                continue
            row = langid.score_words(model, [history + sign]) if sign != " " else None
            whole = langid.score_words(model, [history]) if sign == " " else None
            framed = f" {history}{sign}"
            total += np.exp(_last(model, framed)) if row is not None or whole is not None else 0
        if history:
            assert (total <= 1 + 1e-5).all() and (total > 0.6).all()


def _last(model, framed):
    """Log-probability of the last sign of a framed word, by the recursion written out."""
    p = np.full(len(model.langs), model.base)
    for order in range(langid.ORDER):
        if len(framed) < order + 1:
            break
        gram = framed[-order - 1:]
        h = langid._gram_hashes(langid._codes(gram), order + 1)[-1]
        at = np.searchsorted(model.hashes[order], h)
        hit = at < len(model.hashes[order]) and model.hashes[order][at] == h
        prob = model.prob[order][at] if hit else 0
        if order == 0:
            weight = model.weight[langid.ORDER][0]
        else:
            c = langid._gram_hashes(langid._codes(gram[:-1]), order)[-1]
            at = np.searchsorted(model.hashes[order - 1], c)
            hit = at < len(model.hashes[order - 1]) and model.hashes[order - 1][at] == c
            weight = model.weight[order - 1][at if hit else -1]
        p = prob + weight * p
    return np.log(p)


def test_vector_scores_equal_the_recursion():
    model = langid.build({"aa": dict(langid._gram_counts(Counter({"abcab": 3, "cab": 1}))), "bb": dict(langid._gram_counts(Counter({"xyz": 2, "zab": 1})))})
    words = ["abcab", "z", "unseen", "abc"]
    got = langid.score_words(model, words)
    for word, row in zip(words, got, strict=True):
        framed = f" {word} "
        want = sum(_last(model, framed[:end]) for end in range(2, len(framed) + 1))
        assert np.allclose(row[:-1], want, atol=1e-4) and row[-1] == len(word) + 1


def test_language_id_learns_and_rejects(spark, given):
    learn, calibrate = queries.remainder(3) == 0, queries.remainder(3) == 2
    model = langid.fit(given, learn, calibrate)
    got = langid.predict(model, given.withColumn("held", queries.remainder(3) == 1), ["doc_id", "lang", "held"]).toPandas()
    assert len(got) == given.count() and (got.lang_pred == got.lang)[got.held].mean() > 0.97
    assert got.rejected.mean() < 0.02 and got.score.between(0, 1).all()
    odd = docs(spark, [(1, None, None), (2, "", "en"), (3, "123 !! ²", "en"), (None, "xqzw kjqx zzxq wqkj " * 30, "en"), (5, "the and of " * 20000, "en"), (5, "the and of", "en")])
    rows = {(r.doc_id, i): r for i, r in enumerate(langid.predict(model, odd, odd.columns, prefix="_").collect())}
    found = [r for _, r in sorted(rows.items(), key=lambda x: x[0][1])]
    assert [r._lang_pred for r in found][:3] == ["und"] * 3 and all(r._rejected and r._score == 0 for r in found[:3])
    assert found[3]._rejected and found[4]._lang_pred == "en" and found[0].score == 0.5
    assert langid.predict(model, given.limit(0)).count() == 0
    empty = langid.fit(given.limit(0), learn, calibrate)
    assert [r.lang_pred for r in langid.predict(empty, given.limit(3)).collect()] == ["und"] * 3


def test_brown_base_and_gain(spark, given):
    got = brown.brown_scores(given, queries.remainder(5) != 1, block_bytes=20_000).toPandas().sort_values("doc_id")
    rows = given.toPandas().sort_values("doc_id")
    tokens = [t.encode().lower().split() + [b""] for t in rows.text]
    learned = [zlib.crc32(str(i).encode()) % 5 != 1 for i in rows.doc_id]
    counts = Counter()
    for t, yes in zip(tokens, learned, strict=True):
        if yes:
            counts.update(t)
    total, kinds = sum(counts.values()), len(counts)
    base = [sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t) for t in tokens]
    assert np.allclose(got.base_score, base) and (got.train_tokens == total).all()
    assert got.n_tokens.tolist() == [len(t) for t in tokens] and got.n_known.tolist() == [sum(counts[w] > 0 for w in t) for t in tokens]
    assert got.held_out.tolist() == [not x for x in learned]
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_brown_odd_rows(spark):
    df = docs(spark, [(1, None, None), (2, "", "a"), (None, "a b a", "a"), (2, "a b " * 30_000, "a"), (7, "c", "a")])
    got = brown.brown_scores(df, F.col("doc_id") != 7, frequent=4, groups=3, classes=2, rounds=2).toPandas()
    assert sorted(got.n_tokens) == [1, 1, 2, 4, 60_001] and got.held_out.sum() == 2  # a null id is not learned from when the condition is null
    assert np.isfinite(got.score).all()
    assert brown.brown_scores(df.limit(0), F.lit(True)).count() == 0
    alone = brown.brown_scores(df, F.lit(False), frequent=4, groups=3, classes=2, rounds=1).toPandas()
    assert (alone.train_tokens == 0).all() and (alone.n_known == 0).all()


def test_words_beyond_the_frequent_ones_have_classes_of_their_own(spark):
    """Two words of one group (equal last letters, equally often) that stand in different places: each is likelier in its own."""
    rows = [f"the {w} runs home" for w in ("miliaaa", "moriaaa") for _ in range(30)] + [f"of {w} fell apart" for w in ("naviaaa", "neriaaa") for _ in range(30)]
    rows += ["the cat runs home"] * 100 + ["of tin fell apart"] * 100
    asked = ["the miliaaa runs home", "the naviaaa runs home", "of naviaaa fell apart", "of miliaaa fell apart"]
    df = docs(spark, [(i, t, "a") for i, t in enumerate(rows * 3)] + [(1000 + i, t, "a") for i, t in enumerate(asked)])
    got = brown.brown_scores(df, F.col("doc_id") < 1000, frequent=8, groups=1, classes=8, rounds=6, block_bytes=2000)
    score = {r.doc_id - 1000: r.score for r in got.filter("held_out").collect()}
    assert score[0] > score[1] + 0.5 and score[2] > score[3] + 0.5


def test_class_model_sums_to_one():
    counts = np.array([5.0, 3.0, 1.0, 4.0])  # the last is the end
    classes = np.array([0, 1, 1, 2])
    transitions = np.array([[1.0, 2, 2], [2, 1, 1], [2, 1, 1]])
    model = brown.ClassModel([], 1, classes, transitions, np.array([1.0, 2, 1]), 13, 4, 1.0, 2.0)
    model.class_tokens = np.array([5.0, 4, 4])
    for previous in range(3):
        known = model.chances(np.full(4, previous), classes, counts).sum()
        unknown = model.chances(np.full(3, previous), np.arange(3), np.zeros(3)).sum()
        assert known + unknown == pytest.approx(1)


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    table = rng.poisson(1.0, (12, 12)) * (1 + 8 * (np.add.outer(range(12), range(12)) % 2))

    def likelihood(of):
        n = np.zeros((4, 4))
        np.add.at(n, (of[:, None], of[None, :]), table)
        part = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return part(n) - part(n.sum(0)) - part(n.sum(1))

    of = np.append(np.arange(11) % 3, 3)
    for u in list(range(12)) * 3:
        forward = np.stack([np.bincount(of, table[x], 4) for x in range(12)])
        backward = np.stack([np.bincount(of, table[:, x], 4) for x in range(12)])
        new = brown.exchange(forward, backward, np.diag(table).astype(float), of, np.array([u]), 3)
        assert likelihood(new) >= likelihood(of) - 1e-6
        of = new
    assert of[11] == 3


def test_mixture_meets_targets(spark, given):
    labels = queries.domains(spark.read.parquet(f"{SF}/labels.parquet"))
    weights = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    got = mixing.mix(given, labels, weights, ["doc_id", "source"], prefix="_").toPandas()
    p, n, rate = np.stack(got._posterior), got._n_tokens.to_numpy(), got._rate.to_numpy()
    assert len(got) == given.count() and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    totals = (rate * n) @ p
    assert np.allclose(totals / totals.sum(), list(weights.values()), atol=1e-3) and totals.sum() == pytest.approx(n.sum(), rel=1e-3)
    best = np.array(list(weights))[p.argmax(1)]
    held = got.assign(best=best).merge(labels.toPandas(), on="doc_id")
    assert (held.best == held.domain).mean() > 0.8


def test_mixture_odd_rows(spark):
    df = docs(spark, [(1, None, None), (None, "", "a"), (3, "good words here", "a"), (3, "good words here", "a"), (4, "bad " * 50_000, "a"), (5, "bad thing", None)])
    labels = spark.createDataFrame([(3, "good"), (5, "bad"), (None, "bad"), (99, "good"), (4, None)], "doc_id long, domain string")
    got = mixing.mix(df, labels, {"good": 0.5, "bad": 0.5}, df.columns, prefix="_").collect()
    assert len(got) == 6 and all(r._rate >= 0 for r in got) and got[0].rate == 2.0
    same = {r._rate for r in got if r.text == "good words here"}
    assert len(same) == 1
    none = mixing.mix(df, labels.limit(0), {"good": 0.5, "bad": 0.5}).collect()
    assert all(r.posterior == pytest.approx([0.5, 0.5]) for r in none)
    assert mixing.mix(df.limit(0), labels, {"good": 1.0}).count() == 0


def test_rates_stop_at_zero_and_copies_follow_rates(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0]), (10, [0.0, 1.0]), (5, [0.5, 0.5])], "n_tokens long, posterior array<double>")
    steps, totals, target = mixing.fit_rates(members, [1.0, 0.0])
    rates = mixing._rates(np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]), steps)
    assert rates[1] == 0 and rates.min() >= 0 and target.tolist() == [25.0, 0.0]
    n = spark.range(20_000).select(mixing.copies(F.lit(1.3), "id").alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert n[0] == pytest.approx(1.3, abs=0.02) and (n[1], n[2]) == (1, 2)


@pytest.mark.parametrize("others", [1, 20])
def test_mixture_stage_keeps_every_clean_row(spark, given, others):
    import corpus_pipeline

    labels = queries.domains(spark.read.parquet(f"{SF}/labels.parquet"))
    known = given.join(labels, "doc_id").select(*given.columns, "domain")
    some = known.filter("domain = 'clean'").unionByName(known.filter("domain <> 'clean'").limit(others)).drop("domain")
    short = given.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("text", F.substring_index("text", " ", 2))
    rows = some.unionByName(short).localCheckpoint()
    p = mixing.mix(rows, labels, queries.TARGETS).toPandas()
    clean = {i for i, x in zip(p.doc_id, p.posterior, strict=True) if x[0] == max(x)}
    kept = {r.doc_id for r in corpus_pipeline.mix_domains(spark, rows, SF).collect()}
    assert len(clean) > 0.5 * len(p) and clean <= kept


def test_rates_of_a_whole_domain_rise_only(spark):
    members = spark.createDataFrame([(95, [0.9, 0.1]), (2, [0.6, 0.4]), (3, [0.1, 0.9])], "n_tokens long, posterior array<double>")
    p = np.array([[0.9, 0.1], [0.6, 0.4], [0.1, 0.9]])
    for weights in ([0.8, 0.2], [0.95, 0.05], [0.885, 0.115]):
        steps, _, _ = mixing.fit_rates(members, weights, whole=0)
        rates = mixing._rates(p, steps, 0)
        assert rates[:2].min() >= 1 and rates[2] >= 0
    assert rates[2] < 1 or rates[:2].max() > 1


def test_workers_hold_the_memory_of_one_operator_and_parts_of_a_batch(monkeypatch):
    mixing._cells_of(b"a b", 8)
    assert list(store._HELD) == [("cells", 8)]
    store.worker_keeps("another", dict)
    assert list(store._HELD) == ["another"]
    given_back = []
    monkeypatch.setattr(store, "give_back", lambda: given_back.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 5})
    assert [part.num_rows for part in store.slices(batch, "text", 20)] == [2, 2, 1]
    assert len(given_back) == 3
    assert list(simhash._small(iter([]))) == []
    assert not store._HELD
