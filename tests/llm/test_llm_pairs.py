"""Top-k search, SimHash components, preferences and the pipeline against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliq.llm import components, preferences, queries, simhash, topk


def brute_top(rows, k, asked):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i, tuple(math.floor(64 * x) for x in v)] = None
    for q, a in ints:
        if asked(q):
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ints if i != q)[:k]
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(best))


@pytest.mark.parametrize("blocks", [(2048, 16384), (7, 23)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).tolist() for _ in range(300)] + [[0.5] * 6] * 60 + [[0.0] * 6, [9.0] * 6, [1.0, 2.0], []]
    rows = list(enumerate(vectors)) + [(None, [1.0] * 6), (900, None), (901, [1.0, None]), (902, [math.nan] * 6), (903, [math.inf] * 6), (20, vectors[20])]
    df = spark.createDataFrame([(i, v, "s", 1.0) for i, v in rows], "vec_id long, embedding array<float>, square string, far double")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=blocks[0], block=blocks[1]).collect())
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == sorted(brute_top(rows, 20, lambda i: i % 20 == 0))


def test_top_k_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert sorted(map(tuple, topk.top_k(two, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 64 * 128)]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(pairs, nodes):
    parent = {x: x for x in nodes}
    for u, v in pairs:
        a, b = find(parent, u), find(parent, v)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = chain + star + [tuple(x) for x in rng.integers(2000, 2100, (60, 2)).tolist()] + [(5, 5), (-3, 70), (7, 6)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == joined([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("node_size", "slice_size"), [(1 << 14, 1 << 15), (20, 8), (64, 1 << 15)])
def test_trie_join_finds_all_links(spark, node_size, slice_size):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    prints = set(rng.integers(0, 1 << 63, 100).tolist()) | {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(15):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(c ^ sum(1 << int(b) for b in flips))
    values = np.array(sorted(prints), np.uint64)
    near = [(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 2).tolist() if i < j]
    frame = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "print long")
    rows = simhash.linked_prints(frame, 2, node_size, slice_size).toPandas()
    place = {x: i for i, x in enumerate(values.view(np.int64).tolist())}
    degree = rows.groupby("print")["links"].sum().to_dict()
    want = np.bincount(np.array(near).ravel(), minlength=len(values))
    assert {place[p]: n for p, n in degree.items()} == {i: n for i, n in enumerate(want.tolist()) if n}
    assert joined([(place[a], place[b]) for a, b in zip(rows["print"], rows["root"], strict=True)], range(len(values))) == joined(near, range(len(values)))


def test_fingerprint_votes():
    import xxhash

    words = b"Ab cD ef gh Ab cD ef".lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > 5)
    assert simhash.fingerprint(b"Ab  cD\tef gh\nAb cD ef") == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def test_similar_documents(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(25):
        text = rng.choice(words, 400)
        for copy in range(1 + g % 4):
            changed = text.copy()
            changed[rng.choice(400, 3 * copy, replace=False)] = "new"  # a similarity of about 0.86 for two copies, 0.93 to the first
            rows.append((len(rows), " ".join(changed)))
            groups.append(g)
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    first = {g: groups.index(g) for g in groups}
    assert {i: got[i] for i in range(len(groups))} == {i: first[g] for i, g in enumerate(groups)}
    assert (got[900], got[901], got[902], got[903], got[None]) == (900, 900, 902, 902, 0)
    assert simhash.similar_documents(df.limit(0)).count() == 0


def similar_by_brute_force(rows, share=(4, 5)):
    """Component (least id) of each id, by all pairs of five-word shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) * share[1] >= len(sets[a] | sets[b]) * share[0]]
    return joined(near, ids)


def changed_copies(seed, texts, copies, length, shared=0):
    """Random texts with an equal passage of ``shared`` words, and copies that replace 1 to 7 words in 100."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(5000)])
    passage, rows = rng.choice(words, shared), []
    for _ in range(texts):
        text = np.concatenate([passage, rng.choice(words, length)])
        for c in range(copies):
            new = text.copy()
            at = shared + rng.choice(length, c and int(rng.integers(1, max(2, length * 7 // 100))), replace=False)
            new[at] = rng.choice(words, len(at))
            rows.append((len(rows), " ".join(new)))
    return rows


def kept_by_drop(spark, rows):
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity="0.8").collect())


def test_near_copies_are_exactly_those_of_brute_force(spark):
    rows = changed_copies(8, 60, 3, 150)
    want = similar_by_brute_force(rows)
    assert 60 < len(set(want.values())) < 180
    assert kept_by_drop(spark, rows) == sorted(set(want.values()))


@pytest.mark.parametrize("bucket", [1, 2, 5])
def test_near_copies_in_buckets_shared_with_unrelated_texts(spark, bucket):
    rows = changed_copies(9, 40, 3, 60, shared=300)  # the passage weighs more than the texts: similarities around 0.8
    rows += [(1000 + i, t) for i, t in changed_copies(10, 40, 3, 100, shared=12)]
    want = similar_by_brute_force(rows)
    assert 80 < len(set(want.values())) < 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df, similarity="0.8", bucket=bucket).collect()}
    assert got == want


def test_lines_of_one_template_give_no_pairs(spark, monkeypatch):
    """Work grows with the rows: neither equal nor unequal lengths nor two different ends write the pairs of a bucket."""
    made = {}
    keep = simhash.stored

    def counted(df, name):
        out = keep(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    start = "one two three four five six seven eight"
    rows = [(i, f"{start} end{i}") for i in range(1500)]
    rows += [(2000 + i, f"{start} nine{i % 7} end{i}") for i in range(1500)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity="0.8")
    assert kept.count() == 3000
    assert made["candidates"] <= 6000 and made.get("more-candidates", 0) <= 6000


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_near_copies_around_a_missing_original_are_all_found(spark, bucket):
    """Copies of a few texts, similar to each other or only in chains, some shorter, with the originals left out."""
    rng = np.random.default_rng(bucket)
    rows = []
    for i, text in changed_copies(11, 6, 40, 90, shared=20):
        if i % 40:
            words = text.split()
            rows.append((i, " ".join(words[:len(words) - int(rng.integers(0, 14))])))
    want = similar_by_brute_force(rows)
    assert 6 < len(set(want.values())) < 200
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(
        spark.createDataFrame(rows, "doc_id long, text string"), similarity="0.8", bucket=bucket).collect()}
    assert got == want


def test_near_copies_meet_by_the_trie_first(spark, monkeypatch):
    """The stage links fingerprints by the trie join; its links become candidates, and only similar texts are joined."""
    import corpus_pipeline

    rows = changed_copies(13, 30, 4, 900)
    prints = {i: simhash.voted(simhash.shingles(t.encode())) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert near
    seen, keep = [], simhash._trie_pairs
    monkeypatch.setattr(simhash, "_trie_pairs", lambda nodes, budget: seen.append((nodes, budget, keep(nodes, budget))) or seen[-1][2])
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(similar_by_brute_force(rows, (159, 200)).values()))
    (nodes, budget, pairs), = seen
    told = nodes.collect()
    of = {r.print & (2**64 - 1): r.node for r in told}
    linked = joined([(r.u, r.v) for r in pairs.collect()], [r.node for r in told])
    assert budget == 2 and all(linked[of[prints[a]]] == linked[of[prints[b]]] for a, b in near)


def test_near_copies_keep_less_similar_and_unique_texts(spark):
    start = "one two three four five six seven"
    rows = [(i, f"{start} end{i}") for i in range(40)]  # a similarity of 0.6
    text = " ".join(f"w{i}" for i in range(400))
    rows += [(100, text), (101, f"{text} more"), (101, "a unique text under an id that repeats")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == sorted(r for r in rows if r != (101, f"{text} more"))


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, None), (3, ""), (9, "one"), (8, "ONE"), (1, text), (2, text), (None, text), (None, "alone here now"), (4, "w0 " * 60_000), (4, "w0 " * 60_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, print string, links int")
    got = [tuple(r)[:3] for r in simhash.near_duplicates(df).collect()]
    ids = sorted([(i, c) for i, _, c in got], key=str)
    assert ids == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (1, 1), (2, 1), (None, 1), (None, None), (4, 4), (4, 4)], key=str)
    assert {f for i, f, _ in got if i in (3, 5)} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "8", "1", "4", "4", "None", "None"])


TURNS = "conv_id long, turn long, role string, text string, place int, pair_id string"


def turns(spark, conversations):
    rows = [(c, i, r, t, 1, "x") for c, own in conversations for i, (r, t) in enumerate(own)]
    return spark.createDataFrame(rows, TURNS)


def formatted(spark, conversations):
    made = preferences.preferences(turns(spark, conversations), F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    return {r.pair_id: r for r in made.collect()}


def test_preferences(spark):
    start = [("system", "be kind"), ("user", "hi")]
    got = formatted(spark, [
        (0, [*start, ("assistant", "hello"), ("user", "bye")]), (1, [*start, ("assistant", "no")]),
        (2, start), (3, start), (4, start), (5, [*start, ("assistant", "more")]),
        (6, [("user", "a")]), (7, [("assistant", "a")]), (8, start), (None, start), (11, [("user", None)] * 3), (10, [("user", ""), (None, "x" * 100_000)])])
    assert set(got) == {0, 1, 2, 3, 5}
    r = got[0]
    assert r.prompt == "<|turn|>system\nbe kind<|done|>\n<|turn|>user\nhi<|done|>\n" and r.prompt_turns == 2
    assert r.chosen == "<|turn|>assistant\nhello<|done|>\n<|turn|>user\nbye<|done|>\n"
    assert [r.chosen[s.start:s.end] for s in r.chosen_mask] == ["hello<|done|>\n"]
    assert [r.rejected[s.start:s.end] for s in r.rejected_mask] == ["no<|done|>\n"]
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected) == (2, "", "")
    assert (got[2].chosen, got[2].rejected) == ("", "<|turn|>assistant\nmore<|done|>\n")
    assert got[3].prompt_turns == 0 and got[3].prompt == "" and got[3].chosen_mask == []
    assert got[5].prompt_turns == 1 and len(got[5].chosen) > 100_000
    assert preferences.preferences(turns(spark, []), F.col("conv_id"), F.lit(True)).count() == 0


def test_last_turns_are_swapped(spark):
    pairs = queries.answer_pairs(turns(spark, [(0, [("user", "a"), ("assistant", "b")]), (1, [("user", "c")]), (2, [("user", "d")])]))
    assert sorted((r.conv_id, r.turn, r.text) for r in pairs.collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c"), (2, 0, "c"), (3, 0, "b"), (4, 0, "d")]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = queries_stored(stage(spark, docs, sf), name)
        sizes.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == sizes[-1] == before.select(F.coalesce("text", F.lit(""))).distinct().count()
            assert docs.join(before.groupBy("text").agg(F.min("doc_id").alias("least")), "text").filter("doc_id <> least").count() == 0
        if name == "near_dedup":
            found = simhash.similar_documents(before)
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in found.collect()}
    assert sizes[1] >= 0.98 * sizes[0] and docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def queries_stored(df, name):
    from reliq.llm.store import stored

    return stored(df, name)
