"""SimHash near-dedup by a binary trie self-join.

Fingerprints: each word shingle votes with the bits of its XXH64 (seed 42); a bit is 1 if set in over half the votes. Only
distinct fingerprints are joined. The join walks the binary trie of fingerprints in pairs of nodes, from the root: a pair's
children are paired, differing bits add up, and a pair is dropped once they exceed the error budget. The top levels are Spark
joins: each node at the depth ``top_bits`` meets the nodes within the budget of it. Every surviving pair of nodes is then one
group, walked down to the leaves in vector steps. A node with too many fingerprints is cut into slices that meet pairwise.
A group returns a spanning forest of its links, so a dense cluster never becomes a list of all pairs.

Defined cases: null and empty texts have no words and the fingerprint zero, linked like any other; texts shorter than a shingle
vote as one shingle; ids may repeat (a null id gives its row a component but never names one); an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliq.llm.components import components
from reliq.llm.store import free_name, id_text, slices, stored, utf8, words_of, worker_drops

#: Fingerprints per trie node at the depth where Spark's joins end; smaller nodes meet more others.
NODE_SIZE = 1 << 16
#: Fingerprints of one slice of a node, and node pairs walked at once.
SLICE_SIZE, WALK = 1 << 16, 1 << 16
_MANY = 1 << 15
#: Bytes of text that a worker holds at once.
_TEXT_BYTES = 4 << 20


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text, A-Z lower-cased; unsigned."""
    words = words_of(text.lower())
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), ">u8", n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _MANY):
        votes += np.unpackbits(hashes[i:i + _MANY].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint of every row as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_drops()
        for batch in batches:
            prints = np.array([fingerprint(t, shingle, seed) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, print long")


def _walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, err: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs into the sorted arrays whose values differ in at most ``budget`` bits; below ``depth`` they differ in ``err``."""
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def set_before(level: int):
        if level not in ones:
            bit = np.uint64(63 - level)
            ones[level] = tuple(np.concatenate(([0], np.cumsum((x >> bit) & np.uint64(1)))).astype(np.int64) for x in (a, b))
        return ones[level]

    left, right = [], []
    waiting = [(depth, np.array([[0], [len(a)], [0], [len(b)], [err]], np.int64))]
    while waiting:
        level, nodes = waiting.pop()
        if nodes.shape[1] > WALK:
            half = nodes.shape[1] // 2
            waiting += [(level, nodes[:, :half]), (level, nodes[:, half:])]
            continue
        pairs = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = (pairs <= 16) | (level == 64)
        if small.any():
            i, j = _spell_out(nodes[:, small], pairs[small])
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            left.append(i[near])
            right.append(j[near])
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        in_a, in_b = set_before(level)
        mid_a = nodes[1] - (in_a[nodes[1]] - in_a[nodes[0]])
        mid_b = nodes[3] - (in_b[nodes[3]] - in_b[nodes[2]])
        diagonal = same & (nodes[0] == nodes[2]) & (nodes[1] == nodes[3])
        below = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            child = np.stack([mid_a if x else nodes[0], nodes[1] if x else mid_a, mid_b if y else nodes[2], nodes[3] if y else mid_b, nodes[4] + (x != y)])
            keep = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= budget)
            if (x, y) == (1, 0):
                keep &= ~diagonal  # the mirror of (0, 1)
            below.append(child[:, keep])
        children = np.concatenate(below, axis=1)
        if children.shape[1]:
            waiting.append((level + 1, children))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _spell_out(nodes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of small node pairs."""
    at = np.repeat(np.arange(nodes.shape[1]), pairs)
    k = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    width = (nodes[3] - nodes[2])[at]
    return nodes[0][at] + k // width, nodes[2][at] + k % width


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_prints(prints: DataFrame, budget: int = 2, node_size: int = NODE_SIZE, slice_size: int = SLICE_SIZE) -> DataFrame:
    """(print, root, links) for distinct fingerprints: edges that connect what the links connect, and parts of link counts.

    A fingerprint differs from at most C(64, 1) + ... + C(64, budget) others, which bounds the links of each.
    """
    total = prints.count()
    top = max(0, math.ceil(math.log2(max(total, 1) / node_size)))
    node = F.shiftrightunsigned("print", 64 - top) if top else F.lit(0).cast("long")
    placed = prints.select("print", node.alias("node"))
    sizes = placed.groupBy("node").agg(F.ceil(F.count("*") / slice_size).cast("int").alias("cut"))
    cells = sizes.select("node", "cut", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("slice"))
    # One trie level after the other: flip at most ``budget`` of the top bits.
    masks = [0]
    for bit in range(top):
        masks += [m | (1 << bit) for m in masks if m.bit_count() < budget]
    near = cells.select(F.col("node").alias("n1"), F.col("slice").alias("s1"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    near = near.withColumn("n2", F.col("n1").bitwiseXOR(F.col("mask"))).join(
        cells.select(F.col("node").alias("n2"), F.col("slice").alias("s2")), "n2")
    near = near.filter("n1 < n2 OR (n1 = n2 AND s1 <= s2)").withColumn("err", F.bit_count("mask"))
    sliced = placed.join(sizes, "node").select("print", "node", F.pmod(F.xxhash64("print"), "cut").cast("int").alias("slice"))
    key = ["n1", "s1", "n2", "s2", "err"]
    first = sliced.join(near, (F.col("node") == F.col("n1")) & (F.col("slice") == F.col("s1"))).select(*key, "print", F.lit(0).alias("side"))
    other = near.filter("n1 <> n2 OR s1 <> s2")
    second = sliced.join(other, (F.col("node") == F.col("n2")) & (F.col("slice") == F.col("s2"))).select(*key, "print", F.lit(1).alias("side"))

    def walk(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        worker_drops()
        values = rows["print"].to_numpy().view(np.uint64)
        a, b = (np.sort(values[(rows["side"] == side).to_numpy()]) for side in (0, 1))
        same = group[0] == group[2] and group[1] == group[3]
        if same:
            b = a
        if not len(a) or not len(b):
            return pd.DataFrame({"print": [], "root": [], "links": []}).astype(np.int64)
        i, j = _walk(a, b, same, top, int(group[4]), budget)
        both = a if same else np.concatenate([a, b])
        j = j if same else j + len(a)
        links = np.bincount(i, minlength=len(both)) + np.bincount(j, minlength=len(both))
        roots = _forest(len(both), i, j)
        hit = links > 0
        return pd.DataFrame({"print": both[hit].view(np.int64), "root": both[roots[hit]].view(np.int64), "links": links[hit]})

    return first.unionByName(second).groupBy(*key).applyInPandas(walk, "print long, root long, links long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) per row; links are distinct other fingerprints within ``budget`` bits."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    edges = stored(linked_prints(prints.select("print"), budget), "links")
    parts = components(edges.select(F.col("print").alias("u"), F.col("root").alias("v")))
    links = edges.groupBy("print").agg(F.sum("links").alias("n_links"))
    named = prints.join(parts.withColumnRenamed("node", "print"), "print", "left").join(links, "print", "left")
    named = named.withColumn("component", F.coalesce("component", "print"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = stored(named.join(ids, "component").select("print", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return rows.join(answer, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# --- texts of similarity 0.8 and more --------------------------------------------------------------------------------

#: Rows of a bucket up to which all its pairs are written out; larger buckets are searched around a pivot.
BUCKET = 32
#: Shingles counted at once for the order of rarity, and the most frequent ones that are told to all tasks.
COUNTED, COMMON = 1 << 20, 1 << 18
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def shingles(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The set of 64-bit hashes of a text's word shingles, sorted; a shorter text is one shingle, one without words has none."""
    words = words_of(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    shingle = min(shingle, len(words))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    out = np.full(n, shingle, np.uint64)
    for i in range(shingle):
        out += hashes[i:i + n]
        for mix in _MIX:
            out ^= out >> np.uint64(33)
            out *= mix
    return np.unique(out)


def _prefix(n, share: Fraction):
    """Of n shingles, so many rarest ones that a text of the wanted similarity has one of them among its own."""
    return n - (n * share.numerator + share.denominator - 1) // share.denominator + 1


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, nu, nv, both) for pairs (u, v): sizes of the two sets and of what they share."""
    v, u = (sets.select(F.col("node").alias(x), F.col("own").alias(f"{x}_own")) for x in "vu")
    both = pairs.select("u", "v").join(v, "v").join(u, "u")  # the side that may repeat is slim when it is dealt
    return both.select("u", "v", F.size("u_own").alias("nu"), F.size("v_own").alias("nv"), F.size(F.array_intersect("u_own", "v_own")).alias("both"))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_drops()
    for batch in batches:
        yield from slices(batch, "text", _TEXT_BYTES)


def voted(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: a bit is 1 if set in over half of them."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _MANY):
        votes += np.unpackbits(hashes[i:i + _MANY].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">u8")[0])


def _trie_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """Pairs (u, v) that connect the nodes (node, print) whose fingerprints the trie join links, as few as connect them; not compared yet."""
    nodes = stored(nodes, "node-prints")
    shown = stored(nodes.groupBy("print").agg(F.min("node").alias("shown")), "distinct-prints")
    within = nodes.join(shown, "print").select(F.col("shown").alias("a"), F.col("node").alias("b"))
    links = stored(linked_prints(shown.select("print"), budget).filter("print <> root").select("print", "root"), "linked-prints")
    across = links.join(shown.withColumnRenamed("shown", "a"), "print").join(shown.select(F.col("print").alias("root"), F.col("shown").alias("b")), "root").select("a", "b")
    return within.unionByName(across).filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def similar_nodes(docs: DataFrame, shingle: int, seed: int, share: Fraction, bucket: int, budget: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, node) and edges (u, v) for rows (doc_id, text); a node is a distinct set of shingles.

    The edges connect exactly what pairs with a Jaccard similarity of ``share`` or more connect. First the sets vote for fingerprints, and
    the trie join links those within ``budget`` bits; its links are compared on the whole sets like all other candidates. What differs in more
    bits, as most pairs of a similarity near ``share`` do, is found by a search that misses none: sets are ordered from rare to
    common shingles (any one order gives the same answer). Two similar sets share one of their first n - ceil(share * n) + 1, so
    they meet in that shingle's bucket, whatever the table's size.

    In the first shingle that two sets share, they share at most what either has from there on: whose bound stays too low is no
    candidate there. The lesser set of a similar pair must have that shingle among its first n - ceil(2 share / (1 + share) n) + 1.
    A bucket without such a set gives no pairs at all, so lines of one template cost one row per line and shingle.

    Small buckets give all other pairs, counted: prefixes that share too little cannot reach the similarity. In a large bucket every
    node is measured against a pivot, the node with the fewest rarer shingles of its own. 1 - similarity is a metric, so two nodes can
    only be similar if their distances from the pivot differ by 1 - share at most; those pairs meet if one of them can be the lesser
    and enough is left from the shingle on, and are measured unless the two are connected already. Every pair
    that becomes an edge was measured on the whole sets.
    """
    top, low = share.numerator, share.denominator

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def common() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            most = np.argsort(-n, kind="stable")[:COMMON >> 2]
            most = most[n[most] > 1]
            none = pa.nulls(len(most), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(found[most].view(np.int64)), pa.array(n[most])], names)

        names = ["doc_id", "text_key", "node", "print", "token", "n"]
        for batch in _small(batches):
            nodes, prints = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(utf8(batch.column("text"))):
                own = shingles(text, shingle, seed)
                nodes[i], prints[i] = xxhash.xxh3_64_intdigest(own.tobytes()), voted(own)
                held.append(own)
                size += len(own)
                if size >= COUNTED:
                    yield common()
                    held, size = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), none, none], names)
        yield common()

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    first = stored(keyed.mapInArrow(read, "doc_id long, text_key long, node long, print long, token long, n long"), "sets")
    found = first.filter("node IS NOT NULL").select("doc_id", "text_key", "node")
    often = first.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "token").limit(COMMON).toPandas()
    known = often["token"].to_numpy(np.int64).view(np.uint64)
    known, counts = known[np.argsort(known)], often["n"].to_numpy(np.int64)[np.argsort(known)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            tokens, nodes, sizes, places = [], [], [], []
            for text in utf8(batch.column("text")):
                own = shingles(text, shingle, seed)
                if not len(own):
                    continue
                rarity = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rarity = np.where(known[at] == own, counts[at], 0)
                rare = own[np.lexsort((own, rarity))[:_prefix(len(own), share)]]
                tokens.append(rare)
                nodes.append(np.full(len(rare), xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64))
                sizes.append(np.full(len(rare), len(own)))
                places.append(np.arange(len(rare)))
            token, node = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (tokens, nodes))
            size, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (sizes, places))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, node, size, place)], ["token", "node", "n", "place"])

    def fits(a: str, b: str) -> Column:
        return F.least(a, b) * low >= F.greatest(a, b) * top

    # Enough is left from the first shared shingle on, whatever its number among the rarest of the two.
    left_over = F.least(F.expr("nu - iu"), F.expr("nv - iv")) * (top + low) >= F.expr("nu + nv") * top

    tokens = docs.select("text").mapInArrow(deal, "token long, node long, n long, place long").withColumn(
        "lesser", (F.col("n") - F.col("place")) * (top + low) >= F.col("n") * 2 * top)
    lesser = F.when(F.col("lesser"), F.col("n"))
    shared = tokens.groupBy("token").agg(
        F.min("node").alias("least"), F.max("node").alias("last"), F.count("*").alias("m"), F.min(lesser).alias("lo"), F.max(lesser).alias("hi"),
        F.min_by("node", F.when(F.col("lesser"), F.shiftleft("place", 32).bitwiseOR(F.shiftrightunsigned("node", 32)))).alias("pivot")).filter("least < last").drop("least", "last")
    met = stored(tokens.join(shared, "token").distinct(), "buckets")
    small, large = met.filter(F.col("m") <= bucket), met.filter(F.col("m") > bucket)
    x, y = (small.select("token", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("place").alias(f"i{k}")) for k in "uv")
    pairs = x.join(y, "token").filter((F.col("u") < F.col("v")) & fits("nu", "nv")).groupBy("u", "v", "nu", "nv").agg(
        F.count("*").alias("c"), F.max(left_over).alias("ok")).filter("ok")
    # Shingles shared in large buckets are not counted here: as many as both have.
    crowd = stored(large.groupBy("node").agg(F.count("*").alias("large")), "crowded")
    for k in "uv":
        pairs = pairs.join(crowd.select(F.col("node").alias(k), F.col("large").alias(f"l{k}")), k, "left")
    rest = F.greatest(*(F.expr(f"n{k} - ({_prefix_sql(f'n{k}', share)})") for k in "uv"))
    reach = F.col("c") + F.least(F.coalesce("lu", F.lit(0)), F.coalesce("lv", F.lit(0))) + rest
    pairs = pairs.filter(reach * (top + low) >= (F.col("nu") + F.col("nv")) * top).select("u", "v")
    # Of a pair, the lesser set has the shared shingle early enough; others of a bucket without such a partner can be left out.
    useful = large.filter(F.expr("lo IS NOT NULL") & (F.col("lesser") | F.expr("n >= lo") & (F.col("hi") * low >= F.col("n") * top)))
    spokes = useful.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    trie = _trie_pairs(first.filter("node IS NOT NULL").groupBy("node").agg(F.first("print").alias("print")), budget)
    candidates = stored(trie.unionByName(pairs).unionByName(spokes).distinct(), "candidates")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            own = [shingles(t, shingle, seed).view(np.int64) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    wanted = candidates.select(F.col("u").alias("node")).unionByName(candidates.select(F.col("v").alias("node"))).distinct()
    # stored, so that its size is known before texts are dealt
    texts = stored(found.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")), "whole-keys")
    sets = stored(keyed.select("text", "text_key").join(texts, "text_key").groupBy("node").agg(F.any_value("text").alias("text")).mapInArrow(
        collect, "node long, own array<long>"), "whole-sets")
    similar = F.col("both") * (top + low) >= (F.col("nu") + F.col("nv")) * top
    scored = stored(_scored(candidates.select(F.col("v").alias("u"), F.col("u").alias("v")), sets), "scored")
    edges = scored.filter(similar).select("u", "v")
    if crowd.isEmpty():
        return found, edges

    # The other pairs of large buckets: at least one of the two is not connected with the pivot.
    parts = components(edges)
    # bands are a little wider than the distance, so that rounding never parts neighbours
    band = F.floor((1 - F.col("both") / (F.col("nu") + F.col("nv") - F.col("both"))) * (low / (low - top) * 0.999) if top < low else F.lit(0)).cast("int")
    placed = useful.filter("node <> pivot").join(scored.select(F.col("u").alias("node"), F.col("v").alias("pivot"), band.alias("band")), ["node", "pivot"])
    for k, p in (("node", "part"), ("pivot", "pivot_part")):
        placed = placed.join(parts.select(F.col("node").alias(k), F.col("component").alias(p)), k, "left").withColumn(p, F.coalesce(p, k))
    placed = stored(placed.select("token", "node", "n", "place", "lesser", "band", "part", "pivot_part"), "around-pivots")
    # Every node looks for lesser partners; only those that can be the lesser one look for greater ones.
    roles = {k: F.explode(F.when(F.col("lesser"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(k == "u")))).alias("role") for k in "uv"}
    apart, around = (rows.select("token", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("place").alias(f"i{k}"), F.col("part").alias(f"p{k}"), "band", roles[k])
                     for k, rows in (("u", placed.filter("part <> pivot_part")), ("v", placed)))
    apart = apart.withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))
    more = stored(apart.join(around, ["token", "band", "role"]).filter((F.col("pu") != F.col("pv")) & fits("nu", "nv") & left_over).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "more-candidates")
    return found, stored(edges.unionByName(_scored(more, sets).filter(similar).select("u", "v")), "similar")


def _prefix_sql(n: str, share: Fraction) -> str:
    return f"{n} - CAST(({n} * {share.numerator} + {share.denominator - 1}) DIV {share.denominator} AS BIGINT) + 1"


def text_key(text: Column) -> Column:
    """Hash of a text; null reads as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, similarity: str, bucket: int) -> DataFrame:
    """(doc_id, text_key, component_id) per row."""
    found, edges = similar_nodes(id_text(docs, id_col, text_col), shingle, seed, Fraction(similarity), bucket)
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = nodes.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = stored(named.join(ids, "component").select("node", "component_id"), "similar-classes")
    return found.join(answer, "node").select("doc_id", "text_key", "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, similarity: str = "0.795",
                      bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id) per row: texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more are joined.

    The default takes in what rounds to 0.80.
    """
    return _similar_rows(docs, id_col, text_col, shingle, seed, similarity, bucket).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: str = "0.795") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component (all columns); repeated rows of that id stay together, rows without an id stay."""
    found = _similar_rows(docs, id_col, text_col, shingle, 42, similarity, BUCKET)
    which, text = free_name(docs, "_gone"), free_name(docs, "_gone_text")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(which), F.col("text_key").alias(text)).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == gone[which]) & (text_key(docs[text_col]) == gone[text]), "left_anti")
