"""Exact top-k inner-product search by pivot-table elimination.

Vectors become integers floor(scale * x). One more coordinate makes all candidates equally long, which turns the largest inner
product into the smallest Euclidean distance: d(q, x)^2 = |q|^2 + R^2 - 2 q.x, with R the largest norm. Distances of every
vector to the pivots are computed once (the pivot table); |d(q, p) - d(x, p)| over all pivots p gives each candidate its
greatest lower bound. Candidates are evaluated in the order of these bounds, exactly and in integers, until the next bound
cannot reach the k-th best score. Pivots come from a bounded sample and decide the speed only, never the result.

Queries and candidates meet in blocks of bounded size, one group per pair of blocks; each returns at most k rows per query.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter vectors read as padded with
zeros; ties go to the smaller id; rows that repeat id and vector count once; rows sharing the query's id are its own and never
candidates; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq.llm.store import stored

#: Pivots, rows sampled to choose them from, and rows of a block of queries and of candidates.
PIVOTS, SAMPLE, QUERY_BLOCK, BLOCK = 16, 2048, 2048, 16384
#: Candidates evaluated first (each later step takes twice as many), and queries whose bounds are computed at once.
_STEP, _AT_ONCE = 256, 16


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v: array<long>) of the rows that take part, each once."""
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    ).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first rows of a small sample."""
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots in the space with the extra coordinate; one column per pivot."""
    full = np.hstack([v.astype(np.float64), extra[:, None]])
    squares = (full ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: larger score, then smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _search(q_ids, q, q_far, x_ids, x, x_far, radius: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of one block the k best of one block of candidates: (query id, ids, scores)."""
    top = int(max(abs(x).max(initial=0), abs(q).max(initial=0)))
    exact_floats = top * top * max(q.shape[1], 1) < 1 << 52
    x_far32 = np.ascontiguousarray(x_far.T, np.float32)
    slack = 1e-5 * max(x_far.max(initial=0), q_far.max(initial=0), 1.0)
    if exact_floats:
        q, x = q.astype(np.float64), x.astype(np.float64)
    for start in range(0, len(q), _AT_ONCE):
        far = q_far[start:start + _AT_ONCE].astype(np.float32)
        bound = np.zeros((len(far), len(x)), np.float32)
        gap = np.empty_like(bound)
        for p in range(far.shape[1]):
            np.subtract(x_far32[p][None, :], far[:, p][:, None], out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        for i in range(len(far)):
            one = q[start + i]
            length = float(np.square(one, dtype=np.float64).sum())
            low = np.maximum(bound[i] - slack, 0, dtype=np.float64)
            most = (length + radius * radius - low * low) / 2 + 1  # no candidate scores above this
            others = x_ids != q_ids[start + i]
            most[~others] = -np.inf
            n = int(others.sum())
            if not n:
                continue
            first = np.argpartition(-most, min(_STEP, n) - 1)[:min(_STEP, n)]
            scores, ids = (x[first] @ one).astype(np.int64), x_ids[first]
            keep = _best(scores, ids, k)
            scores, ids = scores[keep], ids[keep]
            worst = scores[-1] if len(scores) == k else -np.inf
            most[first] = -np.inf
            rest = np.flatnonzero((most >= worst) & (most > -np.inf))
            rest = rest[np.argsort(-most[rest])]
            at, step = 0, _STEP
            while at < len(rest):
                part = rest[at:at + step]
                if len(scores) == k and most[part[0]] < scores[-1]:
                    break  # every later bound is lower still
                new = (x[part] @ one).astype(np.int64)
                good = new >= (scores[-1] if len(scores) == k else new.min())
                scores, ids = np.concatenate([scores, new[good]]), np.concatenate([ids, x_ids[part[good]]])
                keep = _best(scores, ids, k)
                scores, ids = scores[keep], ids[keep]
                at, step = at + step, 2 * step
            yield int(q_ids[start + i]), ids, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64,
          pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query row. ``is_query`` reads ``vec_id``."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, scale).withColumn("asked", is_query)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    table = stored(rows.withColumn("square", square), "vectors")
    facts = table.agg(F.count("*"), F.sum(F.col("asked").cast("long")), F.max("square"), F.max(F.size("v"))).first()
    total, asked, radius2, dims = (x or 0 for x in facts)
    schema = "query_id long, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v", "square").toPandas()
    extended = np.hstack([_matrix(sample["v"], dims).astype(np.float64), np.sqrt(np.maximum(radius2 - sample["square"].to_numpy(), 0))[:, None]])
    chosen = _choose_pivots(extended, pivots)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = _matrix(rows["v"], dims)
            far = _distances(v, np.sqrt(np.maximum(radius2 - rows["square"].to_numpy(), 0)), chosen)
            asking = _distances(v, np.zeros(len(v)), chosen)
            small = v.astype(np.int16) if abs(v).max(initial=0) < 1 << 15 else v
            yield pd.DataFrame({"vec_id": rows["vec_id"], "asked": rows["asked"], "v": [x.tobytes() for x in small], "wide": small.dtype.itemsize,
                                "far": [x.tobytes() for x in far.astype(np.float32)], "asking": [x.tobytes() for x in asking.astype(np.float32)]})

    measured = stored(table.mapInPandas(measure, "vec_id long, asked boolean, v binary, wide int, far binary, asking binary"), "pivot-table")
    n_blocks, n_queries = math.ceil(total / block), math.ceil(asked / query_block)
    place = F.xxhash64("vec_id", "v")
    queries = measured.filter("asked").select(
        "vec_id", "v", "wide", F.col("asking").alias("far"), F.pmod(place, F.lit(n_queries)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    candidates = measured.select(
        "vec_id", "v", "wide", "far", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("q"), F.pmod(place, F.lit(n_blocks)).cast("int").alias("b"))

    def unpacked(rows: pd.DataFrame):
        v = np.zeros((len(rows), dims), np.int64)
        for wide in rows["wide"].unique():
            these = (rows["wide"] == wide).to_numpy()
            v[these] = np.frombuffer(b"".join(rows["v"][these]), {2: np.int16, 8: np.int64}[wide]).reshape(-1, dims)
        return rows["vec_id"].to_numpy(), v, np.frombuffer(b"".join(rows["far"]), np.float32).reshape(len(rows), -1)

    def meet(asking: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or offered.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        found = list(_search(*unpacked(asking), *unpacked(offered), math.sqrt(radius2), k))
        return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64),
                             "vec_id": np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in found)]),
                             "score": np.concatenate([np.zeros(0, np.int64), *(s for _, _, s in found)])})

    found = queries.groupBy("q", "b").cogroup(candidates.groupBy("q", "b")).applyInPandas(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
