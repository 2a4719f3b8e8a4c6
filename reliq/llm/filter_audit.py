"""Filter interaction audit: what every filter removes, in every order of the filters, and its share of the whole.

Documents are reduced to how many fail each set of filters, per part of the corpus. A filter order is a path through the lattice of
subsets of filters, from none applied to all applied; applying filter f in state S is an edge that removes the documents which
fail f and nothing in S. Paths are counted forward (orders that reach a state) and backward (orders from a state to the end), so an
edge lies on forward * backward orders: edge removals with these weights add up to a filter's removals over all orders, k! times its
Shapley value. A single order's steps are read from the same edges. With k filters there are 2^k states and k * 2^(k-1) edges, so
only counts meet them: nothing is computed per document and order.

Defined cases: a filter that is null does not fail; a null part reads as the empty text; every part gets rows for all edges and
orders, zeros included; repeated rows count as often as they occur; an empty table gives an empty table; extra columns are not read.
Everything is native: one aggregate with partial sums reads the documents, the rest works on at most 4 * 2^k rows per part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders grow with the factorial of the number of filters.
MOST_FILTERS = 7
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """(forward, backward): for every set of k filters (as bits) how many orders reach it, and how many lead on from it to all."""
    states = range(1 << k)
    forward, backward = [1] + [0] * (len(states) - 1), [0] * (len(states) - 1) + [1]
    for s in states:
        for f in range(k):
            if s >> f & 1:
                forward[s] += forward[s ^ 1 << f]
    for s in reversed(states):
        for f in range(k):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def lattice_edges(k: int) -> list[tuple[int, int, int]]:
    """(state before, filter, number of orders that pass) of every edge."""
    forward, backward = path_counts(k)
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def order_steps(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, state before, filter) of every order of the filters."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return rows


def failing_sets(docs: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """(part, fails, docs, good, toxic): documents by the set of filters they fail, filter i as bit i."""
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    rows = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), sum(bits, F.lit(0)).alias("fails"),
                       F.coalesce(good, F.lit(False)).cast("int").alias("good"), F.coalesce(toxic, F.lit(False)).cast("int").alias("toxic"))
    return rows.groupBy("part", "fails").agg(F.count("*").alias("docs"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def _literal(rows: list[tuple], fields: str) -> Column:
    """Rows as one literal array of structs."""
    names = fields.split()
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))


def edge_counts(sets: DataFrame, k: int) -> DataFrame:
    """(part, state, filter, orders, kept, removed, ...): what happens on every edge; a set meets the k * 2^(k-1) edges of a literal."""
    met = sets.withColumn("edge", F.explode(_literal(lattice_edges(k), "state filter orders"))).select(
        "part", "fails", "docs", "good", "toxic", F.col("edge.state").alias("state"), F.col("edge.filter").alias("filter"), F.col("edge.orders").cast("long").alias("orders"))
    bit = F.expr("shiftleft(1, filter)")
    failed, here = F.col("fails").bitwiseAND(F.col("state")) != 0, F.col("fails").bitwiseAND(bit) != 0
    removed = here & ~failed

    def total(condition: Column, of: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    return met.groupBy("part", "state", "filter", "orders").agg(
        total(~here & ~failed).alias("kept"), total(removed).alias("removed"), total(here & failed).alias("redundant"),
        total(F.col("fails") == bit).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"))


def audit(docs: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) per part, order and step.

    ``filters`` maps one-letter names to conditions that hold for a failing document. ``kept`` counts after the step, ``removed`` in it,
    ``redundant`` documents fail the step's filter but went before, ``unique_fails`` fail no other filter; ``shapley`` is the filter's
    removals added up over all orders (divide by the number of orders for its Shapley value).
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS or any(len(name) != 1 for name in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter are needed")
    edges = edge_counts(failing_sets(docs, filters, part, good, toxic), k)
    whole = F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "filter"))  # 2^(k-1) edges
    steps = docs.sparkSession.createDataFrame(order_steps("".join(filters)), "filter_order string, step int, state int, filter int")
    met = edges.withColumn("shapley", whole).join(F.broadcast(steps), ["state", "filter"])  # k * k! rows
    return met.select("part", "filter_order", "step", *COUNTS, "shapley")


def shapley_values(docs: DataFrame, filters: dict[str, Column], part: Column) -> DataFrame:
    """(part, filter, removals, shapley): the mean removal of every filter over all orders, as a share of the removals."""
    k, names = len(filters), list(filters)
    edges = edge_counts(failing_sets(docs, filters, part, F.lit(False), F.lit(False)), k)
    summed = edges.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("removals"))
    return summed.select("part", F.get(F.array(*map(F.lit, names)), F.col("filter")).alias("filter"), "removals", (F.col("removals") / factorial(k)).alias("shapley"))


# --- the filters of the audit query ----------------------------------------------------------------------------------


def text_fields(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, n_words, n_distinct, n_upper, n_chars, symbols, copy, good, toxic): what the filters read, without texts.

    ``copy``: the same text stands under a smaller id anywhere; a null id is no smaller and no larger one. Texts are equal when
    their SHA-256 are. Labels that repeat an id count if any of them says so.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\f\r", " " * 5), " "), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(part_col).alias("part"), text.alias("text")).select(
        "doc_id", "part", "text", words.alias("words"))
    slim = rows.select(
        "doc_id", "part", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_upper"), F.char_length("text").alias("n_chars"),
        F.col("text").rlike("[#$%&*|]").alias("symbols"), F.unhex(F.sha2("text", 256)).alias("hash"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    repeated = slim.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("hash", "least")
    return slim.join(repeated, "hash", "left").join(known, "doc_id", "left").select(
        *(c for c in slim.columns if c != "hash"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy"), "good", "toxic")


def quality_filters(min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3) -> dict[str, Column]:
    """A: few words, B: few distinct words, C: many capitals, D: symbols, E: a copy; over the columns of ``text_fields``."""
    return {
        "A": F.col("n_words") < min_words, "B": 100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        "C": 100 * F.col("n_upper") > upper_percent * F.col("n_chars"), "D": F.col("symbols"), "E": F.col("copy"),
    }
