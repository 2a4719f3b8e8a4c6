"""Registered queries of this package over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliq.llm import bpe, brown, exact_dedup, filter_audit, langid, mixing, preferences, repair, sentence_pieces, simhash, substrings, token_counts, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS, COUNTED, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Token shares of the domains that the mixture aims at: fewer low and toxic ones than are found, so that clean texts keep a rate of 1 or more.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(parts: int) -> F.Column:
    """crc32 of the document's id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


@_query("op1_pivot_top_k", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""")
def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@_query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    both = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("low").alias("domain"))


@_query("op3_soft_mixture")
def op3_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), domains(_table(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", "n_tokens", *(F.get("posterior", i).alias(f"p_{d}") for i, d in enumerate(TARGETS)), "rate")


@_query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


@_query("op5_brown_lm")
def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(_table(spark, sf_dir, "documents"), remainder(5) != 1)


@_query("op6_simhash_trie")
def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, budget=2, seed=42)


@_query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(3) == 0, remainder(3) == 2)
    return langid.predict(model, docs.withColumn("held_out", remainder(3) == 1), ["doc_id", "held_out"])


@_query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED), limit=512)


@_query("op9_repeated_windows", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), h AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS t FROM p
), rep AS (
  SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY t) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM rep
), g AS (
  SELECT r, list(i) AS gone FROM gone GROUP BY r
), k AS (
  SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (r)
)
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM k
""")
def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=35, first=18)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def answer_pairs(turns: DataFrame) -> DataFrame:
    """Each conversation as the chosen side (2 * id), and as the rejected side (2 * id + 1) with its neighbour's last turn for its own.

    The neighbour of an even id is the next, of an odd id the one before.
    """
    last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("last"))
    swapped = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last").alias("other"))
    ends = last.join(swapped, "conv_id")
    chosen = turns.select((F.col("conv_id") * 2).alias("conv_id"), "turn", "role", "text")
    before = turns.join(last, "conv_id").filter("NOT (turn <=> last.turn)").select((F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", "role", "text")
    after = ends.select((F.col("conv_id") * 2 + 1).alias("conv_id"), F.col("last.turn").alias("turn"), F.col("other.role").alias("role"), F.col("other.text").alias("text"))
    return chosen.unionByName(before).unionByName(after)


@_query("op10_preference_format", """
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
), l AS (SELECT conv_id, role, text FROM t WHERE place = n),
c AS (
  SELECT t.conv_id AS pair_id, t.place, t.n, t.role AS role, t.text AS text,
    CASE WHEN t.place < t.n THEN t.role ELSE l.role END AS bad_role, CASE WHEN t.place < t.n THEN t.text ELSE l.text END AS bad_text
  FROM t LEFT JOIN l ON l.conv_id = xor(t.conv_id, 1)
), s AS (
  SELECT *, '<|turn|>' || role || chr(10) || text || '<|done|>' || chr(10) AS good, '<|turn|>' || bad_role || chr(10) || bad_text || '<|done|>' || chr(10) AS bad,
    place < n OR (role IS NOT DISTINCT FROM bad_role AND text IS NOT DISTINCT FROM bad_text) AS same
  FROM c
)
SELECT pair_id, (count(*) FILTER (WHERE same))::INTEGER AS prompt_turns, coalesce(string_agg(good, '' ORDER BY place) FILTER (WHERE same), '') AS prompt,
  coalesce(string_agg(good, '') FILTER (WHERE NOT same), '') AS chosen, coalesce(string_agg(bad, '') FILTER (WHERE NOT same), '') AS rejected,
  coalesce(string_agg((9 + length(role))::VARCHAR || '-' || length(good)::VARCHAR, '') FILTER (WHERE NOT same AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((9 + length(bad_role))::VARCHAR || '-' || length(bad)::VARCHAR, '') FILTER (WHERE NOT same AND bad_role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair_id
""")
def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = answer_pairs(_table(spark, sf_dir, "conversations"))
    made = preferences.preferences(pairs, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)

    def spans(mask: str) -> F.Column:
        return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["end"])), ";")

    return made.withColumns({m: spans(m) for m in ("chosen_mask", "rejected_mask")})


@_query("op11_filter_audit", r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, list_filter(
    [CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
     CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
     CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
     CASE WHEN coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), s AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM n a JOIN n b ON b.x <> a.x JOIN n c ON c.x NOT IN (a.x, b.x)
  JOIN n d ON d.x NOT IN (a.x, b.x, c.x) JOIN n e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), p AS (
  SELECT filter_order, step::INTEGER AS step, string_split(left(filter_order, step - 1), '') AS before, substr(filter_order, step, 1) AS x
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), m AS (
  SELECT s.*, filter_order, step, x, list_has_any(fails, before) AS gone, list_contains(fails, x) AS here FROM s, p
), r AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND here THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN here AND len(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = filter_audit.text_fields(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(fields, filter_audit.quality_filters(), F.col("part"), F.col("good"), F.col("toxic"))


@_query("op12_sentence_pieces")
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentence_pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op13_structure_repair", r"""
WITH RECURSIVE z AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)
), t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, z.crc[(xor(c, b) & 255) + 1]))) % 20 AS k
  FROM conversations, z
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again
  FROM t WHERE k <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen, left(role, 1) AS x
  FROM d
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM o
), e AS (
  SELECT *, fault IN ('b', 'd') AS goes, (fault = 't')::INTEGER AS own, role || ':' || text || chr(10) AS line FROM f
), r AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 100000, 'a': '', 't': ''} AS s1, {'c': 100000, 'a': '', 't': ''} AS s2,
    {'c': 100000, 'a': '', 't': ''} AS s3 FROM e
  UNION ALL
  SELECT conv_id, i,
    list_min([{'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t}]),
    list_min([{'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t}, {'c': CASE WHEN goes OR x <> 's' THEN 100000 ELSE s0.c + own END, 'a': s0.a || 'K', 't': s0.t || line}]),
    list_min([{'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t}] || list_transform([s0, s1, s3], lambda s: {'c': CASE WHEN goes OR x <> 'u' THEN 100000 ELSE s.c + own END, 'a': s.a || 'K', 't': s.t || line})
      || list_transform([s0, s1, s3], lambda s: {'c': CASE WHEN goes THEN 100000 ELSE s.c + own + 2 END, 'a': s.a || 'R', 't': s.t || 'user:' || text || chr(10)})
      || list_transform([s2], lambda s: {'c': CASE WHEN goes OR x <> 'u' THEN 100000 ELSE s.c + own + 2 END, 'a': s.a || 'IK', 't': s.t || 'assistant:' || chr(10) || line})
      || list_transform([s2], lambda s: {'c': CASE WHEN goes THEN 100000 ELSE s.c + own + 4 END, 'a': s.a || 'IR', 't': s.t || 'assistant:' || chr(10) || 'user:' || text || chr(10)})),
    list_min([{'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t}, {'c': CASE WHEN goes OR x <> 'a' THEN 100000 ELSE s2.c + own END, 'a': s2.a || 'K', 't': s2.t || line},
      {'c': CASE WHEN goes THEN 100000 ELSE s2.c + own + 2 END, 'a': s2.a || 'R', 't': s2.t || 'assistant:' || text || chr(10)}]
      || list_transform([s0, s1, s3], lambda s: {'c': CASE WHEN goes OR x <> 'a' THEN 100000 ELSE s.c + own + 2 END, 'a': s.a || 'IK', 't': s.t || 'user:' || chr(10) || line})
      || list_transform([s0, s1, s3], lambda s: {'c': CASE WHEN goes THEN 100000 ELSE s.c + own + 4 END, 'a': s.a || 'IR', 't': s.t || 'user:' || chr(10) || 'assistant:' || text || chr(10)}))
  FROM (SELECT e.conv_id, e.i, s0, s1, s2, s3, goes, own, x, line, text FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i + 1)
), b AS (
  SELECT conv_id, list_min([s0, {'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || 'user:' || chr(10) || 'assistant:' || chr(10)},
    {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || 'assistant:' || chr(10)}, s3]) AS best
  FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(left(best.t, length(best.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
""")
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    reports, repaired = repair.repair(repair.damaged(turns))
    return repair.with_digests(turns.select("conv_id"), reports, repaired)
