"""Queries over documents as searchable incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliq.operators import search
from reliq.workload import views
from reliq.workload.registry import query
from reliq.workload.views import INCIDENTS

COLUMNS = ["key", "summary", "status", "root_cause", "body"]

# Brute force: every term of every query against every document.
BM25 = f"""
{INCIDENTS},
idx AS (
  SELECT key AS doc_id, regexp_extract_all(lower(strip_accents(concat_ws(' ', key, summary, status, root_cause, body))), '[\\p{{L}}\\p{{N}}]+') AS toks
  FROM v_incidents),
lens AS (SELECT doc_id, len(toks) AS dl FROM idx),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM idx) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+')) AS token FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT query_id, doc_id, round(sum(qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)
     * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qt JOIN post USING (token) JOIN dfs USING (token) JOIN lens USING (doc_id), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"""


def docs(t):
    return views.incidents(t).withColumn("doc_id", F.col("key"))


@query("bm25_search", f"WITH {BM25} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 10")
def _(t):
    top = search.search(views.search_queries(t), views.incident_index(t), COLUMNS, 10)
    return top.withColumn("score", F.round("score", 4))


@query("duplicate_candidates", f"""WITH {BM25},
w AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)), lambda x: length(x) > 2)) AS q
  FROM (SELECT item_id AS query_id, text FROM benchmark)),
d AS (SELECT key AS doc_id, list_distinct(list_transform(regexp_extract_all(summary || ' ' || body, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))) AS d FROM v_incidents),
s AS (SELECT query_id, doc_id, rank AS pool_rank, round(len(list_intersect(q, d)) / len(q), 9) AS s
  FROM ranked JOIN w USING (query_id) JOIN d USING (doc_id) WHERE rank <= 15)
SELECT query_id, doc_id, round(s, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pool_rank) AS rank FROM s QUALIFY rank <= 5""")
def _(t):
    return search.find_duplicates(views.search_queries(t), docs(t), COLUMNS, 5, index=views.incident_index(t))


@query("contains_search", f"""WITH {INCIDENTS},
h AS (SELECT key AS doc_id, updated, lower(concat_ws(' ', key, summary, status, root_cause, body)) AS hay FROM v_incidents)
SELECT doc_id, updated, contains(hay, 'token')::INT + contains(hay, 'src1')::INT + contains(hay, 'the')::INT AS score
FROM h WHERE score > 0 ORDER BY score DESC, updated DESC, doc_id LIMIT 20""")
def _(t):
    return search.search_contains(docs(t), "token src1 the", COLUMNS, 20).select("doc_id", "updated", "score")


@query("term_predicates", """WITH x AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS h FROM documents)
SELECT doc_id, contains(h, ' the ') AND contains(h, ' of ') AS all_of, contains(h, ' token ') OR contains(h, ' ist ') AS any_of,
  NOT contains(h, ' the ') AS none_of, contains(h, ' is the ') AS phrase, contains(h, ' tok') AS prefix FROM x""")
def _(t):
    d = t.spread("documents").withColumn("_t", search.term_text("text"))
    m = search.text_match
    c = F.col("_t")
    return d.select("doc_id", m(c, all_of=["the", "of"]).alias("all_of"), m(c, any_of=["token", "ist"]).alias("any_of"),
                    m(c, none_of=["the"]).alias("none_of"), m(c, phrase="is the").alias("phrase"), m(c, prefix="tok").alias("prefix"))


@query("document_frequency", """SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS uses FROM (
  SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS token FROM documents) GROUP BY ALL)
GROUP BY token""")
def _(t):
    return views.document_index(t).uses()


@query("index_gaps", """SELECT doc_id FROM labels WHERE doc_id NOT IN (
  SELECT doc_id FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]'))""")
def _(t):
    return views.document_index(t).gaps(t("labels").select("doc_id"))
