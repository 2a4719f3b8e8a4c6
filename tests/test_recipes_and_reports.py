import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from reliq.operators import incidents, recipes, search, stability, traces
from reliq.operators import evidence

T0 = datetime(2026, 1, 1)


def parts(spark, rows):
    df = spark.createDataFrame(rows, "id string, e string, a string, s string, m string")
    return recipes.with_parts(df, "e", "a", "s", "m")


def test_signatures_match_the_published_json_form(spark):
    out = {r.id: r for r in parts(spark, [
        ("1", "TimeoutError", "click", "#btn-1f9c", "Timeout 3000ms exceeded\nmore"), ("2", "TimeoutError", "click", "#btn-59c2", "Timeout 99ms exceeded"),
        ("3", "TimeoutError", "click", "#other", "x"), ("4", None, None, None, ' "q"\\ '), ("5", "", "", "#99", "<h>")]).collect()}
    assert out["1"].signature == out["2"].signature != out["3"].signature and out["1"].relaxed_key == out["3"].relaxed_key
    want = {"framework": "playwright", "error_class": "", "failing_action": "", "selector_shape": "", "message_shape": '"q"\\'}
    assert out["4"].signature == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest()
    assert [out[k].degenerate for k in "12345"] == [False, False, False, False, True]


def test_recipe_life(spark):
    p = parts(spark, [("1", "E", "click", "#a", "m"), ("2", "E", "click", "#b", "m"), ("3", "", "", "", ""), ("4", "Z", "hover", "#a", "m")])

    def body(ids, strategy, ts):
        return p.filter(F.col("id").isin(*ids)).select("signature", "relaxed_key", "degenerate", F.lit(strategy).alias("strategy"), F.lit("[]").alias("patch_ops_json"),
                                                       F.lit("{}").alias("diagnosis_json"), F.lit(ts).cast("timestamp_ntz").alias("created_ts"))

    one = recipes.upsert(None, body("13", "s1", T0))
    assert one.count() == 1  # degenerate parts are never stored
    sig = one.head().signature
    used = recipes.bump(one, spark.createDataFrame([(sig, True), (sig, False), (sig, True)], "signature string, success boolean").withColumn("ts", F.lit(T0).cast("timestamp_ntz")))
    r = used.head()
    assert (r.hits, r.successes, r.failures) == (3, 2, 1)
    same = recipes.upsert(used, body("1", "s1", datetime(2026, 2, 1))).head()
    assert (same.hits, same.created_ts, same.last_used_ts) == (3, T0, T0)
    new = recipes.upsert(used, body("1", "s2", datetime(2026, 2, 1))).head()
    assert (new.hits, new.strategy, new.last_used_ts) == (0, "s2", None)
    kinds = {r.id: (r.kind, r.strategy) for r in recipes.match(p, used, "id").collect()}
    assert kinds == {"1": ("exact", "s1"), "2": ("relaxed", "s1"), "3": ("miss", None), "4": ("miss", None)}
    assert recipes.export(used).head().sig8 == sig[:8]


def test_best_relaxed_recipe(spark):
    rows = [("s1", "k", "a", 2, 1, T0), ("s2", "k", "b", 2, 0, T0), ("s3", "k", "c", 1, 0, T0), ("s4", None, "d", 9, 0, T0)]
    stored = spark.createDataFrame(rows, "signature string, relaxed_key string, strategy string, successes bigint, failures bigint, created_ts timestamp_ntz")
    want = spark.createDataFrame([("x", "none", "k", False)], "id string, signature string, relaxed_key string, degenerate boolean")
    assert recipes.match(want, stored, "id").head().recipe == "s2"


def test_stability_and_outcomes(spark):
    runs = spark.createDataFrame([("a", 0, 1.0, False), ("a", 1, 2.0, True), ("a", 1, 2.0, False), ("b", 0, 1.5, False)], "test_id string, exit_code int, duration_s double, timed_out boolean")
    out = {r.test_id: r for r in stability.stability_report(runs, "test_id").collect()}
    assert (out["a"].runs, out["a"].passed, out["a"].failed, out["a"].timed_out_runs, out["a"].exit_codes) == (3, 1, 2, 1, {0: 1, 1: 2})
    assert out["b"].all_green and not out["b"].any_failed
    cols = "id string, category string, is_flaky boolean, all_green boolean, has_pr boolean, has_report boolean, gate_ok boolean, created boolean, write_enabled boolean"
    rows = [("1", "flaky", None, True, False, None, None, None, False), ("2", "timeout", None, True, True, None, None, None, False), ("3", "flaky", None, False, None, None, None, None, False),
            ("4", "data", True, None, None, True, True, None, False), ("5", "data", None, None, None, True, True, True, True), ("6", "data", None, None, None, True, False, None, True),
            ("7", None, True, True, False, None, None, None, False), ("8", None, False, None, None, None, None, None, False), ("9", "data", None, None, None, True, True, False, True)]
    got = {r.id: (r.branch, r.outcome) for r in stability.outcome(stability.route(spark.createDataFrame(rows, cols))).collect()}
    assert got == {"1": ("heal", "healed"), "2": ("heal", "pr_opened"), "3": ("heal", "needs_attention"), "4": ("bug", "ticket_ready"), "5": ("bug", "ticket_created"),
                   "6": ("bug", "needs_attention"), "7": ("heal", "healed"), "8": (None, "needs_attention"), "9": ("bug", "needs_attention")}


REPORT = {"title": " Login\n breaks " + "x" * 100, "summary": "s" * 5000, "reproduction_steps": ["open a@b.com", "click"] + ["z"] * 60, "expected_behavior": "ok", "actual_behavior": "dni 12345678Z",
          "severity": "high", "severity_rationale": "", "missing_evidence": []}


def test_reports_and_tickets(spark):
    bad = [{**REPORT, "severity": "urgent"}, {k: v for k, v in REPORT.items() if k != "title"}, {**REPORT, "missing_evidence": "x"}, [1]]
    df = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate([REPORT, *bad])] + [("9", "nope")], "report_id string, json string")
    good, rejects = stability.normalize_reports(df)
    r = good.head()
    assert len(r.title) == 80 and r.title.startswith("Login breaks x") and r.title.endswith("…")
    assert len(r.summary) == 4000 and len(r.reproduction_steps) == 50
    assert {x.report_id for x in rejects.collect()} == {"1", "2", "3", "4", "9"}
    t = stability.ticket_rows(good.withColumn("summary", F.lit("short"))).head()
    assert t.egress_masked and "dni ********Z" in t.body and "1. open [redacted-email]\n2. click" in t.body and "Severity: high" in t.body and "rationale" not in t.body
    raw = spark.createDataFrame([("a", "ok", None), ("b", "  ", None), ("c", "é" * 9000, None), ("d", "x", "y" * 5000)], "report_id string, raw_text string, context string")
    usable, no = stability.check_raw_reports(raw)
    assert usable.head().report_id == "a" and {x.report_id for x in no.collect()} == {"b", "c", "d"}


def index(spark):
    rows = [("I-1", "Login timeout for Jane Doe", "Open", "Jane Doe", "login page timeout after deploy"), ("I-2", "Checkout fails", "Open", "", "payment error in checkout and login"),
            ("I-3", "Login", "Done", "", "nothing"), ("I-4", "Other", "Done", "", "disk full")]
    df = spark.createDataFrame(rows, "key string, summary string, status string, reporter string, body string")
    return incidents.prepare_rows(df)[0]


def test_search_ranks_like_brute_force_with_tiny_seeds(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(search, "SEED_POSTINGS", 5)  # forces the common-term bound into play
    rng = random.Random(5)
    words = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(40)]
    docs = {f"d{i:03d}": " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for i in range(120)}
    asks = {i: " ".join(rng.choice(words) for _ in range(6)) for i in range(25)}
    n, avg = len(docs), sum(len(d.split()) for d in docs.values()) / len(docs)
    tf = {k: Counter(d.split()) for k, d in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    want = {}
    for q, text in asks.items():
        scores = {}
        for k, c in tf.items():
            s = sum(qtf * max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for t, qtf in Counter(text.split()).items() if t in c)
            if any(t in c for t in text.split()):
                scores[k] = round(s, 9)
        want[q] = [k for k, _ in sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:7]]
    got = {}
    top = search.bm25_top(spark.createDataFrame(list(asks.items()), "query_id int, text string"), spark.createDataFrame(list(docs.items()), "doc_id string, text string"), ["text"], 7)
    for r in top.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: w for q, w in want.items() if w}


def test_redacted_reads(spark):
    asks = spark.createDataFrame([(1, "login timeout"), (2, "!!"), (3, "zebra")], "query_id int, text string")
    hits = {(r.query_id, r["rank"]): r for r in incidents.search_incidents(asks, index(spark), 2).collect()}
    assert set(hits) == {(1, 1), (1, 2)}
    assert hits[1, 1].summary == "Login timeout for [redacted-name]" and set(hits[1, 1].asDict()) == {"query_id", "rank", "key", "summary", "status"}
    lines = incidents.related_lines(asks, index(spark), 1).collect()
    assert [r.lines for r in lines] == ["- I-1: Login timeout for [redacted-name] [Open]"]
    dup = incidents.find_duplicates(asks, index(spark), 2).orderBy("rank").collect()
    assert (dup[0].key, dup[0].score) == ("I-1", 1.0) and dup[1].score == 0.5
    look = {r.incident_key: r for r in incidents.root_causes(spark.createDataFrame([(" I-4 ",), ("I-9",)], "incident_key string"), index(spark)).collect()}
    assert look["I-4"].found and not look["I-9"].found
    note = incidents.safe_notes(spark.createDataFrame([("I-1", "called jane doe")], "incident_key string, note string"), index(spark)).head().note
    assert note == "called [redacted-name]"
    ranked = search.search_contains(index(spark).withColumn("doc_id", F.col("key")), "login error", ["summary", "body"], 3).collect()
    assert [r.key for r in ranked] == ["I-2", "I-1", "I-3"]


def test_upsert_and_removal(spark):
    stored = incidents.upsert(None, index(spark), T0)
    again = index(spark).withColumn("status", F.when(F.col("key") == "I-4", "Open").otherwise(F.col("status")))
    changed = incidents.changed_rows(again, stored)
    assert [r.key for r in changed.collect()] == ["I-4"] and incidents.changed_rows(index(spark), stored).count() == 0
    after = incidents.upsert(stored, changed, datetime(2026, 2, 1))
    assert {r.key for r in after.filter(F.col("indexed_at") > F.lit(T0)).collect()} == {"I-4"} and after.count() == 4
    seen = spark.createDataFrame([("I-1",)], "key string")
    assert incidents.remove_unseen(after, seen, complete=True).count() == 1 and incidents.remove_unseen(after, seen, complete=False).count() == 4
    _, rejects = incidents.prepare_rows(spark.createDataFrame([(" ", "x"), (None, "y"), ("k", None)], "key string, summary string"))
    assert rejects.count() == 2


def test_egress_check(spark):
    rows = spark.createDataFrame([("1", "fine"), ("2", "IBAN GB82 WEST 1234 5698 7654 32")], "k string, t string")
    out = {r.k: r for r in incidents.egress_check(rows, evidence.mask_pii(rows, "k", "t"), "k", "t").collect()}
    assert not out["1"].egress_fired and out["2"].egress_fired and "WEST" not in out["2"].t


def test_match_gives_one_row_per_failure_and_reads_it_once(spark):
    schema = "call_id string, signature string, relaxed_key string, degenerate boolean"
    wanted = spark.createDataFrame([("a", "s1", "k1", False), ("a", "s1", "k1", False), ("b", "s9", "k1", False), ("c", "s9", "k9", False), ("d", "s1", "k1", True), ("e", "s1", "k1", None)], schema)
    stored = spark.createDataFrame([("s1", "k1", "x", 1, 0), ("s2", "k1", "y", 2, 0)], "signature string, relaxed_key string, strategy string, successes long, failures long").withColumn(
        "created_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = sorted(tuple(r) for r in recipes.match(wanted, stored, "call_id").select("call_id", "recipe", "kind").collect())
    assert got == [("a", "s1", "exact"), ("a", "s1", "exact"), ("b", "s2", "relaxed"), ("c", None, "miss"), ("d", None, "miss"), ("e", None, "miss")]


def test_lines_that_are_no_objects_never_reach_the_parser(spark):
    lines = [' \t{"type":"log"}', "{", "[1]", "not json", "\ufeff{}", '"{}"', "", None, '\r\n{"a":1}']
    df = spark.createDataFrame([("t", "0.trace", i, x) for i, x in enumerate(lines)], "trace_id string, entry string, line_no long, line string")
    ev = traces.events(df)
    assert sorted(r.pos.l for r in ev.collect()) == [0, 8]
    assert sorted(r.line_no for r in df.filter(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT")).collect()) == [0, 8]
    assert "RLIKE" in ev._jdf.queryExecution().analyzed().toString()


def test_few_files_are_spread_by_rows(spark, monkeypatch):
    from reliq.workload import registry

    monkeypatch.setattr(registry, "TASK_ROWS", 1000)
    events = registry.Tables(spark, "/root/testdata/sf0.01").spread("events")
    assert events.rdd.getNumPartitions() >= -(-events.count() // 1000)
