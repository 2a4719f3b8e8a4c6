import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reliq.functions import issues
from reliq.functions import signatures as S
from reliq.operators import incidents, recipes, stability, traces, verdicts
from reliq.plans import scan
from reliq.sources import files, junit
from reliq.sources.tables import Store, import_tables
from reliq.streaming import ingest

NOW = datetime(2026, 6, 1, 12)

REPORTS = {
    "basic.xml": '<testsuite name="pytest" tests="3" failures="0" errors="0" skipped="0" timestamp="2026-05-18T14:22:01">'
                 '<testcase classname="a.B" name="t1" file="src/a.py" line="3" time="0.5"/><testcase classname="a.B" name="t2" time="x"/><testcase name="" classname=""/></testsuite>',
    "sub/fail.xml": '<testsuites><testsuite name="jest" timestamp="2026-05-18T10:00:00Z" file="s.js"><testcase name="f"><failure message=" m ">trace<b/>rest</failure></testcase>'
                    '<testcase name="e" file="own.js"><skipped/><failure/><error type="E"> boom </error></testcase><testcase name="s"><skipped message="later"/></testcase></testsuite></testsuites>',
    "nested.xml": '<testsuite name="outer" tests="4"><testcase name="o"/><testsuite name="inner" tests="1" file="i.py"><testcase name="i"/></testsuite></testsuite>',
    "partial.xml": '<testsuites tests="99"><testsuite name="A" tests="3"><testcase name="a"/></testsuite><testsuite name="B"><testcase name="b"/><testcase name="c"/></testsuite></testsuites>',
    "partial2.xml": '<testsuites><testsuite tests="3"><testcase name="a"/></testsuite><testsuite><testcase name="b"/></testsuite></testsuites>',
    "stray.xml": '<other><wrap><testcase name="w" line="1e308" time="inf"/></wrap></other>',
    "html.xml": "<html><body/></html>",
    "broken.xml": "<testsuite><testcase name='x'>",
    "bomb.xml": '<!DOCTYPE l [<!ENTITY a "aa">]><testsuite name="&a;"/>',
    "skip.txt": "not xml",
}


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("junit")
    for name, text in REPORTS.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return junit.read_junit(spark, str(root), NOW, "b1"), root


def test_runs_cases_and_rejects(spark, reports):
    r, _ = reports
    runs = {x.source_file.rsplit("/", 1)[1]: x for x in r.runs.collect()}
    assert {p.path.rsplit("/", 1)[1] for p in r.rejects.collect()} == {"html.xml", "broken.xml", "bomb.xml"}
    assert set(runs) == {"basic.xml", "fail.xml", "nested.xml", "partial.xml", "partial2.xml", "stray.xml"}
    b, f = runs["basic.xml"], runs["fail.xml"]
    assert (b.suite_name, b.total, b.failures, b.run_timestamp) == ("pytest", 3, 0, datetime(2026, 5, 18, 14, 22, 1))
    assert (f.suite_name, f.total, f.failures, f.errors, f.skipped, f.run_timestamp) == ("jest", 3, 1, 1, 1, datetime(2026, 5, 18, 10))
    assert runs["nested.xml"].total == 4  # root attributes, nested suites not doubled
    assert runs["partial.xml"].total == 99 and runs["partial2.xml"].total == 2
    assert runs["stray.xml"].suite_name == "stray.xml" and runs["stray.xml"].run_timestamp is not None
    cases = {(x.source_file.rsplit("/", 1)[1], x.name): x for x in r.cases.join(r.runs.select("run_id", "source_file"), "run_id").collect()}
    t1 = cases["basic.xml", "t1"]
    assert (t1.classname, t1.file_path, t1.line_number, t1.duration_ms, t1.status) == ("a.B", "src/a.py", 3, 500.0, "passed")
    assert cases["basic.xml", "t2"].duration_ms is None and cases["basic.xml", "<unknown>"].classname is None
    fail, err, skip = (cases["fail.xml", n] for n in "fes")
    assert (fail.status, fail.failure_message, fail.stack_trace, fail.file_path) == ("failed", "m", "trace", "s.js")
    assert (err.status, err.failure_type, err.stack_trace, err.file_path) == ("error", "E", "boom", "own.js")
    assert (skip.status, skip.failure_message) == ("skipped", "later")
    assert cases["nested.xml", "i"].file_path == "i.py" and cases["nested.xml", "o"].file_path is None
    assert cases["stray.xml", "w"].line_number is None and cases["stray.xml", "w"].duration_ms is None


def test_stream_then_scan_then_feedback(spark, reports, tmp_path):
    _, root = reports
    store = Store(spark, str(tmp_path / "db"))
    args = (spark, str(root), store, str(tmp_path / "cp"), NOW)
    ingest.stream_junit(*args).awaitTermination()
    assert store.read("test_runs").count() == 6 and store.read("ingest_rejects").count() == 3
    (root / "more.xml").write_text("".join(['<testsuite name="m" timestamp="2026-05-20T00:00:00">', *[f'<testcase name="t1" classname="a.B">{x}</testcase>' for x in ("<failure/>",) * 3], "</testsuite>"]))
    ingest.stream_junit(*args).awaitTermination()  # only the new file is read
    assert store.read("test_runs").count() == 7
    first = scan.run_scan(store, NOW, window_days=30)
    assert first["kind"] == "ok" and first["flaky_found"] == 1
    assert [(r.test_key, r.change) for r in first["changes"].collect()] == [("a.B::t1", "newly_flaky")]
    assert scan.run_scan(store, datetime(2030, 1, 1), window_days=1)["kind"] == "no_runs"
    assert store.read("flaky_verdicts").filter("status = 'flaky'").count() == 1  # the snapshot stands
    assert scan.recent_scans(store).count() == 2
    green = stability.green_runs(stability.stability_report(spark.createDataFrame([("a.B::t1", 0, 1.0)] * 3, "test_id string, exit_code int, duration_s double"), "test_id"), "2026-05-31T00:00:00")
    runs, cases = junit.synthetic_runs(green, NOW)
    store.append("test_runs", runs, "burnin1")
    store.append("test_cases", cases, "burnin1")
    v = verdicts.scan_verdicts(store.read("test_cases"), store.read("test_runs"), NOW, 30).filter("test_key = 'a.B::t1'").head()
    assert (v.passes, v.fails) == (4, 3)


def test_import_fills_in_relaxed_keys(spark, tmp_path):
    def parts(selector):
        return {"framework": "playwright", "error_class": "TimeoutError", "failing_action": "click", "selector_shape": selector, "message_shape": "m"}

    old = [("s1", json.dumps({"diagnosis": {"rule": "x"}, "signature_parts": parts("#a")})), ("s2", json.dumps({"rule": "no parts"})), ("s3", "not json"), ("s4", None)]
    body = "signature string, diagnosis_json string, strategy string, successes bigint, failures bigint, created_ts timestamp_ntz"
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    a.replace("heal", spark.createDataFrame([(s, d, f"by {s}", 1, 0, NOW) for s, d in old], body))
    plan, hooks = {"heal": ("recipes", ["signature"])}, {"heal": recipes.backfill_relaxed_keys}
    assert [tuple(r) for r in import_tables(a, b, plan, "old", dry_run=True, transforms=hooks).collect()] == [("recipes", 4)]
    assert not b.exists("recipes")
    assert [tuple(r) for r in import_tables(a, b, plan, "old", transforms=hooks).collect()] == [("recipes", 4)]
    key = S.relaxed_key({k: F.lit(v) for k, v in parts("#other").items()})  # another selector: no exact match
    want = spark.createDataFrame([("q", "new", False), ("r", "s2", False)], "id string, signature string, degenerate boolean").withColumn("relaxed_key", key)
    got = {r.id: (r.recipe, r.kind) for r in recipes.match(want, b.read("recipes"), "id").collect()}
    assert got == {"q": ("s1", "relaxed"), "r": ("s2", "exact")}
    assert {r.signature for r in b.read("recipes").filter("relaxed_key IS NULL").collect()} == {"s2", "s3", "s4"}

    def broken(table):
        return table.withColumn("x", F.raise_error(F.lit("unreadable recipe")))

    with pytest.raises(Exception, match="unreadable recipe"):
        import_tables(a, Store(spark, str(tmp_path / "c")), plan, "old", transforms={"heal": broken})
    assert Store(spark, str(tmp_path / "c")).get_meta("migrated_from_old") is None


def test_store_versions_import_and_newer_schema(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    a.replace("patterns", spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, n int"))
    b.replace("triage_patterns", spark.createDataFrame([("k1", 9)], "key string, n int"))
    plan = {"patterns": ("triage_patterns", ["key"]), "absent": ("x", [])}
    assert [tuple(r) for r in import_tables(a, b, plan, "old", dry_run=True).collect()] == [("triage_patterns", 2)]
    assert [tuple(r) for r in import_tables(a, b, plan, "old").collect()] == [("triage_patterns", 1)]
    assert {r.key: r.n for r in b.read("triage_patterns").collect()} == {"k1": 9, "k2": 2}
    assert import_tables(a, b, plan, "old").count() == 0
    assert b.read("triage_patterns", version=1).count() == 1
    b.append("log", spark.range(2), 1)
    b.append("log", spark.range(2), 1)
    assert b.read("log").count() == 2 and b.has_batch("log", 1)
    b.set_meta(schema_version="2")
    with pytest.raises(ValueError, match="schema version 2"):
        Store(spark, str(tmp_path / "b"))


def issue(key, **fields):
    return {"key": key, "fields": {"summary": f"sum {key}", "status": {"name": "Open"}, "updated": "2026-01-01T00:00:00", **fields}}


def test_issue_mapping(spark):
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Hello"}, {"type": "text", "text": " you"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "Root cause: bad cable\nmore"}]}]}
    page = {"issues": [
        issue("A-1", description=doc, reporter={"displayName": "Jane"}), issue("A-2", description=" plain ", because="x", **{"Root_Cause": [{"value": "r1"}, "r2", 3]}),
        issue("A-3", description="d", rca=None, customfield_1="conf", status="Closed", assignee={"name": "bob"}), {"key": "A-4", "fields": None}], "nextPageToken": "t"}
    pages = spark.createDataFrame([("p", json.dumps(page))], "page_id string, text string")
    good, bad = incidents.parse_pages(pages)
    rows = {r.key: r for r in incidents.map_issues(good, "customfield_1").collect()}
    assert bad.count() == 0 and good.head().next_token == "t"
    assert rows["A-1"].body == "Hello you\nRoot cause: bad cable\nmore" and rows["A-1"].root_cause == "bad cable" and rows["A-1"].reporter == "Jane"
    assert rows["A-2"].root_cause == "r1, r2, 3" and rows["A-2"].body == "plain"
    assert (rows["A-3"].root_cause, rows["A-3"].status, rows["A-3"].assignee) == ("conf", "Closed", "bob")
    assert rows["A-4"].summary == "" and rows["A-4"].root_cause == ""


@pytest.mark.parametrize("text", ["[]", "nope", '{"issues":{}}', "{}", '{"issues":[],"nextPageToken":5}', '{"issues":[{"key":" "}]}', '{"issues":[{"key":"A","fields":[]}]}', '{"issues":[{"key":"A"},7]}'])
def test_bad_pages_are_rejected_whole(spark, text):
    good, bad = incidents.parse_pages(spark.createDataFrame([("p", text)], "page_id string, text string"))
    assert good.count() == 0 and bad.count() == 1


def test_deep_rich_text_does_not_recurse():
    node = {"type": "text", "text": "x"}
    for _ in range(50_000):
        node = {"type": "q", "content": [node]}
    assert issues._rich_text(node) == "" and issues._rich_text([{"type": "listItem", "content": ["a"]}, None, 5]) == "a\n5"


def test_incident_sync_in_two_batches(spark, tmp_path):
    land = tmp_path / "pages"
    land.mkdir()
    store = Store(spark, str(tmp_path / "db"))

    def sync(query="q"):
        ingest.stream_incidents(spark, str(land), store, str(tmp_path), query, NOW, max_pages=1).awaitTermination()

    def page(name, *rows):
        (land / name).write_text(json.dumps({"issues": list(rows)}))

    page("1.json", issue("A"), issue("B"), issue("A", summary="later wins"))
    page("2.json", issue("C", updated="2026-02-01T00:00:00"))
    sync()
    assert {r.key: r.summary for r in store.read("incidents").collect()} == {"A": "later wins", "B": "sum B", "C": "sum C"}
    assert ingest.finish_sync(store) == "2026-02-01T00:00:00"
    version = store.version("incidents")
    page("3.json", issue("B"))  # unchanged: nothing is written
    sync()
    assert store.version("incidents") == version
    page("4.json", issue("B", status={"name": "Done"}))
    sync()
    assert {r.key: r.status for r in store.read("incidents").collect()}["B"] == "Done"
    sync("other query")  # a new query reads from the first page again and clears the watermark
    assert store.get_meta("sync_watermark") is None
    assert ingest.finish_sync(store, full=True, retention_before="2026-01-15") == "2026-02-01T00:00:00"
    assert [r.key for r in store.read("incidents").collect()] == ["C"]


def test_logs_archives_and_evidence(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_bytes(b"one\ntw\xff")
    good, rejects = files.read_logs(spark, str(tmp_path / "logs"))
    assert good.head().text == "one\ntw�" and rejects.count() == 0
    with zipfile.ZipFile(tmp_path / "r1.zip", "w") as z:
        z.writestr("build/1_x.txt", "ok")
        z.writestr("test/2_y.txt", "bad")
        z.writestr("test/1_z.txt", "bad0")
        z.writestr("test/pic.png", "no")
    (tmp_path / "r2.zip").write_bytes(b"not a zip")
    raw = files._binary(spark, str(tmp_path), "*.zip")
    entries = files.unzip_entries(raw, (".txt",)).withColumn("run_id", F.substring_index("path", "/", -1))
    jobs = spark.createDataFrame([("r1.zip", "test")], "run_id string, name string")
    text = {r.log_id: r.text for r in files.run_logs(files.failed_job_entries(entries.filter("reason IS NULL"), jobs)).collect()}
    assert text == {"r1.zip": "===== test/1_z.txt =====\nbad0\n===== test/2_y.txt =====\nbad"}
    assert entries.filter("reason IS NOT NULL").count() == 1
    ev = tmp_path / "ev"
    ev.mkdir()
    (ev / "t.txt").write_text("mail a@b.com")
    (ev / "b.bin").write_bytes(b"ab\x00c")
    (ev / "i.PNG").write_bytes(b"x")
    (ev / "big.txt").write_bytes(b"a" * 3_000_000 + b" c@d.org")
    out = {r.path.rsplit("/", 1)[1]: r for r in files.read_evidence(spark, str(ev)).collect()}
    assert out["t.txt"].text == "mail a@b.com" and out["b.bin"].skip_reason == "binary" and out["i.PNG"].skip_reason == "ocr_unavailable"
    assert out["big.txt"].text.endswith("c@d.org") and not out["big.txt"].truncated and not out["t.txt"].truncated
    bound = {r.path.rsplit("/", 1)[1]: r for r in files.read_evidence(spark, str(ev), max_bytes=100).collect()}
    assert bound["big.txt"].truncated and len(bound["big.txt"].text) == 100 and not bound["t.txt"].truncated
    two = files.read_evidence(spark, str(ev), max_files=2).collect()
    assert [r.path.rsplit("/", 1)[1] for r in sorted(two, key=lambda r: r.path)] == ["b.bin", "big.txt"] and all(r.truncated for r in two)
    with pytest.raises(ValueError):
        files.read_evidence(spark, str(ev), max_files=0)


def trace_rows(spark, events, network=()):
    rows = [("t", "0.trace", i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)] + [("t", "0.network", i, json.dumps(e)) for i, e in enumerate(network)]
    return spark.createDataFrame(rows, "trace_id string, entry string, line_no int, line string")


BEFORE = {"type": "before", "callId": "c1", "class": "Frame", "method": "click", "params": {"selector": "#btn-1f9c", "timeout": 5000}}


def failed(**error):
    return {"type": "after", "callId": "c1", "error": {"name": "TimeoutError", "message": "Timeout 5000ms exceeded", **error}, "result": {"log": ["waiting for #btn"]}}


SNAP = {"type": "frame-snapshot", "snapshot": {"html": ["HTML", {}, [["DIV", {"id": "btn-59c2", "data-testid": "save"}, "a {\"id\":\"no\"}"], [[1, 2]]]]}}


def diagnose(spark, events, network=()):
    return traces.diagnose(traces.summarize(trace_rows(spark, events, network))).head()


def test_trace_summary_and_rules(spark):
    version = {"type": "context-options", "version": 8}
    r = diagnose(spark, [version, "garbage", "[1]", BEFORE, failed(), SNAP])
    assert (r.cause, r.confidence, r.testid_on_target, r.timeout_ms, r.trace_version, r.actions_total) == ("fragile_selector", 0.85, "save", "5000", 8, 1)
    assert r.recommended_strategy == "testid_selector" and r.triage_label == "flaky" and r.call_log == ["waiting for #btn"]
    pending = [{"type": "resource-snapshot", "snapshot": {"time": -1, "request": {"method": "GET", "url": "https://h:8443/p?token=1"}, "response": {}}}]
    r = diagnose(spark, [BEFORE, failed()], pending)
    assert r.cause == "race_condition" and r.pending_urls == "https://h:8443"
    assert diagnose(spark, [BEFORE, failed()]).evidence.startswith("click on '#btn-1f9c' timed out after 5000ms")
    assert diagnose(spark, [BEFORE, failed(message="net::ERR_CONNECTION_REFUSED")]).cause == "environment"
    assert diagnose(spark, [BEFORE, failed(message="browser has been closed")]).cause == "infra"
    expect = {**BEFORE, "method": "expect", "title": 'expect "toHaveText"'}
    r = diagnose(spark, [expect, failed(name="Error", message="AssertionError: no")])
    assert (r.cause, r.failing_action, r.error_name) == ("data", "expect.toHaveText", "AssertionError")
    assert diagnose(spark, [BEFORE]).cause == "unknown"
    assert traces.summarize(trace_rows(spark, [{"type": "other"}])).count() == 0
    brief = traces.brief(traces.summarize(trace_rows(spark, [BEFORE, failed(message="mail a@b.com password=hunter22")]))).head()
    assert brief.error_message == "mail a***@b****.com password=<REDACTED>"


def test_two_different_test_ids_prove_nothing(spark):
    other = {"type": "frame-snapshot", "snapshot": {"html": ["P", {"id": "btn-77aa", "data-testid": "cancel"}]}}
    assert diagnose(spark, [BEFORE, failed(), SNAP, other]).testid_on_target is None
    exact = {"type": "frame-snapshot", "snapshot": {"html": ["P", {"id": "btn-1f9c"}]}}
    assert diagnose(spark, [BEFORE, failed(), SNAP, exact]).cause == "timeout"  # the exact id decides, and carries none


def test_log_only_diagnosis(spark):
    base = traces.summarize(trace_rows(spark, [BEFORE])).limit(1)
    empty = base.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    df = empty.withColumn("has_trace", F.lit(False)).withColumn("log_excerpt", F.lit("Timeout 300ms exceeded waiting for locator('#a')"))
    r = traces.diagnose(df).head()
    assert (r.cause, r.confidence, r.selector) == ("timeout", 0.6, "#a")


def test_traces_mask_personal_data_and_read_plain_attributes(spark):
    log = {"type": "log", "callId": "c1", "message": "sent to a@b.com"}
    s = traces.summarize(trace_rows(spark, [BEFORE, log, {"type": "error", "message": "for c@d.org"}, failed(message="mail a@b.com")]))
    r = traces.brief(s).head()
    assert "a@b.com" not in str(r) and "c@d.org" not in str(r) and any("sent to" in x for x in r.call_log)
    snap = {"type": "frame-snapshot", "snapshot": {"html": ["P", {"id": "btn-59c2", "data-testid": "save", "n": 1, "b": True}]}}
    assert diagnose(spark, [BEFORE, failed(), snap]).cause == "fragile_selector"


def test_long_inputs_stay_whole(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_bytes(b"line of a log\n" * 2_200_000 + b"end")
    good, rejects = files.read_logs(spark, str(tmp_path / "logs"))
    assert good.select(F.length("text")).head()[0] == 14 * 2_200_000 + 3 and rejects.count() == 0
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "r.xml").write_text('<testsuite name="s">' + '<testcase name="t"><system-out>' + "x" * 70_000_000 + "</system-out></testcase></testsuite>")
    reports = junit.read_junit(spark, str(tmp_path / "xml"), NOW, "b")
    assert reports.rejects.count() == 0 and reports.cases.count() == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "x" * 100)
        z.writestr("b.txt", "y")
    got = {r.entry: r.reason for r in files.unzip_entries(files._binary(spark, str(tmp_path), "z.zip"), (".txt",), max_entry_bytes=50).collect()}
    assert got == {"a.txt": "entry over the size bound", "b.txt": None}


def test_reports_are_handed_back_in_parts_bounded_by_bytes():
    import pyarrow as pa

    def parts(sizes):
        return [p.num_rows for p in junit._parts(pa.RecordBatch.from_pydict({"content": pa.array([b"x" * n for n in sizes], pa.binary())}))]

    assert parts([100] * 1000) == [1000]  # small reports share a batch
    assert parts([10] * (junit.FILES_PER_BATCH + 1)) == [junit.FILES_PER_BATCH, 1]
    assert parts([junit.BATCH_BYTES, 1, 1, junit.BATCH_BYTES, 5]) == [1, 3, 1]
    assert parts([]) == []


def test_rich_text_is_flattened_in_parts_bounded_by_bytes(spark, monkeypatch):
    import pyarrow as pa


    texts = pa.RecordBatch.from_pydict({"t": pa.array(["x" * issues.PART_BYTES, "a", None, "x" * issues.PART_BYTES, "b"])})
    assert [p.num_rows for p in issues._parts(texts, "t")] == [1, 3, 1]
    import json

    doc = '{"d":{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"é %d"}]}]},"n":%d}'
    rows = spark.createDataFrame([(i, None if i == 3 else doc % (i, i)) for i in range(7)], "id int, j string")
    out = {r.id: r.j for r in issues.flatten_rich_text(rows, "j").collect()}
    assert {i: json.loads(j) for i, j in out.items() if j} == {i: {"d": f"é {i}\n", "n": i} for i in range(7) if i != 3} and out[3] is None
