"""Syncs and report streams that follow one another."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reliq.functions import redact
from reliq.operators import verdicts
from reliq.sources import junit
from reliq.sources.tables import Store
from reliq.streaming import ingest

NOW = datetime(2026, 6, 1)


@pytest.fixture
def landed(spark, tmp_path):
    land = tmp_path / "pages"
    land.mkdir()
    store = Store(spark, str(tmp_path / "db"))

    def page(name, *keys, following=None, **fields):
        issues = [{"key": k, "fields": {"summary": name, "updated": "2026-01-01T00:00:00", **fields}} for k in keys]
        (land / name).write_text(json.dumps({"issues": issues, "nextPageToken": following}) if keys else "cut off")

    def sync(query="q"):
        ingest.stream_incidents(spark, str(land), store, str(tmp_path), query, NOW).awaitTermination()

    return store, page, sync


def index(store):
    return {r.key: r.summary for r in store.read("incidents").collect()}


def test_a_page_landed_again_frees_the_watermark(landed):
    store, page, sync = landed
    page("1.json", "A", following="2")
    page("2.json")
    sync()
    assert ingest.finish_sync(store) is None
    page("2.again.json", "B", updated="2026-03-01T00:00:00")
    sync()
    assert ingest.finish_sync(store) == "2026-03-01T00:00:00"
    assert set(index(store)) == {"A", "B"}


def test_each_full_sync_has_its_own_seen_keys(landed):
    store, page, sync = landed
    page("1.json", "A", "Z")
    sync()
    ingest.finish_sync(store, full=True)
    page("3.json", "A")
    sync()
    ingest.finish_sync(store, full=True)
    assert set(index(store)) == {"A"}
    page("4.json", "B", following="more")  # the list was not read to its end
    sync()
    ingest.finish_sync(store, full=True)
    assert set(index(store)) == {"A", "B"}


def test_pages_follow_their_numbers(landed):
    store, page, sync = landed
    page("10.json", "A")
    page("2.json", "A")
    sync()
    assert index(store) == {"A": "10.json"}


def test_page_numbers(spark):
    paths = ["file:/a1/b2/12.json", "/x/7.again.json", "/9/page.json", "p-003.json"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(ingest.page_number(F.col("p"))).collect()
    assert [r[0] for r in got] == [12, 7, None, 3]


def test_two_report_streams_share_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.xml").write_text(f'<testsuite name="s"><testcase name="{name}"/></testsuite>')
        ingest.stream_junit(spark, str(tmp_path / name), store, str(tmp_path / f"cp_{name}"), NOW).awaitTermination()
    assert {r.name for r in store.read("test_cases").collect()} == {"one", "two"}
    assert store.read("test_runs").count() == 2


def test_repeated_synthetic_results_have_ids_of_their_own(spark):
    rows = [("r", "2026-01-01T00:00:00", "t", "failed")] * 2 + [("r", "2026-01-01T00:00:00", "t", "passed")]
    _, cases = junit.synthetic_runs(spark.createDataFrame(rows, "run_key string, run_time string, name string, status string"), NOW)
    assert cases.select("case_id").distinct().count() == 3


def test_markers_only_at_real_line_starts(spark):
    got = spark.createDataFrame([("a\rsystem: x tool: y\nuser: z",)], "t string").select(redact.neutralize(F.col("t"))).head()[0]
    assert got == "a\rsystem: x tool: y\nuser - z"


def test_scans_read_only_the_days_of_their_window(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    (tmp_path / "in").mkdir()
    for day in ("2026-05-20", "2026-05-21", "2024-01-01"):
        (tmp_path / "in" / f"{day}.xml").write_text(f'<testsuite name="s" timestamp="{day}T00:00:00"><testcase name="t"><failure/></testcase></testsuite>')
    ingest.stream_junit(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), NOW).awaitTermination()
    rows = verdicts.windowed_cases(store.read("test_cases"), store.read("test_runs"), datetime(2026, 5, 1))
    assert rows.count() == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(run_date") == 2
    store.append("test_cases", store.read("test_cases").limit(1), "more")
    assert store.compact("test_cases", "joined") == 2 and store.read("test_cases").count() == 4
    assert store.get_meta("schema_version") == "1"


def test_a_newer_store_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.set_meta(schema_version="99")
    with pytest.raises(ValueError, match="schema version 99"):
        Store(spark, str(tmp_path / "db"))


def test_a_sync_writes_changed_rows_only(landed, spark, tmp_path):
    store, page, sync = landed
    page("1.json", *[f"K{i}" for i in range(300)])
    sync()
    ingest.finish_sync(store, full=True)
    before = set((tmp_path / "db" / "incidents").rglob("*.parquet"))
    page("1.again.json", *[f"K{i}" for i in range(0, 300, 2)])  # other summaries, half of the keys
    (tmp_path / "pages" / "1.json").unlink()
    sync()
    ingest.finish_sync(store, full=True)
    assert index(store) == {f"K{i}": "1.again.json" for i in range(0, 300, 2)}
    new = set((tmp_path / "db" / "incidents").rglob("*.parquet")) - before
    assert sum(spark.read.parquet(str(f)).count() for f in new) == 300  # 150 changed rows, 150 removed keys


def test_batches_share_expressions_and_list_by_few_tasks(landed, spark, tmp_path, monkeypatch):
    """The expressions that read an issue are made for a stream and not for each of its batches; pages are parsed once, and listed by few tasks."""
    from reliq.functions import issues
    from reliq.operators import incidents

    store, page, _ = landed
    for n in range(1, 5):
        page(f"{n}.json", f"K{n}", description={"type": "doc", "content": [{"type": "text", "text": f"body {n}"}]}, following=None if n == 4 else "x")
    calls = {"field_text": 0, "checked": 0}

    def counted(name, fn):
        def call(*args, **more):
            calls[name] += 1
            return fn(*args, **more)
        return call

    monkeypatch.setattr(issues, "field_text", counted("field_text", issues.field_text))
    monkeypatch.setattr(ingest, "materialize", counted("checked", ingest.materialize))
    incidents.map_issues(spark.createDataFrame([("p", "[]")], "page_id string, t string").select("page_id", F.parse_json("t").cast("array<variant>").alias("issues")))
    made, calls["field_text"] = calls["field_text"], 0
    ingest.stream_incidents(spark, str(tmp_path / "pages"), store, str(tmp_path), "q", NOW, max_pages=1).awaitTermination()
    assert calls["field_text"] == made and calls["checked"] == 4
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 4 * spark.sparkContext.defaultParallelism
    assert {r.key: r.body for r in store.read("incidents").collect()} == {f"K{n}": f"body {n}" for n in range(1, 5)}


def test_strip_of_long_texts_is_strip(spark):
    from reliq.functions import text as X

    odd = ["", " ", "a", " a", "a ", "a b", " a ", " a", "a ", "a\n", "a\r\n", "\x85a\x85", "😀 ", " 😀", "😀", "a​", "\x1ca\x1f", "\n\na\nb\n\n", None]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select(X.strip(F.col("x")).alias("a"), X.strip_long(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[2].a == "a"


def test_root_cause_line_is_found_in_any_case(spark):
    from reliq.functions import issues

    bodies = ["x\nROOT Cause: the disk\ny", "Root\tcauſe - long s", "no such line", "root of it", "", None]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    none = F.array().cast("array<string>")
    got = frame.select(issues.root_cause(F.create_map().cast("map<string,variant>"), none, F.col("body")).alias("c")).collect()
    want = frame.select(F.coalesce(F.nullif(F.trim(F.regexp_extract("body", issues.ROOT_CAUSE_LINE, 1)), F.lit("")), F.lit("")).alias("c")).collect()
    assert got == want and got[0].c == "the disk"
