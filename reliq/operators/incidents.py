"""Incident index: mapping, upsert, retention, redacted reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq.functions import issues as I
from reliq.functions import redact
from reliq.functions.text import strip
from reliq.operators import search

CONTENT = ["summary", "status", "root_cause", "reporter", "assignee", "created", "updated", "body"]
COLUMNS = ["key", *CONTENT]
SEARCH_COLUMNS = ["key", "summary", "status", "root_cause", "body"]


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their issues, rejected pages) from ``(page_id, text)``, by ``check_pages``."""
    checked = check_pages(pages)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull()).select("page_id", "reason")


def check_pages(pages: DataFrame) -> DataFrame:
    """(page_id, issues, next_token, reason) from ``(page_id, text)``; ``reason`` is null for pages that count.

    A page counts whole or not at all: one issue without a key, or with fields
    that are no object, rejects it, so that nothing is skipped silently.
    """
    v = pages.withColumn("_v", F.try_parse_json("text"))
    kind = F.schema_of_variant(F.try_variant_get("_v", "$.issues", "variant"))
    token_kind = F.schema_of_variant(F.try_variant_get("_v", "$.nextPageToken", "variant"))
    shaped = v.select(
        "page_id",
        F.try_variant_get("_v", "$.issues", "array<variant>").alias("issues"),
        F.try_variant_get("_v", "$.nextPageToken", "string").alias("next_token"),
        F.when(F.col("_v").isNull(), "not a JSON object")
        .when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), "issues is missing or no array")
        .when(~F.coalesce(token_kind.isin("STRING", "VOID"), F.lit(True)), "nextPageToken is no string").alias("_why"),
    )

    def broken(i):
        key = F.try_variant_get(i, "$.key", "variant")
        fields = F.schema_of_variant(F.try_variant_get(i, "$.fields", "variant"))
        no_key = ~F.coalesce((F.schema_of_variant(key) == "STRING") & (strip(F.try_variant_get(i, "$.key", "string")) != ""), F.lit(False))
        return no_key | ~F.coalesce(fields.startswith("OBJECT") | (fields == "VOID"), F.lit(True))

    reason = F.coalesce("_why", F.when(F.exists("issues", broken), "an issue cannot be mapped"))
    return shaped.withColumn("reason", reason).drop("_why")


def issue_fields(root_cause_field: str | None = None) -> tuple[Column, list[Column]]:
    """The body and the columns that ``map_issues`` reads from an issue's fields: many expressions, which a stream makes once and not per batch."""
    fields = F.col("_f")
    cause = I.root_cause(fields, F.col("_order"), F.col("body"), root_cause_field)
    status = F.when(
        F.schema_of_variant(fields["status"]).startswith("OBJECT"), F.coalesce(F.try_variant_get(fields["status"], "$.name", "string"), F.lit(""))
    ).otherwise(I.field_text(fields["status"]))
    return I.field_text(fields["description"]), [
        I.field_text(fields["summary"]).alias("summary"), F.coalesce(status, F.lit("")).alias("status"),
        F.coalesce(F.nullif(cause, F.lit("")), F.col("body")).alias("root_cause"),
        F.coalesce(I.person(fields["reporter"]), F.lit("")).alias("reporter"),
        F.coalesce(I.person(fields["assignee"]), F.lit("")).alias("assignee"),
        I.field_text(fields["created"]).alias("created"), I.field_text(fields["updated"]).alias("updated"), F.col("body")]


def map_issues(pages: DataFrame, root_cause_field: str | None = None, read: tuple[Column, list[Column]] | None = None) -> DataFrame:
    """Index rows of the issues, with their page and position; ``read`` is what ``issue_fields`` gave for the same root-cause field."""
    body, columns = read or issue_fields(root_cause_field)
    rows = pages.select("page_id", F.posexplode("issues").alias("position", "_i"))
    raw = rows.select(
        "page_id", "position", F.try_variant_get("_i", "$.key", "string").alias("key"),
        F.coalesce(F.to_json(F.try_variant_get("_i", "$.fields", "variant")), F.lit("{}")).alias("_json"))
    raw = raw.withColumn("_json", F.when(F.col("_json") == "null", "{}").otherwise(F.col("_json")))
    rich = F.contains("_json", F.lit('"content"')) | F.contains("_json", F.lit('"doc"'))
    # Only issues with rich text go through Python.
    flat = raw.filter(~rich).unionByName(I.flatten_rich_text(raw.filter(rich), "_json"))
    f = flat.withColumn("_f", F.parse_json("_json").cast("map<string,variant>")).withColumn("_order", F.json_object_keys("_json"))
    return f.withColumn("body", body).select("page_id", "position", strip(F.col("key")).alias("key"), *columns)


def prepare_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a trimmed key and no nulls, rejects without a key)."""
    key = F.coalesce(strip(F.col("key")), F.lit(""))
    filled = rows.withColumn("key", key)
    for c in CONTENT:
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit(""))
    return filled.filter(F.col("key") != ""), rows.filter(key == "")


def last_per_key(rows: DataFrame, order: list[str], *also: Column) -> DataFrame:
    """The last row of each key in batch order (a max, so it combines map-side); ``also``: further aggregates of a key."""
    picked = rows.groupBy("key").agg(F.max_by(F.struct(*CONTENT), F.struct(*order)).alias("_r"), *also)
    return picked.select("key", "_r.*", *picked.columns[2:])


def content_hash() -> Column:
    """What tells changed rows: a digest of all content columns, nulls and borders included."""
    return F.md5(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}))


def issue_keys(issues: str) -> Column:
    """Distinct keys of a page's issues."""
    return F.array_distinct(F.transform(issues, lambda i: strip(F.try_variant_get(i, "$.key", "string"))))


def changed_rows(incoming: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Incoming rows that are new or differ in any content column."""
    if stored is None:
        return incoming.select(*COLUMNS)
    old = stored.select("key", F.struct(*CONTENT).alias("_old"))
    joined = incoming.select(*COLUMNS).join(old, "key", "left")
    return joined.filter(F.col("_old").isNull() | ~F.struct(*CONTENT).eqNullSafe(F.col("_old"))).drop("_old")


def upsert(stored: DataFrame | None, changed: DataFrame, indexed_at) -> DataFrame:
    """The index after a batch; untouched rows keep their ``indexed_at``."""
    stamped = changed.withColumn("indexed_at", F.lit(indexed_at).cast("timestamp_ntz"))
    if stored is None:
        return stamped
    return stored.join(changed.select("key"), "key", "left_anti").unionByName(stamped)


def remove_unseen(stored: DataFrame, seen: DataFrame, complete: bool) -> DataFrame:
    """After a complete full sync, keep only the keys it saw; otherwise keep all."""
    return stored.join(seen.select("key").distinct(), "key", "left_semi") if complete else stored


def apply_retention(stored: DataFrame, cutoff_date: str | None) -> DataFrame:
    """Drop incidents last updated before a date; rows without a usable date stay. No date: keep all."""
    if not cutoff_date:
        return stored
    old = (F.col("updated") != "") & (F.length("updated") >= 10) & (F.col("updated") < F.lit(cutoff_date))
    return stored.filter(~F.coalesce(old, F.lit(False)))


def newest_update(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max(F.nullif("updated", F.lit(""))).alias("newest"))


def redact_rows(rows: DataFrame, fields: tuple[str, ...], max_chars: int | None = None) -> DataFrame:
    """Only ``fields``, redacted; names come from the row's person columns even when these are not shown."""
    people = [F.col(c) for c in redact.NAME_FIELDS if c in rows.columns]
    named = rows.withColumn("_names", redact.known_names(people)) if people else rows.withColumn("_names", F.array().cast("array<string>"))
    out = {}
    for f in fields:
        if f in redact.NAME_FIELDS:
            out[f] = F.when(F.coalesce(F.col(f), F.lit("")) != "", redact.NAME).otherwise(F.col(f))
        else:
            out[f] = redact.safe_text(F.col(f), F.col("_names"), max_chars)
    rest = [c for c in rows.columns if c not in {*COLUMNS, *out}]
    return named.select(*rest, *[c.alias(f) for f, c in out.items()])


def index_incidents(stored: DataFrame) -> search.TextIndex:
    """A text index over the incidents, for several searches."""
    return search.text_index.build(stored, SEARCH_COLUMNS, "key")


def search_incidents(queries: DataFrame, stored: DataFrame, limit: int = 5, index: search.TextIndex | None = None) -> DataFrame:
    """Ranked hits per query with redacted key, summary and status; ``index`` is the stored index of ``stored``."""
    hits = search.search(queries, index or index_incidents(stored), SEARCH_COLUMNS, limit)
    rows = hits.select("query_id", "rank", F.col("doc_id").alias("key")).join(stored, "key")
    return redact_rows(rows.select("query_id", "rank", *COLUMNS), ("key", "summary", "status"))


def related_lines(queries: DataFrame, stored: DataFrame, limit: int = 3, index: search.TextIndex | None = None) -> DataFrame:
    """A short text block of related incidents per query."""
    hits = search_incidents(queries, stored, limit, index)
    line = F.format_string("- %s: %s [%s]", "key", F.trim("summary"), F.trim("status"))
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("_l"))
    return listed.select("query_id", F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("lines"))


def find_duplicates(queries: DataFrame, stored: DataFrame, limit: int = 5, index: search.TextIndex | None = None) -> DataFrame:
    docs = stored.withColumn("doc_id", F.col("key"))
    top = search.find_duplicates(queries, docs, SEARCH_COLUMNS, limit, index=index)
    rows = top.select("query_id", "rank", "score", F.col("doc_id").alias("key")).join(stored, "key")
    return redact_rows(rows.select("query_id", "rank", "score", *COLUMNS), ("key", "summary", "status"))


def root_causes(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Point lookups: redacted row per asked key, ``found`` false where there is none."""
    asked = keys.select(strip(F.col("incident_key")).alias("key")).distinct()
    hit = redact_rows(asked.join(stored.select(*COLUMNS), "key").withColumn("incident_key", F.col("key")), ("summary", "status", "root_cause"))
    return asked.withColumnRenamed("key", "incident_key").join(hit, "incident_key", "left").withColumn("found", F.col("summary").isNotNull())


def safe_notes(links: DataFrame, stored: DataFrame) -> DataFrame:
    """Link notes, redacted, with the linked incident's known names scrubbed too."""
    people = [c for c in redact.NAME_FIELDS if c in stored.columns]
    names = stored.select(F.col("key").alias("incident_key"), redact.known_names([F.col(c) for c in people]).alias("_names"))
    joined = links.join(names, "incident_key", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
    return joined.withColumn("note", redact.safe_text(F.col("note"), F.col("_names"))).drop("_names")


def egress_check(rows: DataFrame, masked_again: DataFrame, key: str, text: str) -> DataFrame:
    """Flag rows whose redacted text still changed under a second masking pass."""
    second = masked_again.select(key, F.col(text).alias("_second"))
    return rows.join(second, key).withColumn("egress_fired", F.col(text) != F.col("_second")).withColumn(text, F.col("_second")).drop("_second")
