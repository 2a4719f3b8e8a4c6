"""Learned recipes: signatures of failure parts, upsert, outcomes, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq.functions import signatures as S

COUNTERS = ("hits", "successes", "failures")
# What a diagnosis says about its own making.
VOLATILE_KEYS = ("diagnosis_stage", "llm_used", "llm_error")


def with_parts(df: DataFrame, error_class: str, failing_action: str, selector: str, message: str, framework: str = "playwright") -> DataFrame:
    """Add the five signature parts, both keys, and whether the parts say anything at all."""
    parts = {
        "framework": F.lit(framework), "error_class": F.coalesce(error_class, F.lit("")), "failing_action": F.coalesce(failing_action, F.lit("")),
        "selector_shape": S.shape(F.col(selector)), "message_shape": S.message_shape(F.col(message)),
    }
    for name, c in parts.items():
        df = df.withColumn(name, c)
    cols = {k: F.col(k) for k in S.PART_KEYS}
    return (
        df.withColumn("signature", S.recipe_signature(cols)).withColumn("relaxed_key", S.relaxed_key(cols))
        .withColumn("degenerate", S.is_degenerate(*[F.col(k) for k in S.PART_KEYS[1:]]))
    )


def stable_diagnosis(diagnosis_json: Column) -> Column:
    """The diagnosis object without the keys that differ from run to run; other text stays as it is."""
    fields = F.try_parse_json(diagnosis_json)
    is_object = F.coalesce(F.schema_of_variant(fields).startswith("OBJECT"), F.lit(False))
    kept = F.map_filter(F.when(is_object, fields).cast("map<string,variant>"), lambda k, _: ~k.isin(*VOLATILE_KEYS))
    return F.when(is_object, F.to_json(kept)).otherwise(diagnosis_json)


def backfill_relaxed_keys(recipes: DataFrame) -> DataFrame:
    """Recipes of an older store: a missing relaxed key is built from the signature parts kept with the diagnosis.

    Rows without parts keep no key and match exactly only.
    """
    stored = F.try_parse_json("diagnosis_json")
    has_parts = F.coalesce(F.try_variant_get(stored, "$.diagnosis", "variant").isNotNull()
                           & F.schema_of_variant(F.try_variant_get(stored, "$.signature_parts", "variant")).startswith("OBJECT<"), F.lit(False))
    parts = {k: F.coalesce(F.try_variant_get(stored, f"$.signature_parts.{k}", "string"), F.lit("")) for k in S.PART_KEYS}
    known = F.col("relaxed_key") if "relaxed_key" in recipes.columns else F.lit(None).cast("string")
    return recipes.withColumn("relaxed_key", F.coalesce(known, F.when(has_parts, S.relaxed_key(parts))))


def upsert(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Recipes after a batch ``(signature, relaxed_key, strategy, patch_ops_json, diagnosis_json, created_ts, degenerate)``.

    The newest row of a signature in the batch wins. Counters describe the stored
    body: a new strategy or patch starts from zero.
    """
    body = ["relaxed_key", "strategy", "patch_ops_json", "diagnosis_json"]
    kept = incoming.filter(~F.col("degenerate")).withColumn("diagnosis_json", stable_diagnosis(F.col("diagnosis_json")))
    batch = kept.groupBy("signature").agg(
        F.max(F.struct("created_ts", *body)).alias("n"), F.min("created_ts").alias("first_ts"))
    zero = F.lit(0).cast("bigint")
    if stored is None:
        return batch.select("signature", F.col("first_ts").alias("created_ts"), *[f"n.{c}" for c in body], *[zero.alias(c) for c in COUNTERS],
                            F.lit(None).cast("timestamp_ntz").alias("last_used_ts"))
    new, old = F.col("n"), F.col("s")
    has = new.isNotNull()
    changed = has & F.col("s.signature").isNotNull() & ~(
        F.col("n.patch_ops_json").eqNullSafe(F.col("s.patch_ops_json")) & F.col("n.strategy").eqNullSafe(F.col("s.strategy")))
    joined = stored.alias("s").join(batch.alias("b"), "signature", "full_outer")
    return joined.select(
        "signature", F.coalesce("s.created_ts", "first_ts").alias("created_ts"),
        *[F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in body],
        *[F.when(changed, zero).otherwise(F.coalesce(f"s.{c}", zero)).alias(c) for c in COUNTERS],
        F.when(~changed, F.col("s.last_used_ts")).alias("last_used_ts"))


def bump(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add outcomes ``(signature, success, ts)`` to the counters."""
    seen = outcomes.groupBy("signature").agg(
        F.count("*").alias("_h"), F.count_if("success").alias("_s"), F.count_if(~F.col("success")).alias("_f"), F.max("ts").alias("_t"))
    zero = F.lit(0)
    return stored.join(seen, "signature", "left").withColumn("hits", F.col("hits") + F.coalesce("_h", zero)).withColumn(
        "successes", F.col("successes") + F.coalesce("_s", zero)).withColumn("failures", F.col("failures") + F.coalesce("_f", zero)).withColumn(
        "last_used_ts", F.coalesce("_t", "last_used_ts")).drop("_h", "_s", "_f", "_t")


def match(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Per row of ``wanted`` (signature, relaxed_key, degenerate): exact, else relaxed, else miss.

    One recipe per relaxed key is chosen first (most successes, fewest failures,
    oldest), by an aggregate, so the second join cannot multiply rows.
    """
    ask = wanted.select(key, "signature", "relaxed_key", F.coalesce("degenerate", F.lit(True)).alias("degenerate"))
    # Degenerate parts hash to one constant: they never match and never join.
    told, none = ask.filter(~F.col("degenerate")), ask.filter("degenerate")
    body = F.struct("signature", "strategy")
    order = F.struct((-F.col("successes")).alias("a"), F.col("failures").alias("b"), F.col("created_ts").alias("c"), F.col("signature").alias("d"))
    best = stored.filter(F.col("relaxed_key").isNotNull()).groupBy("relaxed_key").agg(F.min_by(body, order).alias("_r"))
    exact = stored.select("signature", body.alias("_e"))
    kind = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_r").isNotNull(), "relaxed").otherwise("miss")
    found = told.join(exact, "signature", "left").join(best, "relaxed_key", "left").withColumn("kind", kind).withColumn("_e", F.coalesce("_e", "_r"))
    nothing = F.lit(None).cast("string")
    return found.select(key, F.col("_e.signature").alias("recipe"), F.col("_e.strategy").alias("strategy"), "kind").unionByName(
        none.select(key, nothing.alias("recipe"), nothing.alias("strategy"), F.lit("miss").alias("kind")))


def export(stored: DataFrame) -> DataFrame:
    return stored.withColumn("sig8", F.substring("signature", 1, 8)).orderBy("created_ts", "signature")
