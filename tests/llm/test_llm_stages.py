"""The pipeline's stages in a chain on odd rows and on columns whose names they use themselves."""

import corpus_pipeline
from pyspark.sql import functions as F

from reliq.llm.store import stored

SF = "/root/testdata/sf0.001"
CLASHING = ["_rejected", "_lang_pred", "_gone", "_gone_text", "_rate", "_copies", "_copy", "_text", "node", "text_key", "component_id", "posterior", "block", "hash", "__rate"]


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(12)
    null = F.lit(None)
    extra = [
        first, first,  # repeated rows
        first.withColumn("doc_id", null.cast("long")), first.withColumn("text", null.cast("string")), first.limit(2).withColumn("text", F.lit("")),
        first.withColumn("doc_id", F.col("doc_id") + 1),  # other texts under known ids
        first.limit(1).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 400)), first.withColumn("lang", null.cast("string")).withColumn("source", null.cast("string")),
    ]
    for rows in extra:
        docs = docs.unionByName(rows)
    return docs.select(*docs.columns, *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)))


def test_chain_on_odd_rows(spark):
    docs = stored(odd_documents(spark), "odd")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        if name == "byte_bpe":
            assert after.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
            want = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("decoded_sha256"))
            assert after.select("doc_id", "decoded_sha256").exceptAll(want).isEmpty() and after.count() == docs.count()
            break
        assert after.columns == columns
        assert after.filter(" AND ".join(f"`{c}` = 'x{i}'" for i, c in enumerate(CLASHING))).count() == after.count() > 0
        assert after.select(*columns).distinct().exceptAll(docs.select(*columns).distinct()).isEmpty()  # rows stay as they are
        if name != "mixture":
            assert after.count() <= docs.count()
        if name == "exact_dedup":
            assert after.groupBy("text").count().filter("count > 1").isEmpty()
        docs = after
    assert docs.count() < before


def test_chain_on_nothing(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_send_small_batches_to_python(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 40_000, "en", "s", 1) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars int")
    try:
        spark.conf.set(name, "64m")
        encoded = corpus_pipeline.tokenize(spark, docs.coalesce(1), "")
        assert int(spark.conf.get(name).rstrip("b")) == 4 << 20
        sizes = docs.coalesce(1).select("text").mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert len(sizes) > 1 and max(r.n for r in sizes) < 8 << 20
        assert {r.doc_id for r in encoded.select("doc_id").collect()} == set(range(8))
        spark.conf.set(name, "1m")
        corpus_pipeline._small_batches(spark)
        assert spark.conf.get(name) == "1m"  # a smaller setting is kept
    finally:
        spark.conf.set(name, before)
