"""A budget that ends exactly where a bucket of hashes starts."""

from pyspark.sql import functions as F

from lakeloom.llm.mixing import LEVEL_BITS, LEVELS, document_hash, mix_sources, mixed_documents


def test_budget_ends_at_a_bucket(spark):
    hashed = spark.range(20_000).select("id", document_hash(F.col("id"), F.lit("word"), 20).alias("h")).orderBy("h").collect()
    bucket = [r.h >> LEVEL_BITS * (LEVELS - 1) for r in hashed]
    cut = next(k for k in range(1_000, 20_000) if bucket[k - 1] < bucket[k] == bucket[k + 1])
    half, full = hashed[cut - 500 : cut], hashed[cut : cut + 500]
    df = spark.createDataFrame([(r.id, "word", "a") for r in half + full], "doc_id long, text string, source string")
    for share in (0.5, 1.5):
        taken = {r.doc_id: r.taken for r in mix_sources(df, share=share).collect()}
        assert taken == {r.id: int(share) + k for k, rows in ((1, half), (0, full)) for r in rows}
        assert mixed_documents(df, share=share).count() == share * 1_000
