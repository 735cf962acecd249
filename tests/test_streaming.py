from pyspark.sql import functions as F

from lexispan.operators.usage import lexicon_of, usage_sums, word_rows
from lexispan.streaming import ingest


def test_stream_adds_up_to_batch(spark, tmp_path):
    rows = [(i, f"rāma gacchati word{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ingest.start_usage(stream(), f"{tmp_path}/usage", checkpoint=f"{tmp_path}/c").awaitTermination()
    got = {r[0]: r[1] for r in ingest.lexicon_so_far(spark, f"{tmp_path}/usage").collect()}
    want = {r[0]: r[1] for r in lexicon_of(usage_sums(word_rows(docs), "surface")).collect()}
    assert got == want and got["rāma"] == 30
    ingest.start_usage(stream(), f"{tmp_path}/usage", checkpoint=f"{tmp_path}/c").awaitTermination()
    assert {r[0]: r[1] for r in ingest.lexicon_so_far(spark, f"{tmp_path}/usage").collect()} == want


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 00:00:00", "b")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    got = ingest.windowed_counts(rows, time="t", kind="k")
    assert sorted((str(r.start)[:10], r.k, r.n) for r in got.collect()) == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1)]
