from tidemark.streaming import ingest


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    batch = ingest.merge(ingest.bars(spark.read.parquet(f"{d}/events.parquet"))).collect()
    got = {(r.ticker, r.date): r for r in ingest.query(spark, d).collect()}
    assert len(got) == len(batch)
    assert all(got[r.ticker, r.date].n == r.n and abs(got[r.ticker, r.date].volume - r.volume) < 1e-3 for r in batch)


def test_upsert_keeps_stored_values_over_nulls(spark):
    stored = spark.createDataFrame([("A", 1, 1.0, 2.0), ("A", 2, 1.0, 2.0)], "ticker string, date int, close double, volume double")
    fresh = spark.createDataFrame([("A", 2, 3.0, None), ("A", 3, 4.0, 5.0)], stored.schema)
    assert sorted(tuple(r) for r in ingest.upsert(stored, fresh).collect()) == [("A", 1, 1.0, 2.0), ("A", 2, 3.0, 2.0), ("A", 3, 4.0, 5.0)]
