from fathomline.streaming import ingest


def test_activity_and_windows_on_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = src.withColumn("ts", src.ts.cast("timestamp"))
    src.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = ingest.arriving(spark, f"{tmp_path}/events", src.schema, 1)
    seen = []
    q = ingest.into(ingest.activity(stream.select("ts", "event_type", "value"), late="40 days"), f"{tmp_path}/cp1", lambda df, n: seen.extend(df.collect()))
    q.awaitTermination(60)
    assert q.exception() is None
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/docs")
    rows, told = [], []
    q = ingest.into(ingest.triggered_windows(ingest.arriving(spark, f"{tmp_path}/docs", "doc_id long, text string"), "license", "(the|der)"), f"{tmp_path}/cp2", lambda df, n: rows.append(df.count()), progress=lambda n, s: told.append((n, s >= 0)))
    q.awaitTermination(60)
    assert sum(rows) > 0 and told == [(k, True) for k in range(len(rows))]


def test_first_sightings_keep_state(spark, tmp_path):
    df = spark.createDataFrame([(1, "B", 2020), (1, "B", 2022), (1, "C", 2022), (2, "B", 2021)], "company long, category string, year int")
    df.where("year = 2020").write.parquet(f"{tmp_path}/r")
    out = []

    def run():
        q = ingest.into(ingest.first_sightings(ingest.arriving(spark, f"{tmp_path}/r", "company long, category string, year int")), f"{tmp_path}/cp", lambda b, n: out.extend(b.collect()))
        q.awaitTermination(60)

    run()
    df.where("year > 2020").write.mode("append").parquet(f"{tmp_path}/r")
    run()
    assert sorted((r["company"], r["category"], r["year"], r["event_type"]) for r in out) == [(1, "B", 2020, "NEW_ADOPTION"), (1, "B", 2022, "CONFIRMED"), (1, "C", 2022, "NEW_ADOPTION"), (2, "B", 2021, "NEW_ADOPTION")]
