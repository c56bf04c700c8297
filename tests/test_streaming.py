from stanzaline.streaming import checkins as C


def test_log_and_windows(spark, tmp_path):
    events = str(tmp_path / "events")
    schema = "plan_id long, day long, at timestamp, n long"
    spark.sql("select 1L plan_id, 5L day, timestamp'2024-01-05 01:00:00' at, 1L n union all select 1L, 5L, timestamp'2024-01-05 02:00:00', 2L union all select 2L, 1L, timestamp'2024-01-01 00:00:00', 3L").write.parquet(events)
    stream = C.read_events(spark, events, schema)
    log, mark = str(tmp_path / "log"), str(tmp_path / "mark")
    C.upsert_log(stream, log, mark, ["plan_id", "day"], ["at", "n"]).awaitTermination()
    spark.sql("select 1L plan_id, 5L day, timestamp'2024-01-05 03:00:00' at, 7L n").write.mode("append").parquet(events)
    C.upsert_log(C.read_events(spark, events, schema), log, mark, ["plan_id", "day"], ["at", "n"]).awaitTermination()
    found = {(r.plan_id, r.day): r.n for r in C.read_log(spark, log, ["plan_id", "day"], ["at", "n"]).collect()}
    assert found == {(1, 5): 7, (2, 1): 3}
    counted = {(str(r.start)[:10], r.plan_id): r.n for r in C.window_counts(spark.read.parquet(events), "at", "plan_id").collect()}
    assert counted == {("2024-01-05", 1): 3, ("2024-01-01", 2): 1}
