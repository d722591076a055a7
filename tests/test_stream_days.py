def test_days_are_written_in_order_from_their_folders(spark, tmp_path):
    """Each day's file holds that day's rows alone, and a day reads its own folder only."""
    from jobsight.plans.q_stream import by_day, write_days
    from jobsight.streaming.ingest import OBS_SCHEMA
    rows = [(f"u{k}", "co", "t", None, str(k), None, k, day, {"k": "v"}) for k, day in
            enumerate(["2024-01-02", "2024-01-01", "2024-01-02", None])]
    obs, days = by_day(spark.createDataFrame(rows, OBS_SCHEMA))
    assert [d for d in days if d] == ["2024-01-01", "2024-01-02"]
    # one folder for each run, null included
    assert len({f.rsplit("/", 2)[1] for f in obs.inputFiles()}) == 3
    write_days(obs, days, f"{tmp_path}/days")
    back = spark.read.schema(OBS_SCHEMA).parquet(f"{tmp_path}/days").orderBy("seq").collect()
    assert [(r["url"], r["run"], r["metadata"]) for r in back] == [
        ("u0", "2024-01-02", {"k": "v"}), ("u1", "2024-01-01", {"k": "v"}), ("u2", "2024-01-02", {"k": "v"})]
