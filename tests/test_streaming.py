from datetime import datetime, timedelta

from tessera.sources.sinks import read_store
from tessera.streaming import jobs

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_limits(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "client string, ts timestamp"
    put(spark, folder, [("a", at(1)), ("a", at(2)), ("a", at(59)), ("b", at(5)), ("a", at(61))], schema)
    put(spark, folder, [("z", at(7200))], schema)
    put(spark, folder, [("z", at(7201))], schema)
    stream = jobs.stream(spark, folder, schema, files_per_batch=1)
    query = jobs.limited_clients(stream, limit=2).writeStream.outputMode("append").format("memory").queryName("limits").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.client, r.window_start, r.n) for r in spark.table("limits").collect()] == [("a", START, 3)]


def test_job_table_follows_and_replays(spark, tmp_path):
    folder, store, schema = str(tmp_path / "in"), str(tmp_path / "store"), "job string, state string, at timestamp"

    def run():
        assert jobs.keep_states(jobs.stream(spark, folder, schema), store, str(tmp_path / "mark")).awaitTermination(120)
        return {r.job: (r.state, r.attempts) for r in read_store(spark, store).collect()}

    put(spark, folder, [("x", "queued", at(0)), ("x", "processing", at(1)), ("x", "processing", at(1)), ("y", "queued", at(0))], schema)
    assert run() == {"x": ("processing", 0), "y": ("queued", 0)}
    put(spark, folder, [("x", "failed", at(3)), ("y", "completed", at(2))], schema)
    assert run() == {"x": ("failed", 1), "y": ("completed", 0)}
    # late and repeated events
    put(spark, folder, [("x", "failed", at(2)), ("x", "failed", at(3)), ("y", "queued", at(0))], schema)
    assert run() == {"x": ("failed", 2), "y": ("completed", 0)}
    put(spark, folder, [("x", "completed", at(9)), ("x", "failed", at(2))], schema)
    assert run() == {"x": ("completed", 2), "y": ("completed", 0)}
    put(spark, folder, [("x", "failed", at(12))], schema)
    assert run() == {"x": ("failed", 3), "y": ("completed", 0)}
    states = jobs.with_retries(read_store(spark, store))
    assert states.where("job = 'x'").first().retry_at == at(12 + 240)


def test_stale_jobs(spark):
    rows = spark.createDataFrame([("a", "queued", at(0)), ("b", "queued", at(900)), ("c", "failed", at(0))], "job string, state string, at timestamp")
    assert [r.job for r in jobs.stale(rows, "2024-01-01 00:15:00").collect()] == ["a"]


def test_postings_follow(spark, tmp_path):
    folder, store, schema = str(tmp_path / "in"), str(tmp_path / "store"), "chunk_id bigint, chunk_text string, at timestamp"

    def run():
        assert jobs.keep_postings(jobs.stream(spark, folder, schema), store, str(tmp_path / "mark")).awaitTermination(120)
        return sorted((r.chunk_id, r.token, r.tf) for r in read_store(spark, store).where("tf > 0").collect())

    put(spark, folder, [(1, "mold and mold", at(0)), (2, "leak", at(0))], schema)
    assert run() == [(1, "and", 1), (1, "mold", 2), (2, "leak", 1)]
    put(spark, folder, [(1, "heat", at(5)), (2, None, at(5))], schema)
    assert run() == [(1, "heat", 1)]
