from pyspark.sql import functions as F

from threatloom.operators import bayes
from threatloom.sources import files
from threatloom.streaming import jobs


def drain(stream, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql("SELECT * FROM out").collect()


def events(spark, small):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(small)


def test_windows_match_batch(spark, small, tmp_path):
    batch = jobs.windowed_counts(spark.read.parquet(f"{small}/events.parquet"), "ts", "event_type").collect()
    got = drain(jobs.windowed_counts(events(spark, small), "ts", "event_type"), tmp_path, "complete")
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(got) == key(batch)


def test_best_attempts(spark, small, tmp_path):
    make = lambda df: df.select(F.col("user_id").cast("string").alias("message_id"), F.lit("r").alias("recipient_id"), F.lit("i").alias("injection_attempt_id"), F.col("event_id").cast("string").alias("evaluation_id"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("scan_status"), F.col("value").alias("scan_time_ms"), F.col("ts").alias("inserted_at"))
    batch = jobs.best_attempts(make(spark.read.parquet(f"{small}/events.parquet"))).count()
    assert len(drain(jobs.best_attempts(make(events(spark, small))), tmp_path, "complete")) == batch


def test_attempts_cross_the_hour(spark):
    rows = [("m", "r", "i", "1", "error", 5.0, "2026-01-01 09:58:00"), ("m", "r", "i", "2", "success", 7.0, "2026-01-01 10:01:00"), ("m", "r", "i", "3", "error", 9.0, "2026-01-01 10:03:00")]
    df = spark.createDataFrame(rows, "message_id string, recipient_id string, injection_attempt_id string, evaluation_id string, scan_status string, scan_time_ms double, inserted_at string")
    assert [(r.ok, r.evaluation_id, r.scan_time_ms) for r in jobs.best_attempts(df).collect()] == [(True, "2", 7.0)]


def test_learn_rates_keep_state(spark, tmp_path):
    src = tmp_path / "in"
    for k, rows in enumerate([[("a", 0, 10, 5), ("a", 3600, 60, 55)], [("a", 7200, 61, 56), ("a", 10800, 5, 5)]]):
        spark.createDataFrame(rows, "series string, epoch long, spam long, ham long").coalesce(1).write.parquet(str(src / f"k={k}"))
    stream = spark.readStream.schema("series string, epoch long, spam long, ham long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    got = sorted((r.epoch, r.rate, r.reset) for r in drain(jobs.learn_rates(stream), tmp_path))
    assert got == [(3600, 100.0, False), (7200, 2.0, False), (10800, None, True)]


def test_scan_reloads_its_list(spark, small, tmp_path):
    out, calls = [], []

    def reload():
        calls.append(1)
        return spark.createDataFrame([("click",)], "event_type string")

    q = jobs.run_scan(events(spark, small), lambda df, ref: df.join(ref, "event_type", "left_semi"), reload, lambda df, n: out.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(out) == spark.read.parquet(f"{small}/events.parquet").where("event_type = 'click'").count() and calls


def test_load_reaches_the_scan(spark, small, tmp_path):
    seen = []
    q = jobs.run_scan(events(spark, small), lambda df: df.where("load >= 4"), None, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"), load=lambda: 4.5)
    q.awaitTermination(120)
    assert sum(seen) == spark.read.parquet(f"{small}/events.parquet").count()


def test_autolearn_feeds_back(spark, tmp_path):
    """Two batches by hand: guards hold, a class that is ahead waits, and a batch that comes twice is learnt once."""
    base, long = str(tmp_path / "tokens"), " ".join("abcdefghij")
    sink = jobs.autolearn_sink(base, bayes.words, F.col("score") != 99)
    of = lambda rows: spark.createDataFrame(rows, "text string, score double, fired array<string>")
    sink(of([(f"{long} spam", 15.0, []), (f"{long} ham", -2.0, []), ("too short", 20.0, []), (long, 14.9, []), (f"{long} sure", 30.0, ["CLAM_VIRUS"]), (f"{long} own", 99.0, []), (f"{long} spam", 16.0, [])]), 0)
    read = lambda: {r.token: (r.spam, r.ham) for r in files.current(spark, base).collect()}
    first = read()
    assert first == {None: (2, 1), "spam": (2, 0), "ham": (0, 1)} | {c: (2, 1) for c in "abcdefghij"}
    sink(of([(f"{long} again", 15.0, [])]), 0)
    assert read() == first
    sink(of([(f"{long} more", 15.0, []), (f"{long} more", 15.0, [])]), 1)
    assert read()[None] == (4, 1)
    sink(of([(f"{long} late", 15.0, []), (f"{long} fine", -5.0, [])]), 2)
    got = read()
    assert got[None] == (4, 2) and "late" not in got and got["fine"] == (0, 1)
