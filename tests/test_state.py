"""Keyed state, streams joined with streams, and the token store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threatloom.operators import bayes
from threatloom.sources import files
from threatloom.streaming import state, store

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def keyed(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.use_keyed_state(spark)
    yield spark
    spark.conf.set(key, before)


def written(spark, folder, batches, schema):
    """A stream of files, one a batch, in order."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{folder}/_{k}")
        part = next(f for f in os.listdir(f"{folder}/_{k}") if f.endswith(".json"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        if not os.path.exists(f"{folder}/in/{k}.json"):
            os.rename(f"{folder}/_{k}/{part}", f"{folder}/in/{k}.json")
            os.utime(f"{folder}/in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def drained(stream, folder):
    """All rows that a stream has given out into a folder, over all its runs."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect()


ATTEMPT = "message_id string, recipient_id string, injection_attempt_id string, evaluation_id string, scan_status string, scan_time_ms double, inserted_at timestamp"


def test_a_retry_after_hours_gives_one_decision(keyed, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    row = lambda m, e, ok, h: (m, "r", "i", e, "success" if ok else "error", float(h), at(h))
    batches = [
        [row("a", "1", False, 0), row("b", "1", True, 0), row("b", "2", False, 0.1)], [row("a", "2", True, 2), row("c", "9", False, 2), row("c", "8", False, 2)],
        [row("x", "1", True, 9)], [row("a", "3", True, 9.2), row("y", "1", True, 9.3)], [row("z", "1", True, 20)], [row("z", "1", True, 21)],
    ]
    got = sorted((r.message_id, r.ok, r.evaluation_id, r.scan_time_ms) for r in drained(state.one_decision(written(keyed, tmp_path, batches, ATTEMPT)), tmp_path))
    assert [g for g in got if g[0] in "abc"] == [("a", True, "2", 2.0), ("b", True, "1", 0.0), ("c", False, "9", 2.0)]
    assert len({g[0] for g in got}) == len(got)


SAMPLE = "series string, epoch long, spam long, ham long"


def test_the_baseline_is_the_first_sample_across_restarts(keyed, tmp_path):
    first = [[("s", 1, 0, 0), ("t", 1, 1, 9)], [("s", 2, 50, 50)]]
    got = drained(state.drift(written(keyed, tmp_path, first, SAMPLE)), tmp_path)
    assert {(r.series, r.epoch): (r.drift, r.drift_alert) for r in got} == {("s", 1): (None, False), ("t", 1): (0.0, False), ("s", 2): (0.0, False)}
    got = drained(state.drift(written(keyed, tmp_path, [*first, [("s", 3, 65, 35), ("t", 2, 2, 8)]], SAMPLE)), tmp_path)
    later = {(r.series, r.epoch): (r.drift, r.drift_alert) for r in got}
    assert later["s", 3] == (0.15, True) and later["t", 2] == (0.1, False) and len(later) == 5


def test_a_batch_starts_the_baseline(keyed, tmp_path):
    base = keyed.createDataFrame([("s", 0.9)], "series string, spam_share double")
    got = drained(state.drift(written(keyed, tmp_path, [[("s", 2, 50, 50), ("u", 2, 1, 1)]], SAMPLE), base), tmp_path)
    assert {r.series: r.drift for r in got} == {"s": 0.4, "u": 0.0}


def test_coverage_of_two_streams_equals_the_batch(spark, tmp_path):
    minute = lambda m: START + dt.timedelta(minutes=m)
    got_in = [("m%d" % k, minute(k)) for k in range(0, 120, 7)]
    decided = [("m%d" % k, minute(k + k % 30)) for k in range(0, 120, 14)]
    end = minute(60 * 24)
    r_schema, d_schema = "message_id string, received_at timestamp", "message_id string, decided_at timestamp"
    r_rows, d_rows = spark.createDataFrame(got_in, r_schema), spark.createDataFrame(decided, d_schema)
    batch = {r.message_id: r.decided_at for r in state.covered(r_rows, d_rows).collect()}
    assert sum(v is not None for v in batch.values()) == sum(k % 30 <= 15 for k in range(0, 120, 14))
    # a late row of either side moves both watermarks past every bound
    parts = lambda rows, last: [rows[:9], rows[9:], [(f"end{last}", end)], [(f"end{last}x", end)]]
    left, right = written(spark, tmp_path / "r", parts(got_in, "r"), r_schema), written(spark, tmp_path / "d", parts(decided, "d"), d_schema)
    rows = {r.message_id: r.decided_at for r in drained(state.covered(left, right), tmp_path) if not r.message_id.startswith("end")}
    assert rows == batch
    windows = state.coverage(r_rows, d_rows).orderBy("start").collect()
    assert [w.received for w in windows] == [9, 9] and sum(w.decided for w in windows) == sum(v is not None for v in batch.values())


def test_rows_ahead_of_our_clock_go(spark):
    rows = spark.sql("SELECT current_timestamp() + make_interval(0,0,0,0,0,0,s) AS ts, s FROM VALUES (-100), (0), (30), (300) AS v(s)")
    assert sorted(r.s for r in state.not_ahead(rows, "ts").collect()) == [-100, 0, 30]


# --- tokens


def tokens(s):
    return {r.token: (r.spam, r.ham) for r in s.tokens().collect()}


def test_the_store_learns_merges_and_goes_back(spark, tmp_path):
    s = store.TokenStore(spark, str(tmp_path / "store"), buckets=3, compact_after=3, keep=2)
    of = lambda *rows: spark.createDataFrame(list(rows), store.TOKENS)
    assert tokens(s) == {} and s.totals() == (0, 0)
    assert s.add(of(("a", 1, 0), ("b", 2, 2)), 3, 1, 0) and s.add(of(("a", 1, 5)), 1, 1, 1)
    assert tokens(s) == {"a": (2, 5), "b": (2, 2)} and s.totals() == (4, 2)
    # a batch that comes again is not learnt twice
    assert not s.add(of(("a", 100, 0)), 9, 9, 1) and tokens(s)["a"] == (2, 5)
    assert [len(files.children(spark, f"{s.base}/{k}")) for k in ("delta", "merged")] == [2, 0]
    kept = s.snapshot()
    # what a batch left behind that failed before the switch is nothing, and its second run replaces it
    s._write(of(("junk", 1, 1)), f"{s.base}/delta/{2:012d}")
    assert "junk" not in tokens(s)
    assert s.add(of(("c", 7, 7)), 1, 0, 2)
    m = s.manifest()
    assert m.deltas == [] and m.merged and tokens(s) == {"a": (2, 5), "b": (2, 2), "c": (7, 7)}
    # the snapshot's folders are still there
    s.restore(kept)
    assert tokens(s) == {"a": (2, 5), "b": (2, 2)} and s.totals() == (4, 2) and s.manifest().batch == 2
    assert not s.add(of(("c", 7, 7)), 1, 0, 2) and s.add(of(("d", 1, 1)), 1, 0, 3) and tokens(s)["d"] == (1, 1)
    for k in range(4, 8):
        s.add(of(("e", 1, 0)), 0, 0, k)
        s.snapshot()
    assert len(files.children(spark, f"{s.base}/snapshot")) == 2 and tokens(s)["e"] == (4, 0)


def test_a_sink_teaches_the_store(spark, tmp_path):
    s, long = store.TokenStore(spark, str(tmp_path / "s")), " ".join("abcdefghij")
    sink = store.learning_sink(s, bayes.words)
    of = lambda *rows: spark.createDataFrame(list(rows), "text string, score double, fired array<string>")
    sink(of((f"{long} spam", 15.0, []), (f"{long} ham", -2.0, []), ("too short", 20.0, [])), 0)
    sink(of((f"{long} spam", 15.0, [])), 0)
    sink(of((long, 1.0, [])), 1)
    assert s.totals() == (1, 1) and tokens(s) == {c: (1, 1) for c in "abcdefghij"} | {"spam": (1, 0), "ham": (0, 1)}


# --- the combiner


def test_the_tail_of_chi_square_is_stable(spark):
    import math

    rows = [(0.0, 1), (0.5, 1), (10.0, 5), (50.0, 60), (5000.0, 4000), (1e-9, 3000), (1e6, 10), (7.0, 0), (2000.0, 2000)]
    got = spark.createDataFrame(rows, "m double, n long").select("m", "n", bayes.chi_square_tail(F.col("m"), F.col("n")).alias("q")).collect()
    for r in got:
        terms = [math.exp(-r.m + i * (math.log(r.m) if r.m else -1e9 * (i > 0)) - math.lgamma(i + 1)) if r.m or i == 0 else 0.0 for i in range(r.n)]
        assert abs(r.q - (min(1.0, math.fsum(terms)) if r.n else 1.0)) < 1e-9 and 0 <= r.q <= 1


def test_probabilities_follow_the_evidence(spark):
    words = lambda s: bayes.weighted_pairs(bayes.words(F.col(s)))
    spam, ham = "buy cheap pills now dear friend of money", "the meeting notes are in the shared folder today"
    taught = spark.createDataFrame([(spam, True)] * 25 + [(ham, False)] * 25, "text string, is_spam boolean")
    stats = bayes.learn(taught, bayes.sparse_bigrams(bayes.words(F.col("text"))))
    asked = spark.createDataFrame([("s", spam), ("h", ham), ("b", spam + " " + ham), ("n", "nothing known at all"), ("e", None)], "id string, text string")
    p = {r.id: (r.n_tokens, r.probability) for r in bayes.fisher(asked, stats, 25, 25, "id", words("text")).collect()}
    assert p["s"][1] > 0.999 and p["h"][1] < 0.001 and abs(p["b"][1] - 0.5) < 0.2 and p["n"] == (0, 0.5) and p["e"] == (0, 0.5)
    assert {r.probability for r in bayes.fisher(asked, stats, 25, 5, "id", words("text")).collect()} == {None}
    sharp = spark.createDataFrame([(0.943,), (0.914,), (0.5,), (0.01,), (1.0,)], "p double").select(bayes.sharpened(F.col("p")).alias("s")).collect()
    assert [(r.s.symbol, round(r.s.multiplier, 2)) if r.s else None for r in sharp] == [("BAYES_SPAM", 0.38), ("BAYES_SPAM", 0.22), None, ("BAYES_HAM", 0.85), ("BAYES_SPAM", 1.0)]


def test_pairs_are_dealt_part_by_part_and_as_hashes(spark, small, monkeypatch):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    from threatloom import queries

    queries.bayes_fisher(spark, small).collect()
    done = stages()
    written = sum(done.apply(i).shuffleWriteBytes() for i in range(done.size()) if done.apply(i).stageId() not in before)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert written < 8 * docs.agg(F.sum(F.octet_length("text"))).first()[0]
    # the parts of a distance, and what `fisher` says of the same texts
    monkeypatch.setattr(bayes, "WORDS_AT_ONCE", 0)
    taught = docs.limit(60).select("text", (F.col("doc_id") % 2 == 0).alias("is_spam"))
    asked = docs.limit(80).select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "one")], "doc_id long, text string"))
    stats = bayes.learn(taught, bayes.sparse_bigrams(bayes.words(F.col("text"))))
    plain = bayes.fisher(asked, stats, 30, 30, "doc_id", bayes.weighted_pairs(bayes.words(F.col("text"))))
    rows = [sorted((r.doc_id, r.n_tokens, round(r.probability, 6)) for r in df.collect()) for df in (plain, bayes.fisher_of_pairs(asked, taught, 30, 30, "doc_id"))]
    assert rows[0] == rows[1] and len(rows[0]) == 82


@pytest.mark.parametrize("at_once", [0, 10**9])
def test_pairs_travel_packed(spark, small, monkeypatch, at_once):
    """Shuffled rows are blocks of pairs, far fewer than words; keys that repeat or are null, and unlabelled rows, count as in `fisher`."""
    monkeypatch.setattr(bayes, "WORDS_AT_ONCE", at_once)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(None, "one two three one two"), ("7", "K\u0130 A1-b2 \u00e9t\u00e9 a1 B2 K a1"), ("7", "a1 b2 a1 b2 a1 b2"), ("8", None), ("9", ""), ("10", "a b")], "id string, text string")
    asked = docs.select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(odd)
    is_spam = F.when(F.xxhash64("text") % 5 != 0, F.xxhash64("text") % 2 == 0)
    taught = asked.where("id is null or length(id) < 3").select("text", is_spam.alias("is_spam"))
    stats = bayes.learn(taught.where("is_spam is not null"), bayes.sparse_bigrams(bayes.words(F.col("text"))))
    plain = bayes.fisher(asked, stats, 30, 30, "id", bayes.weighted_pairs(bayes.words(F.col("text")))).collect()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    packed = bayes.fisher_of_pairs(asked, taught, 30, 30, "id").collect()
    done = stages()
    written = sum(done.apply(i).shuffleWriteRecords() for i in range(done.size()) if done.apply(i).stageId() not in before)
    rows = [sorted((str(r.id), r.n_tokens, round(r.probability, 6)) for r in df) for df in (plain, packed)]
    assert rows[0] == rows[1] and len(packed) == asked.select("id").distinct().count() and len({r[1] for r in rows[0]}) > 20
    assert written < asked.agg(F.sum(F.size(bayes.words(F.col("text"))))).first()[0] / 3
