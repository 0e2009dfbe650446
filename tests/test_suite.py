"""The suite from files, lists and classifier inside the scan, the database source, and small sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from threatloom.operators import bayes, monitor
from threatloom.plans import suite
from threatloom.plans.scan import Known, scan
from threatloom.sources import files
from threatloom.sources.mime import MESSAGE, parse_message

GIFTS = b"From: a@b.org\nDate: x\nSubject: hi\n\nbuy gift cards"


def put(folder, name, mail=None, expected=None):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    if mail is not None:
        at.with_suffix(".eml").write_bytes(mail)
    if expected is not None:
        at.with_suffix(".expected").write_text(expected)


def test_the_suite_from_files(spark, tmp_path):
    put(tmp_path, "attacks/bec/01", GIFTS, "action: add_header # certain\nsymbols: BEC_PATTERN\ndescription: gifts\n")
    put(tmp_path, "attacks/bec/02", b"From: a@b.org\nDate: x\n\nhello", "action: add_header\nsymbols: BEC_PATTERN, MISSING_DATE\n")
    put(tmp_path, "legitimate/fp_stress/01", GIFTS, "action: no_action\nsymbols: BEC_PATTERN\n")
    put(tmp_path, "legitimate/business/01", b"From: a@b.org\nDate: x\n\nminutes", "action: no_action\nsymbols:   # none\n")
    put(tmp_path, "legitimate/business/lonely", b"From: a@b.org\n\nx")
    put(tmp_path, "attacks/bec/missing", None, "action: reject\nsymbols: A\n")
    (tmp_path / "README.eml").write_text("no mail")
    out, counts = suite.run_suite(spark, str(tmp_path))
    got = {tuple(r.stem.split("/")[-3:]): (r.outcome, r.orphan, sorted(r.missing or [])) for r in out.collect()}
    assert got == {
        ("attacks", "bec", "01"): ("pass", None, []), ("attacks", "bec", "02"): ("fail", None, ["BEC_PATTERN", "MISSING_DATE"]), ("legitimate", "fp_stress", "01"): ("warning", None, []),
        ("legitimate", "business", "01"): ("pass", None, []), ("legitimate", "business", "lonely"): (None, "message", []), ("attacks", "bec", "missing"): (None, "expected", ["A"]),
    }
    assert {(r.corpus, r.category): (r.caught, r.evaded, r.false_positives, r.warnings) for r in counts.collect()} == {("attacks", "bec"): (1, 1, 0, 0), ("legitimate", "fp_stress"): (0, 0, 1, 1), ("legitimate", "business"): (0, 0, 0, 0)}


def test_lists_networks_terms_and_classifier_score_in_the_scan(spark):
    html = b"From: a@known.bad\nDate: x\nContent-Type: text/html\n\n"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    mails = {
        "blocked": html + b"<a href='https://evil.net/a'>x</a>", "short": html + b"<a href='https://t.co/a'>x</a>", "sender": html + b"x", "phished": html + b"<a href='https://phish.net/'>x</a>",
        "term": b"From: a@b.org\nDate: x\n\nmy own term", "learnt": f"From: a@b.org\nDate: x\n\n{words}".encode(), "clean": b"From: a@b.org\nDate: x\n\nnothing",
    }
    rows = spark.createDataFrame([parse_message(k, m) for k, m in mails.items()], MESSAGE).withColumn("address", F.when(F.col("message_id") == "clean", "10.1.2.3").otherwise("11.0.0.1"))
    one = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    stats = bayes.learn(spark.createDataFrame([(words, True)], "text string, is_spam boolean"), bayes.sparse_bigrams(bayes.words(F.col("text"))))
    known = Known(
        blocklist=one("url", "https://evil.net/a"), phishing=one("url", "https://phish.net/"), shorteners=one("host", "t.co"), lookalikes=one("domain", "known.bad"),
        networks=spark.createDataFrame([("10.0.0.0/8", "rbl")], "network string, zone string"), terms=spark.createDataFrame([("mine", "own term", "strict")], "list_name string, term string, boundary string"),
        term_symbols=spark.createDataFrame([("mine", "OBFUSCATED_SPAM")], "list_name string, symbol string"), tokens=stats, n_spam=30, n_ham=30,
    )
    got = {r.message_id: (set(r.fired) - {"OCR_SKIPPED"}, r.score, r.action, r.policy_action) for r in scan(rows, mode="deterministic_reject", known=known).collect()}
    assert got["blocked"] == ({"PHISHED_URL_BLOCKLIST", "KNOWN_LOOKALIKE_DOMAIN"}, 13.0, "add_header", "deliver")
    assert got["phished"] == ({"PHISHED_OPENPHISH", "KNOWN_LOOKALIKE_DOMAIN"}, 12.0, "add_header", "reject")
    assert got["short"][0] == {"SHORT_URL_FLAG", "KNOWN_LOOKALIKE_DOMAIN"} and got["sender"][:2] == ({"KNOWN_LOOKALIKE_DOMAIN"}, 5.0)
    assert got["term"][0] == {"OBFUSCATED_SPAM"} and got["clean"][:2] == ({"RBL_LISTED"}, 3.0)
    assert got["learnt"][0] == {"BAYES_SPAM"} and got["learnt"][1] > 10


# --- the database


DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
COLUMNS = "message_id VARCHAR(64), scan_mode VARCHAR(64)"


def test_decisions_of_a_database(spark):
    url = "jdbc:derby:memory:decisions;create=true"
    rows = spark.sql("SELECT concat('m', id) AS message_id, CASE WHEN id % 4 = 3 THEN 'enforce' ELSE 'shadow' END AS scan_mode, CAST(id AS DOUBLE) AS score, timestamp_seconds(1767225600 + id * 3600) AS inserted_at FROM range(240)")
    rows.coalesce(1).write.mode("overwrite").option("createTableColumnTypes", COLUMNS).jdbc(url, "decisions", properties={"driver": DRIVER})
    got = files.decisions_jdbc(spark, url, "decisions", "2026-01-02 00:00:00", "2026-01-05 00:00:00", partitions=5, driver=DRIVER)
    names = [r.message_id for r in got.collect()]
    assert names == [f"m{k}" for k in range(96, 23, -1) if k % 4 != 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(scan_mode,shadow)" in plan.replace(" ", "")
    read = spark.read.jdbc(url, "decisions", predicates=["score < 10", "score >= 10"], properties={"driver": DRIVER})
    assert read.rdd.getNumPartitions() == 2
    # the look-back counts from the window's end, or from now
    assert {r.message_id for r in files.decisions_jdbc(spark, url, "decisions", end="2026-01-03 00:00:00", days=1, driver=DRIVER).collect()} == {f"m{k}" for k in range(24, 49) if k % 4 != 3}
    import datetime as dt

    late = [("new", "shadow", 1.0, dt.datetime.now(dt.UTC) - dt.timedelta(hours=1)), ("old", "shadow", 1.0, dt.datetime.now(dt.UTC) - dt.timedelta(days=9))]
    spark.createDataFrame(late, "message_id string, scan_mode string, score double, inserted_at timestamp").write.mode("overwrite").option("createTableColumnTypes", COLUMNS).jdbc(url, "recent", properties={"driver": DRIVER})
    assert [r.message_id for r in files.decisions_jdbc(spark, url, "recent", driver=DRIVER).collect()] == ["new"]


# --- small sources and sinks


def test_corpus_folders(spark, tmp_path):
    for name in ("b.txt", "a.txt", "cmds", ".hidden", "README.md", "deep/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    base = lambda rows: [r.path.rpartition("/")[2] for r in rows.collect()]
    assert base(files.corpus_dir(spark, str(tmp_path))) == ["a.txt", "b.txt"]
    assert base(files.corpus_dir(spark, str(tmp_path), recursive=True)) == ["a.txt", "b.txt", "c.txt"]


def test_key_value_lines(spark):
    text = "action: reject # sure\nsymbols:\nnote:  a b  \nactionless: x"
    row = spark.createDataFrame([(text,)], "t string").select(*(files.key_values(F.col("t"), k).alias(k) for k in ("action", "symbols", "note", "absent"))).first()
    assert tuple(row) == ("reject", "", "a b", None)


def test_a_report_as_json(spark, tmp_path):
    report = spark.createDataFrame([(1, "x", None)], "n int, s string, gone string")
    assert files.report_json(report, str(tmp_path / "report")) == [{"n": 1, "s": "x"}]
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "report")).collect()] == [{"n": 1, "s": "x"}]


def test_audit_lines(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert sorted(map(tuple, monitor.audit_counts(lines("a 1", "", "  ", "# note 5 6", " b\t2 ", "a 3", "#x")).collect())) == [("a", 1), ("a", 3), ("b", 2)]
    for bad in ("a", "a 1 2", "a -1", "a|b 1", "a 1.5"):
        with pytest.raises(Exception, match="malformed"):
            monitor.audit_counts(lines("a 1", bad)).collect()
