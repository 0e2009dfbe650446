import json

from pyspark.sql import functions as F

from threatloom.operators import bayes, gates, monitor, score
from threatloom.plans.scan import scan_mail
from threatloom.sources import files
from threatloom.sources.mime import parse_message


def test_feeds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("https://b.de/1\r\nftp://x\nhttps://a.de/2\n")
    (tmp_path / "b.csv").write_text('# id,date\n"1","2024-01-01","https://c.de/3","online"\n"2","2024-01-01","gopher://x","online"\n"3","2024-01-01","https://a.de/2","offline"\n')
    a, b = files.text_feed(spark, str(tmp_path / "a.txt")), files.quoted_csv_feed(spark, str(tmp_path / "b.csv"))
    out = files.refreshed_map([a, b])
    assert [r.url for r in out.collect()] == ["https://a.de/2", "https://b.de/1", "https://c.de/3"]
    assert files.refreshed_map([a, b.limit(0)]) is None
    (tmp_path / "p.csv").write_text('url,x\n"https://a.de",1\n')
    assert files.first_column_feed(spark, str(tmp_path / "p.csv")).first().url == "https://a.de"


def test_versions(spark, tmp_path):
    base = str(tmp_path / "map")
    made = [files.publish(spark.createDataFrame([(f"u{i}",)], "url string"), base) for i in range(4)]
    assert files.current(spark, base).first().url == "u3"
    assert len(files.retain(spark, base, 2)) == 2
    files.restore(spark, base, made[2])
    assert files.current(spark, base).first().url == "u2"


def test_corpora(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,text\n1,"win ""now"",\nfriend"\n0,hello\n7,skip\n')
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x", "is_spam": 1}, {"text": "y", "is_spam": False}, {"text": "z", "is_spam": None}]))
    (tmp_path / "c.csv").write_text("Email Text,Email Type\nhi,Safe Email\nbuy,Phishing Email\n")
    a = files.labelled_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.text, r.is_spam) for r in a] == [('win "now",\nfriend', True), ("hello", False)]
    assert [(r.text, r.is_spam) for r in files.labelled_json(spark, str(tmp_path / "b.json")).collect()] == [("x", True), ("y", False)]
    c = files.labelled_csv(spark, str(tmp_path / "c.csv"), "Email Text", "Email Type", ("Phishing Email",), ("Safe Email",))
    assert sorted((r.text, r.is_spam) for r in c.collect()) == [("buy", True), ("hi", False)]
    rows = spark.createDataFrame([(1, "a text that is long enough\nand more", True), (2, "short", True), (3, "Subject: x\r\n\r\nbody of the mail", True)], "id int, text string, is_spam boolean")
    mails = files.numbered_messages(rows, "id").orderBy("number").collect()
    assert [(r.number, r.mail[:9]) for r in mails] == [("000001", "Subject: "), ("000002", "Subject: ")] and "\r\n\r\na text that is long enough\r\nand" in mails[0].mail and "\r\r" not in mails[1].mail


def test_decisions_and_canaries(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"message_id": "m", "scan_mode": "shadow", "scan_status": "success", "scan_time_ms": 5.0, "created_at": "2024-01-01T00:00:00Z"}, {"message_id": "n", "inserted_at": "bad"}]))
    rows = files.decisions_json(spark, str(tmp_path / "d.json")).orderBy("message_id").collect()
    assert rows[0].inserted_at is not None and rows[1].inserted_at is None
    lines = [{"event": "canary", "canary": "clean", "status": "pass"}, {"event": "canary", "canary": "spam", "status": "fail"}, {"event": "canary", "canary": "spam", "status": "pass"}, {"event": "canary_summary", "timestamp": "2024-01-01T00:00:00Z"}]
    (tmp_path / "c.jsonl").write_text("garbage\n" + "\n".join(map(json.dumps, lines)))
    row = files.canary_log(spark, str(tmp_path / "c.jsonl")).first()
    assert (row.clean, row.spam, row.phishing) == (True, True, None) and row.timestamp is not None
    assert json.loads(files.event_lines(spark.createDataFrame([("a\x01b\n",)], "detail string")).first().value) == {"detail": "a b "}


def test_gate_bounds():
    from datetime import datetime, timezone

    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    assert gates.bounds_error(None, None, now) is None and gates.bounds_error("2024-01-01", "2024-01-08", now) is None
    assert all(gates.bounds_error(a, b, now) for a, b in (("2024-01-01", None), ("x", "2024-01-02"), ("2024-01-03", "2024-01-02"), ("2024-01-01", "2024-03-01")))


def test_percentile_index(spark):
    p = gates.nearest_index(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v", [0, 50, 99, 100]).first()
    assert (p.p0, p.p50, p.p99, p.p100) == (1.0, 51.0, 100.0, 100.0)
    assert gates.nearest_index(spark.createDataFrame([], "v double"), "v", [50]).first().p50 == 0.0


def test_monitor(spark):
    rows = spark.createDataFrame([(100, 10), (100, 60), (0, 5), (0, 0)], "spam int, ham int")
    assert [r.ratio_alert for r in monitor.class_ratio(rows).collect()] == [False, True, True, False]
    report = spark.createDataFrame([("Statfile: BAYES_SPAM type: redis; length: 0; learned: 1,234; users: 1\nStatfile: BAYES_HAM type: redis; learned: 7; users: 1",)], "r string")
    got = report.select(monitor.learned(F.col("r"), "BAYES_SPAM").alias("s"), monitor.learned(F.col("r"), "BAYES_HAM").alias("h"), monitor.learned(F.col("r"), "NONE").alias("n")).first()
    assert (got.s, got.h, got.n) == (1234, 7, None)
    audit = spark.createDataFrame([("b", 3), ("a", 3), ("c", 4)], "account_id string, learns int")
    top = monitor.account_share(audit).first()
    assert (top.account_id, top.learns, top.share, top.share_alert) == ("c", 4, 0.4, True)
    a, b = spark.createDataFrame([(1, 2)], "spam int, ham int"), spark.createDataFrame([(60, 50)], "spam int, ham int")
    assert tuple(monitor.learn_delta(a, b).first()) == (107, True)


def test_score_profiles(spark):
    sym = spark.createDataFrame([("m", s, 1.0, []) for s in ("LOOKALIKE_DOMAIN", "BEC_PATTERN", "TEXT_SOCIAL_ENGINEERING", "RBL_SEM")] + [("n", "SHORT_URL_FLAG", 1.0, [])] * 3, "message_id string, symbol string, multiplier double, options array<string>")
    w = score.weights(spark)
    got = {(p, r.message_id): (r.score, r.action) for p in ("outbound", "trusted") for r in score.verdicts(sym, w, p).collect()}
    assert got == {("outbound", "m"): (17.0, "reject"), ("trusted", "m"): (17.0, "add_header"), ("outbound", "n"): (2.0, "no_action"), ("trusted", "n"): (2.0, "no_action")}


def test_scores_of_a_row_equal_the_joined_ones(spark):
    import random

    from pyspark.sql import functions as F

    from threatloom.functions import refdata as R
    from threatloom.operators import score

    rng = random.Random(4)
    names = [*R.WEIGHTS, *R.SENDER_IP_SYMBOLS, "UNKNOWN"]
    rows = [(i, [(rng.choice(names), rng.choice([0.5, 1.0, 2.0])) for _ in range(rng.randrange(1, 9))]) for i in range(200)]
    df = spark.createDataFrame(rows, "message_id long, symbols array<struct<symbol: string, multiplier: double>>")
    want = score.score(df.select("message_id", F.explode("symbols").alias("s")).select("message_id", "s.*"), score.weights(spark))
    points, fired = score.score_row(F.col("symbols"))
    got = {r.message_id: (round(r.score, 6), r.fired) for r in df.select("message_id", points.alias("score"), fired.alias("fired")).collect()}
    want = {r.message_id: (round(r.score, 6), r.fired) for r in want.collect()}
    assert all(got[i] == want.get(i, (0.0, [])) for i in got) and len(want) > 150
    odd = spark.createDataFrame([(None,), ([],), ([(None, 1.0), ("GTUBE", None)],)], "symbols array<struct<symbol: string, multiplier: double>>")
    assert [r[0] for r in odd.select(score.score_row(F.col("symbols"))[0]).collect()] == [0.0, 0.0, 0.0]


def test_classifier_orders(spark):
    rows = spark.createDataFrame([(i, "win cash now" if i % 2 else "minutes of the meeting", bool(i % 2)) for i in range(60)], "id int, text string, is_spam boolean")
    f = bayes.words(F.col("text"))
    p = {r.id: r.probability for r in bayes.classify(rows, bayes.learn(rows, f), 30, 30, "id", f).collect()}
    assert p[1] > 0.9 > 0.1 > p[0]
    assert bayes.classify(rows, bayes.learn(rows, f), 19, 30, "id", f).first().probability is None


MAIL = b"""From: PayPal Support <help@evil-site.net>
To: Bob <bob@corp.com>
Reply-To: x@other.org
Subject: Urgent: buy gift cards today
MIME-Version: 1.0
Content-Type: text/html; charset=utf-8

<html><body><p>Please <a href="https://paypal.com.evil-site.net/login">www.paypal.com</a></p></body></html>
"""


def test_mail_to_verdict(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(MAIL)
    (tmp_path / "b.eml").write_bytes(b"From: bob@corp.com\nTo: al@corp.com\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nSubject: lunch\n\nnoon?\n")
    (tmp_path / "c.eml").write_bytes(b"\xff\xfe not a mail")
    got = {r.message_id.rsplit("/", 1)[1]: r for r in scan_mail(spark, str(tmp_path)).collect()}
    assert {"BEC_PATTERN", "FROM_DISPLAY_IMPERSONATION", "PHISH_URL_HEURISTIC", "HTML_LINK_MISMATCH", "MISSING_DATE"} <= set(got["a.eml"].fired)
    assert got["a.eml"].action == "reject"
    assert (got["b.eml"].fired, got["b.eml"].action) == (["OCR_SKIPPED"], "no_action")  # every mail without a picture to read says so


def test_parse_is_total():
    row = parse_message("m", b"Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=nope\n\nhi http://a.test/x http://b.com/y.\n")
    assert row["message_id"] == "m" and parse_message("n", b"")["urls"] == []
    assert parse_message("p", b"Subject: s\n\nhttp://a.test/x http://b.com/y.")["urls"] == ["http://b.com/y"]
