"""The mail source: files and archives in any cut, streams, errors, and the numbered sink."""

import os
import random

import pytest
from pyspark.sql import functions as F

from threatloom.sources import files, mail


@pytest.fixture(scope="module")
def source(spark):
    mail.register(spark)
    return spark


def letter(k, body="hello"):
    return f"From: a{k}@b.org\nSubject: s{k}\nDate: x\n\n{body}\n".encode()


def archive(mails):
    return b"".join(b"From MAILER Mon Jan  1 00:00:00 2024\n" + m.replace(b"\nFrom ", b"\n>From ") + b"\n" for m in mails)


@pytest.mark.parametrize("seed", range(12))
def test_every_cut_of_an_mbox_gives_every_message_once(seed):
    rng = random.Random(seed)
    mails = [letter(k, "x" * rng.choice([0, 1, 30]) + rng.choice(["", "\nFrom here on", "\n\nFrom \n"])) for k in range(rng.randrange(9))]
    data = archive(mails)
    cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(12)))})
    got = [m for a, b in zip(cuts, cuts[1:], strict=False) for m in mail.mbox_messages(lambda at, n: data[at : at + n], a, b, len(data), step=7)]
    assert [m.rstrip(b"\n") for _, m in got] == [m.rstrip(b"\n") for m in mails]


def test_partitions_are_planned_by_bytes():
    spans = mail.planned([(1, "a.eml", 40), (2, "b.eml", 40), (3, "c.eml", 40), (4, "d.mbox", 250), (5, "e.eml", 500), (6, "f.eml", 0)], 100)
    assert [s.pieces for s in spans] == [[("a.eml", 0, 40), ("b.eml", 0, 40)], [("c.eml", 0, 40)], [("d.mbox", 0, 100)], [("d.mbox", 100, 200)], [("d.mbox", 200, 250)], [("e.eml", 0, 500)], [("f.eml", 0, 0)]]


def test_files_and_archives_are_messages(source, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/one.eml").write_bytes(letter(1))
    (tmp_path / "in/deep/two.mbox").write_bytes(archive([letter(k, "y" * 50) for k in range(2, 40)]))
    (tmp_path / "in/notes.txt").write_text("no mail")
    (tmp_path / "in/empty.eml").write_bytes(b"")
    (tmp_path / "in/bad.eml").write_bytes(b"From: a@b.c\nContent-Type: text/plain; charset=nonsense\n\nx")
    rows = source.read.format("mail").option("partitionBytes", 300).load(str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() > 5
    got = rows.collect()
    assert sorted(r.subject for r in got if r.subject) == sorted(f"s{k}" for k in range(1, 40)) and len(got) == 41
    assert [(os.path.basename(r.message_id), r.error.split(":")[0]) for r in got if r.error] == [("bad.eml", "LookupError")]
    assert source.read.format("mail").load(f"file://{tmp_path}/in/one.eml").first().from_domain == "b.org"


def test_a_stream_reads_each_mail_once(source, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()

    def pass_over():
        rows = source.readStream.format("mail").load(str(inbox)).select("message_id", "subject")
        q = rows.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted(r.subject for r in source.read.schema("message_id string, subject string").parquet(out).collect())

    for k in range(3):
        (inbox / f"{k}.eml").write_bytes(letter(k))
        os.utime(inbox / f"{k}.eml", ns=(k * 10**9, k * 10**9))
    assert pass_over() == ["s0", "s1", "s2"]
    (inbox / "3.eml").write_bytes(letter(3))
    assert pass_over() == ["s0", "s1", "s2", "s3"]


def test_the_sink_writes_whole_or_nothing(source, tmp_path):
    rows = source.range(50).select("id", F.concat(F.lit("a text that is long enough "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3 == 0).alias("is_spam")).repartition(5)
    mails = files.numbered_messages(rows, "id")
    at = tmp_path / "corpus"
    mails.write.format("mail").mode("append").save(str(at))
    assert sorted(p.name for p in (at / "spam").iterdir()) == [f"{k:06d}.eml" for k in range(1, 18)]
    assert (at / "ham/000001.eml").read_bytes().endswith(b"long enough 1") and os.listdir(tmp_path) == ["corpus"]
    # what fails leaves the old corpus as it was, and nothing aside
    bad = mails.withColumn("mail", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("mail")))
    twice = mails.withColumn("number", F.lit("000001"))
    for broken, mode in ((bad, "overwrite"), (twice, "overwrite"), (mails, "append")):
        with pytest.raises(Exception):  # noqa: B017
            broken.write.format("mail").mode(mode).save(str(at))
        assert len(list(at.rglob("*.eml"))) == 50 and os.listdir(tmp_path) == ["corpus"]
    mails.where("class = 'spam'").write.format("mail").mode("overwrite").save(str(at))
    assert len(list(at.rglob("*.eml"))) == 17


def test_numbers_equal_a_global_sort(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 7 < 5).cast("string").alias("k")).repartition(9, F.xxhash64("id"))
    got = files.numbered(rows.repartition(6), "k", "id")
    by = {}
    for r in got.orderBy("id").collect():
        by.setdefault(r.k, []).append(r.number)
    assert all(v == list(range(1, len(v) + 1)) for v in by.values()) and sum(map(len, by.values())) == 2000
