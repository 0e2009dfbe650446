"""A token store that grows by deltas: a batch writes what it learnt, readers merge, and compaction bounds the number of files.

    base/delta/<batch>/      tokens of one batch (token, spam, ham), dealt by hash buckets
    base/merged/<version>/   all tokens up to a batch
    base/CURRENT             the manifest: merged folder, deltas since, last batch, messages learnt; one rename switches it

A batch costs its own tokens. Nothing that a manifest names is changed, so a snapshot is a copy of the manifest and a restore
puts it back. A batch that is handed over again writes the same folder and is not counted twice: a folder no manifest names
is nothing. A batch with a number at or below the manifest's last one is skipped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators import bayes
from threatloom.sources import files

TOKENS = "token string, spam long, ham long"
BUCKETS, COMPACT_AFTER, KEEP = 16, 20, 10


@dataclass
class Manifest:
    merged: str | None = None
    deltas: list[str] = field(default_factory=list)
    batch: int = -1
    n_spam: int = 0
    n_ham: int = 0
    version: int = 0


class TokenStore:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER, keep: int = KEEP) -> None:
        self.spark, self.base, self.buckets, self.compact_after, self.keep = spark, base.rstrip("/"), buckets, compact_after, keep

    def manifest(self) -> Manifest:
        if not files.exists(self.spark, self.base):
            return Manifest()
        return Manifest(**json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.base}/CURRENT").collect())))

    def _switch(self, m: Manifest) -> None:
        m.version = time.time_ns()
        files.switch(self.spark, self.base, json.dumps(asdict(m)))

    def _write(self, tokens: DataFrame, path: str) -> str:
        dealt = tokens.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")).repartition(self.buckets, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return path

    def _read(self, m: Manifest) -> DataFrame:
        paths = [*([m.merged] if m.merged else []), *m.deltas]
        if not paths:
            return self.spark.createDataFrame([], TOKENS)
        # one reader per folder keeps `bucket` a partition column, so that a look-up of some buckets reads no others
        parts = [self.spark.read.schema(TOKENS + ", bucket int").parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("bucket", "token").agg(F.sum("spam").alias("spam"), F.sum("ham").alias("ham")).select("token", "spam", "ham")

    def tokens(self) -> DataFrame:
        """(token, spam, ham) of everything learnt: merged and deltas, summed as they are read."""
        return self._read(self.manifest())

    def totals(self) -> tuple[int, int]:
        m = self.manifest()
        return m.n_spam, m.n_ham

    def add(self, tokens: DataFrame, n_spam: int, n_ham: int, batch: int) -> bool:
        """Learn a batch's tokens (token, spam, ham); False if it was learnt before."""
        m = self.manifest()
        if batch <= m.batch:
            return False
        m.deltas.append(self._write(tokens.where("token is not null"), f"{self.base}/delta/{batch:012d}"))
        m.batch, m.n_spam, m.n_ham = batch, m.n_spam + n_spam, m.n_ham + n_ham
        self._switch(m)
        if len(m.deltas) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Write merged and deltas as one folder and forget the deltas; what no manifest or snapshot needs goes later."""
        m = self.manifest()
        if m.deltas:
            m.merged, m.deltas = self._write(self._read(m), f"{self.base}/merged/{m.batch:012d}"), []
            self._switch(m)
            self.clean()

    def snapshot(self) -> str:
        """Keep the present state under a name; the newest `keep` stay."""
        m = self.manifest()
        name = f"{self.base}/snapshot/{m.version:020d}"
        files.put_text(self.spark, name, json.dumps(asdict(m)))
        for old in files.children(self.spark, f"{self.base}/snapshot")[: -self.keep]:
            files.remove(self.spark, old)
        return name

    def restore(self, name: str) -> None:
        """Put a snapshot back. Batches go on behind the last one ever learnt, so nothing of a stream comes twice."""
        m = Manifest(**json.loads("\n".join(r[0] for r in self.spark.read.text(name).collect())))
        m.batch = max(m.batch, self.manifest().batch)
        self._switch(m)

    def clean(self) -> None:
        """Remove folders that neither the manifest nor a snapshot names."""
        held = [self.manifest(), *(Manifest(**json.loads("\n".join(r[0] for r in self.spark.read.text(s).collect()))) for s in files.children(self.spark, f"{self.base}/snapshot"))]
        named = {p.rstrip("/").rpartition("/")[2] + p.split(self.base)[-1].split("/")[1] for m in held for p in [*m.deltas, *([m.merged] if m.merged else [])]}
        for kind in ("delta", "merged"):
            for folder in files.children(self.spark, f"{self.base}/{kind}"):
                if folder.rstrip("/").rpartition("/")[2] + kind not in named:
                    files.remove(self.spark, folder)


def learning_sink(store: TokenStore, feature: Callable[[Column], Column], condition: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of verdicts (text, score, fired) that teaches a store; see bayes.autolearn for what is learnt."""

    def learn(df: DataFrame, n: int) -> None:
        if n <= store.manifest().batch:
            return
        new = bayes.autolearn(df, *store.totals(), feature(F.col("text")), bayes.words(F.col("text")), condition)
        counts = new.where("token is null").first()
        store.add(new, *((counts["spam"], counts["ham"]) if counts else (0, 0)), n)

    return learn
