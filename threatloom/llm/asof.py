"""As-of join whose keys may be hot: rows are dealt by key and time bucket, and buckets hand on their last event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(time: Column, edges: list) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (time >= F.lit(e)).cast("int")
    return out


def asof_join(probes: DataFrame, events: DataFrame, keys: list[str], time: str, order: str, payload: str, strict: bool) -> DataFrame:
    """probes with `payload` of the latest event of the same keys: earlier than the probe (strict) or not later.

    Both sides hold keys, `time` (long) and `order` (long; breaks ties among events, the larger wins); events hold the
    struct column `payload`. A null key or time matches nothing. Time buckets are the quantiles of all times, so a hot key
    is split where its rows are; each (key, bucket) hands its last event on, at most BUCKETS rows a key.
    """
    cols = probes.columns
    usable = F.col(time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    kind = events.schema[payload].dataType
    ev = events.where(usable).select(*keys, time, order, F.lit(None).cast(probes.select(F.struct(*cols)).schema[0].dataType).alias("_probe"), payload, F.lit(1 if strict else 0).alias("_turn"))
    pr = probes.where(usable).select(*keys, time, F.lit(None).cast("long").alias(order), F.struct(*cols).alias("_probe"), F.lit(None).cast(kind).alias(payload), F.lit(0 if strict else 1).alias("_turn"))
    both = ev.unionByName(pr)
    found = both.agg(F.percentile_approx(time, [i / BUCKETS for i in range(1, BUCKETS)], 1000)).first()[0]
    both = both.withColumn("_bucket", _bucket(F.col(time), sorted(set(found or []))))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time, "_turn", F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last(payload, ignorenulls=True).over(inside))
    ends = ev.withColumn("_bucket", _bucket(F.col(time), sorted(set(found or [])))).groupBy(*keys, "_bucket").agg(F.max_by(payload, F.struct(time, order)).alias("_end"))
    # a bucket starts with the last event of the latest earlier bucket that has one
    hold = both.select(*keys, "_bucket").distinct().join(ends, [*keys, "_bucket"], "left")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = hold.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    out = (
        seen.where("_probe is not null")
        .join(carried, [*keys, "_bucket"], "left")
        .select("_probe.*", F.coalesce("_last", "_carried").alias(payload))
    )
    return out.unionByName(probes.where(~usable).withColumn(payload, F.lit(None).cast(kind)))
