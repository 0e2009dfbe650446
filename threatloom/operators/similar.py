"""Names near a brand, as joins on equal keys with a table of brands of any size.

Two names within k edits share a string that k deletions or fewer make of either, so names and brands are joined on their
deletions and the edit distance is computed for candidates alone. Names that spell a brand with look-alike characters share
its skeleton, and the brand's own pattern decides. Nothing in the plan grows with the brands; what is joined are distinct
labels, so a hot host costs one.

Edge cases: null and empty names match nothing; a name that is a brand isn't near any; repeated names and brands count
once; names too long or too short for any brand are left out before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions import domains as D
from threatloom.functions import refdata as R
from threatloom.operators.maps import small_or_dealt

EDITS = 2


def _without_one(name: Column) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))
    return F.when(F.length(name) > 0, cut).otherwise(F.array().cast("array<string>"))


def deletions(name: Column, edits: int = EDITS) -> Column:
    """A name and all strings that up to `edits` deletions make of it, each once."""
    out = step = F.array(name)
    for _ in range(edits):
        step = F.array_distinct(F.flatten(F.transform(step, _without_one)))
        out = F.array_distinct(F.concat(out, step))
    return out


def near(names: DataFrame, name: str, brands: DataFrame, edits: int = EDITS) -> DataFrame:
    """(name, brand, distance): names 1 to `edits` edits from a brand (brands: brand) that aren't brands themselves."""
    known = brands.select("brand").where("brand <> ''").distinct()
    least, most = known.agg(F.min(F.length("brand")), F.max(F.length("brand"))).first()
    here = names.select(F.col(name).alias("name")).where("name <> ''").distinct()
    here = here.where(F.length("name").between((least or 0) - edits, (most or -1) + edits)).join(small_or_dealt(known.withColumnRenamed("brand", "name")), "name", "left_anti")
    left = here.select("name", F.explode(deletions(F.col("name"), edits)).alias("_key"))
    right = known.select("brand", F.explode(deletions(F.col("brand"), edits)).alias("_key"))
    pairs = left.join(small_or_dealt(right), "_key").select("name", "brand").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "brand", edits)).where(F.col("distance").between(1, edits))


def folded(name: Column) -> Column:
    """A name with every character that passes for another in one form: equal for a brand and all its spellings."""
    return F.replace(F.replace(F.translate(name, R.FOLD_FROM, R.FOLD_TO), F.lit("m"), F.lit("rn")), F.lit("w"), F.lit("vv"))


def spelling_pattern(brand: Column) -> Column:
    """The pattern of a brand's look-alike spellings (domains.brand_pattern of a column)."""
    pairs = ", ".join(f"'{c}', '{p}'" for c, p in R.LOOKS_LIKE.items())
    quoted = lambda c: F.when(c.rlike("[a-z0-9]"), c).otherwise(F.concat(F.lit("\\"), c))
    letters = F.transform(F.split(brand, "(?!$)"), lambda c: F.coalesce(F.element_at(F.expr(f"map({pairs})"), c), quoted(c)))
    return F.concat(F.lit("^"), F.array_join(letters, ""), F.lit("$"))


def spelt_like(names: DataFrame, name: str, brands: DataFrame) -> DataFrame:
    """(name, brand): names that spell a brand with look-alike characters and aren't it."""
    here = names.select(F.col(name).alias("name")).where("name <> ''").distinct().withColumn("_key", folded(F.col("name")))
    known = brands.select("brand").where("brand <> ''").distinct().withColumn("_key", folded(F.col("brand")))
    return here.join(small_or_dealt(known), "_key").where("name <> brand").where(F.rlike("name", spelling_pattern(F.col("brand")))).select("name", "brand")


def lookalikes(hosts: DataFrame, host: str, brands: DataFrame) -> DataFrame:
    """(host, reason, label, brand) of hosts that look like a brand (brands: brand, rank): a look-alike spelling anywhere in
    the name first, then a registered name within two edits; of several the first label, then the brand of least rank."""
    sites = hosts.select(F.col(host).alias("host")).where("host is not null").distinct().withColumn("_h", D.normalize_host(F.col("host")))
    sites = sites.withColumn("_d", D.registered_domain(F.col("_h")))
    spelt = sites.select("host", F.lit("homoglyph").alias("reason"), F.posexplode(F.flatten(F.transform(D.name_labels(F.col("_h"), F.col("_d")), D.components))).alias("_n", "name"))
    close = sites.select("host", F.lit("levenshtein").alias("reason"), F.posexplode(D.components(F.get(D.host_labels(F.col("_d")), F.lit(0)))).alias("_n", "name"))
    found = spelt.join(spelt_like(spelt, "name", brands), "name").unionByName(close.join(near(close, "name", brands).drop("distance"), "name"))
    ranked = found.join(small_or_dealt(brands.groupBy("brand").agg(F.min("rank").alias("rank"))), "brand")
    first = Window.partitionBy("host").orderBy("reason", "_n", "rank", "brand")
    return ranked.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("host", "reason", F.col("name").alias("label"), "brand")


def fixed_brands(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(R.BRANDS)), "rank int, brand string").select("brand", "rank")
