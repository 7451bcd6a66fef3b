"""Set operations over pages, and consistency checks: each returns the violations, `require_none` makes them an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_none(violations: DataFrame, what: str) -> None:
    if first := violations.take(1):
        raise ValueError(f"{what}: {first[0].asDict()}")


def page_union(pages: DataFrame, key: str, body: Column) -> DataFrame:
    """Rows with an id once, those without all kept; `conflict` where one id has different bodies."""
    d = pages.withColumn("_h", F.sha2(body.cast("binary"), 256))
    named = d.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_h").alias("digest"), (F.min("_h") != F.max("_h")).alias("conflict"), F.count("*").alias("copies"))
    unnamed = d.where(F.col(key).isNull()).select(key, F.col("_h").alias("digest"), F.lit(False).alias("conflict"), F.lit(1).cast("bigint").alias("copies"))
    return named.unionByName(unnamed)


def declared_total(pages: DataFrame, source: str, declared: str, returned: str) -> DataFrame:
    """Sources whose rows do not add up to a declared total that is the same on every page."""
    d = pages.groupBy(source).agg(F.min(declared).alias("low"), F.max(declared).alias("high"), F.sum(returned).alias("rows"))
    return d.where((F.col("low") != F.col("high")) | (F.col("rows") != F.col("high")))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def absent(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.exceptAll(present) if wanted.columns == present.columns else wanted.join(present, wanted.columns, "left_anti")


def add_scenes(pinned: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """Pins stay as they are; only keys that have none are added."""
    return pinned.unionByName(offered.join(pinned.select(*keys), keys, "left_anti"))


def add_assets(pinned: DataFrame, offered: DataFrame, quality: list[str]) -> DataFrame:
    """Assets (id, asset, ...) of scenes: those of pinned scenes stay, a new scene brings all of its own, and a pinned one
    only gets quality assets that it has not."""
    known = pinned.select("id").distinct()
    new = offered.join(known, "id", "left_anti")
    missing = offered.where(F.col("asset").isin(quality)).join(known, "id", "left_semi").join(pinned.select("id", "asset"), ["id", "asset"], "left_anti")
    return pinned.unionByName(new).unionByName(missing)


def page_loops(pages: DataFrame, source: str, cursor: str) -> DataFrame:
    """Cursors that a source gave more than once."""
    return pages.where(F.col(cursor).isNotNull()).groupBy(source, cursor).agg(F.count("*").alias("times")).where("times > 1")


def unit_count(units: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Countries whose units do not match the declared number, repeat an id, or mix levels."""
    d = units.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("level").alias("levels"))
    j = d.join(declared, key, "full")
    return j.where(~F.coalesce((F.col("n") == F.col("declared")) & (F.col("n") == F.col("ids")) & (F.col("levels") == 1), F.lit(False))).select(key, "n", "declared")


def stored_bytes(files: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Files whose bytes do not have the recorded length and SHA-256. files: key, content (binary)."""
    d = files.select(key, F.length("content").alias("_n"), F.sha2("content", 256).alias("_h")).join(recorded, key, "full")
    return d.where(~F.coalesce((F.col("_n") == F.col("bytes")) & (F.col("_h") == F.col("sha256")), F.lit(False))).select(key)
