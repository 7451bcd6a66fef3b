"""Requests against dataset presets: defaults, tiles, month windows, catalogue filters, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.windows import page

from terraloom.functions.grid import tile_footprints


def with_defaults(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Year, layer and season of every request, by default the preset's last year and first layer; `reason` where a given one is not offered."""
    j = requests.join(presets, "dataset", "left")
    year, layer = F.coalesce("year", F.element_at("years", -1)), F.coalesce("layer", F.element_at("layers", 1))
    reason = F.when(F.col("years").isNull(), "dataset").when(~F.array_contains("years", year), "year").when(~F.array_contains("layers", layer), "layer")
    return j.withColumns({"_y": year, "_l": layer, "reason": reason}).drop("year", "layer", "years", "layers").withColumnsRenamed({"_y": "year", "_l": "layer"})


def tiles(requests: DataFrame, step: int) -> DataFrame:
    """One source per tile and layer of every request."""
    d = tile_footprints(requests, step).withColumn("layer", F.explode("layers"))
    name = F.format_string("%s%02d%s%03d_%s", F.when(F.col("lat0") < 0, "S").otherwise("N"), F.abs("lat0"), F.when(F.col("lon0") < 0, "W").otherwise("E"), F.abs("lon0"), F.col("layer"))
    return d.withColumn("source", name)


def month_window(year: Column, month: Column) -> tuple[Column, Column]:
    """First and last second of a month."""
    first = F.make_date(year, month, F.lit(1))
    return first.cast("timestamp"), F.date_add(F.last_day(first), 1).cast("timestamp") - F.expr("interval 1 second")


def catalog_filter(rows: DataFrame, terms: list[str], text: Column, status: str | None = None, category: str | None = None) -> DataFrame:
    """Rows in which every term occurs (lower case), with a status and a category where asked for."""
    ok = F.lit(True)
    for t in terms:
        ok = ok & F.contains(F.lower(text), F.lit(t.lower()))
    if status is not None:
        ok = ok & (F.col("status") == status)
    if category is not None:
        ok = ok & (F.col("category") == category)
    return rows.where(ok)


def catalog_page(rows: DataFrame, query: str | None = None, offset: int = 0, limit: int = 10) -> DataFrame:
    """One page of the datasets (id, title, category) that hold `query` in "id title category", lower case: the rows by id, with

    `total`, `next_offset` (null at the end) and `complete`. Pages of 1 to 20 rows, offsets to 10,000 and queries to 100 bytes are allowed.
    A null field reads as empty.
    """
    text = query or ""
    if not 1 <= limit <= 20 or not 0 <= offset <= 10_000 or len(text.encode()) > 100:
        raise ValueError("invalid dataset catalog page")
    named = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "title", "category")]))
    return page(rows.where(F.contains(named, F.lit(text.lower()))), ["id"], offset, limit)


def packages(areas: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """Packages of each area, with `refused` where there are more than `most`."""
    n = pairs.groupBy("area_id").agg(F.count("*").alias("n"))
    return areas.select("area_id").join(n, "area_id", "left").select("area_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > most).alias("refused"))
