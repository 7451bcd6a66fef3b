"""Pixel mosaics: per output pixel the newest usable sample wins, bit for bit.

Every winner is an argmax aggregate (`max_by` over (order key)) and so is combined on the map side: a pixel that very many
scenes cover costs one partial row per task. Counters come from a second aggregate over the winners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["x", "y"]


def newest(value: Column, order: list[str], usable: Column) -> Column:
    """The value of the usable row with the greatest order key; null if there is none.

    With a single number as key the aggregate's buffer has a fixed width and Spark hashes; a key of several columns makes it
    sort, so a rank of the scenes (one number a scene) is the better key over very many pixels.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return F.max_by(F.when(usable, value), F.when(usable, key))


def has_data(family: str, bands: list[Column], nodata=0, mask: Column | None = None) -> Column:
    """Whether a sample of a product family counts as data.

    rgb: not all bands are no-data; class: not 0; elevation: not NaN; radar and srtm: not -32768; aerial: by its mask, whatever the
    colour; single: not the declared no-data.
    """
    first = bands[0]
    rules = {
        "rgb": lambda: ~F.forall(F.array(*bands), lambda b: b == nodata),
        "class": lambda: first != 0,
        "elevation": lambda: ~F.isnan(first),
        "radar": lambda: first != -32768,
        "srtm": lambda: first != -32768,
        "aerial": lambda: mask,
        "single": lambda: first != nodata,
    }
    if family not in rules or (family == "aerial" and mask is None):
        raise ValueError(f"no rule for {family}")
    return F.coalesce(rules[family](), F.lit(False))


def mosaic_newest(px: DataFrame, value: str, valid: Column, order: list[str], fill=None, grid: DataFrame | None = None) -> DataFrame:
    """Per pixel the newest valid value (`value`), whether it is covered, and the winning scene; fill elsewhere.

    grid: the output pixels (x, y), where pixels without any sample are wanted too.
    """
    out = px.groupBy(*PIXEL).agg(newest(F.col(value), order, valid).alias("value"), newest(F.col(order[-1]), order, valid).alias("winner"), F.bool_or(valid).alias("covered"))
    if grid is not None:
        out = grid.join(out, PIXEL, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return out.withColumn("value", F.coalesce("value", F.lit(fill))) if fill is not None else out


def plan_grid(grids: DataFrame, w: float, s: float, e: float, n: float) -> DataFrame:
    """One row: the output window of an area of interest over aligned grids, rounded out to whole pixels.

    `agreed` is false where CRS, pixel size or band count differ between the sources.
    """
    a = grids.agg(
        F.min("left").alias("left"), F.max("right").alias("right"), F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.min("dx").alias("dx"), F.min("dy").alias("dy"),
        ((F.count_distinct("crs") == 1) & (F.count_distinct("bands") == 1) & (F.max("dx") - F.min("dx") <= 1e-8) & (F.max("dy") - F.min("dy") <= 1e-8)).alias("agreed"),
    )
    snap = lambda v, up: F.when(F.abs(v - F.round(v)) <= 1e-7, F.round(v)).otherwise(F.ceil(v) if up else F.floor(v)).cast("bigint")
    lo, hi = F.greatest(F.col("left"), F.lit(w)), F.least(F.col("right"), F.lit(e))
    up, down = F.least(F.col("top"), F.lit(n)), F.greatest(F.col("bottom"), F.lit(s))
    return a.select(
        snap((lo - F.col("left")) / F.col("dx"), False).alias("col0"), snap((hi - F.col("left")) / F.col("dx"), True).alias("col1"),
        snap((F.col("top") - up) / F.col("dy"), False).alias("row0"), snap((F.col("top") - down) / F.col("dy"), True).alias("row1"), "agreed",
    )


def mosaic_flags(px: DataFrame, value: str, valid: Column, order: list[str]) -> DataFrame:
    """Flag bands: the newest unfilled word, or else the newest word at all, which does not count as covered."""
    any_row = F.lit(True)
    return px.groupBy(*PIXEL).agg(F.coalesce(newest(F.col(value), order, valid), newest(F.col(value), order, any_row)).alias("value"), F.bool_or(valid).alias("covered"))


def select_two(px: DataFrame, complete: Column, accepted: Column, values: list[str], order: list[str], scene: str) -> DataFrame:
    """Baseline and winner of every pixel in one pass: the newest complete sample, and the newest that is accepted as well.

    All `values` come from the winner. Null winner: nothing is accepted there.
    """
    good = complete & accepted
    return px.groupBy(*PIXEL).agg(
        newest(F.col(scene), order, complete).alias("baseline"), newest(F.col(scene), order, good).alias("winner"), *[newest(F.col(v), order, good).alias(v) for v in values]
    )


def selection_counters(selected: DataFrame) -> DataFrame:
    """One row: pixels, common, covered, rejected (no winner), removed (only a baseline), fallback (an older winner), and the winners' sum."""
    base, win = F.col("baseline").isNotNull(), F.col("winner").isNotNull()
    return selected.agg(
        F.count("*").alias("pixels"), F.count_if(base).alias("common"), F.count_if(win).alias("covered"), F.count_if(~win).alias("rejected"), F.count_if(base & ~win).alias("removed"),
        F.count_if(base & win & (F.col("baseline") != F.col("winner"))).alias("fallback"), F.coalesce(F.sum(F.col("winner") + 1), F.lit(0)).cast("bigint").alias("winner_sum"),
    )


def scene_contributions(selected: DataFrame) -> DataFrame:
    return selected.where("winner is not null").groupBy("winner").agg(F.count("*").alias("pixels"))


def mask_scene(px: DataFrame, bands: list[str], accepted: Column, nodata: int = 0) -> DataFrame:
    """Rejected pixels of one scene become no-data in all bands; `was_valid` says what they were."""
    was = F.lit(True)
    for b in bands:
        was = was & (F.col(b) != nodata)
    return px.select("*", accepted.alias("accepted"), was.alias("was_valid")).withColumns({b: F.when(F.col("accepted"), F.col(b)).otherwise(F.lit(nodata)) for b in bands})


def mask_counters(masked: DataFrame) -> DataFrame:
    """`rejected` counts every failing pixel, `removed` only those that were valid before."""
    return masked.agg(F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(~F.col("accepted") & F.col("was_valid")).alias("removed"))


def polygon_mask(px: DataFrame, inside: Column, value: str, fill: int) -> DataFrame:
    """After selection, pixels whose centre lies outside become fill; `masked` marks them."""
    return px.withColumn("masked", ~inside).withColumn(value, F.when(inside, F.col(value)).otherwise(F.lit(fill)))
