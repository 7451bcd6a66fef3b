"""Predicates over boxes, times, clouds, tags and text, and the split into valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAFE_INTEGER = (1 << 53) - 1
EARTH_RADIUS = 6371008.8


def bbox_closed(w, s, e, n, box: tuple) -> Column:
    """Boxes meet; touching counts."""
    return (w <= box[2]) & (e >= box[0]) & (s <= box[3]) & (n >= box[1])


def bbox_open(w, s, e, n, box: tuple) -> Column:
    """Boxes overlap; touching does not count."""
    return (w < box[2]) & (e > box[0]) & (s < box[3]) & (n > box[1])


def valid_bounds(w, s, e, n) -> Column:
    fine = F.lit(True)
    for c in (w, s, e, n):
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return fine & w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90) & (w < e) & (s < n)


def bbox_rows(w, s, e, n, box: tuple) -> Column:
    """Closed meeting of each row's own box; a malformed box is an error."""
    ok = (w <= e) & (s <= n)
    return F.when(F.coalesce(ok, F.lit(False)), bbox_closed(w, s, e, n, box)).otherwise(F.raise_error(F.lit("malformed box")).cast("boolean"))


def datetime_overlap(instant: Column, start: Column, end: Column, low, high) -> Column:
    """An instant or interval meets [low, high]; None is open; no time at all fails."""
    first, last = F.coalesce(instant, start), F.coalesce(instant, end)
    ok = first.isNotNull() & last.isNotNull()
    if low is not None:
        ok = ok & (last >= low)
    if high is not None:
        ok = ok & (first <= high)
    return F.coalesce(ok, F.lit(False))


def datetime_syntax(c: Column) -> Column:
    """An instant, or two in order with `..` for an open end, not both open."""
    part = lambda k: F.split_part(c, F.lit("/"), F.lit(k))
    t = lambda k: F.try_to_timestamp(part(k))
    open_ = lambda k: part(k) == ".."
    size = F.size(F.split(c, "/"))
    two = (size == 2) & ~(open_(1) & open_(2)) & (open_(1) | t(1).isNotNull()) & (open_(2) | t(2).isNotNull()) & (open_(1) | open_(2) | F.coalesce(t(1) <= t(2), F.lit(False)))
    return F.coalesce(((size == 1) & t(1).isNotNull()) | two, F.lit(False))


def cloud_range(c: Column, low: float, high: float) -> Column:
    return F.coalesce(~F.isnan(c) & c.between(0, 100) & c.between(low, high), F.lit(False))


def platform_mode(platform: Column, mode: Column, platforms: list[str], wanted: str) -> Column:
    return platform.isin(platforms) & (mode == wanted)


def latest_year(items: DataFrame, day: str, today) -> DataFrame:
    """Items of the newest year that has one on or before today. The year comes from an aggregate of one row, so no task sees all items."""
    newest = items.where(F.col(day) <= today).agg(F.max(F.year(day)).alias("_year"))
    return items.where(F.col(day) <= today).withColumn("_year", F.year(day)).join(F.broadcast(newest), "_year", "left_semi").drop("_year")


def quarantine(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds `reason`: the first check that fails, null for a valid row."""
    out = None
    for label, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, label) if out is None else out.when(bad, label)
    return rows.withColumn("reason", out)


def require_valid(rows: DataFrame) -> DataFrame:
    """Valid rows only; an error where there are rejected rows and no valid one."""
    counts = rows.agg(F.count_if(F.col("reason").isNull()).alias("good"), F.count("*").alias("all")).first()
    if counts["all"] and not counts["good"]:
        raise ValueError("all rows were rejected")
    return rows.where("reason is null").drop("reason")


# Tag selectors of the feature presets; a key alone takes every value but "no".
PRESETS = {
    "buildings": [("building", None), ("building:part", None)],
    "roads": [("highway", None)],
    "water": [("natural", "water"), ("waterway", None), ("landuse", "reservoir"), ("landuse", "basin")],
    "landuse": [("landuse", None)],
    "pois": [("amenity", None), ("shop", None), ("tourism", None), ("leisure", None)],
}

# Which tags make a closed way an area (key, mode, values), as OpenStreetMap's public table of polygon features has it.
AREA_RULES = [
    ("building", "all", []),
    ("highway", "whitelist", ["services", "rest_area", "escape", "elevator"]),
    ("natural", "blacklist", ["coastline", "cliff", "ridge", "arete", "tree_row"]),
    ("landuse", "all", []),
    ("waterway", "whitelist", ["riverbank", "dock", "boatyard", "dam"]),
    ("amenity", "all", []),
    ("leisure", "all", []),
    ("barrier", "whitelist", ["city_wall", "ditch", "hedge", "retaining_wall", "wall", "spikes"]),
    ("railway", "whitelist", ["station", "turntable", "roundhouse", "platform"]),
    ("area", "all", []),
    ("boundary", "all", []),
    ("man_made", "blacklist", ["cutline", "embankment", "pipeline"]),
    ("power", "whitelist", ["plant", "substation", "generator", "transformer"]),
    ("place", "all", []),
    ("shop", "all", []),
    ("aeroway", "blacklist", ["taxiway"]),
    ("tourism", "all", []),
    ("historic", "all", []),
    ("public_transport", "all", []),
    ("office", "all", []),
    ("building:part", "all", []),
    ("military", "all", []),
    ("ruins", "all", []),
    ("area:highway", "all", []),
    ("craft", "all", []),
    ("golf", "all", []),
    ("indoor", "all", []),
]


def osm_preset(tags: Column, preset: str) -> Column:
    """Whether tags (a map) meet any selector of a feature preset; an unknown preset is an error."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}")
    out = F.lit(False)
    for key, value in PRESETS[preset]:
        out = out | F.coalesce(tags[key] != "no" if value is None else tags[key] == value, F.lit(False))
    return out


def area_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AREA_RULES, "key string, mode string, `values` array<string>")


def osm_area(ways: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """`is_area` of closed ways: `area` decides, else a rule (key, mode all / whitelist / blacklist, values) that a tag meets."""
    rules = area_rules(ways.sparkSession) if rules is None else rules
    t = ways.select("way_id", "closed", "tags", F.explode_outer(F.map_entries("tags")).alias("_t"))
    j = t.join(F.broadcast(rules), F.col("_t.key") == F.col("key"), "left")
    listed = F.array_contains("values", F.col("_t.value"))
    met = (F.col("_t.value") != "no") & F.when(F.col("mode") == "all", True).when(F.col("mode") == "whitelist", listed).when(F.col("mode") == "blacklist", ~listed)
    by_rule = j.groupBy("way_id").agg(F.first("closed").alias("closed"), F.max(F.when(F.col("_t.key") == "area", F.col("_t.value"))).alias("area"), F.bool_or(F.coalesce(met, F.lit(False))).alias("met"))
    return by_rule.select("way_id", (F.col("closed") & F.when(F.col("area") == "no", False).when(F.col("area") == "yes", True).otherwise(F.col("met"))).alias("is_area"))


def overpass_area(w, s, e, n) -> Column:
    """At most one degree a side and 100 square kilometres on the sphere."""
    area = F.lit(EARTH_RADIUS**2) * F.radians(e - w) * (F.sin(F.radians(n)) - F.sin(F.radians(s)))
    return (e - w <= 1) & (n - s <= 1) & (area <= 1e8)


def nodata(value: Column, declared: Column, as_float32: bool = False) -> Column:
    """Typed no-data test: NaN matches NaN, and a Float32 sample meets the declaration rounded to Float32."""
    d = declared.cast("float").cast("double") if as_float32 else declared
    return F.coalesce((value == d) | (F.isnan(value) & F.isnan(d)), F.lit(False))


def text_clean(c: Column, limit: int) -> Column:
    return F.coalesce((F.length(c) > 0) & (F.trim(c) == c) & (F.length(c) <= limit) & ~c.rlike("\\p{Cntrl}"), F.lit(False))


def safe_integer(c: Column) -> Column:
    return F.abs(c) <= SAFE_INTEGER


def scene_search(items: DataFrame, collection: str, box: tuple, low, high, cloud: float) -> DataFrame:
    """Items of a collection that overlap a box, lie in a date range and are clear enough; the first of equal ids stays."""
    ok = items.where((F.col("collection_id") == collection) & bbox_open(F.col("w"), F.col("s"), F.col("e"), F.col("n"), box) & F.col("dt").between(low, high) & cloud_range(F.col("cloud"), 0, cloud))
    return ok.withColumn("_r", F.row_number().over(Window.partitionBy("item_id").orderBy("dt"))).where("_r = 1").drop("_r")


UUID4 = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
VERSION = "^[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}(-[a-zA-Z0-9.-]{1,32})?$"


def usage_event_reason(now: Column, names: list[str]) -> Column:
    """Why a usage event is refused, null if it is not. Reads id, installation_id, session_id, version, platform, environment, name, at, fields."""
    c, fields = F.col, F.col("fields")
    acquisition = ["acquisitionSource", "acquisitionCampaign", "acquisitionKind"]
    some, every = F.lit(False), F.lit(True)
    for k in acquisition:
        some, every = some | fields[k].isNotNull(), every & fields[k].isNotNull()
    tutorial, website = c("name").startswith("tutorial_"), fields["acquisitionKind"] == "website"
    checks = [
        ("name", c("name").isin(names)),
        ("identifier", c("id").rlike(UUID4) & c("installation_id").rlike(UUID4) & c("session_id").rlike(UUID4)),
        ("version", c("version").rlike(VERSION) & c("platform").isin("desktop", "browser") & c("environment").isin("development", "production")),
        ("expired", (c("at") >= now - F.expr("interval 30 days")) & (c("at") <= now + F.expr("interval 300 seconds"))),
        ("incomplete label", ~some | every),
        ("wrong surface", F.when(some, (website == tutorial) & (c("platform") == F.when(website, "browser").otherwise("desktop"))).otherwise(~tutorial)),
    ]
    out = None
    for label, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, label) if out is None else out.when(bad, label)
    return out


def monitor_item(collection: Column, stamp: Column, cloud: Column, wanted, low, high, most) -> Column:
    return F.coalesce((collection == wanted) & stamp.between(low, high) & ~F.isnan(cloud) & (cloud <= most), F.lit(False))
