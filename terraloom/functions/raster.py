"""Column functions of raster science: calibration, bit fields, acceptance rules, display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (product, scale, offset, no-data value) of published surface products.
CALIBRATION = [
    ("landsat-c2-l2", 0.0000275, -0.2, 0),
    ("modis-09a1-v061", 0.0001, 0.0, -28672),
    ("modis-13q1-v061", 0.0001, 0.0, -3000),
    ("hls-l30-v2", 0.0001, 0.0, -9999),
    ("viirs-09a1-v002", 0.0001, 0.0, -28672),
]

# Vegetation layers (key, type, bits, scale, fill, least, greatest, kind).
BAND_LAYERS = [
    ("ndvi", "int16", 16, 0.0001, -3000, -2000, 10000, "index"),
    ("evi", "int16", 16, 0.0001, -3000, -2000, 10000, "index"),
    ("vi_quality", "uint16", 16, 1.0, 65535, 0, 65534, "flags"),
    ("vi_reliability", "int8", 8, 1.0, -1, 0, 3, "rank"),
    ("vi_doy", "int16", 16, 1.0, -1, 1, 366, "date"),
    ("vi_red", "int16", 16, 0.0001, -1000, 0, 10000, "reflectance"),
    ("vi_nir", "int16", 16, 0.0001, -1000, 0, 10000, "reflectance"),
    ("vi_blue", "int16", 16, 0.0001, -1000, 0, 10000, "reflectance"),
    ("vi_mir", "int16", 16, 0.0001, -1000, 0, 10000, "reflectance"),
    ("vi_view_zenith", "int16", 16, 0.01, -10000, 0, 18000, "angle"),
    ("vi_sun_zenith", "int16", 16, 0.01, -10000, 0, 18000, "angle"),
    ("vi_relative_azimuth", "int16", 16, 0.01, -4000, -18000, 18000, "angle"),
]

# Bit fields (name, first bit, last bit, codes that the product defines; None: all of them).
QC_MODIS_500M = [("modland", 0, 1, None)] + [(f"band{b}", 2 + 4 * (b - 1), 5 + 4 * (b - 1), [0, *range(7, 16)]) for b in range(1, 8)] + [("atmospheric", 30, 30, None), ("adjacency", 31, 31, None)]
QC_MODIS_STATE = [("cloud", 0, 1, None), ("shadow", 2, 2, None), ("land_water", 3, 5, None), ("aerosol", 6, 7, None), ("cirrus", 8, 9, None)] + [(n, b, b, None) for b, n in enumerate(["internal_cloud", "internal_fire", "snow", "near_cloud", "salt_pan", "internal_snow"], 10)]
QC_VI = [("modland", 0, 1, None), ("usefulness", 2, 5, [0, 1, 2, 4, 8, 9, 10, 12, 13, 14, 15]), ("aerosol", 6, 7, None), ("adjacent_cloud", 8, 8, None), ("brdf", 9, 9, None), ("mixed_clouds", 10, 10, None), ("land_water", 11, 13, None), ("snow", 14, 14, None), ("shadow", 15, 15, None)]
QA_PIXEL = [(n, b, b, None) for b, n in enumerate(["fill", "dilated_cloud", "cirrus", "cloud", "cloud_shadow", "snow", "clear", "water"])] + [("cloud_confidence", 8, 9, None)] + [(n, b, b + 1, [0, 1, 3]) for b, n in ((10, "shadow_confidence"), (12, "snow_confidence"), (14, "cirrus_confidence"))]
QA_RADSAT = [(f"band{b + 1}", b, b, None) for b in range(7)] + [("unused7", 7, 7, [0]), ("band9", 8, 8, None), ("unused9", 9, 9, [0]), ("unused10", 10, 10, [0]), ("terrain", 11, 11, None), ("unused12_15", 12, 15, [0])]

# Scene classes 0-11 (label, red, green, blue).
SCENE_CLASSES = [
    ("No data", 0, 0, 0),
    ("Saturated or defective", 255, 0, 0),
    ("Terrain shadow", 47, 47, 47),
    ("Cloud shadow", 100, 50, 0),
    ("Vegetation", 0, 160, 0),
    ("Bare/non-vegetated", 255, 230, 90),
    ("Water", 0, 0, 255),
    ("Unclassified", 128, 128, 128),
    ("Medium-probability cloud", 192, 192, 192),
    ("High-probability cloud", 255, 255, 255),
    ("Thin cirrus", 100, 200, 255),
    ("Snow or ice", 255, 150, 255),
]

# Fixed values: (index value, red, green, blue) of the vegetation ramp.
VEGETATION_RAMP = [(-2000, 42, 91, 135), (0, 208, 169, 104), (2000, 235, 223, 160), (4000, 161, 196, 112), (7000, 75, 143, 76), (10000, 24, 86, 51)]


def bits(c: Column, first: int, last: int) -> Column:
    """Value of an inclusive bit range; the word is taken as BIGINT, so unsigned 32-bit words fit."""
    return F.shiftright(c.cast("bigint"), first).bitwiseAND(F.lit((1 << (last - first + 1)) - 1).cast("bigint"))


def any_bit(c: Column, mask: int) -> Column:
    return c.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")) != 0


def calibration_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALIBRATION, "product string, scale double, offset double, nodata long")


def calibrate(values: DataFrame, table: DataFrame, value: str = "value") -> DataFrame:
    """`reflectance` = value * scale + offset by product; null at the product's no-data value. The table is a fixed handful of rows."""
    joined = values.join(F.broadcast(table), "product", "left")
    return joined.withColumn("reflectance", F.when(F.col(value) != F.col("nodata"), F.col(value) * F.col("scale") + F.col("offset"))).drop("scale", "offset", "nodata")


def band_layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BAND_LAYERS, "layer string, data_type string, bits int, scale double, fill long, low long, high long, kind string")


def within_range(value: Column, fill: Column, low: Column, high: Column, kind: Column, year: Column) -> Column:
    """Not fill, inside the layer's range, and for dates a day that the year has."""
    return (value != fill) & value.between(low, high) & ((kind != "date") | doy_to_date(year, value).isNotNull())


def doy_to_date(year: Column, doy: Column) -> Column:
    """Date of a day of the year; null where the year has no such day."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(leap, 366).otherwise(365)
    safe = F.when(doy.between(1, days), doy)
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (safe - 1).cast("int"))


def gamma0_db(v: Column) -> Column:
    return F.when(v > 0, F.lit(10.0) * F.log10(v))


def decode_bits(c: Column, fields: list) -> Column:
    """Array of (name, first, last, code, defined) of a flag word, one entry a field."""
    out = []
    for name, first, last, codes in fields:
        code = bits(c, first, last)
        out.append(F.struct(F.lit(name).alias("field"), F.lit(first).alias("first"), F.lit(last).alias("last"), code.alias("code"), (F.lit(True) if codes is None else code.isin(codes)).alias("defined")))
    return F.array(*out)


def bits_text(c: Column, width: int) -> tuple[Column, Column]:
    """Zero-padded binary and hexadecimal text."""
    return F.lpad(F.bin(c.cast("bigint")), width, "0"), F.concat(F.lit("0x"), F.lpad(F.hex(c.cast("bigint")), width // 4, "0"))


def qa_pixel_class(c: Column) -> Column:
    """Cloud 3, dilated 2, cirrus 4, shadow 5, snow 6, water 7, clear 1, else 0: the first flag that is set, in this order."""
    out = F.lit(None).cast("int")
    for mask, k in reversed([(8, 3), (2, 2), (4, 4), (16, 5), (32, 6), (128, 7), (64, 1)]):
        out = F.when(any_bit(c, mask), k).otherwise(F.coalesce(out, F.lit(0)))
    return out


def radsat_class(c: Column) -> Column:
    """Unused bits 4, terrain 3, colour bands 1, other bands 2, else 0."""
    return F.when(any_bit(c, 0xF680), 4).when(any_bit(c, 2048), 3).when(any_bit(c, 14), 1).when(any_bit(c, 0x0171), 2).otherwise(0)


def scene_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *x) for k, x in enumerate(SCENE_CLASSES)], "class long, label string, r int, g int, b int")


def scl_class(values: DataFrame, table: DataFrame, value: str = "scl") -> DataFrame:
    """Label and colour of every class value; an unknown class is an error."""
    checked = values.withColumn("class", F.when(F.col(value).between(0, 11), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("unknown scene class "), F.col(value).cast("string")))))
    return checked.join(F.broadcast(table), "class")


def accept_landsat(policy: str, exclude_snow: bool, pixel: Column, radsat: Column) -> Column:
    """`cloud_free`: no fill, cloud, cirrus or shadow flag, no colour-band saturation, no terrain. `conservative`: the clear
    flag and low confidences besides, and no unused saturation bit. Values outside 16 bits are refused."""
    ok = pixel.between(0, 65535) & radsat.between(0, 65535) & ~any_bit(pixel, 31) & ~any_bit(radsat, 2062)
    if exclude_snow:
        ok = ok & ~any_bit(pixel, 32)
    if policy == "conservative":
        ok = ok & any_bit(pixel, 64) & (bits(pixel, 8, 9) == 1) & (bits(pixel, 10, 11) == 1) & (bits(pixel, 14, 15) == 1) & ~any_bit(radsat, 0xF680)
        if exclude_snow:
            ok = ok & (bits(pixel, 12, 13) == 1)
    elif policy != "cloud_free":
        raise ValueError(f"unknown policy {policy}")
    return ok


def accept_modis(policy: str, exclude_snow: bool, qc: Column, state: Column) -> Column:
    """`clear`: no fill, cloud, shadow, cirrus or adjacent cloud. `clear_best`: best quality of the colour bands besides."""
    ok = (qc != 4294967295) & (state != 65535) & ~any_bit(state, 3 | 4 | 768 | 1024 | 8192)
    if exclude_snow:
        ok = ok & ~any_bit(state, 4096 | 32768)
    if policy == "clear_best":
        ok = ok & ~any_bit(qc, 3 | 15 << 2 | 15 << 10 | 15 << 14)
    elif policy != "clear":
        raise ValueError(f"unknown policy {policy}")
    return ok


def accept_vi(policy: str, quality: Column, rank: Column) -> Column:
    ok = (quality != 65535) & bits(quality, 2, 5).isin(0, 1, 2, 4, 8, 9, 10) & (bits(quality, 6, 7) != 3) & ~any_bit(quality, 256 | 1024 | 16384 | 32768)
    if policy == "good":
        return ok & (rank == 0) & (bits(quality, 0, 1) == 0)
    if policy == "usable":
        return ok & rank.isin(0, 1) & (bits(quality, 0, 1) <= 1)
    raise ValueError(f"unknown policy {policy}")


def vi_color(v: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue by whole-number interpolation (w + span / 2) / span, clamped to the ramp."""
    v = F.greatest(F.lit(VEGETATION_RAMP[0][0]), F.least(F.lit(VEGETATION_RAMP[-1][0]), v)).cast("bigint")
    out = []
    for k in (1, 2, 3):
        c = None
        for a, b in zip(VEGETATION_RAMP, VEGETATION_RAMP[1:]):
            span = b[0] - a[0]
            mixed = F.floor((F.lit(a[k]) * (F.lit(b[0]) - v) + F.lit(b[k]) * (v - F.lit(a[0])) + span // 2) / F.lit(span)).cast("int")
            c = F.when(v <= b[0], mixed) if c is None else c.when(v <= b[0], mixed)
        out.append(c)
    return tuple(out)


def stretch_byte(v: Column, low: Column, high: Column) -> Column:
    """Byte of a linear stretch; an empty range gives 128."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low).cast("double") / F.nullif((high - low).cast("double"), F.lit(0.0))))
    return F.when(low == high, F.lit(128)).otherwise(F.round(share * 255).cast("int"))


def band_view(bands: Column, view: str) -> Column:
    """Channels of a band array: `rgb` 1-2-3, `cir` 4-1-2, `nir` 4-4-4."""
    return F.array(*[F.element_at(bands, k) for k in {"rgb": (1, 2, 3), "cir": (4, 1, 2), "nir": (4, 4, 4)}[view]])


def item_period(item: Column) -> tuple[Column, Column]:
    """First and last day of a composite named like PRODUCT.AyyyyDDD.h..: 8 days (09A1) or 16 days (13Q1), ending with the year."""
    year, doy = F.substring(F.split_part(item, F.lit("."), F.lit(2)), 2, 4).cast("int"), F.substring(F.split_part(item, F.lit("."), F.lit(2)), 6, 3).cast("int")
    first = doy_to_date(year, doy)
    length = F.when(item.contains("13Q1"), 15).otherwise(7)
    return first, F.least(F.date_add(first, length), F.make_date(year, F.lit(12), F.lit(31)))


def item_cell(item: Column) -> tuple[Column, Column]:
    """Whole-degree longitude and latitude of the lower-left corner in names like N47E008."""
    lat, lon = F.regexp_extract(item, "([NS])([0-9]{2})", 2).cast("int"), F.regexp_extract(item, "([EW])([0-9]{3})", 2).cast("int")
    return F.when(F.regexp_extract(item, "([EW])[0-9]{3}", 1) == "W", -lon).otherwise(lon), F.when(F.regexp_extract(item, "([NS])[0-9]{2}", 1) == "S", -lat).otherwise(lat)


def in_cell(lon: Column, lat: Column, w: Column, s: Column, e: Column, n: Column, slack: float = 0.001) -> Column:
    """Whether a catalogue box stays within its whole-degree cell; half-pixel registration offsets are allowed for by `slack`."""
    return F.coalesce((w >= lon - slack) & (e <= lon + 1 + slack) & (s >= lat - slack) & (n <= lat + 1 + slack), F.lit(False))


def landsat_date(item: Column) -> Column:
    return F.try_to_date(F.split_part(item, F.lit("_"), F.lit(4)), "yyyyMMdd")
