"""Sources and sinks of catalogues, features, extracts, grids and tiles. Schemas are stated, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.sources.storage import written

STAC = """type string, numberReturned long, features array<struct<id: string, collection: string, bbox: array<double>,
properties: struct<datetime: string, start_datetime: string, end_datetime: string, `eo:cloud_cover`: double>, assets: map<string, struct<href: string, type: string, roles: array<string>>>>>"""
#: coordinates and geometries differ in depth by kind: they stay text here, and geometry_parts() takes them apart
FEATURE = "type string, id string, properties map<string, string>, geometry string, crs string"


def stac_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of FeatureCollection pages (one page a line, or a file each): page, pos, and the item's fields.

    A page without items has one row, whose `pos` and fields are null, so that checks of pages see it.
    """
    pages = spark.read.schema(STAC).option("mode", "FAILFAST").json(path).withColumn("page", F.concat_ws("@", F.col("_metadata.file_path"), F.sha2(F.to_json(F.struct("numberReturned", "features")), 256)))
    items = pages.select("page", "numberReturned", F.coalesce(F.size("features"), F.lit(0)).alias("returned"), F.posexplode_outer("features").alias("pos", "f"))
    return items.select("page", "numberReturned", "returned", "pos", "f.id", "f.collection", "f.bbox", F.col("f.properties.datetime").alias("datetime"), F.col("f.properties.`eo:cloud_cover`").alias("cloud"), "f.assets")


def page_items(items: DataFrame) -> DataFrame:
    """The items alone, without the rows that stand for empty pages."""
    return items.where("pos is not null")


def short_pages(items: DataFrame) -> DataFrame:
    """Pages that say they hold another number of items than they do: page, declared, rows."""
    return items.groupBy("page").agg(F.max("numberReturned").alias("declared"), F.max("returned").cast("bigint").alias("rows")).where("declared != rows")


def refused_items(items: DataFrame, collection: str) -> DataFrame:
    """Items by which a search is refused: of another collection, or with an id that is there twice. page, id, reason."""
    own = page_items(items)
    twice = own.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit(True).alias("_twice"))
    reason = F.when(~F.col("collection").eqNullSafe(F.lit(collection)), "foreign collection").when(F.col("_twice"), "duplicate id")
    return own.join(twice, "id", "left").select("page", "id", reason.alias("reason")).where("reason is not null")


def item_assets(items: DataFrame) -> DataFrame:
    """One row per asset, with whether it is a TIFF image."""
    a = items.select("id", F.explode(F.map_entries("assets")).alias("a")).select("id", F.col("a.key").alias("asset"), "a.value.*")
    media = F.lower(F.trim(F.split_part("type", F.lit(";"), F.lit(1))))
    return a.withColumn("eligible", F.coalesce(media.isin("image/tiff", "image/geotiff"), F.lit(False)))


def catalog_tree(links: DataFrame, root: str, max_levels: int = 64) -> DataFrame:
    """Items below a node with their chain of ancestors; links: parent, child, is_item. A URL found twice is kept once.

    A tree deeper than `max_levels` is an error.
    """
    level = links.where(F.col("parent") == root).select("child", "is_item", F.array(F.lit(root)).alias("chain"))
    found = None
    for _ in range(max_levels + 1):
        level = written(level, "tree")
        if not level.take(1):
            break
        items = level.where("is_item").select(F.col("child").alias("url"), "chain")
        found = items if found is None else found.unionByName(items)
        up = level.where("not is_item").select(F.col("child").alias("parent"), F.array_append("chain", F.col("child")).alias("chain"))
        level = links.join(up, "parent").select("child", "is_item", "chain").where(~F.array_contains("chain", F.col("child")))
    else:
        raise ValueError("the catalogue is deeper than max_levels")
    if found is None:
        return level.select(F.col("child").alias("url"), "chain")
    return found.groupBy("url").agg(F.min("chain").alias("chain"))


#: depth of the arrays around the positions of a geometry of each kind
KINDS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
_POSITIONS = ["array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"]
_GEOMETRY = "struct<type: string, coordinates: string, geometries: array<string>, crs: string>"


def _coordinates(text: Column, kind: str) -> Column:
    """Coordinates as lists (of parts) of lines of positions; null where the text has another shape."""
    depth = KINDS[kind]
    # from_json has no top-level scalars: an object around the text
    made = F.from_json(F.concat(F.lit('{"c":'), text, F.lit("}")), f"struct<c: {_POSITIONS[depth]}>", {"mode": "PERMISSIVE"})["c"]
    for _ in range(3 - depth):
        made = F.when(made.isNotNull(), F.array(made))
    return made


def geometry_valid(kind: Column, coordinates: Column) -> Column:
    """Whether a simple geometry's coordinates (a text) have the shape and the values of its kind.

    Positions have two or three finite numbers within WGS84 range, lines two positions, rings four and a closing one; empty
    coordinates are valid.
    """
    good = lambda p: F.size(p).between(2, 3) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x)) & p[0].between(-180, 180) & p[1].between(-90, 90)
    position = lambda p: (F.size(p) == 0) | good(p)

    def shaped(name: str) -> Column:
        least, ring = 4 if name.endswith("Polygon") else 2 if name.endswith("LineString") else 0, name.endswith("Polygon")

        def line(r: Column) -> Column:
            closed = (F.element_at(r, 1) == F.element_at(r, -1)) if ring else F.lit(True)
            return F.when(F.size(r) == 0, True).otherwise((F.size(r) >= least) & closed & F.forall(r, position))

        return F.forall(_coordinates(coordinates, name), lambda part: F.forall(part, line))

    out = F.lit(False)
    for name in KINDS:
        out = F.when(kind == name, F.regexp_replace(coordinates, r"\s", "").isin("[]") | F.coalesce(shaped(name), F.lit(False))).otherwise(out)
    return out


def geometry_parts(features: DataFrame, key: str = "_feature", depth: int = 8) -> DataFrame:
    """Simple geometries of features: `key`, `kind`, `coordinates` (text), `ok`.

    GeometryCollections are taken apart level by level; one nested deeper than `depth`, an unknown type or a geometry with a
    crs of its own gives a row that is not ok. A null geometry and an empty collection have no row.
    """
    level, out = features.select(key, F.col("geometry").alias("g")).where("g is not null and g <> 'null'"), None
    for k in range(depth + 2):
        g = level.select(key, F.from_json("g", _GEOMETRY).alias("g"))
        collection = F.coalesce(F.col("g.type") == "GeometryCollection", F.lit(False)) & F.col("g.crs").isNull()
        g = g.withColumn("_parts", F.when(collection, F.col("g.geometries")))
        whole = F.col("_parts").isNull() if k <= depth else F.lit(True)
        sound = F.lit(False) if k > depth else F.col("g.crs").isNull() & ~collection & geometry_valid(F.col("g.type"), F.col("g.coordinates"))
        rows = g.where(whole).select(key, F.col("g.type").alias("kind"), F.col("g.coordinates").alias("coordinates"), F.coalesce(sound, F.lit(False)).alias("ok"))
        out = rows if out is None else out.unionByName(rows)
        level = written(g.where("_parts is not null").select(key, F.explode("_parts").alias("g")), "geometries") if k <= depth else None
        if level is None or not level.take(1):
            return out


def with_validity(features: DataFrame) -> DataFrame:
    """Features with `valid`: a Feature without a crs of its own whose geometries, null or of any kind, are all valid."""
    rows = written(features.withColumn("_feature", F.monotonically_increasing_id()), "features")
    bad = geometry_parts(rows).where("not ok").select("_feature", F.lit(True).alias("_bad")).distinct()
    head = F.coalesce(F.col("type") == "Feature", F.lit(False)) & F.col("crs").isNull()
    return rows.join(bad, "_feature", "left").withColumn("valid", head & F.col("_bad").isNull()).drop("_feature", "_bad", "crs")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features (one a line) with `valid`; `geometry` is the text of a geometry of any kind."""
    return with_validity(spark.read.schema(FEATURE).json(path))


def geojsonl_gz(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited features, gzip or not; a line that is no feature fails the load."""
    f = spark.read.text(path).select(F.from_json("value", FEATURE).alias("f"))
    ok = F.coalesce(F.col("f.type") == "Feature", F.lit(False))
    return f.select(F.when(ok, F.col("f")).otherwise(F.raise_error(F.lit("a line is not a feature")).cast(f.schema["f"].dataType)).alias("f")).select("f.*").drop("crs")


def geoparquet(spark: SparkSession, path: str, box: tuple) -> DataFrame:
    """Rows whose publisher box meets `box`, with the digest of their geometry; nested bounds are pushed down to the scan."""
    d = spark.read.parquet(path).where((F.col("bbox.xmin") <= box[2]) & (F.col("bbox.xmax") >= box[0]) & (F.col("bbox.ymin") <= box[3]) & (F.col("bbox.ymax") >= box[1]))
    return d.withColumn("sha256", F.sha2("geometry", 256))


def osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of an extract."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    tags = "array<struct<_k: string, _v: string>>"
    nodes = read("node", f"_id long, _lat double, _lon double, tag {tags}")
    ways = read("way", f"_id long, nd array<struct<_ref: long>>, tag {tags}")
    relations = read("relation", f"_id long, member array<struct<_type: string, _ref: long, _role: string>>, tag {tags}")
    as_map = F.map_from_entries(F.coalesce("tag", F.array().cast(tags)))
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role")))
    return (
        nodes.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), as_map.alias("tags")),
        ways.select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), as_map.alias("tags")),
        relations.select(F.col("_id").alias("id"), members.alias("members"), as_map.alias("tags")),
    )


def osm_missing(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """What an extract refers to and does not hold: owner (type and id), type, ref."""
    refs = ways.select(F.concat(F.lit("way/"), "id").alias("owner"), F.lit("node").alias("type"), F.explode("refs").alias("ref"))
    members = relations.select(F.concat(F.lit("relation/"), "id").alias("owner"), F.explode("members").alias("m")).select("owner", "m.type", "m.ref")
    there = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref"))
    for kind, rows in (("way", ways), ("relation", relations)):
        there = there.unionByName(rows.select(F.lit(kind).alias("type"), F.col("id").alias("ref")))
    return refs.unionByName(members).join(there, ["type", "ref"], "left_anti").select("owner", "type", "ref")


def package_index(spark: SparkSession, path: str) -> DataFrame:
    """Publisher index (Location, QuadKey, Url, Size) with `reason` for a bad row: quadkey, url or repeated."""
    d = spark.read.schema("Location string, QuadKey string, Url string, Size string").option("header", True).csv(path)
    twice = d.groupBy("Location", "QuadKey").agg(F.count("*").alias("_n"))
    reason = F.when(~F.col("QuadKey").rlike("^[0-3]{9}$"), "quadkey").when(~F.col("Url").rlike("^https://"), "url").when(F.col("_n") > 1, "repeated")
    return d.join(twice, ["Location", "QuadKey"]).select("Location", "QuadKey", "Url", "Size", reason.alias("reason"))


#: pixels of a strip
STRIP = 100_000


def hgt_grid(files: DataFrame, side: int) -> DataFrame:
    """Big-endian 16-bit height grids (path, content) -> pixels (path, x, y, height); -32768 is void (null)."""

    cells = side * side

    def made(paths: pa.Array, values: np.ndarray, top: int) -> pa.RecordBatch:
        """Rows of as many grids as there are paths, or of a strip of one that begins at row `top`."""
        each = len(values) // len(paths)
        y, x = np.divmod(np.arange(each, dtype=np.int32), np.int32(side))
        height = values.astype(np.int32)
        columns = [paths.take(pa.array(np.repeat(np.arange(len(paths)), each))), pa.array(np.tile(x, len(paths))), pa.array(np.tile(y + np.int32(top), len(paths))), pa.array(height, mask=height == -32768)]
        return pa.RecordBatch.from_arrays(columns, ["path", "x", "y", "height"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, contents = b.column("path"), b.column("content").to_pylist()
            for k, content in enumerate(contents):
                if content is None or len(content) != 2 * cells:
                    raise ValueError(f"{paths[k]} is not a grid of side {side}")
            several = max(1, STRIP // cells)  # small files share a batch
            for k in range(0, len(contents), several):
                values = np.frombuffer(b"".join(contents[k : k + several]), ">i2")
                if cells <= STRIP:
                    yield made(paths.slice(k, several), values, 0)
                    continue
                rows = max(1, STRIP // side)
                for top in range(0, side, rows):  # strips of rows, so that a large file is never one frame
                    yield made(paths.slice(k, 1), values[top * side : (top + rows) * side], top)

    return files.select("path", "content").mapInArrow(run, "path string, x int, y int, height int")


def tile_rows(rows: DataFrame) -> DataFrame:
    """Rows (z, tile_column, tms_row, data) -> tiles with y from the top; `repeated` marks addresses given twice, `outside` those beyond their level."""
    d = rows.withColumn("y", F.pow(F.lit(2), "z").cast("bigint") - 1 - F.col("tms_row"))
    side = F.pow(F.lit(2), "z").cast("bigint")
    outside = ~(F.col("tile_column").between(0, side - 1) & F.col("y").between(0, side - 1))
    return d.groupBy("z", F.col("tile_column").alias("x"), "y").agg(F.min("data").alias("data"), (F.count("*") > 1).alias("repeated"), F.bool_or(outside).alias("outside"))


def tile_package_faults(tiles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Why a package of tiles (z, width, height, format) is refused: check, found. metadata: name, value.

    All tiles have one size and one format, `format` names it, and `minzoom` and `maxzoom`, where given, are the levels there are.
    """
    stated = metadata.groupBy().agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(f"_{k}") for k in ("format", "minzoom", "maxzoom")])
    found = tiles.groupBy().agg(
        F.count("*").alias("n"), F.min(F.struct("width", "height")).alias("small"), F.max(F.struct("width", "height")).alias("large"),
        F.min("format").alias("f0"), F.max("format").alias("f1"), F.min("z").alias("z0"), F.max("z").alias("z1"),
    )
    j = found.crossJoin(stated)  # one row each
    same = lambda a, b: F.coalesce(a.cast("string") == b, F.lit(True))
    checks = [
        ("empty", F.col("n") > 0, F.col("n")),
        ("size", F.col("small") == F.col("large"), F.to_json("large")),
        ("mixed format", F.col("f0") == F.col("f1"), F.col("f1")),
        ("format", same(F.col("f0"), F.col("_format")), F.col("f0")),
        ("minzoom", same(F.col("z0"), F.col("_minzoom")), F.col("z0")),
        ("maxzoom", same(F.col("z1"), F.col("_maxzoom")), F.col("z1")),
    ]
    faults = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(k).alias("check"), shown.cast("string").alias("found"))) for k, ok, shown in checks])
    return j.select(F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("f")).select("f.*")


def write_boundaries(units: DataFrame, key: str, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write feature files by country, and return the manifest, read from the written files: one row a file.

    key, file, features, bytes, sha256 of the file. A country is dealt over as many files as it has blocks of `rows_per_file` rows.
    """
    counts = units.groupBy(key).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    rest = [c for c in units.columns if c != key]
    salted = units.join(counts, key).withColumn("_salt", F.pmod(F.xxhash64(*rest), F.col("_files")))
    # rows stand in the order of their columns, so that equal rows give equal files
    salted.repartition(key, "_salt").sortWithinPartitions(key, "_salt", *rest).drop("_salt", "_files").write.partitionBy(key).json(path)
    files = units.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    name = F.url_decode(F.regexp_extract("path", f"/{key}=([^/]*)/", 1))
    lines = F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))
    return files.select(name.alias(key), F.col("path").alias("file"), lines.cast("bigint").alias("features"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_blocks(px: DataFrame, value: str, path: str, rows_per_block: int) -> DataFrame:
    """Write an output grid as ordered row blocks (one row each: block, y-x-ordered values) and read it back."""
    d = px.withColumn("block", F.floor(F.col("y") / rows_per_block).cast("int"))
    blocks = d.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v")))), lambda p: p["v"]).alias("values"))
    blocks.write.parquet(path)
    return px.sparkSession.read.schema(blocks.schema).parquet(path).withColumn("digest", F.sha2(F.array_join(F.transform("values", lambda x: x.cast("string")), ",", "-").cast("binary"), 256))
