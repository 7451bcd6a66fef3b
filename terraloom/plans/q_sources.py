"""Queries of sources, sinks and streams. Files are first derived from the given tables, then read by the source."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from terraloom.plans.registry import query
from terraloom.sources import collections as Sc
from terraloom.sources import readers as S
from terraloom.sources.storage import shared_path
from terraloom.streaming import operators as St
from terraloom.streaming import stateful as Sf

C = F.col
NOW = dt.datetime(2024, 1, 20)


def _stac(v):
    asset = lambda kind: F.struct(F.concat(F.lit("http://h/"), C("item_id")).alias("href"), F.lit(kind).alias("type"), F.array(F.lit("data")).alias("roles"))
    props = F.struct(F.date_format("dt", "yyyy-MM-dd'T'00:00:00'Z'").alias("datetime"), C("cloud").alias("eo:cloud_cover"))
    f = F.struct(C("item_id").alias("id"), C("collection_id").alias("collection"), F.array("w", "s", "e", "n").alias("bbox"), props.alias("properties"), F.create_map(F.lit("b1"), asset("image/tiff; application=geotiff"), F.lit("meta"), asset("application/json")).alias("assets"))
    pages = v.item.groupBy((C("o") % 400).alias("p")).agg(F.collect_list(f).alias("features"))
    path = shared_path(v.spark, "stac")
    pages = pages.select(F.lit("FeatureCollection").alias("type"), (F.size("features") + F.when(C("p") == 7, 1).otherwise(0)).alias("numberReturned"), "features")
    empty = v.spark.range(2).select(F.lit("FeatureCollection").alias("type"), (C("id") * 5).cast("int").alias("numberReturned"), F.array().cast(pages.schema["features"].dataType).alias("features"))
    pages.unionByName(empty).write.json(path)  # two pages without items, one of which says that it has five
    return S.stac_pages(v.spark, path)


@query("""SELECT item_id AS id, collection_id AS collection, w, cloud, strftime(dt, '%Y-%m-%dT00:00:00Z') AS datetime, o % 400 = 7 AS short FROM item
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, k = 1 FROM (SELECT unnest([0, 1]) AS k) t""")
def src_stac_pages(v):
    items = _stac(v)
    bad = S.short_pages(items).select("page", F.lit(True).alias("short"))
    return items.join(bad, "page", "left").select("id", "collection", C("bbox")[0].alias("w"), "cloud", "datetime", F.coalesce("short", F.lit(False)).alias("short"))


@query("SELECT item_id AS id, CASE WHEN collection_id <> '1-URGENT' THEN 'foreign collection' ELSE 'duplicate id' END AS reason, count(*) AS n FROM (SELECT * FROM item UNION ALL SELECT * FROM item WHERE o % 9 = 0) t WHERE collection_id <> '1-URGENT' OR o % 9 = 0 GROUP BY ALL")
def src_stac_refused(v):
    items = _stac(v)
    again = items.where("cast(substring(id, 2) as bigint) % 9 = 0")
    return S.refused_items(items.unionByName(again), "1-URGENT").groupBy("id", "reason").agg(F.count("*").alias("n"))


@query("SELECT item_id AS id, a AS asset, a = 'b1' AS eligible FROM item, (SELECT unnest(['b1', 'meta']) AS a) t")
def src_item_assets(v):
    return S.item_assets(S.page_items(_stac(v))).select("id", "asset", "eligible")


@query("SELECT concat('http://c/', CAST(p_partkey AS INT)) AS url, CASE WHEN p_partkey // 8 % 3 = 1 THEN 3 ELSE 2 END AS depth FROM part WHERE p_partkey // 8 % 3 <> 2")
def src_catalog_tree(v):
    p = C("p_partkey").cast("bigint")
    group = F.floor(p / 8)
    node = F.concat(F.lit("n"), group.cast("string"))
    items = v.part.select(node.alias("parent"), F.concat(F.lit("http://c/"), p.cast("string")).alias("child"), F.lit(True).alias("is_item"))
    top = v.part.where(group % 3 == 0).select(F.lit("root").alias("parent"), node.alias("child"), F.lit(False).alias("is_item")).distinct()
    sub = v.part.where(group % 3 == 1).select(F.concat(F.lit("n"), (group - 1).cast("string")).alias("parent"), node.alias("child"), F.lit(False).alias("is_item")).distinct()
    return S.catalog_tree(items.unionByName(top).unionByName(sub), "root").select("url", F.size("chain").alias("depth"))


def _feature(v, name, gz=False):
    """A feature a part: by the part's number one of the geometries below, moved by (x, y), some of them faulty."""
    p = C("p_partkey").cast("bigint")
    x, y = (p % 50).cast("double"), (F.floor(p / 50) % 80).cast("double")
    at = lambda dx, dy: F.format_string("[%.1f,%.1f]", x + dx, y + dy)
    lines = lambda *points: F.concat(F.lit("["), F.concat_ws(",", *points), F.lit("]"))
    ring, open_ring = lines(at(0, 0), at(1, 0), at(1, 1), at(0, 0)), lines(at(0, 0), at(1, 0), at(1, 1), at(9, 0))
    shape = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), c, F.lit("}"))
    both = lambda *g: F.concat(F.lit('{"type":"GeometryCollection","geometries":'), lines(*g), F.lit("}"))
    kinds = [
        shape("Polygon", lines(ring)), shape("Polygon", lines(open_ring)), shape("Point", at(0, 0)), shape("LineString", lines(at(0, 0), at(1, 1))), shape("LineString", lines(at(0, 0))),
        shape("MultiPoint", lines(at(0, 0), at(2, 2))), shape("MultiLineString", lines(lines(at(0, 0), at(1, 1)))), shape("MultiPolygon", lines(lines(ring), lines(ring))), shape("MultiPolygon", lines(lines(open_ring))),
        both(shape("Point", at(0, 0)), shape("Polygon", lines(ring))), both(shape("Point", at(0, 0)), both(shape("LineString", lines(at(0, 0))))), shape("Point", at(500, 0)), F.lit("null"), shape("Circle", at(0, 0)), shape("Point", F.lit("[]")), shape("Polygon", at(0, 0)),
    ]
    geometry = F.element_at(F.array(*kinds), (p % len(kinds) + 1).cast("int"))
    line = F.concat(F.lit('{"type":"Feature","id":'), p.cast("string"), F.lit(',"properties":'), F.to_json(F.struct(C("p_name").alias("name"))), F.lit(',"geometry":'), geometry, F.lit("}"))
    path = shared_path(v.spark, name)
    v.part.select(line.alias("value")).write.option("compression", "gzip" if gz else "none").text(path)
    return path


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, p_partkey % 16 NOT IN (1, 4, 8, 10, 11, 13, 15) AS valid FROM part")
def src_geojson(v):
    return S.geojson(v.spark, _feature(v, "geojson")).select(C("id").cast("bigint").alias("id"), C("properties")["name"].alias("name"), "valid")


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, p_partkey % 16 NOT IN (1, 4, 8, 10, 11, 13, 15) AS valid FROM part")
def src_feature_collection(v):
    lines = v.spark.read.text(_feature(v, "features"))
    # one document: its head and foot are lines of their own, files in the order of the parts
    file = F.pmod(F.xxhash64("value"), F.lit(4)).cast("string")
    one = lines.select(file.alias("file"), F.array_join(F.array("value"), "").alias("value"))
    whole = one.groupBy("file").agg(F.concat(F.lit('{"type":"FeatureCollection","bbox":[0,0,1,1],"crs":{"name":"a \\"}]["},"other":[{"type":"Feature"}],\n "features" : ['), F.array_join(F.collect_list("value"), ",\n"), F.lit('],"last":[{"id":5}]}')).alias("value"))
    path = shared_path(v.spark, "collection")
    whole.select("value").write.text(path)
    return Sc.feature_collection(v.spark, path).select(C("id").cast("bigint").alias("id"), C("properties")["name"].alias("name"), "valid")


@query("""SELECT kind, ok, count(*) AS n FROM (SELECT unnest(CASE p_partkey % 16 WHEN 0 THEN [('Polygon', TRUE)] WHEN 1 THEN [('Polygon', FALSE)] WHEN 2 THEN [('Point', TRUE)] WHEN 3 THEN [('LineString', TRUE)] WHEN 4 THEN [('LineString', FALSE)] WHEN 5 THEN [('MultiPoint', TRUE)]
WHEN 6 THEN [('MultiLineString', TRUE)] WHEN 7 THEN [('MultiPolygon', TRUE)] WHEN 8 THEN [('MultiPolygon', FALSE)] WHEN 9 THEN [('Point', TRUE), ('Polygon', TRUE)] WHEN 10 THEN [('Point', TRUE), ('LineString', FALSE)] WHEN 11 THEN [('Point', FALSE)] WHEN 12 THEN []
WHEN 13 THEN [('Circle', FALSE)] WHEN 14 THEN [('Point', TRUE)] ELSE [('Polygon', FALSE)] END) AS g FROM part) t, LATERAL (SELECT g[1] AS kind, g[2] AS ok) u GROUP BY ALL""")
def src_geojson_parts(v):
    rows = S.geojson(v.spark, _feature(v, "geojson-parts")).withColumnRenamed("id", "_feature")
    return S.geometry_parts(rows).groupBy("kind", "ok").agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CASE p_partkey % 16 WHEN 2 THEN CAST(p_partkey % 50 AS DOUBLE) WHEN 11 THEN CAST(p_partkey % 50 + 500 AS DOUBLE) END AS x FROM part")
def src_geojsonl_gz(v):
    point = F.when(F.get_json_object("geometry", "$.type") == "Point", F.get_json_object("geometry", "$.coordinates[0]").cast("double"))
    return S.geojsonl_gz(v.spark, _feature(v, "geojsonl", True)).select(C("id").cast("bigint").alias("id"), C("properties")["name"].alias("name"), point.alias("x"))


@query("SELECT item_id, sha256(item_id) AS sha256 FROM item WHERE w <= 20 AND e >= 0 AND s <= 20 AND n >= 0")
def src_geoparquet(v):
    path = shared_path(v.spark, "geoparquet")
    v.item.select("item_id", C("item_id").cast("binary").alias("geometry"), F.struct(C("w").alias("xmin"), C("e").alias("xmax"), C("s").alias("ymin"), C("n").alias("ymax")).alias("bbox")).write.parquet(path)
    return S.geoparquet(v.spark, path, (0.0, 0.0, 20.0, 20.0)).select("item_id", "sha256")


def _osm(v):
    c, p, r = C("c_custkey").cast("bigint"), C("p_partkey").cast("bigint"), C("s_suppkey").cast("bigint")
    tag = lambda ok, value: F.when(ok, F.array(F.struct(F.lit("building").alias("_k"), F.lit(value).alias("_v"))))
    path = shared_path(v.spark, "osm")
    save = lambda d, row: d.write.format("xml").option("rootTag", "osm").option("rowTag", row).save(f"{path}/{row}")
    save(v.customer.select(c.alias("_id"), (c % 90).cast("double").alias("_lat"), (c % 180).cast("double").alias("_lon"), tag(c % 3 == 0, "yes").alias("tag")), "node")
    save(v.part.select(p.alias("_id"), F.array(F.struct(p.alias("_ref")), F.struct((p + 1).alias("_ref"))).alias("nd"), tag(p % 4 == 0, "no").alias("tag")), "way")
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("_type"), ref.alias("_ref"), F.lit(role).alias("_role"))
    save(v.supplier.select(r.alias("_id"), F.array(member("way", r, "outer"), member("node", r + 1, ""), member("relation", r + 1, "inner")).alias("member"), tag(r % 2 == 0, "yes").alias("tag")), "relation")
    return S.osm_xml(v.spark, path + "/*")


@query("""SELECT 'node' AS kind, CAST(c_custkey AS BIGINT) AS id, 1 AS size, CASE WHEN c_custkey % 3 = 0 THEN 'yes' END AS building, NULL AS roles FROM customer UNION ALL SELECT 'way', CAST(p_partkey AS BIGINT), 2, CASE WHEN p_partkey % 4 = 0 THEN 'no' END, NULL FROM part
UNION ALL SELECT 'relation', CAST(s_suppkey AS BIGINT), 3, CASE WHEN s_suppkey % 2 = 0 THEN 'yes' END, 'way:outer,node:,relation:inner' FROM supplier""")
def src_osm_xml(v):
    nodes, ways, relations = _osm(v)
    roles = F.array_join(F.transform("members", lambda m: F.concat(m["type"], F.lit(":"), m["role"])), ",")
    kind = lambda d, k, n, r: d.select(F.lit(k).alias("kind"), "id", n.cast("int").alias("size"), C("tags")["building"].alias("building"), r.alias("roles"))
    none = F.lit(None).cast("string")
    return kind(nodes, "node", F.lit(1), none).unionByName(kind(ways, "way", F.size("refs"), none)).unionByName(kind(relations, "relation", F.size("members"), roles))


@query("""WITH w AS (SELECT concat('way/', CAST(p_partkey AS BIGINT)) AS owner, 'node' AS type, unnest([CAST(p_partkey AS BIGINT), CAST(p_partkey + 1 AS BIGINT)]) AS ref FROM part),
r AS (SELECT concat('relation/', CAST(s_suppkey AS BIGINT)) AS owner, unnest(['way', 'node', 'relation']) AS type, unnest([CAST(s_suppkey AS BIGINT), CAST(s_suppkey + 1 AS BIGINT), CAST(s_suppkey + 1 AS BIGINT)]) AS ref FROM supplier)
SELECT * FROM (SELECT * FROM w UNION ALL SELECT * FROM r) t WHERE NOT CASE type WHEN 'node' THEN ref IN (SELECT c_custkey FROM customer) WHEN 'way' THEN ref IN (SELECT p_partkey FROM part) ELSE ref IN (SELECT s_suppkey FROM supplier) END""")
def src_osm_missing(v):
    return S.osm_missing(*_osm(v))


@query("SELECT coalesce(CASE WHEN id % 9 = 0 THEN 'quadkey' WHEN id % 7 = 0 THEN 'url' WHEN id % 10 = 5 THEN 'repeated' END, 'ok') AS reason, CAST(sum(CASE WHEN id % 10 = 5 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM site GROUP BY 1")
def src_package_index(v):
    i = C("id")
    row = v.site.select(C("name").alias("Location"), F.when(i % 9 == 0, "9").otherwise(F.lpad(F.conv(i.cast("string"), 10, 4), 9, "0")).alias("QuadKey"), F.when(i % 7 == 0, "ftp://x").otherwise("https://x").alias("Url"), F.lit("1KB").alias("Size"), i)
    path = shared_path(v.spark, "index")
    row.unionByName(row.where("id % 10 = 5")).drop("id").write.option("header", True).csv(path)
    return S.package_index(v.spark, path).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT 6 AS z, CAST(p_partkey % 64 AS BIGINT) AS x, 63 - CAST(p_partkey // 64 % 70 AS BIGINT) AS y, count(*) > 1 AS repeated, p_partkey // 64 % 70 > 63 AS outside FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 50 = 0) t GROUP BY 1, 2, 3, 5")
def src_tile_rows(v):
    p = C("p_partkey").cast("bigint")
    row = v.part.select(F.lit(6).alias("z"), (p % 64).alias("tile_column"), (F.floor(p / 64) % 70).alias("tms_row"), C("p_name").alias("data"), p.alias("p"))
    return S.tile_rows(row.unionByName(row.where("p % 50 = 0"))).select("z", "x", "y", "repeated", "outside")


@query("SELECT unnest(['size', 'mixed format', 'format', 'maxzoom']) AS check, unnest([concat('{\"width\":512,\"height\":', CAST(max(256 + p_partkey % 2) AS INT), '}'), 'webp', 'png', CAST(max(p_partkey % 5) AS VARCHAR)]) AS found FROM part")
def src_tile_package(v):
    p = C("p_partkey").cast("bigint")
    tiles = v.part.select((p % 5).alias("z"), F.when(p % 11 == 0, 512).otherwise(256).alias("width"), F.when(p % 11 == 0, (256 + p % 2)).otherwise(256).alias("height"), F.when(p % 3 == 0, "webp").otherwise("png").alias("format"))
    stated = v.spark.createDataFrame([("format", "jpg"), ("minzoom", "0"), ("maxzoom", "9")], "name string, value string")
    return S.tile_package_faults(tiles, stated)


@query("""SELECT CAST(country AS VARCHAR) AS country, count(*) AS features, CAST(sum(strlen(line)) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY id)) AS sha256
FROM (SELECT *, concat('{"id":', CAST(id AS VARCHAR), ',"name":"', name, '"}', chr(10)) AS line FROM site) t GROUP BY country""")
def sink_partitioned_boundaries(v):
    path = shared_path(v.spark, "boundaries")
    return S.write_boundaries(v.site.select("country", "id", "name"), "country", path).select("country", "features", "bytes", "sha256")


@query("WITH m AS (SELECT x, y, coalesce(arg_max(red, scene) FILTER (WHERE red <> 0), 0) AS value FROM px GROUP BY x, y) SELECT CAST(y // 4 AS INT) AS block, CAST(count(*) AS INT) AS n, sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY y, x)) AS digest FROM m GROUP BY 1")
def sink_mosaic_blocks(v):
    from terraloom.operators.mosaic import mosaic_newest

    m = mosaic_newest(v.px, "red", C("red") != 0, ["scene"], fill=0)
    return S.write_blocks(m, "value", shared_path(v.spark, "blocks"), 4).select("block", F.size("values").alias("n"), "digest")


# --- streams


def _stream(v):
    return St.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet", v.events.schema)


@query("SELECT event_id FROM events")
def sink_event_append(v):
    path = shared_path(v.spark, "appended")
    twice = _stream(v).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("_k"), "*").drop("_k")
    St.append_events(twice, path)
    St.append_events(_stream(v), path)
    return v.spark.read.parquet(path).select("event_id")


@query("SELECT event_id, event_type FROM events")
def st_event_dedup(v):
    twice = _stream(v).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("_k"), "*").drop("_k")
    return St.drain(St.dedup(twice).select("event_id", "event_type"), "dedup")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2024-02-10 00:05:00'")
def st_late_future(v):
    return St.drain(St.timely(_stream(v), F.lit(dt.datetime(2024, 2, 10))).select("event_id"), "timely")


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-04-20 11:30:00' - INTERVAL 90 DAY")
def st_retention(v):
    path = shared_path(v.spark, "kept")
    St.keep_events(_stream(v), path, dt.datetime(2024, 4, 20, 11, 30))
    return v.spark.read.parquet(path).select("event_id", "day")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_daily_counts(v):
    return St.drain(St.daily_counts(_stream(v)), "daily", "complete")


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, greatest(count(*) - 1, 0) AS refused FROM events GROUP BY 1, 2")
def st_rate_limit(v):
    return St.drain(St.minute_limit(_stream(v), 1), "minute", "update", ["user_id", "minute"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, ts AS begin, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts - w.begin >= INTERVAL 1 DAY THEN e.ts ELSE w.begin END, CASE WHEN e.ts - w.begin >= INTERVAL 1 DAY THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, n > 2 AS refused FROM w""")
def st_rate_limit_anchored(v):
    return St.drain(St.anchored_limit(_stream(v), 2, 86400), "anchored")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) * 0.95::DOUBLE AS low, count(DISTINCT user_id) * 1.05::DOUBLE AS high, TRUE AS near FROM events GROUP BY 1")
def st_sessions(v):
    d = St.drain(St.sessions(_stream(v)), "sessions", "complete")
    exact = v.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("_u"))
    low, high = (C("_u") * 0.95), (C("_u") * 1.05)  # the count of users is approximate, within a twentieth
    return d.join(exact, "day").select("day", "n", low.alias("low"), high.alias("high"), C("users").between(low, high).alias("near"))


@query("SELECT user_id AS monitor, count(DISTINCT event_id % 50) AS found, array_to_string(list_sort(list(DISTINCT event_id % 50))[:20], ',') AS items FROM events GROUP BY 1")
def st_new_items(v):
    d = _stream(v).select(C("user_id").alias("monitor"), (C("event_id") % 50).alias("item_id"), "ts")
    return St.new_items(d, "new").select("monitor", "found", F.array_join("items", ",").alias("items"))


def _polls(v):
    return _stream(v).select(C("user_id").alias("job_id"), C("event_id").alias("seq"), C("ts").alias("at"), F.when(C("event_type") == "signup", "queued").otherwise("running").alias("status"), F.floor(C("event_id") * 977 % 100000 / 20000).alias("bytes"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id AS seq, epoch_us(ts) / 1000.0::DOUBLE AS ms, CASE WHEN event_type = 'signup' THEN 'queued' ELSE 'running' END AS status, (event_id * 977 % 100000) // 20000 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT job_id, seq, i, ms, status, bytes, ms AS moved, 0.0::DOUBLE AS idle, NULL::DOUBLE AS rate FROM e WHERE i = 1
UNION ALL SELECT job_id, seq, i, ms, status, bytes, moved, idle, CASE WHEN status <> 'running' THEN NULL WHEN going AND bytes > pb AND ms > pms THEN (bytes - pb) * 1000 / (ms - pms) WHEN going AND idle < 5000 THEN prate END
FROM (SELECT *, CASE WHEN status = 'running' THEN greatest(0, ms - moved) ELSE 0 END AS idle FROM (SELECT *, CASE WHEN NOT going OR bytes > pb THEN ms ELSE pmoved END AS moved
FROM (SELECT e.job_id, e.seq, e.i, e.ms, e.status, e.bytes, w.bytes AS pb, w.ms AS pms, w.moved AS pmoved, w.rate AS prate, e.status = 'running' AND w.status = 'running' AND e.bytes >= w.bytes AS going FROM w JOIN e ON e.job_id = w.job_id AND e.i = w.i + 1) x) y) z)
SELECT job_id, seq, round(idle, 3) AS idle_ms, round(rate, 9) AS rate FROM w""")
def st_download_progress(v):
    return St.drain(St.download_progress(_polls(v)), "progress").select("job_id", "seq", F.round("idle_ms", 3).alias("idle_ms"), F.round("rate", 9).alias("rate"))


@query("""WITH l AS (SELECT user_id AS job_id, arg_max(event_type, event_id) AS last, arg_max(ts, event_id) AS seen FROM events GROUP BY 1), m AS (SELECT date_trunc('milliseconds', max(ts)) AS t FROM events)
SELECT job_id, 'released' AS outcome, 0 AS charged FROM l, m WHERE last <> 'signup' AND date_trunc('milliseconds', seen) + INTERVAL 12 HOUR <= t""")
def st_lease_timeout(v):
    return St.drain(Sf.lease_releases(_polls(v).select("job_id", "seq", "at", "status")), "leases", large_state=True)


@query("""SELECT job_id, 'released' AS outcome, 0 AS charged FROM poll GROUP BY job_id HAVING arg_max(status, seq) = 'running' AND arg_max("at", seq) + INTERVAL 12 HOUR <= TIMESTAMP '2024-01-31'""")
def st_lease_timeout_batch(v):
    return St.expired_leases(v.poll, F.lit(dt.datetime(2024, 1, 31)), "12 hours")


_LEDGER = """SELECT event_id // 3 AS execution, event_id AS seq, ts, CASE event_id % 3 WHEN 0 THEN 'reserve' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'consume' ELSE 'release' END ELSE 'consume' END AS kind, event_id * 641 % 1000 AS micros FROM events WHERE NOT (event_id % 3 > 0 AND event_id % 11 < 3)"""


@query(f"""WITH l AS ({_LEDGER}), f AS (SELECT execution, arg_min(kind, seq) AS kind, arg_min(micros, seq) AS micros FROM l WHERE kind <> 'reserve' GROUP BY 1), m AS (SELECT date_trunc('milliseconds', max(ts)) AS t FROM l)
SELECT r.execution, r.micros AS reserved, coalesce(f.kind, 'expired') AS outcome, CASE f.kind WHEN 'consume' THEN least(f.micros, r.micros) ELSE 0 END AS charged FROM (SELECT * FROM l WHERE kind = 'reserve') r LEFT JOIN f USING (execution), m
WHERE f.kind IS NOT NULL OR date_trunc('milliseconds', r.ts) + INTERVAL 1 HOUR < t""")
def st_reserve_settle(v):
    e = C("event_id")
    d = _stream(v).where("not (event_id % 3 > 0 and event_id % 11 < 3)").select(F.floor(e / 3).alias("execution"), e.alias("seq"), "ts", F.when(e % 3 == 0, "reserve").when((e % 3 == 1) & (e % 2 == 1), "release").otherwise("consume").alias("kind"), (e * 641 % 1000).alias("micros"))
    return St.drain(St.settlements(d), "settled")


@query("""WITH l AS (SELECT id // 3 AS execution, id AS seq, CASE id % 3 WHEN 0 THEN 'reserve' WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'consume' ELSE 'release' END ELSE 'consume' END AS kind, received AS micros FROM job WHERE NOT (id % 3 > 0 AND id % 11 < 3)),
f AS (SELECT execution, arg_min(kind, seq) AS kind, arg_min(micros, seq) AS micros FROM l WHERE kind <> 'reserve' GROUP BY 1) SELECT r.execution, r.micros AS reserved, coalesce(f.kind, 'open') AS outcome, CASE f.kind WHEN 'consume' THEN least(f.micros, r.micros) WHEN 'release' THEN 0 END AS charged FROM (SELECT * FROM l WHERE kind = 'reserve') r LEFT JOIN f USING (execution)""")
def st_reserve_settle_batch(v):
    i = C("id")
    d = v.job.where("not (id % 3 > 0 and id % 11 < 3)").select(F.floor(i / 3).alias("execution"), i.alias("seq"), F.when(i % 3 == 0, "reserve").when((i % 3 == 1) & (i % 2 == 1), "release").otherwise("consume").alias("kind"), C("received").alias("micros"))
    return St.settle(d)


@query("""WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), w AS (SELECT k, seq, i, ts AS made, FALSE AS hit FROM e WHERE i = 1
UNION ALL SELECT e.k, e.seq, e.i, CASE WHEN e.ts - w.made < INTERVAL 7 DAY THEN w.made ELSE e.ts END, e.ts - w.made < INTERVAL 7 DAY FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1) SELECT k AS key, seq, hit FROM w""")
def st_ttl_cache(v):
    return St.drain(Sf.ttl_lookup(_stream(v).select(C("user_id").alias("key"), C("event_id").alias("seq"), "ts")), "ttl", large_state=True)


@query("""SELECT event_id FROM usage_event WHERE "at" > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY""")
def st_ttl_cache_batch(v):
    return St.ttl_valid(v.usage_event, F.lit(NOW)).select("event_id")


@query("""WITH e AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 3 = 1 THEN 'cancelled' ELSE 'interrupted' END WHEN 'click' THEN 'queued' ELSE 'running' END AS status, event_id * 31000 AS bytes FROM events),
t AS (SELECT *, count(*) FILTER (WHERE status NOT IN ('queued', 'running')) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM e),
w AS (SELECT job_id, turn, arg_min(ts, seq) AS since FROM t WHERE status IN ('queued', 'running') GROUP BY 1, 2), d AS (SELECT t.*, (epoch_ms(ts) - epoch_ms(since)) AS ms FROM t JOIN w USING (job_id, turn) WHERE status NOT IN ('queued', 'running'))
SELECT job_id, seq, concat(CASE WHEN seq % 3 = 0 THEN 'operation' ELSE 'download' END, CASE status WHEN 'succeeded' THEN '_completed' WHEN 'failed' THEN '_failed' ELSE '_cancelled' END) AS name, status AS outcome, CASE status WHEN 'succeeded' THEN 'success' WHEN 'failed' THEN 'error' ELSE 'cancelled' END AS result,
CASE WHEN ms < 1000 THEN 'lt_1s' WHEN ms < 3000 THEN '1_3s' WHEN ms < 10000 THEN '3_10s' WHEN ms < 30000 THEN '10_30s' WHEN ms < 120000 THEN '30_120s' WHEN ms < 600000 THEN '120_600s' ELSE 'gte_600s' END AS duration,
CASE WHEN seq % 4 = 0 THEN NULL WHEN bytes = 0 THEN '0' WHEN bytes < 1048576 THEN 'lt_1mib' WHEN bytes < 10485760 THEN '1_10mib' WHEN bytes < 104857600 THEN '10_100mib' WHEN bytes < 1073741824 THEN '100_1024mib' WHEN bytes < 10737418240 THEN '1_10gib' ELSE 'gte_10gib' END AS bytes,
status = 'succeeded' AND seq % 5 <> 0 AS validated FROM d""")
def st_watch_completion(v):
    e = C("event_id")
    ended = F.when(e % 3 == 0, "failed").when(e % 3 == 1, "cancelled").otherwise("interrupted")
    status = F.when(C("event_type") == "purchase", "succeeded").when(C("event_type") == "error", ended).when(C("event_type") == "click", "queued").otherwise("running")
    digest = F.when(e % 5 != 0, F.sha2(e.cast("string").cast("binary"), 256)).otherwise("none")
    d = _stream(v).select(C("user_id").alias("job_id"), e.alias("seq"), "ts", status.alias("status"), F.when(e % 4 != 0, e * 31000).alias("bytes"), digest.alias("sha256"), F.when(e % 3 == 0, "raster_clip").when(e % 3 == 1, "download").alias("kind"))
    return St.drain(Sf.completions(d), "completions", large_state=True)
