"""Queries of text functions and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from terraloom.functions import text as X
from terraloom.operators import filters as P
from terraloom.plans.registry import query

C = F.col
BOX = (0.0, 0.0, 20.0, 20.0)
LOW, HIGH = dt.date(1994, 1, 1), dt.date(1995, 12, 31)


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(strip_accents(text)), '\\s+'), lambda x: x <> ''), ' ') AS folded FROM documents")
def fn_fold_text(v):
    return v.documents.select("doc_id", X.fold_text(C("text")).alias("folded"))


@query("SELECT doc_id, concat(h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32]) AS id FROM (SELECT doc_id, sha256(text) AS h FROM documents) t")
def fn_stable_id(v):
    return v.documents.select("doc_id", X.stable_id(C("text")).alias("id"))


@query("""SELECT event_id, sha256(concat('{"a":', CAST(event_id AS VARCHAR), ',"m":', CASE WHEN source IS NULL THEN 'null' ELSE concat('"', source, '"') END, ',"z":"', name, '"}')) AS digest FROM usage_event""")
def fn_fingerprint(v):
    return v.usage_event.select("event_id", X.fingerprint(z=C("name"), a=C("event_id"), m=C("source")).alias("digest"))


@query("""SELECT id, coalesce(total, received) AS size, CASE WHEN id % 3 = 0 THEN sha256(href) END AS digest, (coalesce(total <> received, FALSE) OR id % 3 = 1) AS conflict FROM job""")
def fn_file_declared(v):
    multi = F.when(C("id") % 3 == 0, F.concat(F.lit("1220"), F.sha2(C("href").cast("binary"), 256))).when(C("id") % 3 == 1, "1114aa")
    size, digest, conflict = X.file_declared(C("total"), C("received"), multi)
    return v.job.select("id", size.alias("size"), digest.alias("digest"), conflict.alias("conflict"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' ELSE 'number' END AS kind, CAST(strlen(j) AS INT) AS size, sha256(j) AS digest
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{"k":', CAST(event_id AS VARCHAR), '}') WHEN 1 THEN concat('[', CAST(event_id AS VARCHAR), ',1]') WHEN 2 THEN concat('"', name, '"') ELSE CAST(event_id AS VARCHAR) END AS j FROM usage_event) t""")
def fn_json_node(v):
    e = C("event_id").cast("string")
    node = F.when(C("event_id") % 4 == 0, F.concat(F.lit('{"k": '), e, F.lit("}"))).when(C("event_id") % 4 == 1, F.concat(F.lit("["), e, F.lit(", 1]"))).when(C("event_id") % 4 == 2, F.concat(F.lit('"'), C("name"), F.lit('"'))).otherwise(e)
    kind, size, digest = X.json_node(F.concat(F.lit('{"a": {"b": '), node, F.lit("}}")), "$.a.b")
    return v.usage_event.select("event_id", kind.alias("kind"), size.alias("size"), digest.alias("digest"))


@query("""SELECT CASE WHEN x < 1000 THEN 'lt_1s' WHEN x < 3000 THEN '1_3s' WHEN x < 10000 THEN '3_10s' WHEN x < 30000 THEN '10_30s' WHEN x < 120000 THEN '30_120s' WHEN x < 600000 THEN '120_600s' ELSE 'gte_600s' END AS bucket, count(*) AS n FROM (SELECT (bytes * bytes) % 900000 AS x FROM poll) t GROUP BY 1""")
def fn_bucket_duration(v):
    return v.poll.groupBy(X.bucket_duration(C("bytes") * C("bytes") % 900000).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN x < 1 THEN '0' WHEN x < 2 THEN '1' WHEN x < 6 THEN '2_5' WHEN x < 21 THEN '6_20' WHEN x < 101 THEN '21_100' WHEN x < 1001 THEN '101_1000' ELSE 'gte_1001' END AS bucket, count(*) AS n FROM (SELECT bytes % 1500 // (1 + seq % 300) AS x FROM poll) t GROUP BY 1""")
def fn_bucket_count(v):
    return v.poll.groupBy(X.bucket_count(F.floor(C("bytes") % 1500 / (1 + C("seq") % 300))).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN x = 0 THEN '0' WHEN x < 1048576 THEN 'lt_1mib' WHEN x < 10485760 THEN '1_10mib' WHEN x < 104857600 THEN '10_100mib' WHEN x < 1073741824 THEN '100_1024mib' WHEN x < 10737418240 THEN '1_10gib' ELSE 'gte_10gib' END AS bucket, count(*) AS n FROM (SELECT bytes * (seq % 7) * (seq % 1000) * 50 AS x FROM poll) t GROUP BY 1""")
def fn_bucket_bytes(v):
    return v.poll.groupBy(X.bucket_bytes(C("bytes") * (C("seq") % 7) * (C("seq") % 1000) * 50).alias("bucket")).agg(F.count("*").alias("n"))


_MESSAGES = ["Request timed out", "HTTP 403", "no space left", "fetch failed", "Checksum mismatch", "odd", "connection aborted", "TIMEOUT of login", "HTTP 403", "invalid", "The user aborted"]
_NAMES = ["Error"] * 8 + ["AbortError", "TimeoutError", None]


@query("SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'authorization' WHEN 2 THEN 'storage' WHEN 3 THEN 'network' WHEN 4 THEN 'validation' WHEN 5 THEN 'unknown' WHEN 6 THEN 'network' WHEN 7 THEN 'timeout' WHEN 8 THEN 'cancelled' WHEN 9 THEN 'timeout' ELSE 'unknown' END AS kind FROM usage_event")
def fn_classify_error(v):
    pick = lambda values: F.element_at(F.array(*[F.lit(m) for m in values]), (C("event_id") % 11 + 1).cast("int"))
    return v.usage_event.select("event_id", X.classify_error(pick(_MESSAGES), pick(_NAMES)).alias("kind"))


@query("""SELECT page_id, CASE WHEN h = 'blog.tionble.example.com' THEN 'blog' WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'net' ELSE 'other' END AS source FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages) t""")
def fn_source_from_href(v):
    return v.pages.select("page_id", X.source_from_href(C("url"), {"blog.tionble.example.com": "blog"}, {"example.net": "net"}).alias("source"))


@query("SELECT item_id, CAST(dt + INTERVAL 1 MONTH AS DATE) AS day FROM item")
def fn_month_after(v):
    return v.item.select("item_id", X.month_after(C("dt")).alias("day"))


@query("""SELECT o, CASE o % 4 WHEN 0 THEN datediff('day', DATE '1992-01-01', dt) % 10 = 0 AND dt <= DATE '1996-12-31' WHEN 1 THEN day(dt) = 31 OR (day(dt) = day(last_day(dt)) AND month(dt) IN (2, 4, 6, 9, 11)) WHEN 2 THEN dt = DATE '1995-05-05' ELSE (month(dt) = 3 AND day(dt) = 1 AND (year(dt) - 1990) % 2 = 0) END AS supported FROM item""")
def fn_time_supported(v):
    dims = F.when(C("o") % 4 == 0, "1992-01-01/1996-12-31/P10D").when(C("o") % 4 == 1, "1990-01-31/2005-01-01/P1M").when(C("o") % 4 == 2, "1991-01-01,1995-05-05, 1980-01-01/x/P1D").otherwise("1990-03-01/2010-01-01/P2Y")
    return X.time_supported(v.item.select("o", dims.alias("dims"), C("dt").cast("timestamp").alias("at")), "dims", "at").select("o", "supported")


@query("SELECT item_id, dt - 30 AS first, dt AS last, CAST(date_trunc('month', dt) AS DATE) AS month_first, last_day(dt + 40) AS month_last FROM item")
def fn_date_defaults(v):
    a, b = X.date_defaults(C("dt"))
    c, d = X.month_span(C("dt"), F.date_add("dt", 40))
    return v.item.select("item_id", a.alias("first"), b.alias("last"), c.alias("month_first"), d.alias("month_last"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_filter([trim(name), trim(alias), trim(code), ''], lambda x: x <> '' AND x <> '-99'))), '|') AS aliases FROM site")
def fn_alias_list(v):
    return v.site.select("id", F.array_join(X.alias_list(C("name"), C("alias"), C("code"), F.lit(""), F.lit(None)), "|").alias("aliases"))


# --- filters

def _b():
    return C("w"), C("s"), C("e"), C("n")


@query("SELECT item_id FROM item WHERE w <= 20 AND e >= 0 AND s <= 20 AND n >= 0")
def flt_bbox_closed(v):
    return v.item.where(P.bbox_closed(*_b(), BOX)).select("item_id")


@query("SELECT item_id FROM item WHERE w < 20 AND e > 0 AND s < 20 AND n > 0 AND cloud <= 40")
def flt_bbox_open(v):
    return v.item.where(P.bbox_open(*_b(), BOX) & (C("cloud") <= 40)).select("item_id")


@query("SELECT count(*) AS n FROM item WHERE w <= 20 AND e >= 0 AND s <= 20 AND n >= 0")
def flt_bbox_rows(v):
    return v.item.where(P.bbox_rows(*_b(), BOX)).agg(F.count("*").alias("n"))


@query("SELECT item_id FROM item WHERE w + o % 3 * 200 < e AND w + o % 3 * 200 <= 180 AND e <= 180 AND s < n AND s >= -90 AND n <= 90")
def flt_valid_bounds(v):
    return v.item.where(P.valid_bounds(C("w") + C("o") % 3 * 200, C("s"), C("e"), C("n"))).select("item_id")


@query("SELECT item_id FROM item WHERE o % 3 <> 2 AND CASE WHEN o % 3 = 0 THEN dt ELSE dt + 20 END >= DATE '1994-01-01' AND dt <= DATE '1995-12-31'")
def flt_datetime_overlap(v):
    i = C("o") % 3
    ok = P.datetime_overlap(F.when(i == 0, C("dt")), F.when(i == 1, C("dt")), F.when(i == 1, F.date_add("dt", 20)), F.lit(LOW), F.lit(HIGH))
    return v.item.where(ok).select("item_id")


@query("SELECT o, (o % 5 IN (0, 1, 3)) AS ok FROM item")
def flt_datetime_syntax(v):
    k, d = C("o") % 5, C("dt").cast("string")
    text = F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("/.."))).when(k == 2, F.lit("../..")).when(k == 3, F.concat(d, F.lit("/"), F.date_add("dt", 1).cast("string"))).otherwise(F.concat(d, F.lit("/"), F.date_sub("dt", 1).cast("string")))
    return v.item.select("o", P.datetime_syntax(text).alias("ok"))


@query("SELECT item_id FROM item WHERE cloud BETWEEN 10 AND 40 AND o % 7 <> 0")
def flt_cloud_range(v):
    return v.item.where(P.cloud_range(F.when(C("o") % 7 != 0, C("cloud")), 10, 40)).select("item_id")


@query("SELECT id FROM job WHERE asset IN ('red', 'green') AND status = 'running'")
def flt_platform_mode(v):
    return v.job.where(P.platform_mode(C("asset"), C("status"), ["red", "green"], "running")).select("id")


@query("SELECT scene, count(*) AS n FROM job GROUP BY scene HAVING bool_or(asset = 'red')")
def flt_polarization(v):
    bands = v.job.groupBy("scene").agg(F.count("*").alias("n"), F.collect_set("asset").alias("assets"))
    return bands.where(F.array_contains("assets", "red")).select("scene", "n")


@query("SELECT item_id, dt FROM item WHERE dt <= DATE '1997-03-01' AND year(dt) = (SELECT max(year(dt)) FROM item WHERE dt <= DATE '1997-03-01')")
def flt_latest_year(v):
    return P.latest_year(v.item, "dt", F.lit(dt.date(1997, 3, 1))).select("item_id", "dt")


@query("SELECT item_id, collection_id FROM item WHERE collection_id = '1-URGENT' AND w < 60 AND e > -60 AND s < 40 AND n > -40 AND dt BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' AND cloud <= 60")
def flt_scene_search(v):
    return P.scene_search(v.item, "1-URGENT", (-60.0, -40.0, 60.0, 40.0), F.lit(LOW), F.lit(HIGH), 60).select("item_id", "collection_id")


@query("SELECT coalesce(CASE WHEN cloud > 90 THEN 'cloud' WHEN o % 11 = 0 THEN 'identifier' END, 'ok') AS reason, count(*) AS n FROM item GROUP BY 1")
def flt_quarantine(v):
    d = P.quarantine(v.item, [("cloud", C("cloud") <= 90), ("identifier", C("o") % 11 != 0)])
    return d.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


# tags of a way by its number: one row for each boundary of the preset and area rules
_TAGS = [
    {"building": "yes"}, {"highway": "primary"}, {"natural": "water"}, {"building": "no"}, {"landuse": "forest", "area": "no"}, {"highway": "services", "amenity": "fuel"},
    {"building:part": "yes"}, {"building:part": "no"}, {"highway": "construction"}, {"highway": "proposed"}, {"highway": "no"}, {"natural": "wetland"}, {"natural": "cliff"}, {"landuse": "reservoir"}, {"landuse": "basin"}, {"landuse": "no"},
    {"waterway": "river"}, {"waterway": "dock"}, {"waterway": "no"}, {"leisure": "park"}, {"leisure": "no", "shop": "no"}, {"shop": "books"}, {"tourism": "hotel"}, {"area": "yes", "highway": "path"}, {"aeroway": "taxiway"}, {"aeroway": "apron"}, {"barrier": "wall"}, {"barrier": "gate"}, {"name": "x"}, {},
]


def _tags(v):
    texts = [F.map_from_arrays(F.array(*map(F.lit, t)), F.array(*map(F.lit, t.values()))) if t else F.create_map().cast("map<string, string>") for t in _TAGS]
    k = (C("p_partkey") % len(_TAGS) + 1).cast("int")
    return v.part.select(C("p_partkey").cast("bigint").alias("way_id"), (C("p_partkey") % 7 != 0).alias("closed"), F.element_at(F.array(*texts), k).alias("tags"))


@query(f"""SELECT k IN (0, 6) AS buildings, k IN (1, 5, 8, 9, 23) AS roads, k IN (2, 13, 14, 16, 17) AS water, k IN (4, 13, 14) AS landuse, k IN (5, 19, 21, 22) AS pois, count(*) AS n
FROM (SELECT p_partkey % {len(_TAGS)} AS k FROM part) t GROUP BY ALL""")
def flt_osm_preset(v):
    names = ["buildings", "roads", "water", "landuse", "pois"]
    return _tags(v).select(*[P.osm_preset(C("tags"), k).alias(k) for k in names]).groupBy(*names).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(p_partkey AS BIGINT) AS way_id, p_partkey % 7 <> 0 AND p_partkey % {len(_TAGS)} IN (0, 2, 5, 6, 11, 13, 14, 17, 19, 21, 22, 23, 25, 26) AS is_area FROM part")
def flt_osm_area(v):
    return P.osm_area(_tags(v))


@query("SELECT item_id FROM item WHERE e - w <= 1 AND n - s <= 1 AND 6371008.8::DOUBLE * 6371008.8 * radians(e - w) * (sin(radians(n)) - sin(radians(s))) <= 1e8")
def flt_overpass_area(v):
    return v.item.where(P.overpass_area(*_b())).select("item_id")


@query("SELECT scene, count(*) FILTER (WHERE red = 0) AS empty, count(*) FILTER (WHERE scl = 3) AS nan FROM px GROUP BY scene")
def flt_nodata(v):
    value = F.when(C("scl") == 3, float("nan")).otherwise(C("red").cast("double"))
    return v.px.groupBy("scene").agg(F.count_if(P.nodata(C("red").cast("double"), F.lit(0.0), True)).alias("empty"), F.count_if(P.nodata(value, F.lit(float("nan")))).alias("nan"))


@query("SELECT doc_id FROM documents WHERE length(text) > 0 AND length(text) <= 2000 AND text = regexp_replace(text, '^ +| +$', '', 'g') AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]')")
def flt_text_clean(v):
    return v.documents.where(P.text_clean(C("text"), 2000)).select("doc_id")


@query("SELECT seq FROM poll WHERE bytes * 100000000000 <= 9007199254740991")
def flt_safe_integer(v):
    return v.poll.where(P.safe_integer(C("bytes") * 100000000000)).select("seq")


@query("""SELECT CASE WHEN name = 'purchase' THEN 'name' WHEN event_id % 6 = 0 THEN 'identifier' WHEN event_id % 6 = 1 THEN 'version' WHEN "at" < TIMESTAMP '2024-01-20' - INTERVAL 30 DAY OR "at" > TIMESTAMP '2024-01-20 00:05:00' THEN 'expired' WHEN event_id % 6 = 2 THEN 'incomplete label' WHEN event_id % 6 = 3 AND platform <> 'browser' THEN 'wrong surface' WHEN event_id % 6 = 3 THEN 'wrong surface' ELSE 'ok' END AS reason, count(*) AS n FROM usage_event GROUP BY 1""")
def flt_usage_event(v):
    k = C("event_id") % 6
    uuid = lambda c: F.concat(F.lpad(F.hex(c), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    fields = F.when(k == 2, F.create_map(F.lit("acquisitionKind"), F.lit("website"))).when(k == 3, F.create_map(*[F.lit(x) for x in ("acquisitionKind", "website", "acquisitionSource", "s", "acquisitionCampaign", "c")])).otherwise(F.create_map(F.lit("a"), F.lit("b")))
    e = v.usage_event.select(F.when(k == 0, "x").otherwise(uuid(C("event_id"))).alias("id"), uuid(C("installation")).alias("installation_id"), uuid(C("session_id")).alias("session_id"), F.when(k == 1, "1.2").otherwise("1.2.3-rc.1").alias("version"), "platform", "environment", "name", "at", fields.alias("fields"))
    names = ["click", "view", "signup", "scroll", "error", "login", "logout", "search"]
    reason = P.usage_event_reason(F.lit(dt.datetime(2024, 1, 20)), names)
    return e.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT item_id FROM item WHERE collection_id = '2-HIGH' AND dt BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' AND cloud <= 30")
def flt_monitor_item(v):
    return v.item.where(P.monitor_item(C("collection_id"), C("dt"), C("cloud"), "2-HIGH", F.lit(LOW), F.lit(HIGH), 30)).select("item_id")
