"""Queries of joins, aggregates, ordered operators, checks, graphs and dataset resolution."""

from __future__ import annotations


from pyspark.sql import functions as F

from terraloom.operators import aggregates as A
from terraloom.operators import checks as K
from terraloom.operators import graph as Gr
from terraloom.operators import joins as J
from terraloom.operators import resolve as Rs
from terraloom.operators import rings as Rg
from terraloom.operators import windows as W
from terraloom.plans.q_grid import _TILES, _ring, _tiles
from terraloom.plans.registry import query

C = F.col


def _long(v):
    px = v.px
    parts = [px.select("scene", "x", "y", F.lit(b).alias("asset"), C(b).alias("value")) for b in ("red", "green", "blue")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT scene, x, y, red, green, blue, (red <> 0 AND green <> 0 AND blue <> 0) AS valid FROM px")
def join_bands(v):
    return J.join_bands(_long(v), ["red", "green", "blue"])


@query("SELECT scene, count(*) FILTER (WHERE qa_pixel & 1 = 0) AS valid, CAST(sum(CASE WHEN qa_pixel & 1 = 0 THEN qa_radsat ELSE 0 END) AS BIGINT) AS total FROM px GROUP BY scene")
def join_qa_pair(v):
    j = J.join_qa_pair(v.px.select("scene", "x", "y", "qa_pixel"), v.px.select("scene", "x", "y", "qa_radsat"))
    return j.groupBy("scene").agg(F.count_if("valid").alias("valid"), F.sum(F.when(C("valid"), C("qa_radsat")).otherwise(0)).alias("total"))


@query("SELECT scene, x, y, ndvi, evi, vi_quality, vi_rel FROM px")
def join_vi_quad(v):
    parts = [v.px.select("scene", "x", "y", F.lit(b).alias("asset"), C(b).alias("value")) for b in ("ndvi", "evi", "vi_quality", "vi_rel")]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return J.join_bands(d, ["ndvi", "evi", "vi_quality", "vi_rel"]).drop("valid")


def _edges(v):
    """Squares of side 1 with a square hole of side 0.5 in every third."""
    p = C("p_partkey").cast("bigint")
    x, y = (p % 50).cast("double"), F.floor(p / 50).cast("double")

    def sides(x, y, a):
        c = [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
        return F.array(*[F.struct(c[i][0].alias("ax"), c[i][1].alias("ay"), c[i + 1][0].alias("bx"), c[i + 1][1].alias("by")) for i in range(4)])

    all_ = F.when(p % 3 == 0, F.concat(sides(x, y, 1.0), sides(x + 0.25, y + 0.25, 0.5))).otherwise(sides(x, y, 1.0))
    return v.part.select(p.alias("poly_id"), F.explode(all_).alias("e")).select("poly_id", "e.*")


@query("""SELECT c AS id, CAST(floor(py) * 50 + floor(px) AS BIGINT) AS poly_id FROM (SELECT CAST(c_custkey AS BIGINT) AS c, CAST(c_custkey * 7 % 500 AS DOUBLE) / 10 + 0.03 AS px, CAST(c_custkey * 13 % 400 AS DOUBLE) / 10 + 0.03 AS py FROM customer) t
JOIN part ON p_partkey = CAST(floor(py) * 50 + floor(px) AS BIGINT)
WHERE NOT (p_partkey % 3 = 0 AND px - floor(px) >= 0.25 AND px - floor(px) < 0.75 AND py - floor(py) >= 0.25 AND py - floor(py) < 0.75)""")
def join_point_polygon(v):
    c = C("c_custkey").cast("bigint")
    points = v.customer.select(c.alias("id"), ((c * 7 % 500).cast("double") / 10 + 0.03).alias("px"), ((c * 13 % 400).cast("double") / 10 + 0.03).alias("py"))
    return J.points_in_polygons(points, _edges(v), 2.0)


_AREAS = "SELECT id AS area_id, CAST(id * 37 % 340 AS DOUBLE) - 180 AS w, CAST(id * 53 % 160 AS DOUBLE) - 90 AS s, CAST(id * 37 % 340 AS DOUBLE) - 175 AS e, CAST(id * 53 % 160 AS DOUBLE) - 86 AS n FROM site"


def _areas(v):
    w, s = (C("id") * 37 % 340).cast("double") - 180, (C("id") * 53 % 160).cast("double") - 90
    return v.site.select(C("id").alias("area_id"), w.alias("w"), s.alias("s"), (w + 5).alias("e"), (s + 4).alias("n"))


@query(f"WITH areas AS ({_AREAS}) SELECT item_id, area_id FROM item i JOIN areas a ON i.w < a.e AND i.e > a.w AND i.s < a.n AND i.n > a.s")
def join_scene_aoi(v):
    return J.scenes_in_areas(v.item, _areas(v), 5.0)


def _ways(v):
    p = C("p_partkey").cast("bigint")
    return v.part.select(p.alias("way_id"), F.array(p, p * 7 % 1500, p + 1, p * 3).alias("refs"))


_WAYREF = "SELECT CAST(p_partkey AS BIGINT) AS way_id, unnest([0, 1, 2, 3]) AS pos, unnest([CAST(p_partkey AS BIGINT), CAST(p_partkey AS BIGINT) * 7 % 1500, CAST(p_partkey AS BIGINT) + 1, CAST(p_partkey AS BIGINT) * 3]) AS node_id FROM part"


def _nodes(v):
    c = C("c_custkey").cast("bigint")
    return v.customer.select(c.alias("node_id"), (c % 360).cast("double").alias("x"), (c % 90).cast("double").alias("y"))


@query(f"""WITH r AS ({_WAYREF}) SELECT way_id, string_agg(coalesce(CAST(CAST(c_custkey % 360 AS INT) AS VARCHAR) || ' ' || CAST(CAST(c_custkey % 90 AS INT) AS VARCHAR), '-'), ',' ORDER BY pos) AS path, count(*) FILTER (WHERE c_custkey IS NULL) AS missing FROM r LEFT JOIN customer ON c_custkey = node_id GROUP BY way_id""")
def join_osm_way_nodes(v):
    w = J.way_nodes(_ways(v), _nodes(v))
    text = F.transform("points", lambda p: F.coalesce(F.concat_ws(" ", F.when(p["x"].isNotNull(), p["x"].cast("int").cast("string")), p["y"].cast("int").cast("string")), F.lit("-")))
    return w.select("way_id", F.array_join(F.transform(text, lambda t: F.when(t == "", "-").otherwise(t)), ",").alias("path"), "missing")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS relation_id, count(*) AS members, count(p_partkey) AS found FROM (SELECT s_suppkey, unnest([s_suppkey, s_suppkey * 3, 999999]) AS ref FROM supplier) t LEFT JOIN part ON p_partkey = ref GROUP BY 1""")
def join_osm_members(v):
    i = C("s_suppkey").cast("bigint")
    m = F.array(*[F.struct(F.lit("way").alias("type"), r.alias("ref"), F.lit("outer").alias("role")) for r in (i, i * 3, F.lit(999999).cast("bigint"))])
    elements = v.part.select(F.lit("way").alias("type"), C("p_partkey").cast("bigint").alias("ref"), F.lit(True).alias("there"))
    j = J.relation_members(v.supplier.select(i.alias("relation_id"), m.alias("members")), elements)
    return j.groupBy("relation_id").agg(F.count("*").alias("members"), F.count("there").alias("found"))


@query(f"WITH r AS ({_WAYREF}) SELECT way_id, node_id FROM r WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = node_id)")
def join_missing_refs(v):
    refs = _ways(v).select("way_id", F.explode("refs").alias("node_id"))
    return J.missing_refs(refs, _nodes(v), "node_id").select("way_id", "node_id")


@query("""SELECT CAST(p_partkey AS BIGINT) AS hole_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS BIGINT) * 2 + 1 WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey AS BIGINT) * 2 END AS shell_id, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 5 = 0 THEN 'no shell' END AS error FROM part""")
def join_hole_shell(v):
    p = C("p_partkey").cast("bigint")
    x, y = (p % 50 * 10).cast("double"), (F.floor(p / 50) * 10).cast("double")

    def sides(a):
        c = [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
        return F.array(*[F.struct(c[i][0].alias("ax"), c[i][1].alias("ay"), c[i + 1][0].alias("bx"), c[i + 1][1].alias("by")) for i in range(4)])

    big = v.part.select((p * 2).alias("shell_id"), F.lit(64.0).alias("area"), sides(8.0).alias("edges"))
    small = v.part.select((p * 2 + 1).alias("shell_id"), F.lit(4.0).alias("area"), sides(2.0).alias("edges"))
    off = F.when(p % 2 == 0, 1.0).when(p % 5 == 0, 9.0).otherwise(5.0)
    holes = v.part.select(p.alias("hole_id"), (x + off).alias("px"), (y + off).alias("py"))
    return J.holes_to_shells(holes, big.unionByName(small), 5.0)


@query("""WITH a AS (SELECT DISTINCT scene, asset, href FROM job WHERE id % 2 = 0) SELECT a.scene, a.asset, a.href, max(id) AS job_id, arg_max(status, id) AS status FROM a LEFT JOIN (SELECT * FROM job WHERE status IN ('succeeded', 'queued', 'running')) j USING (scene, asset, href) GROUP BY ALL""")
def join_project_jobs(v):
    wanted = v.job.where("id % 2 = 0").select("scene", "asset", "href").distinct()
    return J.reusable_jobs(wanted, v.job)


@query("""WITH a AS (SELECT o AS id, 'saved' AS href FROM item WHERE o % 2 = 0), b AS (SELECT o AS id, 'fresh' AS href FROM item WHERE o % 3 = 0) SELECT id, coalesce(a.href, b.href) AS href FROM a FULL JOIN b USING (id)""")
def join_catalog_merge(v):
    a = v.item.where("o % 2 = 0").select(C("o").alias("id"), F.lit("saved").alias("href"))
    b = v.item.where("o % 3 = 0").select(C("o").alias("id"), F.lit("fresh").alias("href"))
    return J.merge_catalog(a, b, ["id"], "href")


@query("SELECT event_id FROM usage_event WHERE installation NOT IN (SELECT id FROM site WHERE id % 3 = 0)")
def join_exclude_registry(v):
    return J.anti(v.usage_event, v.site.where("id % 3 = 0").select(C("id").alias("installation")), ["installation"]).select("event_id")


@query("SELECT o % 7 AS monitor, item_id FROM item WHERE NOT (o % 5 = 0 AND o % 7 < 4)")
def join_new_items(v):
    items = v.item.select((C("o") % 7).alias("monitor"), "item_id", "o")
    return J.anti(items, items.where("o % 5 = 0 and monitor < 4"), ["monitor", "item_id"]).select("monitor", "item_id")


@query("SELECT id FROM site s WHERE level = 1 AND NOT EXISTS (SELECT 1 FROM site c WHERE c.level = 0 AND c.code = s.code)")
def join_top_level_dup(v):
    return J.anti(v.site.where("level = 1"), v.site.where("level = 0"), ["code"]).select("id")


@query("SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS aliases FROM site")
def join_alias(v):
    al = v.site.where("id % 3 = 0").select("id", F.array("name", "alias").alias("aliases"))
    return J.with_aliases(v.site.select("id"), al, "id").select("id", F.size("aliases").alias("aliases"))


@query("SELECT o AS id, CASE WHEN o % 10 = 0 THEN 'added' WHEN o % 10 = 1 THEN 'removed' ELSE 'changed' END AS change FROM item WHERE o % 10 < 3")
def join_snapshot_compare(v):
    a = v.item.where("o % 10 <> 0").select(C("o").alias("id"), "cloud", "collection_id")
    b = v.item.where("o % 10 <> 1").select(C("o").alias("id"), F.when(C("o") % 10 == 2, C("cloud") + 1).otherwise(C("cloud")).alias("cloud"), "collection_id")
    return J.snapshot_compare(a, b, "id")


@query("SELECT count(*) AS pairs FROM job a JOIN job b ON a.scene = b.scene AND a.asset = b.asset AND a.href = b.href AND a.total IS NOT DISTINCT FROM b.total AND a.id < b.id")
def join_same_selection(v):
    a, b = v.job.select("id", "scene", "asset", "href", "total"), v.job.select(C("id").alias("other"), "scene", "asset", "href", "total")
    return a.join(b, J.same_selection(a, b, ["scene", "asset", "href", "total"]) & (C("id") < C("other"))).agg(F.count("*").alias("pairs"))


# --- aggregates


@query("""WITH r AS (SELECT scene, red, row_number() OVER (PARTITION BY scene ORDER BY red) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n FROM px WHERE red <> 0) SELECT scene, max(red) FILTER (WHERE i = (n - 1) * 2 // 100) AS low, max(red) FILTER (WHERE i = (n - 1) * 98 // 100) AS high FROM r GROUP BY scene""")
def agg_stretch_2_98(v):
    return A.stretch_range(v.px.where("red <> 0"), ["scene"], "red")


@query("SELECT scene, count(*) AS samples, count(*) FILTER (WHERE red <> 0) AS valid, count(*) FILTER (WHERE red <> 0 AND red NOT BETWEEN 500 AND 15000) AS outside FROM px GROUP BY scene")
def agg_valid_counts(v):
    return A.valid_counts(v.px, ["scene"], "red", 0, 500, 15000)


@query(" UNION ALL ".join(f"SELECT '{b}' AS band, min({b}) FILTER (WHERE {b} <> 0) AS low, max({b}) FILTER (WHERE {b} <> 0) AS high, count(*) FILTER (WHERE {b} = 0) AS nodata, count(*) FILTER (WHERE {b} <> 0 AND {b} NOT BETWEEN 100 AND 19000) AS outside FROM px" for b in ("red", "green", "blue")))
def agg_band_summary(v):
    return A.band_summary(v.px, ["red", "green", "blue"], 0, 100, 19000)


@query("SELECT scene, count(*) FILTER (WHERE y >= 10) AS masked, count(*) FILTER (WHERE y < 10 AND red <> 0) AS covered FROM px GROUP BY scene")
def agg_masked_covered(v):
    return A.masked_covered(v.px, ["scene"], C("y") < 10, C("red") != 0)


@query("SELECT o % 40 AS g, min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n, CASE WHEN max(w) < min(e) AND max(s) < min(n) THEN max(w) END AS iw FROM item GROUP BY 1")
def agg_bounds_union(v):
    return A.bounds_union(v.item.withColumn("g", C("o") % 40), ["g"]).select("g", "w", "s", "e", "n", "iw")


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Polygon' ELSE 'LineString' END AS geom_type, count(*) AS features, CAST(count(*) * 5 AS BIGINT) AS positions, CAST(min(p_partkey % 50) AS DOUBLE) AS w, CAST(max(p_partkey // 50) + 1 AS DOUBLE) AS n FROM part GROUP BY 1")
def agg_geometry_stats(v):
    p = C("p_partkey").cast("bigint")
    f = v.part.select(F.when(p % 3 == 0, "Polygon").otherwise("LineString").alias("geom_type"), _ring(p % 50, F.floor(p / 50)).alias("ring"))
    return A.geometry_stats(f).select("geom_type", "features", "positions", "w", "n")


@query("SELECT 'node' AS kind, count(*) AS n, TRUE AS ok FROM customer UNION ALL SELECT 'way', count(*), TRUE FROM part UNION ALL SELECT 'relation', count(*), FALSE FROM supplier")
def agg_osm_counts(v):
    kinds = v.customer.select(F.lit("node").alias("kind")).union(v.part.select(F.lit("way"))).union(v.supplier.select(F.lit("relation")))
    counts = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    declared = v.customer.agg(F.count("*").alias("declared")).select(F.lit("node").alias("kind"), "declared").union(v.part.agg(F.count("*")).select(F.lit("way"), "count(1)")).union(v.supplier.agg(F.count("*") + 1).select(F.lit("relation"), "(count(1) + 1)"))
    return counts.join(declared, "kind").select("kind", "n", (C("n") == C("declared")).alias("ok"))


_CELLS = f"""WITH areas AS (SELECT * FROM ({_AREAS}) t),
j AS (SELECT a.area_id, a.w, a.s, a.e, a.n, i.item_id, i.o, row_number() OVER (PARTITION BY a.area_id ORDER BY i.dt DESC, i.item_id) AS rank, i.w AS sw, i.s AS ss, i.e AS se, i.n AS sn FROM areas a JOIN item i ON i.w < a.e AND i.e > a.w AND i.s < a.n AND i.n > a.s),
xs AS (SELECT DISTINCT area_id, unnest([w, e, greatest(w, sw), least(e, se)]) AS x FROM j), ys AS (SELECT DISTINCT area_id, unnest([s, n, greatest(s, ss), least(n, sn)]) AS y FROM j),
xc AS (SELECT area_id, x AS cw, lead(x) OVER (PARTITION BY area_id ORDER BY x) AS ce FROM xs), yc AS (SELECT area_id, y AS cs, lead(y) OVER (PARTITION BY area_id ORDER BY y) AS cn FROM ys),
cells AS (SELECT xc.area_id, cw, cs, ce, cn, min(rank) AS first_rank, arg_min(item_id, rank) AS first_item FROM xc JOIN yc USING (area_id) LEFT JOIN j ON j.area_id = xc.area_id AND sw <= cw AND se >= ce AND ss <= cs AND sn >= cn WHERE ce IS NOT NULL AND cn IS NOT NULL GROUP BY ALL)"""


def _report_sql():
    """One branch a counter: its name, its keys, and when an event belongs to it."""
    other = lambda c, absent="other": f"coalesce({c}, '{absent}')"
    counters = [
        ("event", ["name"], "TRUE"),
        ("source", [other("source"), "name"], "TRUE"),
        ("surface", [other("surface"), "name"], "TRUE"),
        ("day", ["strftime(\"at\", '%Y-%m-%d')", "name"], "TRUE"),
        ("environment", ["environment"], "TRUE"),
        ("outcome", [other("source"), other("action"), "result"], "result <> ''"),
        ("duration", [other("source"), other("action"), "duration"], "duration <> ''"),
        ("terminal", [other("source"), other("surface"), "status"], "status <> ''"),
        ("failure", [other("source"), other("action"), "error"], "error <> ''"),
        ("diagnostic", [other("source"), "name", other("stage", "unavailable"), other("reason", "unavailable"), other("http_status", "unknown"), other("retries", "unknown"), other("origin", "unavailable")], "reason <> '' OR error <> ''"),
    ]
    keys = lambda parts: ", ".join(f"{p} AS k{i}" for i, p in enumerate([*parts, *["''"] * (7 - len(parts))], 1))
    return " UNION ALL ".join(f"SELECT '{name}' AS report, {keys(parts)}, count(*) AS n FROM usage_event WHERE {where} GROUP BY ALL" for name, parts, where in counters)


@query(_report_sql())
def agg_usage_report(v):
    return A.usage_report(v.usage_event)


@query("SELECT count(*) AS events, count(DISTINCT installation) AS installations, count(DISTINCT session_id) AS sessions FROM usage_event")
def agg_usage_totals(v):
    return A.usage_totals(v.usage_event)


@query("SELECT CAST(\"at\" AS DATE) AS day, name, count(*) AS n FROM usage_event GROUP BY 1, 2")
def agg_usage_daily(v):
    return v.usage_event.groupBy(F.to_date("at").alias("day"), "name").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) FILTER (WHERE platform = 'browser' AND name = 'view') AS views, count(DISTINCT CASE WHEN platform = 'browser' THEN installation END) AS browsers, count(DISTINCT CASE WHEN platform = 'desktop' THEN installation END) AS desktops,
count(DISTINCT CASE WHEN platform = 'desktop' AND name = 'signup' THEN installation END) AS first_runs, count(*) FILTER (WHERE platform = 'desktop' AND name = 'purchase') AS completed, count(DISTINCT CASE WHEN platform = 'desktop' AND name = 'purchase' THEN installation END) AS completing, count(*) FILTER (WHERE platform = 'desktop' AND name = 'error') AS failures
FROM usage_event WHERE environment = 'production' AND source IS NOT NULL AND installation NOT IN (SELECT id FROM site WHERE id % 3 = 0) GROUP BY source""")
def agg_campaign(v):
    return A.campaign(v.usage_event, v.site.where("id % 3 = 0").select(C("id").alias("installation")))


@query("SELECT s AS status, count(id) AS n FROM (SELECT unnest(['queued', 'running', 'succeeded', 'failed', 'cancelled', 'interrupted']) AS s) t LEFT JOIN (SELECT * FROM job WHERE id % 6 <> 4) j ON status = s GROUP BY s")
def agg_job_status(v):
    return A.job_status(v.job.where("id % 6 <> 4"))


@query("""WITH x AS (SELECT DISTINCT delivery, id FROM job WHERE id % 5 <> delivery % 5 OR id % 7 = 3), j AS (SELECT id, delivery, CASE WHEN id % 4 = 1 THEN 'succeeded' ELSE status END AS status, id % 13 <> 0 AS settled FROM job WHERE id % 5 <> delivery % 5),
g AS (SELECT DISTINCT delivery FROM job UNION SELECT DISTINCT delivery + 100 FROM job), d AS (SELECT g.delivery, count(x.id) AS total, count(*) FILTER (WHERE status = 'succeeded' AND settled) AS done, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active,
count(*) FILTER (WHERE status IN ('failed', 'interrupted', 'cancelled')) AS attention, count(*) FILTER (WHERE x.id IS NOT NULL AND status IS NULL) AS missing FROM g LEFT JOIN x USING (delivery) LEFT JOIN j ON j.delivery = g.delivery AND j.id = x.id GROUP BY 1)
SELECT *, CASE WHEN total = 0 THEN 'saved' WHEN done = total THEN 'ready' WHEN active > 0 THEN 'active' WHEN attention > 0 AND done > 0 THEN 'partial' WHEN attention > 0 THEN 'attention' ELSE 'pending' END AS state FROM d""")
def agg_delivery_state(v):
    job = v.job.withColumns({"status": F.when(C("id") % 4 == 1, "succeeded").otherwise(C("status")), "settled": C("id") % 13 != 0})
    twice = job.withColumn("seq", F.lit(2)).unionByName(job.withColumns({"seq": F.lit(1), "status": F.lit("failed")}))
    groups = v.job.select("delivery").union(v.job.select(C("delivery") + 100))
    return A.delivery_state(twice.where("id % 5 <> delivery % 5"), "delivery", v.job.where("id % 5 <> delivery % 5 or id % 7 = 3").select("delivery", "id"), groups)


@query("""WITH d AS (SELECT task, count(*) AS jobs, count(*) FILTER (WHERE status = 'succeeded') AS ready, count(*) FILTER (WHERE status IN ('failed', 'interrupted')) AS failed, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
bool_and(coalesce(total > 0, FALSE)) AS known, CAST(sum(greatest(0, received)) AS BIGINT) AS transferred, CAST(sum(total) AS BIGINT) AS t, CAST(sum(least(total, greatest(0, received))) AS BIGINT) AS p FROM job WHERE id % 7 <> 0 OR task % 2 = 0 GROUP BY task)
SELECT task, jobs, ready, failed, running, queued, transferred, CASE WHEN known THEN t END AS total_bytes, CASE WHEN known THEN p END AS progress_bytes, CASE WHEN failed > 0 THEN 'attention' WHEN ready = jobs THEN 'complete' WHEN running > 0 THEN 'running' WHEN queued > 0 THEN 'queued' WHEN cancelled > 0 THEN 'stopped' ELSE 'submitted' END AS status FROM d""")
def agg_task_summary(v):
    return A.task_summary(v.job.where("id % 7 <> 0 or task % 2 = 0"), "task")


_REC = """SELECT installation AS req, event_id % 500 AS id, event_id AS seq, event_id % 7 <> 0 OR installation % 4 <> 0 AS linked, CASE WHEN event_id % 12 = 0 THEN 'failed' ELSE 'completed' END AS state,
CASE event_id % 4 WHEN 0 THEN 'workflow' WHEN 1 THEN 'compaction' ELSE 'human' END AS origin, CASE WHEN event_id % 9 = 0 AND installation % 2 = 0 THEN NULL ELSE event_id % 1000 END AS input, event_id % 300 AS output,
CASE WHEN installation % 3 = 0 THEN event_id % 1200 ELSE event_id % 1000 // 2 END AS cached, CASE WHEN installation % 5 = 0 THEN NULL ELSE event_id % 300 // 3 END AS reasoning, CASE WHEN installation % 7 = 0 AND event_id % 8 = 0 THEN NULL ELSE event_id % 6 END AS tools FROM usage_event"""


@query(f"""WITH r AS ({_REC}), u AS (SELECT r.* FROM r JOIN (SELECT req, id, max(seq) AS seq FROM r GROUP BY ALL) l USING (req, id, seq)),
q AS (SELECT DISTINCT installation AS req, installation % 11 = 0 AS running, installation % 13 = 0 AS truncated FROM usage_event UNION SELECT DISTINCT installation + 1000, installation % 2 = 0, FALSE FROM usage_event),
d AS (SELECT req, count(*) AS requests, count(input) AS known_requests, bool_and(linked) AS linked, CAST(coalesce(sum(input), 0) AS BIGINT) AS input, CAST(coalesce(sum(CASE WHEN input IS NOT NULL THEN output END), 0) AS BIGINT) AS output,
CASE WHEN count(input) > 0 AND bool_and(input IS NULL OR coalesce(cached <= input, FALSE)) THEN CAST(sum(CASE WHEN input IS NOT NULL THEN cached END) AS BIGINT) END AS cached_input,
CASE WHEN count(input) > 0 AND bool_and(input IS NULL OR coalesce(reasoning <= output, FALSE)) THEN CAST(sum(CASE WHEN input IS NOT NULL THEN reasoning END) AS BIGINT) END AS reasoning_output,
count(*) FILTER (WHERE state = 'failed') AS failed_requests, count(*) FILTER (WHERE origin = 'workflow') AS workflow_requests, count(*) FILTER (WHERE origin = 'compaction') AS compaction_requests, CASE WHEN bool_and(tools IS NOT NULL) THEN max(tools) END AS max_tools FROM u GROUP BY req)
SELECT req, CASE WHEN requests IS NULL THEN CASE WHEN running THEN 'pending' ELSE 'unavailable' END WHEN running OR truncated OR NOT linked OR known_requests < requests THEN 'partial' ELSE 'complete' END AS status,
coalesce(requests, 0) AS requests, coalesce(known_requests, 0) AS known_requests, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(failed_requests, 0) AS failed_requests, coalesce(workflow_requests, 0) AS workflow_requests, coalesce(compaction_requests, 0) AS compaction_requests,
coalesce(input, 0) + coalesce(output, 0) AS total, cached_input, reasoning_output, max_tools FROM q LEFT JOIN d USING (req)""")
def agg_token_usage(v):
    e, i = C("event_id"), C("installation")
    r = v.usage_event.select(
        i.alias("req"), (e % 500).alias("id"), e.alias("seq"), ((e % 7 != 0) | (i % 4 != 0)).alias("linked"), F.when(e % 12 == 0, "failed").otherwise("completed").alias("state"), F.when(e % 4 == 0, "workflow").when(e % 4 == 1, "compaction").otherwise("human").alias("origin"),
        F.when((e % 9 != 0) | (i % 2 != 0), e % 1000).alias("input"), (e % 300).alias("output"), F.when(i % 3 == 0, e % 1200).otherwise(F.floor(e % 1000 / 2)).alias("cached"), F.when(i % 5 != 0, F.floor(e % 300 / 3)).alias("reasoning"), F.when((i % 7 != 0) | (e % 8 != 0), e % 6).alias("tools"),
    )
    q = v.usage_event.select(i.alias("req"), (i % 11 == 0).alias("running"), (i % 13 == 0).alias("truncated")).union(v.usage_event.select(i + 1000, i % 2 == 0, F.lit(False))).distinct()
    return A.token_usage(r, q, "req")


@query("""WITH r AS (SELECT session_id, event_id, CASE WHEN name = 'signup' THEN 'user' ELSE 'work' END AS kind, event_id % 700 AS turn FROM usage_event),
o AS (SELECT *, last_value(CASE WHEN kind = 'user' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS request FROM r),
w AS (SELECT * FROM o WHERE request IS NOT NULL AND kind <> 'user'), c AS (SELECT turn FROM w GROUP BY turn HAVING count(DISTINCT (session_id, request)) = 1) SELECT session_id, request, count(DISTINCT turn) AS turns FROM w WHERE turn IN (SELECT turn FROM c) GROUP BY ALL""")
def agg_token_by_request(v):
    r = v.usage_event.select("session_id", "event_id", F.when(C("name") == "signup", "user").otherwise("work").alias("kind"), (C("event_id") % 700).alias("turn"))
    return A.token_by_request(r, "session_id", "event_id")


@query("SELECT user_id, kind, CAST(sum(remaining) AS BIGINT) AS available, CAST(sum(reserved) AS BIGINT) AS reserved, min(expires_day) AS nearest FROM credit_grant WHERE expires_day IS NULL OR expires_day > 12 GROUP BY user_id, kind")
def agg_credit_buckets(v):
    return A.credit_buckets(v.credit_grant, ["user_id", "kind"], F.lit(12))


@query("""WITH u AS (SELECT task, id % 30 AS day, CASE WHEN status IN ('queued', 'running') THEN received WHEN status = 'succeeded' THEN total END AS x FROM job) SELECT task, CAST(coalesce(sum(x), 0) AS BIGINT) AS used, CAST(coalesce(sum(CASE WHEN day = 7 THEN x END), 0) AS BIGINT) AS used_today FROM u GROUP BY task""")
def agg_budget_used(v):
    return A.budget_used(v.job.withColumn("day", C("id") % 30), ["task"], F.lit(7))


@query("SELECT CAST(sum(received) AS BIGINT) AS bytes, CAST(sum(id % 50) AS BIGINT) AS returned, count(DISTINCT href) AS urls, sum(id % 50) >= sum(id % 40) AS ok FROM job")
def agg_receipt_totals(v):
    return A.receipt_totals(v.job.select(C("received").alias("bytes"), (C("id") % 50).alias("returned"), C("href").alias("url"), (C("id") % 40).alias("features")))


@query("SELECT country, count(*) AS features, CAST(sum(strlen(name)) AS BIGINT) AS bytes, count(*) FILTER (WHERE id % 6 = 0) AS limited FROM site GROUP BY country")
def agg_country_manifest(v):
    return A.country_manifest(v.site.select("country", F.length("name").alias("bytes"), F.when(C("id") % 6 == 0, "polar").otherwise("").alias("limitation")))


# --- ordered operators


@query("SELECT collection_id, o % 500 AS k, arg_min(item_id, (dt, o)) AS item_id FROM item GROUP BY 1, 2")
def win_dedup_first(v):
    d = v.item.select("collection_id", (C("o") % 500).alias("k"), "dt", "o", "item_id")
    return W.dedup_first(d, ["collection_id", "k"], ["dt", "o"]).select("collection_id", "k", "item_id")


@query("SELECT collection_id, o % 500 AS k, arg_max(item_id, (dt, o)) AS item_id FROM item GROUP BY 1, 2")
def win_dedup_last(v):
    d = v.item.select("collection_id", (C("o") % 500).alias("k"), "dt", "o", "item_id")
    return W.dedup_last(d, ["collection_id", "k"], ["dt", "o"]).select("collection_id", "k", "item_id")


@query("""WITH p AS (SELECT *, lag(status) OVER w AS ps, lag(bytes) OVER w AS pb, lag("at") OVER w AS pa FROM poll WINDOW w AS (PARTITION BY job_id ORDER BY seq)), c AS (SELECT *, coalesce(status = 'running' AND ps = 'running' AND bytes >= pb, FALSE) AS continuing, epoch_us("at") // 1000 - 0 AS x, (epoch_us("at") - epoch_us(pa)) AS us FROM p)
SELECT job_id, seq, status, bytes, continuing, round(CASE WHEN continuing AND bytes > pb AND us // 1000 > 0 THEN CAST((bytes - pb) * 1000 AS DOUBLE) / (us // 1000) END, 6) AS rate FROM c""")
def win_progress_rate(v):
    return W.progress_rate(v.poll).withColumn("rate", F.round("rate", 6))


@query("""WITH l AS (SELECT *, user_id % 9 + 1 AS amount FROM credit_grant WHERE expires_day IS NULL OR expires_day > 10),
r AS (SELECT *, coalesce(sum(remaining) OVER (PARTITION BY user_id ORDER BY expires_day NULLS LAST, grant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(remaining) OVER (PARTITION BY user_id) AS t FROM l)
SELECT user_id, grant_id, CAST(least(greatest(amount - b, 0), remaining) AS BIGINT) AS spent FROM r WHERE t >= amount AND least(greatest(amount - b, 0), remaining) > 0""")
def win_fifo_allocate(v):
    amounts = v.customer.select(C("c_custkey").cast("bigint").alias("user_id"), (C("c_custkey") % 9 + 1).cast("bigint").alias("amount"))
    return W.fifo_allocate(v.credit_grant, amounts, F.lit(10))


@query("""WITH r AS (SELECT task, id, row_number() OVER w AS n, sum(received) OVER w AS b FROM job WINDOW w AS (PARTITION BY task ORDER BY id ROWS UNBOUNDED PRECEDING)) SELECT task, id FROM r WHERE n <= 20 AND b <= 900000""")
def win_page_budget(v):
    return W.page_budget(v.job, "task", "id", C("received"), 900000, 20).select("task", "id")


@query("""WITH RECURSIVE r AS (SELECT task, id, received, row_number() OVER (PARTITION BY task ORDER BY id) AS n FROM job), s AS (SELECT task, n, sum(received) OVER (PARTITION BY task ORDER BY n) AS b, received FROM r),
j AS (SELECT a.task, a.n, (SELECT count(*) FROM s c WHERE c.task = a.task AND c.n >= a.n AND c.n < a.n + 20 AND c.b <= a.b - a.received + 900000) AS k FROM s a),
w AS (SELECT task, CAST(5 AS BIGINT) AS n, CAST(1 AS BIGINT) AS page, k FROM j WHERE n = 5 UNION ALL SELECT j.task, j.n, page + 1, j.k FROM w JOIN j ON j.task = w.task AND j.n = w.n + w.k),
m AS (SELECT task, max(page) AS last FROM w GROUP BY task)
SELECT r.task, r.id, page, w.n - 1 AS page_offset, CASE WHEN page < last THEN w.n + w.k - 1 END AS next_offset FROM r JOIN w ON w.task = r.task AND r.n >= w.n AND r.n < w.n + w.k JOIN m ON m.task = r.task""")
def win_pages(v):
    return W.pages(v.job.select("task", "id", "received"), "task", "id", C("received"), 900000, 20, offset=4).drop("received")


@query("""WITH r AS (SELECT task, id, received, lag(received) OVER (PARTITION BY task ORDER BY id) AS p FROM job) SELECT task, id FROM r WHERE p >= received""")
def win_strict_order(v):
    return W.strict_order(v.job, "task", ["id"], "received").select("task", "id")


@query("SELECT item_id, dt FROM item ORDER BY dt DESC, item_id LIMIT 100")
def top_newest_100(v):
    return W.top_newest(v.item.select("item_id", "dt"), "dt", "item_id", 100)


#: names with accents and more blanks than one
_NAMED = "(SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN replace(name, 'u', 'Ü') ELSE name END AS name, concat('  É ', alias) AS alias) FROM site)"


def _named(v):
    return v.site.withColumns({"name": F.when(C("id") % 2 == 0, F.replace("name", F.lit("u"), F.lit("Ü"))).otherwise(C("name")), "aliases": F.array(F.concat(F.lit("  É "), C("alias")))})


def _search_sql(text, admin):
    fold = "regexp_replace(trim(lower(strip_accents(c))), ' +', ' ', 'g')"
    rank = f"list_min(list_transform([alias, name], lambda c: CASE WHEN {fold} = '{text}' THEN 0.0::DOUBLE WHEN starts_with({fold}, '{text}') THEN 1.0::DOUBLE WHEN contains({fold}, '{text}') THEN 2.0::DOUBLE END))"
    if admin:
        rank += " + CASE WHEN level > 0 THEN 0.1::DOUBLE ELSE 0 END"
    return f"WITH r AS (SELECT id, name, level, country, {rank} AS rank FROM {_NAMED} t), h AS (SELECT *, count(*) OVER () AS total FROM r WHERE rank IS NOT NULL) SELECT id, name, rank, total, total > 20 AS truncated FROM h ORDER BY rank, level, country, name, id LIMIT 20"


@query(_search_sql("supplier#00000001", False))
def top_region_search(v):
    return W.region_search(_named(v), "Supplíer#00000001", 20).select("id", "name", "rank", "total", "truncated")


@query(_search_sql("0001", True))
def top_admin_search(v):
    return W.region_search(_named(v), "0001", 20, True).select("id", "name", "rank", "total", "truncated")


@query("SELECT item_id, (SELECT count(*) FROM item) AS total, 150 AS next_offset, FALSE AS complete FROM item ORDER BY item_id LIMIT 50 OFFSET 100")
def page_offset(v):
    return W.page(v.item.select("item_id"), ["item_id"], 100, 50).select("item_id", "total", "next_offset", "complete")


_PTS = "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(floor(c_custkey * 7 % 500 / 10) AS INT) AS x, CAST(floor(c_custkey * 13 % 80 / 10) AS INT) AS y FROM customer"


def _points(v):
    c = C("c_custkey").cast("bigint")
    return v.customer.select(c.alias("id"), (100 + (c * 7 % 500) * 3).cast("double").alias("px"), (900 - (c * 13 % 80) * 3).cast("double").alias("py"))


@query(f"WITH p AS ({_PTS}) SELECT id, scene, red, CASE WHEN red <> 0 THEN round(red * 0.0000275::DOUBLE - 0.2::DOUBLE, 9) END AS reflectance, red = 0 AS nodata, scl FROM p JOIN px USING (x, y)")
def smp_pixel(v):
    d = J.coordinate_samples(v.px, _points(v), 100.0, 900.0, 30.0, 30.0)
    return d.select("id", "scene", "red", F.when(C("red") != 0, F.round(C("red") * 0.0000275 - 0.2, 9)).alias("reflectance"), (C("red") == 0).alias("nodata"), "scl")


@query(f"WITH p AS ({_PTS}) SELECT id, scene, red, green, blue, (red <> 0 AND green <> 0 AND blue <> 0) AS valid FROM p JOIN px USING (x, y)")
def smp_rgb_pixel(v):
    d = J.coordinate_samples(v.px, _points(v), 100.0, 900.0, 30.0, 30.0)
    return d.select("id", "scene", "red", "green", "blue", ((C("red") != 0) & (C("green") != 0) & (C("blue") != 0)).alias("valid"))


# --- sets and checks


@query("""SELECT CASE WHEN o % 9 = 0 THEN NULL ELSE o // 2 END AS id, count(*) AS copies, count(DISTINCT o % 20 // 18) > 1 AS conflict FROM item WHERE o % 9 <> 0 GROUP BY 1 UNION ALL SELECT NULL, 1, FALSE FROM item WHERE o % 9 = 0""")
def set_page_union(v):
    pages = v.item.select(F.when(C("o") % 9 != 0, F.floor(C("o") / 2)).alias("id"), F.floor(C("o") % 20 / 18).cast("string").alias("body"))
    return K.page_union(pages, "id", C("body")).select("id", "copies", "conflict")


@query("""WITH p AS (SELECT task, task + CASE WHEN id % 97 = 5 THEN 1 ELSE 270 END AS declared FROM job)
SELECT task, min(declared) AS low, max(declared) AS high, count(*) AS rows FROM p GROUP BY task HAVING min(declared) <> max(declared) OR count(*) <> max(declared)""")
def set_declared_total(v):
    pages = v.job.select("task", (C("task") + F.when(C("id") % 97 == 5, 1).otherwise(270)).alias("declared"), F.lit(1).cast("bigint").alias("returned"))
    return K.declared_total(pages, "task", "declared", "returned")


@query("SELECT o AS id, CASE WHEN o % 6 = 0 THEN 'left' ELSE 'right' END AS side FROM item WHERE o % 6 IN (0, 1)")
def set_equal(v):
    return K.set_difference(v.item.where("o % 6 <> 1").select(C("o").alias("id")), v.item.where("o % 6 <> 0").select(C("o").alias("id")))


@query("SELECT o AS id, CASE WHEN o % 4 = 0 THEN 'pinned' ELSE 'offered' END AS href FROM item")
def set_add_scenes(v):
    return K.add_scenes(v.item.where("o % 4 = 0").select(C("o").alias("id"), F.lit("pinned").alias("href")), v.item.select(C("o").alias("id"), F.lit("offered").alias("href")), ["id"])


@query("""SELECT o AS id, a AS asset, CASE WHEN o % 4 = 0 AND (a = 'b1' OR a = 'qa' AND o % 8 = 0) THEN 'pinned' ELSE 'offered' END AS href FROM item, (SELECT unnest(['b1', 'b2', 'qa']) AS a) t WHERE o % 4 <> 0 OR a <> 'b2'""")
def set_add_assets(v):
    rows = lambda d, names, href: d.select(C("o").alias("id"), F.explode(F.array(*map(F.lit, names))).alias("asset"), F.lit(href).alias("href"))
    pinned = rows(v.item.where("o % 4 = 0"), ["b1"], "pinned").unionByName(rows(v.item.where("o % 8 = 0"), ["qa"], "pinned"))
    return K.add_assets(pinned, rows(v.item, ["b1", "b2", "qa"], "offered"), ["qa"])


@query("SELECT task, received % 1000 AS cursor, count(*) AS times FROM job GROUP BY ALL HAVING count(*) > 1")
def set_page_loop(v):
    return K.page_loops(v.job.select("task", (C("received") % 1000).alias("cursor")), "task", "cursor")


@query("SELECT country, count(*) AS n, CASE WHEN country % 2 = 0 THEN count(*) ELSE count(*) + 1 END AS declared FROM site GROUP BY country HAVING country % 2 <> 0 OR count(DISTINCT level) <> 1")
def chk_unit_count(v):
    declared = v.site.groupBy("country").agg((F.count("*") + F.when(C("country") % 2 == 0, 0).otherwise(1)).alias("declared"))
    return K.unit_count(v.site, declared, "country")


@query("SELECT page_id FROM pages WHERE page_id % 10 IN (3, 4)")
def chk_sha256(v):
    files = v.pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    i = C("page_id") % 10
    text = F.when(i == 3, F.concat(F.coalesce("html", F.lit("")), F.lit("x"))).otherwise(F.coalesce("html", F.lit("")))
    recorded = v.pages.select("page_id", (F.octet_length(F.coalesce("html", F.lit(""))) + F.when(i == 4, 1).otherwise(0)).alias("bytes"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    return K.stored_bytes(files, recorded, "page_id")


# --- graphs


@query("""WITH RECURSIVE c AS (SELECT CAST(max(p_partkey) - 222 AS BIGINT) AS id, 0 AS depth FROM part UNION ALL SELECT parent_id, depth + 1 FROM c JOIN job_edge e ON e.id = c.id) SELECT id, depth FROM c""")
def graph_closure(v):
    seeds = v.part.agg((F.max("p_partkey") - 222).cast("bigint").alias("id"))
    return Gr.closure(v.job_edge, seeds)


@query("SELECT id FROM (SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_partkey % 20 < 9) t")
def graph_cycle(v):
    p = C("p_partkey").cast("bigint")
    first = p - p % 10
    d = v.part.where("p_partkey % 20 < 9").select(p.alias("id"), F.when(p % 10 < 3, first + (p % 10 + 1) % 3).otherwise(p - 1).alias("parent_id"))
    return Gr.cyclic_nodes(d)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(floor(log2(CAST(p_partkey + 1 AS DOUBLE)) + 1e-9) AS INT) AS depth FROM part")
def graph_topo_depth(v):
    return Gr.topological_depth(v.job_edge)


@query("""WITH RECURSIVE c AS (SELECT CAST(5 AS BIGINT) AS id UNION ALL SELECT e.id FROM c JOIN job_edge e ON e.parent_id = c.id) SELECT id FROM c""")
def graph_project_jobs(v):
    return Gr.project_jobs(v.job_edge.where("id = 5").select("id"), v.job_edge)


@query("SELECT id, parent_id FROM job_edge WHERE id % 13 = 0")
def graph_bad_pins(v):
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    edges = v.job_edge.withColumn("pinned", F.when(C("id") % 13 == 0, "x").otherwise(sha(C("parent_id"))))
    return Gr.bad_pins(edges, v.part.select(C("p_partkey").cast("bigint").alias("id")).withColumn("sha", sha(C("id"))))


@query("SELECT CAST(s_suppkey AS BIGINT) AS relation_id, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS rings, s_suppkey % 4 <> 0 AS ok FROM supplier")
def graph_ring_assembly(v):
    i = C("s_suppkey").cast("bigint")
    parts = [(1, 0, 1), (2, 2, 1), (3, 2, 0), (4, 5, 6), (5, 6, 5)]
    s = F.explode(F.array(*[F.struct(F.lit(w).alias("way_id"), (i * 10 + a).alias("first_node"), (F.when(i % 4 == 0, i * 10 + b + (1 if w == 3 else 0)).otherwise(i * 10 + b)).alias("last_node")) for w, a, b in parts]))
    return Gr.assemble_rings(v.supplier.select(i.alias("relation_id"), s.alias("s")).select("relation_id", "s.*"))


_SEGMENTS = """SELECT i AS relation_id, pos, list_transform(nodes, lambda k: i * 100 + k) AS nodes FROM (SELECT i, unnest(range(len(ways))) AS pos, unnest(ways) AS nodes FROM (SELECT CAST(s_suppkey AS BIGINT) AS i, CASE s_suppkey % 8
WHEN 0 THEN [[1, 2, 3, 1]] WHEN 1 THEN [[1, 2, 3], [5, 4, 3], [5, 6, 1]] WHEN 2 THEN [[1, 2, 3], [3, 4, 1], [11, 12, 13, 11]] WHEN 3 THEN [[1, 2, 3], [3, 4]] WHEN 4 THEN [[1, 2], [2, 3], [2, 4], [3, 1], [4, 1]]
WHEN 5 THEN [[1, 2, 1], [5, 6, 7, 5]] WHEN 6 THEN [[3, 2, 1], [3, 4, 1]] ELSE [[1, 2], [3, 2], [3, 4], [5, 4], [5, 6], [7, 6], [7, 8], [1, 8]] END AS ways FROM supplier) t) u"""
_WAYS = {0: [[1, 2, 3, 1]], 1: [[1, 2, 3], [5, 4, 3], [5, 6, 1]], 2: [[1, 2, 3], [3, 4, 1], [11, 12, 13, 11]], 3: [[1, 2, 3], [3, 4]], 4: [[1, 2], [2, 3], [2, 4], [3, 1], [4, 1]], 5: [[1, 2, 1], [5, 6, 7, 5]], 6: [[3, 2, 1], [3, 4, 1]], 7: [[1, 2], [3, 2], [3, 4], [5, 4], [5, 6], [7, 6], [7, 8], [1, 8]]}


@query(f"""WITH RECURSIVE seg AS ({_SEGMENTS}),
bad AS (SELECT relation_id FROM (SELECT relation_id, unnest([nodes[1], nodes[-1]]) AS e FROM seg) t GROUP BY relation_id, e HAVING count(*) <> 2),
w AS (SELECT relation_id, nodes AS path, [pos] AS used FROM seg WHERE relation_id NOT IN (SELECT relation_id FROM bad) UNION ALL
SELECT w.relation_id, list_concat(path, CASE WHEN s.nodes[1] = path[-1] THEN s.nodes[2:] ELSE list_reverse(s.nodes)[2:] END), list_append(used, s.pos)
FROM w JOIN seg s ON s.relation_id = w.relation_id AND NOT list_contains(used, s.pos) AND (s.nodes[1] = path[-1] OR s.nodes[-1] = path[-1]) WHERE path[1] <> path[-1]),
c AS (SELECT relation_id, used[1] AS ring, path FROM w WHERE path[1] = path[-1] AND used[1] = list_max(used)), small AS (SELECT relation_id FROM c WHERE len(path) < 4)
SELECT relation_id, ring, array_to_string(path, ',') AS nodes, NULL AS error FROM c WHERE relation_id NOT IN (SELECT relation_id FROM small)
UNION ALL SELECT relation_id, NULL, NULL, 'open' FROM (SELECT DISTINCT relation_id FROM bad) b UNION ALL SELECT DISTINCT relation_id, NULL, NULL, 'degenerate' FROM small""")
def graph_ring_paths(v):
    found = Rg.ring_paths(_segments(v))
    return found.select("relation_id", "ring", F.array_join(F.transform("points", lambda p: p["node"]), ",").alias("nodes"), "error")


def _segments(v):
    i = C("s_suppkey").cast("bigint")
    point = lambda k: F.struct((i * 100 + k).alias("node"), (i * 100 + k).cast("double").alias("x"), F.lit(float(k)).alias("y"))
    ways = None
    for case, own in _WAYS.items():
        a = F.array(*[F.array(*[point(k) for k in way]) for way in own])
        ways = F.when(i % 8 == case, a) if ways is None else ways.when(i % 8 == case, a)
    return v.supplier.select(i.alias("relation_id"), F.posexplode(ways).alias("pos", "points"))


# squares of side 10 in a row; holes of side 2; what is wrong with some: an open ring, a hole outside, a member of another kind, two outers around one hole
@query("""SELECT CAST(s_suppkey AS BIGINT) AS relation_id, CASE s_suppkey % 7 WHEN 0 THEN '5:0' WHEN 1 THEN '5:1' WHEN 2 THEN '5:1,5:1' END AS polygons,
CASE s_suppkey % 7 WHEN 3 THEN 'open' WHEN 4 THEN 'hole' WHEN 5 THEN 'member' WHEN 6 THEN 'no outer ring' END AS error FROM supplier""")
def graph_multipolygon(v):
    i = C("s_suppkey").cast("bigint")
    case = i % 7
    at = lambda x, y: F.struct(F.lit(None).cast("bigint").alias("node"), (i * 50 + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))

    def square(x, y, a, role, kind="way", turned=False):
        c = [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
        half = [c[:3], c[2:][::-1] if turned else c[2:]]
        return [F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), F.array(*[at(*p) for p in h]).alias("points")) for h in half]

    outer, hole = square(0, 0, 10, "outer", turned=True), square(3, 3, 2, "inner")
    away, second, label = square(20, 20, 2, "inner"), square(20, 0, 10, ""), square(1, 1, 1, "label", "node")[:1]
    inside = square(23, 3, 2, "inner", turned=True)
    rows = {0: outer + label, 1: outer + hole, 2: outer + second + hole + inside, 3: outer[:1], 4: outer + away, 5: outer + square(1, 1, 1, "part")[:1], 6: hole}
    members = None
    for k, own in rows.items():
        members = F.when(case == k, F.array(*own)) if members is None else members.when(case == k, F.array(*own))
    d = v.supplier.select(i.alias("relation_id"), F.posexplode(members).alias("pos", "_m")).select("relation_id", "pos", "_m.*")
    found = Rg.multipolygons(d, 5.0)
    text = F.array_join(F.transform("polygons", lambda p: F.concat_ws(":", F.size(p["outer"]).cast("string"), F.size(p["inners"]).cast("string"))), ",")
    return found.select("relation_id", text.alias("polygons"), "error")


@query("""WITH RECURSIVE m AS (SELECT CAST(s_suppkey AS BIGINT) AS relation_id, unnest([0, 1, 2]) AS pos, unnest(['node', CASE WHEN s_suppkey % 11 = 9 THEN 'way' ELSE 'relation' END, CASE WHEN s_suppkey % 11 = 4 THEN 'relation' ELSE 'way' END]) AS type,
unnest([CAST(s_suppkey AS BIGINT) * 7, CASE WHEN s_suppkey % 13 = 5 THEN s_suppkey - s_suppkey % 13 ELSE CAST(s_suppkey AS BIGINT) + 1 END, CASE WHEN s_suppkey % 11 = 4 THEN 999999 ELSE CAST(s_suppkey AS BIGINT) * 3 END]) AS ref FROM supplier),
k AS (SELECT CAST(s_suppkey AS BIGINT) AS r, s_suppkey % 10 = 9 AS area FROM supplier),
w AS (SELECT relation_id AS root, CAST(pos AS VARCHAR) AS path, [relation_id] AS way, type, ref, 1 AS depth FROM m JOIN k ON r = relation_id WHERE NOT area UNION ALL
SELECT root, path || '.' || CAST(m.pos AS VARCHAR), list_append(way, w.ref), m.type, m.ref, depth + 1 FROM w JOIN k ON r = w.ref AND NOT area JOIN m ON m.relation_id = w.ref WHERE w.type = 'relation' AND NOT list_contains(way, w.ref) AND depth <= 8)
SELECT root, path, CASE WHEN type = 'relation' AND area AND NOT list_contains(way, ref) AND depth <= 8 THEN 'area' ELSE type END AS type, ref, CASE WHEN type <> 'relation' THEN NULL WHEN area IS NULL THEN 'missing' WHEN list_contains(way, ref) THEN 'cycle' WHEN depth > 8 THEN 'depth' END AS error
FROM w LEFT JOIN k ON k.r = w.ref AND w.type = 'relation' WHERE NOT (type = 'relation' AND area IS NOT NULL AND NOT area AND NOT list_contains(way, ref) AND depth <= 8)""")
def graph_collections(v):
    i = C("s_suppkey").cast("bigint")
    member = lambda kind, ref: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), ref.cast("bigint").alias("ref"))
    three = F.array(
        member("node", i * 7),
        member(F.when(i % 11 == 9, "way").otherwise("relation"), F.when(i % 13 == 5, i - i % 13).otherwise(i + 1)),
        member(F.when(i % 11 == 4, "relation").otherwise("way"), F.when(i % 11 == 4, 999999).otherwise(i * 3)),
    )
    members = v.supplier.select(i.alias("relation_id"), F.posexplode(three).alias("pos", "_m")).select("relation_id", "pos", "_m.*")
    found = Rg.collections(members, v.supplier.select(i.alias("relation_id"), (i % 10 == 9).alias("area")))
    return found.withColumn("path", F.array_join("path", "."))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey - p_partkey % 10 AS BIGINT) AS cycle FROM part WHERE p_partkey % 20 < 3""")
def graph_cycle_names(v):
    p = C("p_partkey").cast("bigint")
    first = p - p % 10
    d = v.part.where("p_partkey % 20 < 9").select(p.alias("id"), F.when(p % 10 < 3, first + (p % 10 + 1) % 3).otherwise(p - 1).alias("parent_id"))
    return Gr.cycles(d)


# --- datasets


@query("""SELECT o AS id, CASE WHEN o % 5 <> 0 THEN 2018 + o % 5 WHEN o % 7 <> 6 THEN 2020 END AS year, CASE WHEN o % 2 = 0 AND o % 3 = 0 THEN 'blue' WHEN o % 2 = 0 OR o % 7 <> 6 THEN 'red' END AS layer,
CASE WHEN o % 7 = 6 THEN 'dataset' WHEN o % 5 <> 0 AND 2018 + o % 5 > 2020 THEN 'year' WHEN o % 2 = 0 AND o % 3 = 0 THEN 'layer' END AS reason FROM item""")
def res_defaults(v):
    o = C("o")
    req = v.item.select(o.alias("id"), F.when(o % 7 == 6, "none").otherwise("cover").alias("dataset"), F.when(o % 5 != 0, 2018 + o % 5).alias("year"), F.when(o % 2 == 0, F.when(o % 3 == 0, "blue").otherwise("red")).alias("layer"))
    presets = v.spark.createDataFrame([("cover", [2018, 2019, 2020], ["red", "nir"])], "dataset string, years array<long>, layers array<string>")
    return Rs.with_defaults(req, F.broadcast(presets)).select("id", "year", "layer", "reason")


@query("SELECT item_id, CAST(date_trunc('month', dt) AS TIMESTAMP) AS first, CAST(last_day(dt) + 1 AS TIMESTAMP) - INTERVAL 1 SECOND AS last FROM item")
def res_month_window(v):
    a, b = Rs.month_window(F.year("dt"), F.month("dt"))
    return v.item.select("item_id", a.alias("first"), b.alias("last"))


@query("SELECT id FROM site WHERE contains(lower(name), 'supplier') AND contains(lower(name), '5') AND level = 1 AND code = 'C3'")
def res_catalog_filter(v):
    d = v.site.withColumns({"status": C("level").cast("string"), "category": C("code")})
    return Rs.catalog_filter(d, ["SUPPLIER", "5"], C("name"), "1", "C3").select("id")


@query("""WITH s AS (SELECT *, count(*) OVER () AS total FROM site WHERE contains(lower(concat(CAST(id AS VARCHAR), ' ', name, ' ', code)), 'supplier'))
SELECT id, name, total, CASE WHEN total > 3 + 12 THEN 15 END AS next_offset, total <= 15 AS complete FROM s ORDER BY id LIMIT 12 OFFSET 3""")
def res_catalog_page(v):
    return Rs.catalog_page(v.site.select("id", C("name").alias("title"), C("code").alias("category")), "SUPPLIER", 3, 12).select("id", C("title").alias("name"), "total", "next_offset", "complete")


@query(f"WITH areas AS ({_AREAS}) SELECT a.area_id, count(item_id) AS n, count(item_id) > 8 AS refused FROM areas a LEFT JOIN item i ON i.w < a.e AND i.e > a.w AND i.s < a.n AND i.n > a.s GROUP BY a.area_id")
def res_packages(v):
    areas = _areas(v)
    return Rs.packages(areas, J.scenes_in_areas(v.item, areas, 5.0))


