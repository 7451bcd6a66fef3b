"""Counters, ranges, coverage and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.graph import components
from terraloom.operators.ranks import running
from terraloom.sources.storage import written


def stretch_range(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact values at ranks (n-1)*2 div 100 and (n-1)*98 div 100, without interpolation.

    Values are counted first; their running numbers come from ranges of values, so that a raster with as many values as pixels
    has no task that holds a group. Null values don't count.
    """
    counts = px.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    d = written(running(counts, keys, [value], _upto=("sum", "_n")), "stretch")
    whole = d.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.max("_upto").alias("_all"))
    on = F.lit(True)
    for n, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    d = d.join(whole, on)
    at = lambda q: F.floor((F.col("_all") - 1) * q / 100)
    hit = lambda q: (F.col("_upto") > at(q)) & (F.col("_upto") - F.col("_n") <= at(q))
    return d.groupBy(*keys).agg(F.max(F.when(hit(2), F.col(value))).alias("low"), F.max(F.when(hit(98), F.col(value))).alias("high"))


def valid_counts(px: DataFrame, keys: list[str], value: str, nodata: int, low: int, high: int) -> DataFrame:
    v = F.col(value)
    return px.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(v != nodata).alias("valid"), F.count_if((v != nodata) & ~v.between(low, high)).alias("outside"))


def masked_covered(px: DataFrame, keys: list[str], retained: Column, valid: Column) -> DataFrame:
    """Samples that a mask takes out, and valid ones of those retained; a group of which nothing is retained is an error."""
    kept = F.count_if(retained)
    masked = F.when(kept > 0, F.count("*") - kept).otherwise(F.raise_error(F.lit("the mask retains no sample")).cast("bigint"))
    return px.groupBy(*keys).agg(masked.alias("masked"), F.count_if(retained & valid).alias("covered"))


def band_summary(px: DataFrame, bands: list[str], nodata: int, low: int, high: int) -> DataFrame:
    """One row per band: least and greatest valid value, no-data and outside-range counts."""
    long = px.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands])).alias("_b")).select("_b.*")
    ok = F.col("v") != nodata
    return long.groupBy("band").agg(F.min(F.when(ok, F.col("v"))).alias("low"), F.max(F.when(ok, F.col("v"))).alias("high"), F.count_if(~ok).alias("nodata"), F.count_if(ok & ~F.col("v").between(low, high)).alias("outside"))


def ordered_digest(px: DataFrame, value: str, rows_per_block: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 over values in row-major order for every block of rows of each key: keys, `block`, `digest`, `n`. A block's size is bounded by the grid's width."""
    b = px.withColumn("block", F.floor(F.col("y") / rows_per_block).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    text = F.array_join(F.transform(ordered, lambda p: F.coalesce(p["v"].cast("string"), F.lit("-"))), ",")
    return b.groupBy(*keys, "block").agg(F.sha2(text.cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def grid_digest(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Digest of each grid: SHA-256 over the digests of its blocks, in their order; and the samples in all."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda b: b["digest"])
    return blocks.groupBy(*keys).agg(F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))


def bounds_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Union box, and intersection box (null where it is empty)."""
    d = boxes.groupBy(*keys).agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), F.max("w").alias("_w"), F.max("s").alias("_s"), F.min("e").alias("_e"), F.min("n").alias("_n"))
    meets = (F.col("_w") < F.col("_e")) & (F.col("_s") < F.col("_n"))
    return d.select(*keys, "w", "s", "e", "n", *[F.when(meets, F.col(f"_{c}")).alias(f"i{c}") for c in "wsen"])


def geometry_stats(features: DataFrame) -> DataFrame:
    """Feature and coordinate counts by geometry type, with bounds; features: geom_type, ring (array of x, y)."""
    p = features.select("geom_type", F.explode("ring").alias("_p"), F.monotonically_increasing_id().alias("_id"))
    boxes = p.groupBy("geom_type").agg(F.count("*").alias("positions"), F.min("_p.x").alias("w"), F.min("_p.y").alias("s"), F.max("_p.x").alias("e"), F.max("_p.y").alias("n"))
    return features.groupBy("geom_type").agg(F.count("*").alias("features")).join(boxes, "geom_type")


def coverage_cells(areas: DataFrame, scenes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells of each area cut by its scenes' edges (coordinate compression): area_id, cell box, size, covering scenes.

    pairs: area_id, item_id of overlapping boxes. Cells of one area number the square of its scenes' edges: scenes are dealt to the
    strips between edges that they span, and the cells of a strip look for the first of its scenes, which are its only ones.
    """
    j = pairs.join(scenes.select("item_id", "rank", F.col("w").alias("sw"), F.col("s").alias("ss"), F.col("e").alias("se"), F.col("n").alias("sn")), "item_id").join(areas, "area_id")
    cut = lambda lo, hi, a, b: F.array(F.greatest(lo, a), F.least(hi, b))
    edges = j.groupBy("area_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union(cut("w", "e", "sw", "se"), F.array("w", "e")))))).alias("xs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union(cut("s", "n", "ss", "sn"), F.array("s", "n")))))).alias("ys"),
    )
    between = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, i + 1).alias("b")))
    strips = edges.select("area_id", F.explode(between(F.col("xs"))).alias("x"), "ys")
    spans = j.join(edges.select("area_id", "xs"), "area_id").withColumn("x", F.explode(F.filter(between(F.col("xs")), lambda x: (x["a"] >= F.col("sw")) & (x["b"] <= F.col("se")))))
    own = spans.groupBy("area_id", "x").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "ss", "sn"))).alias("over"))
    cells = strips.join(own, ["area_id", "x"], "left").withColumn("y", F.explode(between(F.col("ys"))))
    first = F.get(F.filter("over", lambda o: (o["ss"] <= F.col("y.a")) & (o["sn"] >= F.col("y.b"))), F.lit(0))
    cells = cells.withColumn("_f", first).select("area_id", F.col("x.a").alias("cw"), F.col("y.a").alias("cs"), F.col("x.b").alias("ce"), F.col("y.b").alias("cn"), F.col("_f.rank").alias("first_rank"), F.col("_f.item_id").alias("first_item"))
    return cells.withColumn("size", (F.col("ce") - F.col("cw")) * (F.col("cn") - F.col("cs")))


def coverage_report(cells: DataFrame) -> DataFrame:
    """Covered share of each area and the number of gap cells; complete if the gap is at most 1e-10 of the whole."""
    d = cells.groupBy("area_id").agg(F.sum("size").alias("_all"), F.sum(F.when(F.col("first_rank").isNotNull(), F.col("size")).otherwise(0.0)).alias("_in"), F.count_if(F.col("first_rank").isNull()).alias("gaps"))
    return d.select("area_id", (F.col("_in") / F.col("_all")).alias("fraction"), "gaps", (F.col("_all") - F.col("_in") <= 1e-10 * F.col("_all")).alias("complete"))


def gap_boxes(cells: DataFrame) -> DataFrame:
    """Bounding box of each connected gap of an area: area_id, cell count, w, s, e, n. Cells are connected over common sides."""
    gaps = cells.where("first_rank is null").select("area_id", "cw", "cs", "ce", "cn").withColumn("id", F.monotonically_increasing_id())
    gaps = written(gaps, "gaps")
    other = lambda **names: gaps.select("area_id", F.col("id").alias("other"), *[F.col(a).alias(b) for a, b in names.items()])
    right = gaps.join(other(cw="ce", cs="cs", cn="cn"), ["area_id", "ce", "cs", "cn"])
    above = gaps.join(other(cs="cn", cw="cw", ce="ce"), ["area_id", "cn", "cw", "ce"])
    pairs = right.select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(above.select(F.col("id").alias("a"), F.col("other").alias("b")))
    label = components(pairs).withColumnRenamed("node", "id")
    named = gaps.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    return named.groupBy("area_id", "label").agg(F.count("*").alias("cells"), F.min("cw").alias("w"), F.min("cs").alias("s"), F.max("ce").alias("e"), F.max("cn").alias("n")).drop("label")


def covering_selection(cells: DataFrame, most: int) -> DataFrame:
    """Newest-first greedy cover: a scene is kept exactly if it is the first one (least rank) over some cell, as a scene that
    is passed over adds nothing; of these the first `most` by rank."""
    kept = cells.where("first_rank is not null").select("area_id", F.col("first_item").alias("item_id"), F.col("first_rank").alias("rank")).distinct()
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("area_id").orderBy("rank"))).where(F.col("place") <= most)


def usage_report(events: DataFrame) -> DataFrame:
    """All ten grouped counters of the usage report in one scan: `report`, key columns k1-k7, `n`. An empty field counts as absent.

    Every event is exploded into the reports that it belongs to, so there is one shuffle with map-side sums.
    """
    c, other = F.col, lambda k, absent="other": F.coalesce(F.col(k), F.lit(absent))
    has = lambda k: F.coalesce(F.col(k), F.lit("")) != ""
    keys = [f"k{i}" for i in range(1, 8)]

    def row(name, *parts, where=None):
        out = F.struct(F.lit(name).alias("report"), *[p.alias(k) for k, p in zip(keys, [*parts, *[F.lit("")] * 7], strict=False)])
        return out if where is None else F.when(where, out)

    reports = F.array(
        row("event", c("name")),
        row("source", other("source"), c("name")),
        row("surface", other("surface"), c("name")),
        row("day", F.date_format("at", "yyyy-MM-dd"), c("name")),
        row("environment", c("environment")),
        row("outcome", other("source"), other("action"), c("result"), where=has("result")),
        row("duration", other("source"), other("action"), c("duration"), where=has("duration")),
        row("terminal", other("source"), other("surface"), c("status"), where=has("status")),
        row("failure", other("source"), other("action"), c("error"), where=has("error")),
        row("diagnostic", other("source"), c("name"), other("stage", "unavailable"), other("reason", "unavailable"), other("http_status", "unknown"), other("retries", "unknown"), other("origin", "unavailable"), where=has("reason") | has("error")),
    )
    return events.select(F.explode(F.filter(reports, lambda r: r.isNotNull())).alias("_r")).select("_r.*").groupBy("report", *keys).agg(F.count("*").alias("n"))


def usage_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_distinct("installation").alias("installations"), F.count_distinct("session_id").alias("sessions"))


def campaign(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """Funnel per source over production events, without excluded installations; browser and desktop are never joined."""
    e = events.where("environment = 'production' and source is not null").join(excluded, "installation", "left_anti")
    web, desk = F.col("platform") == "browser", F.col("platform") == "desktop"
    at = lambda n: desk & (F.col("name") == n)
    return e.groupBy("source").agg(
        F.count_if(web & (F.col("name") == "view")).alias("views"), F.count_distinct(F.when(web, F.col("installation"))).alias("browsers"), F.count_distinct(F.when(desk, F.col("installation"))).alias("desktops"),
        F.count_distinct(F.when(at("signup"), F.col("installation"))).alias("first_runs"), F.count_if(at("purchase")).alias("completed"), F.count_distinct(F.when(at("purchase"), F.col("installation"))).alias("completing"), F.count_if(at("error")).alias("failures"),
    )


STATUSES = ["queued", "running", "succeeded", "failed", "cancelled", "interrupted"]


def job_status(jobs: DataFrame) -> DataFrame:
    """Counts for all statuses, zero included."""
    names = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def delivery_state(jobs: DataFrame, key: str, expected: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """State of each delivery. jobs: key, id, seq, status, settled; the last row of an id stands, and an unsettled success is not done.

    expected: (key, id) of the jobs that a delivery is to have (others are left out, and `missing` counts those without a row);
    groups: (key) of all deliveries: one without any job is `saved`.
    """
    rows = jobs.groupBy(key, "id").agg(F.max_by(F.struct("status", "settled"), "seq").alias("_j")).select(key, "id", "_j.*")
    if expected is not None:
        rows = expected.select(key, "id").distinct().join(rows, [key, "id"], "left")
    if groups is not None:
        rows = groups.select(key).distinct().join(rows, key, "left")
    here = F.count_if(F.col("status").isNotNull())
    d = rows.groupBy(key).agg(
        F.count("id").alias("total"),
        F.count_if((F.col("status") == "succeeded") & F.coalesce("settled", F.lit(True))).alias("done"),
        F.count_if(F.col("status").isin("queued", "running")).alias("active"),
        F.count_if(F.col("status").isin("failed", "interrupted", "cancelled")).alias("attention"),
        (F.count("id") - here).alias("missing"),
    )
    state = F.when(F.col("total") == 0, "saved").when(F.col("done") == F.col("total"), "ready").when(F.col("active") > 0, "active").when((F.col("attention") > 0) & (F.col("done") > 0), "partial").when(F.col("attention") > 0, "attention").otherwise("pending")
    return d.withColumn("state", state)


def task_summary(jobs: DataFrame, key: str) -> DataFrame:
    """Totals; bytes are known only if every size is; progress is clamped to the size."""
    known = F.bool_and(F.coalesce(F.col("total") > 0, F.lit(False)))
    s = lambda *names: F.count_if(F.col("status").isin(*names))
    d = jobs.groupBy(key).agg(F.count("*").alias("jobs"), s("succeeded").alias("ready"), s("failed", "interrupted").alias("failed"), s("running").alias("running"), s("queued").alias("queued"), s("cancelled").alias("cancelled"), known.alias("known"), F.sum(F.greatest(F.lit(0), F.col("received"))).alias("transferred"), F.sum("total").alias("_t"), F.sum(F.least(F.col("total"), F.greatest(F.lit(0), F.col("received")))).alias("_p"))
    status = F.when(F.col("failed") > 0, "attention").when(F.col("ready") == F.col("jobs"), "complete").when(F.col("running") > 0, "running").when(F.col("queued") > 0, "queued").when(F.col("cancelled") > 0, "stopped").otherwise("submitted")
    return d.select(key, "jobs", "ready", "failed", "running", "queued", "transferred", F.when(F.col("known"), F.col("_t")).alias("total_bytes"), F.when(F.col("known"), F.col("_p")).alias("progress_bytes"), status.alias("status"))


def token_usage(records: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Token use of each request. requests: key, running, truncated; records: key, id, seq, linked, state, origin, input, output, cached, reasoning, tools.

    The last record of an id stands, whole. A detail (cached, reasoning) is null unless every known record has it, at most as
    large as its parent. Without records a running request is pending, another unavailable; it is partial while it runs, where the
    ledger was truncated, where a record is not linked by the request's own id, or where its tokens are unknown.
    """
    fields = ["linked", "state", "origin", "input", "output", "cached", "reasoning", "tools"]
    last = records.groupBy(key, "id").agg(F.max_by(F.struct(*fields), "seq").alias("_r")).select(key, "id", "_r.*")
    known = F.col("input").isNotNull() & F.col("output").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0))

    def detail(c, parent):
        return F.when(F.bool_and(~known | F.coalesce(F.col(c) <= F.col(parent), F.lit(False))) & (F.count_if(known) > 0), F.sum(F.when(known, F.col(c))))

    origin = lambda name: F.count_if(F.col("origin") == name)
    sums = [
        F.count("*").alias("requests"), F.count_if(known).alias("known_requests"), F.bool_and("linked").alias("_linked"), total("input").alias("input"), total("output").alias("output"),
        detail("cached", "input").alias("cached_input"), detail("reasoning", "output").alias("reasoning_output"), F.count_if(F.col("state") == "failed").alias("failed_requests"),
        origin("workflow").alias("workflow_requests"), origin("compaction").alias("compaction_requests"), F.when(F.bool_and(F.col("tools").isNotNull()), F.max("tools")).alias("max_tools"),
    ]
    d = requests.join(last.groupBy(key).agg(*sums), key, "left")
    zero = ["requests", "known_requests", "input", "output", "failed_requests", "workflow_requests", "compaction_requests"]
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    partial = F.col("running") | F.col("truncated") | ~F.col("_linked") | (F.col("known_requests") < F.col("requests"))
    status = F.when(F.col("requests") == 0, F.when(F.col("running"), "pending").otherwise("unavailable")).when(partial, "partial").otherwise("complete")
    return d.select(key, status.alias("status"), *zero, (F.col("input") + F.col("output")).alias("total"), "cached_input", "reasoning_output", "max_tools")


def token_by_request(rows: DataFrame, session: str, order: str) -> DataFrame:
    """Each work row belongs to the last user row before it; turns that more than one request claims are left out."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("request", F.last(F.when(F.col("kind") == "user", F.col(order)), ignorenulls=True).over(w)).where("request is not null and kind <> 'user'")
    clear = own.groupBy("turn").agg(F.count_distinct(session, "request").alias("_k")).where("_k = 1").select("turn")
    return own.join(clear, "turn", "left_semi").groupBy(session, "request").agg(F.count_distinct("turn").alias("turns"))


def credit_buckets(grants: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """Available and reserved credit and nearest expiry by key (user and kind), of grants that expire after today or never, spent ones included."""
    live = grants.where(F.col("expires_day").isNull() | (F.col("expires_day") > today))
    return live.groupBy(*keys).agg(F.sum("remaining").alias("available"), F.sum("reserved").alias("reserved"), F.min("expires_day").alias("nearest"))


def budget_used(runs: DataFrame, keys: list[str], today: Column) -> DataFrame:
    used = F.when(F.col("status").isin("queued", "running"), F.col("received")).when(F.col("status") == "succeeded", F.col("total"))
    return runs.groupBy(*keys).agg(F.coalesce(F.sum(used), F.lit(0)).alias("used"), F.coalesce(F.sum(F.when(F.col("day") == today, used)), F.lit(0)).alias("used_today"))


def receipt_totals(pages: DataFrame) -> DataFrame:
    return pages.agg(F.sum("bytes").alias("bytes"), F.sum("returned").alias("returned"), F.count_distinct("url").alias("urls"), (F.sum("returned") >= F.sum("features")).alias("ok"))


def country_manifest(units: DataFrame) -> DataFrame:
    return units.groupBy("country").agg(F.count("*").alias("features"), F.sum("bytes").alias("bytes"), F.count_if(F.col("limitation") != "").alias("limited"))


def tile_contents(tiles: DataFrame) -> DataFrame:
    """Addressed tiles and distinct contents per zoom level."""
    return tiles.groupBy("z").agg(F.count("*").alias("tiles"), F.count_distinct(F.sha2(F.col("data").cast("binary"), 256)).alias("contents"))
