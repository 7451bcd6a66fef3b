"""Ordered operators: first or last of a key, progress rates, allocation, pages, searches, previews."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terraloom.functions.text import fold_text, folded
from terraloom.operators.ranks import running
from terraloom.sources.storage import written


def dedup_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key. An aggregate (least struct) instead of a window, so a hot key is combined on the map side."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    d = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return d.select(*keys, "_r.*").select(*rows.columns)


def dedup_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    d = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return d.select(*keys, "_r.*").select(*rows.columns)


def progress_rate(polls: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Bytes a second between polls: a restart (fewer bytes) or a change of status resets it, and no progress gives null."""
    w = Window.partitionBy(key).orderBy(order)
    prev = lambda c: F.lag(c).over(w)
    going = (F.col("status") == "running") & (prev("status") == "running") & (F.col("bytes") >= prev("bytes"))
    ms = F.timestamp_diff("MILLISECOND", prev("at"), F.col("at"))
    rate = F.when(going & (F.col("bytes") > prev("bytes")) & (ms > 0), (F.col("bytes") - prev("bytes")) * 1000 / ms)
    return polls.select(key, order, "status", "bytes", F.coalesce(going, F.lit(False)).alias("continuing"), rate.alias("rate"))


def fifo_allocate(grants: DataFrame, amounts: DataFrame, today: Column, user: str = "user_id") -> DataFrame:
    """Spend from grants that expire after today by earliest expiry (none last), then id; a user without enough in total gets nothing."""
    live = grants.where(F.col("expires_day").isNull() | (F.col("expires_day") > today)).join(amounts, user)
    w = Window.partitionBy(user).orderBy(F.asc_nulls_last("expires_day"), "grant_id")
    before = F.coalesce(F.sum("remaining").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("remaining").over(Window.partitionBy(user))
    d = live.withColumns({"_b": before, "_t": total}).where(F.col("_t") >= F.col("amount"))
    spent = F.least(F.greatest(F.col("amount") - F.col("_b"), F.lit(0)), F.col("remaining"))
    return d.select(user, "grant_id", spent.alias("spent")).where("spent > 0")


def page_budget(rows: DataFrame, group: str, order: str, size: Column, max_bytes: int, max_rows: int) -> DataFrame:
    """First page of each group: rows while their sizes add up to at most `max_bytes`, at most `max_rows`."""
    w = Window.partitionBy(group).orderBy(order)
    d = rows.withColumns({"_n": F.row_number().over(w), "_b": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return d.where((F.col("_n") <= max_rows) & (F.col("_b") <= max_bytes)).drop("_n", "_b")


def pages(rows: DataFrame, group: str, order: str, size: Column, max_bytes: int, max_rows: int, offset: int = 0) -> DataFrame:
    """All pages of each group from `offset` rows on: the rows with `page` (from 1), `page_offset` and `next_offset` (null on the last page).

    A page takes rows while their sizes add up to at most `max_bytes`, at most `max_rows`. A row that is larger by itself is an error. Every
    row's next page start comes from running sizes, for rows and limits in one order. Within blocks of rows the pages are followed
    one by one; from block to block they are found by jumping 1, 2, 4... blocks. Rows with a null group are a group; null sizes count as 0.
    """
    small = F.when(F.coalesce(size, F.lit(0)) > max_bytes, F.raise_error(F.lit("one entry exceeds the page's bytes")).cast("bigint")).otherwise(F.coalesce(size, F.lit(0)))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_g")
    placed = running(rows.select("*", key, small.cast("bigint").alias("_s")), ["_g"], [order], place="_n", _b=("sum", "_s"))
    placed = written(placed.where(F.col("_n") > offset), "pages")
    limits = placed.select("_g", F.lit(1).alias("_kind"), (F.col("_b") - F.col("_s") + max_bytes).alias("_v"), "_n", F.lit(0).cast("bigint").alias("_one"))
    sums = placed.select("_g", F.lit(0).alias("_kind"), F.col("_b").alias("_v"), "_n", F.lit(1).cast("bigint").alias("_one"))
    met = running(limits.unionByName(sums), ["_g"], ["_v", "_kind"], _fit=("sum", "_one")).where("_kind = 1")
    reach = F.least(F.col("_n") + max_rows, F.col("_fit") + offset + 1).alias("_to")
    # rows lie in blocks; a block tells for each row at which a page from an earlier block may end where its pages lead
    block = (F.expr(f"_n div {_BLOCK}")).alias("_block")
    jumps = written(met.select("_g", block, "_n", reach), "page-jumps")
    ways = written(_by_block(jumps, _way_out(max_rows, offset), "_g string, _n long, _to long, _last long, _pages long"), "page-ways")
    starts, count = written(ways.where(F.col("_n") == offset + 1).select("_g", "_n", F.lit(1).cast("bigint").alias("_page")), "page-starts"), -1
    jump, seen = ways.drop("_last"), 0
    while seen != count:
        seen = count
        on = starts.join(jump, ["_g", "_n"]).select("_g", F.col("_to").alias("_n"), (F.col("_page") + F.col("_pages")).alias("_page"))
        starts = written(starts.unionByName(on.join(jump.select("_g", "_n"), ["_g", "_n"], "left_semi")).distinct(), "page-starts")
        count = starts.count()
        ahead = jump.select("_g", F.col("_n").alias("_to"), F.col("_to").alias("_next"), F.col("_pages").alias("_more"))
        jump = written(jump.join(ahead, ["_g", "_to"], "left").select("_g", "_n", F.coalesce("_next", "_to").alias("_to"), (F.col("_pages") + F.coalesce("_more", F.lit(0))).alias("_pages")), "page-hops")
    # every block has one page that leads into it from before, or is begun by the first page
    hops = starts.join(ways, ["_g", "_n"]).where(F.expr(f"_to div {_BLOCK} > _last div {_BLOCK}"))  # the last page may end in its block
    into = hops.select("_g", F.explode(F.expr(f"sequence(_last div {_BLOCK} + 1, _to div {_BLOCK})")).alias("_block"), F.col("_last").alias("_from"), F.col("_to").alias("_into"), (F.col("_page") + F.col("_pages") - 1).alias("_before"))
    first = starts.where(F.col("_n") == offset + 1).select("_g", block, F.lit(None).cast("bigint").alias("_from"), F.col("_n").alias("_into"), F.lit(0).cast("bigint").alias("_before"))
    rows_of = placed.groupBy("_g").agg(F.max("_n").alias("_rows"))
    leads = into.unionByName(first).join(rows_of, "_g").where(F.col("_block") <= F.expr(f"_rows div {_BLOCK}")).withColumn("_n", F.lit(0).cast("bigint"))
    whole = placed.drop("_s", "_b").join(jumps.drop("_block"), ["_g", "_n"]).withColumn("_block", block)
    shown = StructType([*rows.schema.fields, *[StructField(c, LongType()) for c in ("page", "page_offset", "next_offset")]])
    return _by_block(whole.unionByName(leads, allowMissingColumns=True), _paged(rows.columns), shown)


#: rows of a group that lie in one block
_BLOCK = 4096


def _by_block(rows: DataFrame, fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType | str) -> DataFrame:
    """fn(table, edges) for runs of whole blocks (_g, _block), each sorted by _n; edges: where a block begins, and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held is None or not held.num_rows:
                continue
            g, k = held.column("_g").combine_chunks(), held.column("_block").to_numpy()
            edge = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False), True])
            if b is not None:  # the last block may go on in the next batch
                edge = edge[:-1]
            if len(edge) > 1:
                yield from fn(held.slice(0, edge[-1]), edge).to_batches()
                held = held.slice(edge[-1])

    return rows.repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_n").mapInArrow(run, schema)


def _way_out(max_rows: int, offset: int) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    """For rows at which a page from an earlier block may end: the first page start after the block (_to), the last in it, and how many pages lead there."""

    def fn(t: pa.Table, edge: np.ndarray) -> pa.Table:
        n, to, block = (t.column(c).to_numpy() for c in ("_n", "_to", "_block"))
        at = np.arange(len(n))
        ahead = at + to - n
        inside = ahead < np.repeat(edge[1:], np.diff(edge))
        last, pages = np.where(inside, ahead, at), inside.astype(np.int64)
        while not np.array_equal(last, further := last[last]):
            pages, last = pages + pages[last], further
        some = (n - np.maximum(block * _BLOCK, offset + 1) < max_rows) | (n == offset + 1)
        return pa.table({"_g": t.column("_g").filter(pa.array(some)), "_n": n[some], "_to": to[last][some], "_last": n[last][some], "_pages": pages[some] + 1})

    return fn


def _paged(columns: list[str]) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    """Page, its offset and the next one of each row; a block's first row (_n = 0) tells of the page that leads into it."""

    def fn(t: pa.Table, edge: np.ndarray) -> pa.Table:
        n, to = t.column("_n").to_numpy(), t.column("_to").to_numpy()
        heads = t.take(pa.array(edge[:-1]))
        before, into, rows = (heads.column(c).to_numpy() for c in ("_before", "_into", "_rows"))
        came = heads.column("_from").fill_null(0).to_numpy()
        size = np.diff(edge)
        ahead = np.arange(len(n)) + np.nan_to_num(to).astype(np.int64) - n
        begin = edge[:-1] + 1
        entry = np.where(size > 1, begin + into - n[np.minimum(begin, len(n) - 1)], edge[1:])
        steps, marks, number = ahead.tolist(), [], []
        for i, end, page in zip(entry.tolist(), edge[1:].tolist(), before.tolist(), strict=True):
            while i < end:  # one turn per page
                page += 1
                marks.append(i)
                number.append(page)
                i = steps[i]
        # the page of a row is the last one begun in its block, or that which leads into it
        marks, number = np.array(marks, np.int64), np.array(number, np.int64)
        unit = np.repeat(np.arange(len(size)), size)
        place = np.searchsorted(marks, np.arange(len(n)), side="right") - 1
        own = place >= 0
        own[own] = marks[place[own]] >= edge[unit[own]]
        page, start, after = before[unit], came[unit], into[unit]
        page[own], start[own], after[own] = number[place[own]], n[marks[place[own]]], np.nan_to_num(to[marks[place[own]]]).astype(np.int64)
        real = n > 0
        made = {"page": pa.array(page[real]), "page_offset": pa.array(start[real] - 1), "next_offset": pa.array(after[real] - 1, mask=(after > rows[unit])[real])}
        shown = t.select(columns).filter(pa.array(real))
        for c, x in made.items():
            shown = shown.append_column(c, x)
        return shown

    return fn


def ranked(rows: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """All rows with their place (from 1) in one order, worked out by ranges: no task sorts them all."""
    return running(rows, [], order, place=place)


def strict_order(rows: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """Rows whose key does not rise over that of the row before."""
    prev = F.lag(key).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_p", prev).where(F.col("_p") >= F.col(key)).drop("_p")


def top_newest(items: DataFrame, day: str, key: str, n: int = 100) -> DataFrame:
    return items.orderBy(F.desc(day), F.asc(key)).limit(n)


def region_search(regions: DataFrame, text: str, n: int, countries_first: bool = False) -> DataFrame:
    """Regions by match of name and aliases, all folded: exact 0, prefix 1, contained 2; then level, country, name, id. `total` counts all."""
    t = folded(text)
    score = lambda c: F.when(c == t, 0.0).when(c.startswith(t), 1.0).when(F.contains(c, F.lit(t)), 2.0)
    # all names of a region are folded in one call, with a separator that folding leaves alone
    names = F.transform(F.split(fold_text(F.array_join(F.array_append("aliases", F.col("name")), "\ue000", "")), "\ue000"), lambda x: F.trim(x))
    rank = F.array_min(F.transform("_names", score))
    if countries_first:
        rank = rank + F.when(F.col("level") > 0, 0.1).otherwise(0.0)
    hits = regions.withColumn("_names", names).withColumn("rank", rank).where("rank is not null").drop("_names")
    total = hits.agg(F.count("*")).scalar()
    best = hits.orderBy("rank", "level", "country", "name", "id").limit(n)
    return best.withColumn("total", total).withColumn("truncated", F.col("total") > n)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page with `total`, `next_offset` (null at the end) and `complete`; the total is one row."""
    total = rows.agg(F.count("*")).scalar()
    part = rows.orderBy(*order).offset(offset).limit(limit)
    end = offset + limit
    return part.withColumn("total", total).withColumns({"next_offset": F.when(F.col("total") > end, F.lit(end)), "complete": F.col("total") <= end})


def preview(px: DataFrame, width: int, height: int, pw: int, ph: int) -> DataFrame:
    """Nearest decimation: preview cell (i, j) shows source pixel (floor(i * width / pw), floor(j * height / ph))."""
    spark = px.sparkSession
    xs = spark.range(pw).select(F.col("id").cast("int").alias("i"), F.floor(F.col("id") * width / pw).cast("int").alias("x"))
    ys = spark.range(ph).select(F.col("id").cast("int").alias("j"), F.floor(F.col("id") * height / ph).cast("int").alias("y"))
    return px.join(F.broadcast(xs), "x").join(F.broadcast(ys), "y")  # at most the preview's side, 768 by design
