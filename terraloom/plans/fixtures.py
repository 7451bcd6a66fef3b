"""Domain tables derived from the given star-schema tables, in one SQL text for Spark and DuckDB.

`DIV` is integer division in either. Pixel scenes come from `explode`, so no table is crossed with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> (names it reads, SQL); LIST(a, b) is the rows a..b-1 as column `k`
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "px": (
        ("part",),
        """SELECT CAST(n AS INT) AS scene, concat('S', lpad(CAST(n AS STRING), 3, '0')) AS item_id, CAST(p % 50 AS INT) AS x, CAST(p DIV 50 AS INT) AS y,
        (p*37 + n*10007) % 12301 - 2300 AS ndvi, (p*53 + n*7919) % 12301 - 2300 AS evi, (p*40503 + n*2654435761) % 65536 AS qa_pixel,
        (p*30103 + n*1103515245) % 4096 AS qa_radsat, (p*2654435 + n*40503) % 65536 AS vi_quality, (p*7 + n*3) % 4 AS vi_rel,
        CASE WHEN (p*31 + n*17) % 9 = 0 THEN 0 ELSE (p*97 + n*211) % 20000 + 1 END AS red,
        CASE WHEN (p*29 + n*19) % 11 = 0 THEN 0 ELSE (p*89 + n*223) % 20000 + 1 END AS green,
        CASE WHEN (p*23 + n*13) % 13 = 0 THEN 0 ELSE (p*83 + n*227) % 20000 + 1 END AS blue,
        (p*7 + n*5) % 12 AS scl, (p*2654435761 + n*40503) % 4294967296 AS qc, (p*48271 + n*69621) % 65536 AS state
        FROM (SELECT CAST(p_partkey AS BIGINT) AS p, EXPLODE(25) AS n FROM part) t""",
    ),
    "item": (
        ("orders",),
        """SELECT concat('I', CAST(o AS STRING)) AS item_id, o AS o, o_orderpriority AS collection_id, CAST(o_orderdate AS DATE) AS dt, CAST((o*13) % 101 AS DOUBLE) AS cloud,
        CAST(o*7919 % 3580 AS DOUBLE)/10 - 180 AS w, CAST(o*104729 % 1780 AS DOUBLE)/10 - 90 AS s,
        CAST(o*7919 % 3580 AS DOUBLE)/10 - 180 + CAST(1 + o % 10 AS DOUBLE)/10 AS e, CAST(o*104729 % 1780 AS DOUBLE)/10 - 90 + CAST(1 + o % 10 AS DOUBLE)/10 AS n
        FROM (SELECT CAST(o_orderkey AS BIGINT) AS o, o_orderpriority, o_orderdate FROM orders) t""",
    ),
    "usage_event": (
        ("events",),
        """SELECT CAST(event_id AS BIGINT) AS event_id, CAST(ts AS TIMESTAMP) AS at, CAST(user_id % 97 AS BIGINT) AS installation, CAST(user_id AS BIGINT) AS session_id, event_type AS name,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('src', CAST(event_id % 6 AS STRING)) END AS source,
        CASE WHEN user_id % 5 = 0 THEN 'development' ELSE 'production' END AS environment,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('surface', CAST(event_id % 4 AS STRING)) END AS surface,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('act', CAST(event_id % 3 AS STRING)) END AS action,
        CASE WHEN event_id % 7 < 3 THEN CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failure' END END AS result,
        CASE WHEN event_id % 11 = 0 THEN concat('err', CAST(event_id % 5 AS STRING)) END AS error, CASE WHEN event_id % 6 < 2 THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('d', CAST(event_id % 3 AS STRING)) END END AS duration,
        CASE event_id % 8 WHEN 1 THEN 'succeeded' WHEN 2 THEN 'failed' WHEN 3 THEN '' END AS status, CASE WHEN event_id % 10 = 0 THEN concat('why', CAST(event_id % 3 AS STRING)) END AS reason, CASE WHEN event_id % 3 = 1 THEN 'transfer' END AS stage,
        CASE WHEN event_id % 4 = 1 THEN '503' END AS http_status, CASE WHEN event_id % 2 = 1 THEN '2' END AS retries, CASE WHEN event_id % 5 = 2 THEN 'explicit' END AS origin, CASE WHEN event_id % 2 = 0 THEN 'desktop' ELSE 'browser' END AS platform, value
        FROM events""",
    ),
    "job_edge": (("part",), "SELECT CAST(p_partkey AS BIGINT) AS id, (CAST(p_partkey AS BIGINT) - 1) DIV 2 AS parent_id FROM part WHERE p_partkey > 0"),
    "credit_grant": (
        ("customer",),
        """SELECT c*3 + k AS grant_id, c AS user_id, (c*7 + k*11) % 6 AS remaining, (c*5 + k) % 3 AS reserved, CASE WHEN (c + k) % 2 = 0 THEN 'trial' ELSE 'paid' END AS kind, CASE WHEN k = 2 THEN NULL ELSE (c*13 + k*5) % 30 END AS expires_day
        FROM (SELECT CAST(c_custkey AS BIGINT) AS c, EXPLODE(3) AS k FROM customer) t""",
    ),
    "poll": (
        ("events",),
        """SELECT CAST(user_id AS BIGINT) AS job_id, CAST(event_id AS BIGINT) AS seq, CAST(ts AS TIMESTAMP) AS at, CASE WHEN event_type = 'signup' THEN 'queued' ELSE 'running' END AS status,
        CAST((event_id * 977) % 100000 AS BIGINT) AS bytes FROM events""",
    ),
    "job": (
        ("orders",),
        """SELECT o AS id, concat('scene', CAST(o % 97 AS STRING)) AS scene, CASE o % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS asset, concat('http://h/', CAST(o % 211 AS STRING)) AS href,
        CASE o % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'interrupted' END AS status,
        CASE WHEN o % 7 = 0 THEN NULL ELSE (o * 977) % 100000 END AS total, (o * 641) % 120000 AS received, o % 53 AS task, o % 11 AS delivery
        FROM (SELECT CAST(o_orderkey AS BIGINT) AS o FROM orders) t""",
    ),
    "site": (
        ("supplier",),
        """SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, s_nationkey AS country, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS level, concat('  ', lower(s_name), ' ') AS alias,
        CASE WHEN s_suppkey % 5 = 0 THEN '-99' ELSE concat('C', CAST(s_suppkey % 7 AS STRING)) END AS code FROM supplier""",
    ),
}


def duck(name: str) -> str:
    text = VIEWS[name][1].replace(" DIV ", " // ")
    for n in (25, 3):
        text = text.replace(f"EXPLODE({n})", f"unnest(range({n}))")
    return text


def spark_sql(name: str) -> str:
    text = VIEWS[name][1]
    for n in (25, 3):
        text = text.replace(f"EXPLODE({n})", f"explode(sequence(0L, {n - 1}L))")
    return text


class Views:
    """The given and derived tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        tables = {t: getattr(self, t) for t in VIEWS[name][0]}
        text = spark_sql(name)
        for t in tables:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self.spark.sql(text, **tables)
