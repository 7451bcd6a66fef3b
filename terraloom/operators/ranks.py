"""Places and running aggregates of ordered rows, however many rows a key has.

A window hands each key to one task. Here the sorted rows lie in ranges of about equal size; a range holds its own running
values, and what lies before it comes from the totals of the ranges, of which there is one row per range and key. Only a
range's first key can begin in an earlier range, so the carried totals are at most as many as there are ranges; they alone
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.sources.storage import written

_KINDS = {"sum": F.sum, "bit_xor": F.bit_xor, "max": F.max}


def running(df: DataFrame, keys: list[str], order: list[str | Column], place: str | None = None, **aggregates: tuple[str, str | Column]) -> DataFrame:
    """`df` with the `place` of each row within its keys (from 1, by `order`, ascending, nulls first) and running aggregates up to and with the row.

    aggregates: name -> (kind, column), of the kinds sum, bit_xor and max; none of their inputs may be null. Null keys are a
    key of their own; columns that begin with _rk_ are the function's own. Rows that tie have places in no stated order; many equal rows are spread over ranges all the same.
    """
    names = list(aggregates)
    by = [F.col(f"_rk_b{k}") for k in range(len(order))]
    inputs = [(F.col(c) if isinstance(c, str) else c).alias(f"_rk_v{k}") for k, (_, c) in enumerate(aggregates.values())]
    ordered = [(F.col(c) if isinstance(c, str) else c).alias(f"_rk_b{k}") for k, c in enumerate(order)]
    rows = written(df.select("*", *ordered, *inputs), "ranks")
    dealt = rows.withColumn("_rk_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, *by, "_rk_tie")
    parts = written(dealt.withColumn("_rk_part", F.spark_partition_id()), "ranges")

    kinds = [_KINDS[kind] for kind, _ in aggregates.values()]
    totals = parts.groupBy("_rk_part", *keys).agg(F.count("*").alias("_rk_n"), *[f(f"_rk_v{k}").alias(f"_rk_t{k}") for k, f in enumerate(kinds)])
    before = Window.partitionBy(*keys).orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_rk_part").alias("_rk_p"), *[F.col(c).alias(f"_rk_k{k}") for k, c in enumerate(keys)],
        F.sum("_rk_n").over(before).alias("_rk_n0"), *[f(f"_rk_t{k}").over(before).alias(f"_rk_c{k}") for k, f in enumerate(kinds)],
    ).where("_rk_n0 is not null")
    same = F.col("_rk_part") == F.col("_rk_p")
    for k, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_rk_k{k}"))

    own = Window.partitionBy("_rk_part", *keys).orderBy(*by, "_rk_tie").rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_rk_n", F.count("*").over(own)).withColumns({f"_rk_r{k}": f(f"_rk_v{k}").over(own) for k, f in enumerate(kinds)})
    out = local.join(F.broadcast(carried), same, "left")
    shown = [F.col(f"`{c}`") for c in df.columns]
    if place:
        shown.append((F.col("_rk_n") + F.coalesce("_rk_n0", F.lit(0))).alias(place))
    for k, ((kind, _), name) in enumerate(zip(aggregates.values(), names, strict=True)):
        r, c = F.col(f"_rk_r{k}"), F.col(f"_rk_c{k}")
        joined = {"sum": r + c, "bit_xor": r.bitwiseXOR(c), "max": F.greatest(r, c)}[kind]
        shown.append(F.when(c.isNull(), r).otherwise(joined).alias(name))
    return out.select(*shown)
