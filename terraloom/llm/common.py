"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.sources.storage import shared_path, written


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share, which no other run uses."""
    return shared_path(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor, and gives later joins plain scans as inputs,
    whose skewed partitions adaptive execution can split.
    """
    return written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n: the fold that splits learned rows from held-out ones."""
    return F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(n))


def utf8(col: str | Column) -> Column:
    """The raw bytes of a text column, so that damaged UTF-8 can't stop a task; null reads as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("binary"), F.lit(b"").cast("binary"))


_turn: tuple[str, Callable[[], None]] | None = None


def take_turn(name: str, forget: Callable[[], None]) -> None:
    """Python workers serve one stage after another; when another operator begins in one, the last one's memory is given up, to the system as well."""
    global _turn
    if _turn is None or _turn[0] != name:
        if _turn is not None:
            _turn[1]()
        _turn = (name, forget)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what they have
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin and count tell, one after another."""
    ends = np.cumsum(count)
    size = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(size, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - (ends - count)).astype(kind), count)
    at += np.arange(size, dtype=kind)
    return flat[at]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows and 16 MB, so that what a task holds follows neither row count nor text length.

    Smaller settings of the session stay.
    """
    for key, most, unit in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000, ""), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20, "b")):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, f"{most}{unit}")


def with_computed(df: DataFrame, keep: list[str], inputs: list[Column | str], fn: Callable[..., list[pa.Array]], fields: list[tuple[str, str]], only: int | None = None) -> DataFrame:
    """`keep` columns of `df`, followed by columns that `fn` computes from the `inputs`, one Arrow batch at a time.

    fn gets one Arrow array per input and returns one per field (name, type). An input given as a name is that column's raw
    bytes (nulls stay); a kept column is not sent twice for it. only: the position among the fields of a boolean by which
    rows are kept; that column itself is left out.
    """
    small_batches(df.sparkSession)
    n = len(keep)
    sent = [c for c in inputs if not (isinstance(c, str) and c in keep)]
    at = [keep.index(c) if isinstance(c, str) and c in keep else n + sum(1 for x in inputs[:k] if not (isinstance(x, str) and x in keep)) for k, c in enumerate(inputs)]
    raw = [isinstance(c, str) for c in inputs]
    extra = [(F.col(f"`{c}`").cast("binary") if isinstance(c, str) else c).alias(f"_i{k}") for k, c in enumerate(sent)]
    taken = df.select(*[F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(keep)], *extra)
    shown = [(k, f) for k, f in enumerate(fields) if k != only]
    names = [f"_k{k}" for k in range(n)] + [f"_o{k}" for k, _ in shown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(*[b.column(k).cast(pa.binary()) if r else b.column(k) for k, r in zip(at, raw, strict=True)])
            out = pa.RecordBatch.from_arrays([*[b.column(k) for k in range(n)], *[made[k] for k, _ in shown]], names=names)
            yield out if only is None else out.filter(made[only])

    kept = T.StructType([T.StructField(f"_k{k}", df.schema[c].dataType) for k, c in enumerate(keep)])
    for k, (_, kind) in shown:
        kept = kept.add(f"_o{k}", T.DataType.fromDDL(kind))
    return taken.mapInArrow(run, kept).toDF(*keep, *[f[0] for _, f in shown])
