"""One large GeoJSON document, cut into its features without holding it in a row.

The document is read in byte ranges and cut at every closing brace. Whether a piece begins inside a string, and how deeply nested it
begins, are running sums over the pieces in file order: of quotation marks, then of brackets outside strings. An object that ends at depth two
inside the top level's `features` array is a feature; its pieces are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.ranks import running
from terraloom.sources.readers import FEATURE, with_validity
from terraloom.sources.storage import written

_OPENS = r'"features"\s*:\s*\['


def _count(text: Column, *signs: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in signs), F.lit(0))


def _bare(text: Column, inside: bool) -> Column:
    """A piece without its strings; escapes are gone already."""
    return F.regexp_replace(F.concat(F.lit('"'), text) if inside else text, '"[^"]*("|$)', "")


def _depth(bare: Column) -> Column:
    return _count(bare, "{", "[") - _count(bare, "}", "]")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of each file in order: file, block, id, value (without the brace that ends it)."""
    d = spark.read.option("lineSep", "}").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return written(d.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"), "pieces")


def features(spark: SparkSession, path: str) -> DataFrame:
    """file, `place` (in file order) and `text` of each object in the top level's `features` array of each document."""
    order = ["block", "id"]
    cut = pieces(spark, path)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    known = {"quotes": _count(plain, '"')}
    for p in (0, 1):
        bare = _bare(plain, p == 1)
        before = F.regexp_extract(plain, rf"(?s)^(.*?){_OPENS}(?!\s*\])", 1)
        opens = F.when(plain.rlike(rf"{_OPENS}(?!\s*\])"), _depth(_bare(before, p == 1)))
        known |= {f"delta{p}": _depth(bare), f"closes{p}": bare.rlike(r"^[^\[\{]*\]"), f"opens{p}": opens}
    signs = running(cut.select("file", *order, *[c.alias(k) for k, c in known.items()]), ["file"], order, q=("sum", "quotes"))
    start = (F.col("q") - F.col("quotes")) % 2 == 1
    own = lambda k: F.when(start, F.col(f"{k}1")).otherwise(F.col(f"{k}0"))
    ended = F.col("q") % 2 == 0
    signs = signs.select("file", *order, own("closes").alias("closes"), own("opens").alias("opens"), own("delta").alias("delta"), ended.alias("ended"), (own("delta") - ended.cast("int")).cast("bigint").alias("step"))
    deep = running(signs, ["file"], order, place="n", depth=("sum", "step"))
    begin = F.col("depth") - F.col("step")
    here = F.coalesce(begin + F.col("opens") == 1, F.lit(False))  # the array is opened in this piece
    top = (begin <= 1) | ((begin == 2) & F.col("closes"))
    object_ = F.col("ended") & (F.col("depth") == 2)
    deep = deep.select("file", *order, "n", here.alias("here"), object_.cast("bigint").alias("is_end"), F.when(top | here, F.col("n") * 2 + here.cast("int")).otherwise(F.lit(0)).cast("bigint").alias("mode"))
    named = running(deep, ["file"], order, last=("max", "mode"), ends=("sum", "is_end")).where("last % 2 = 1")
    named = named.select("file", *order, "n", "here", "is_end", (F.col("ends") - F.col("is_end")).alias("feature"))
    j = named.join(cut, ["file", *order])
    body = F.when(F.col("here"), F.regexp_replace("value", rf"(?s)^.*?{_OPENS}\s*", "")).otherwise(F.col("value"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("v")))), lambda s: F.concat(s["v"], F.lit("}")))
    text = F.regexp_replace(F.array_join(parts, ""), r"^[^{]*", "")
    whole = j.groupBy("file", "feature").agg(F.min("n").alias("place"), text.alias("text"), F.max("is_end").alias("_whole")).where("_whole = 1")
    return whole.select("file", "place", "text")


def feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON documents, as geojson() gives those of lines, with `valid`. An element that is no object is left out."""
    d = features(spark, path).select(F.from_json("text", FEATURE).alias("f"))
    return with_validity(d.select("f.*"))
