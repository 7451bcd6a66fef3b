"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing. Each page is one record, written by Spark's text writer with the record separator CRLF CRLF as line separator, so
the files are plain WARC files on any store, committed task by task. Of pages with equal payloads (of at least
`min_revisit_bytes`) the one with the largest id is a response; the others are revisits, which carry HTTP headers only. A
payload that very many pages share stays spread: its largest id comes from an aggregate with map-side maxima, and the join
back has plain scans on both sides, whose skewed partitions adaptive execution splits.

Reading. Files are read in byte ranges, each range cut at every occurrence of the version line. Whatever follows one is a
candidate record: its task emits the candidate's offset and, from Content-Length, its successor's. A version line inside a
payload makes a candidate too, even one whose own chain looks right. Pointer jumping from the start of each file keeps
what is reachable: jump tables of 1, 2, 4, ... records are joined to themselves until no jump is left, and the reached set
doubles with each. Length and digest of every payload are taken from the bytes read: at once where no version line lies in
it, else in a second pass over the parts of such reachable records, hashed in their order (across batches and ranges).

Edge cases: null html is an empty payload; null url gives no target line; control characters in a url are percent-encoded;
null ids are written as `null`; rows that repeat the response's id and payload are responses too; an empty table gives no
records. A chain that does not begin at the start of its file or breaks off before its end is an error, and so is a payload
that differs from what its record says.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import materialize, new_path, small_batches

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*)$")


def base32_sha1(col: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    digest = F.sha1(col.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def assign(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int) -> DataFrame:
    """page, url, html, digest and `refers_to` (null for a response)."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    # only payloads that are there more than once
    largest = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.max("page").alias("main"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(materialize(largest, "warc-main"), ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page").eqNullSafe(F.col("main")) & F.col("main").isNotNull(), F.col("main")))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", path: str | None = None) -> str:
    """Write one record per page; returns the folder of the archives."""
    path = path or new_path(pages.sparkSession, "warc")
    rows = assign(pages, id_col, url_col, html_col, min_revisit_bytes)
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    none = F.lit("")
    url = F.col("url")
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, none).otherwise(F.col("html")))
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(none),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    text = rows.withColumn("block", block).select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))
    text.write.option("lineSep", END).text(path)
    return path


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for row in raw.split(b"\r\n"):
        if m := _FIELD.match(row):
            out[m[1].decode("latin-1").lower()] = m[2].decode("utf-8", "replace")
    return out


_VERSION = VERSION.encode()


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, in the order of the file within each range: file, range, size of file, v."""
    return spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("v"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """Rows of _rows() one by one: file, range, size, bytes from the first row of the range, v."""
    key, at = None, 0
    for b in batches:
        for file, begin, size, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            v = v.as_py()
            if (file, begin) != key:
                key, at = (file, begin), 0
            yield file, begin, size, at, v
            at += len(v) + len(_VERSION)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per occurrence of the version line, and one for what precedes the first of a file (offset -10, no successor).

    file, range, at, size of file, offset, successor's offset (null: no record), header fields, HTTP fields, `ahead` (bytes
    before the payload, in the row), `left` (bytes of the payload), `computed`: its digest, null where it goes on in other rows.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for file, begin, size, at, v in _placed(batches):
            row = dict.fromkeys(arrow) | {"file": file, "range": begin, "size": size, "at": at, "length": len(v) + len(_VERSION)}
            end = v.find(b"\r\n\r\n")
            head = _fields(v[:end]) if end >= 0 else {}
            if head.get("content-length", "").isdigit():
                stop = end + 4 + int(head["content-length"])
                row |= {"hop": len(_VERSION) + stop + 4, "head": list(head.items())}
                cut = v.find(b"\r\n\r\n", end + 4, stop)
                if cut >= 0:
                    row |= {"http": list(_fields(v[end + 4 : cut]).items()), "ahead": cut + 4, "left": stop - cut - 4}
                    if stop <= len(v):
                        row["computed"] = base64.b32encode(hashlib.sha1(v[cut + 4 : stop]).digest()).decode()
            rows.append(row)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in arrow.items()], names=list(arrow))
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in arrow.items()], names=list(arrow))

    text_map = pa.map_(pa.string(), pa.string())
    number = dict.fromkeys(("range", "size", "at", "length", "hop"), pa.int64())
    arrow = {"file": pa.string(), **number, "head": text_map, "http": text_map, "ahead": pa.int64(), "left": pa.int64(), "computed": pa.string()}
    schema = "file string, range long, size long, at long, length long, hop long, head map<string, string>, http map<string, string>, ahead long, left long, computed string"
    small_batches(spark)
    found = materialize(_rows(spark, path).mapInArrow(parts, schema), "warc-candidates")
    # ranges of one file follow each other without a gap: their lengths add up to each one's first offset
    ranges = found.groupBy("file", "range").agg(F.sum("length").alias("bytes"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    # a row follows its version line
    placed = found.join(materialize(ranges, "warc-ranges"), ["file", "range"]).withColumn("offset", F.col("base") + F.col("at") - len(_VERSION))
    hop = F.when(F.col("offset") >= 0, F.col("offset") + F.col("hop"))
    return placed.select("file", "range", "at", "size", "offset", hop.alias("successor"), "head", "http", "ahead", "left", "computed")


def reachable(edges: DataFrame) -> DataFrame:
    """(file, offset) of what is reached from offset 0 over (file, offset, successor), by pointer jumping."""
    jump = materialize(edges.where("successor is not null").select("file", "offset", F.col("successor").alias("to")), "warc-jump")
    there = edges.select("file", F.col("offset").alias("to"))
    jump = materialize(jump.join(there, ["file", "to"], "left_semi").select("file", "offset", "to"), "warc-jump")
    reached = materialize(edges.where("offset = 0").select("file", "offset"), "warc-reached")
    while jump.take(1):
        further = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = materialize(reached.unionByName(further), "warc-reached")
        twice = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("then"))
        jump = materialize(jump.join(twice, ["file", "to"]).select("file", "offset", F.col("then").alias("to")), "warc-jump")
    return reached


def _hashed(spark: SparkSession, path: str, all_: DataFrame, open_: DataFrame) -> DataFrame:
    """(file, offset, computed) of records whose payload goes on in other rows."""
    own = all_.join(open_.select("file").distinct(), "file", "left_semi").select("file", "range", "at", "offset")
    record = Window.partitionBy("file").orderBy("offset", F.col("record").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    marks = open_.select("file", F.lit(None).cast("long").alias("range"), F.lit(None).cast("long").alias("at"), "offset", F.struct("offset", "successor", "ahead", "left").alias("record"))
    marked = own.withColumn("record", F.lit(None).cast(marks.schema["record"].dataType)).unionByName(marks)
    # each row with the last open record that begins at or before it
    parts = marked.withColumn("r", F.last("record", ignorenulls=True).over(record)).where("range is not null and offset < r.successor")
    parts = materialize(parts.select("file", "range", "at", "offset", F.col("r.offset").alias("record"), "r.ahead", "r.left"), "warc-parts")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, begin, _, at, v in _placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin]), pa.array([at]), pa.array([v], pa.binary())], names=["file", "range", "at", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a record follow each other: the first one holds `ahead` bytes before the payload, the others a version line."""
        key, digest, left = None, None, 0
        for b in batches:
            for file, record, ahead, size, v in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if (file, record) != key:
                    key, digest, left, v = (file, record), hashlib.sha1(), size, v[ahead:]
                else:
                    v = _VERSION + v
                digest.update(v[:left])
                if left > 0 >= left - len(v):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([record]), pa.array([base64.b32encode(digest.digest()).decode()])], names=["file", "offset", "computed"])
                left -= len(v)

    bytes_ = _rows(spark, path).mapInArrow(placed, "file string, range long, at long, v binary").join(parts, ["file", "range", "at"])
    dealt = bytes_.repartition("file", "record").sortWithinPartitions("file", "record", "offset")
    return dealt.select("file", "record", "ahead", "left", "v").mapInArrow(run, "file string, offset long, computed string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: `file`, `offset`, `head` and `http` (maps of fields), `payload_bytes`, `computed` (digest of the payload)."""
    all_ = candidates(spark, path)
    kept = all_.where("offset >= 0").join(reachable(all_.select("file", "offset", "successor")), ["file", "offset"])
    ends = all_.select("file", "size").distinct().join(kept.groupBy("file").agg(F.max("successor").alias("end")), "file", "left").where("end is null or end != size")
    if broken := ends.take(1):
        raise ValueError(f"record chain breaks off in {broken[0]['file']}")
    open_ = kept.where("left is not null and computed is null")
    kept = kept.select("file", "offset", "head", "http", F.col("left").alias("payload_bytes"), "computed")
    if open_.take(1):
        later = materialize(_hashed(spark, path, all_, open_), "warc-hashed").withColumnRenamed("computed", "later")
        kept = kept.join(later, ["file", "offset"], "left").withColumn("computed", F.coalesce("computed", "later")).drop("later")
    return materialize(kept, "warc-records")


def digests(records: DataFrame, id_col: str = "page_id", id_type: str = "long") -> DataFrame:
    """Length and digest of each page's full payload, record type, and the page that a revisit refers to.

    A response's are those of the bytes read, a revisit's those of the response that it refers to. `verified`: the record says so
    too; a record that says otherwise is an error.
    """
    page = lambda c: F.when(c == "<urn:page:null>", None).otherwise(F.regexp_extract(c, "^<urn:page:(.*)>$", 1)).cast(id_type)
    head = lambda k: F.col("head")[k]
    own = records.select(
        page(head("warc-record-id")).alias(id_col),
        "payload_bytes",
        "computed",
        head("warc-type").alias("record_type"),
        page(head("warc-refers-to")).alias("refers_to"),
        F.col("http")["content-length"].cast("long").alias("_bytes"),
        F.regexp_replace(head("warc-payload-digest"), "^sha1:", "").alias("_digest"),
    )
    response = F.col("record_type") == "response"
    main = materialize(own.where(response).select(F.col(id_col).alias("refers_to"), F.col("payload_bytes").alias("_b"), "_digest", F.col("computed").alias("_c")).distinct(), "warc-responses")
    revisits = own.where(~response).drop("payload_bytes", "computed").join(main, ["refers_to", "_digest"], "left").withColumnsRenamed({"_b": "payload_bytes", "_c": "computed"})
    both = own.where(response).unionByName(revisits)
    verified = F.coalesce((F.col("payload_bytes") == F.col("_bytes")) & (F.col("computed") == F.col("_digest")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("a payload is not what its record says: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast("string")
    return both.select(id_col, "payload_bytes", F.when(verified, F.col("computed")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to", verified.alias("verified"))
