"""Column functions of text, JSON, hashes, times and labelled ranges."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(text: str) -> str:
    """Compatibility-decomposed, without combining marks, lower case, single blanks."""
    return " ".join("".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).lower().split())


def fold_text(c: Column) -> Column:
    """folded() of a column. Spark has no decomposition of its own, so this is a vectorised UDF."""

    def fold(s: pd.Series) -> pd.Series:
        return s.map(folded, na_action="ignore")

    return F.pandas_udf(fold, "string")(c)


def stable_id(c: Column) -> Column:
    """UUID-shaped text of the first 16 bytes of the SHA-256."""
    return F.regexp_replace(F.substring(F.sha2(c.cast("binary"), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def fingerprint(**parts: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are written."""
    body = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    return F.sha2(body.cast("binary"), 256)


def file_declared(size_a: Column, size_b: Column, multihash: Column) -> tuple[Column, Column, Column]:
    """Declared size, SHA-256 out of a multihash with prefix 1220, and whether the declarations conflict."""
    digest = F.when(multihash.rlike("^1220[0-9a-f]{64}$"), F.substring(multihash, 5, 64))
    conflict = F.coalesce(size_a != size_b, F.lit(False)) | (multihash.isNotNull() & digest.isNull())
    return F.coalesce(size_a, size_b), digest, conflict


def json_node(c: Column, path: str) -> tuple[Column, Column, Column]:
    """Kind, size in bytes and SHA-256 of the node at a path of a JSON text."""
    node = F.try_variant_get(F.try_parse_json(c), path, "variant")
    text = F.to_json(node)
    head = F.substring(text, 1, 1)
    kind = F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(text.isin("true", "false"), "boolean").when(text.isNull() | (text == "null"), "null").otherwise("number")
    return kind, F.octet_length(text), F.sha2(text.cast("binary"), 256)


def ranges(c: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """Label of the first step that the value is below."""
    out = None
    for limit, label in steps:
        out = F.when(c < limit, label) if out is None else out.when(c < limit, label)
    return out.otherwise(last)


def bucket_duration(ms: Column) -> Column:
    return ranges(ms, [(1000, "lt_1s"), (3000, "1_3s"), (10000, "3_10s"), (30000, "10_30s"), (120000, "30_120s"), (600000, "120_600s")], "gte_600s")


def bucket_count(n: Column) -> Column:
    return ranges(n, [(1, "0"), (2, "1"), (6, "2_5"), (21, "6_20"), (101, "21_100"), (1001, "101_1000")], "gte_1001")


def bucket_bytes(n: Column) -> Column:
    mib = 1 << 20
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0").otherwise(ranges(n, [(mib, "lt_1mib"), (10 * mib, "1_10mib"), (100 * mib, "10_100mib"), (1024 * mib, "100_1024mib"), (10240 * mib, "1_10gib")], "gte_10gib"))


# Patterns by which a message is classified, after the error's name; the first that matches wins.
ERROR_PATTERNS = [
    ("timeout", "timed? ?out|timeout"),
    ("authorization", "401|403|unauthori[sz]ed|forbidden|credential|login|sign.?in"),
    ("storage", "disk|storage|no space|permission denied"),
    ("network", "network|fetch|connection|offline|502|503|504"),
    ("validation", "invalid|mismatch|unsupported|not match|validation"),
]


def classify_error(message: Column, name: Column | None = None) -> Column:
    """Class of an error: AbortError is cancelled and TimeoutError a timeout by name, all others go by their message."""
    name, text = F.lit("") if name is None else F.coalesce(name, F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    out = F.when(name == "AbortError", "cancelled").when(name == "TimeoutError", "timeout")
    for label, pattern in ERROR_PATTERNS:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise("unknown")


def source_from_href(href: Column, hosts: dict[str, str], suffixes: dict[str, str]) -> Column:
    """Source of a URL's host: an exact name, or a domain suffix; `other` otherwise."""
    host = F.lower(F.try_parse_url(href, F.lit("HOST")))
    out = F.when(host.isNull(), "other")
    for name, label in hosts.items():
        out = out.when(host == name, label)
    for suffix, label in suffixes.items():
        out = out.when((host == suffix) | host.endswith("." + suffix), label)
    return out.otherwise("other")


def month_after(day: Column, months: int = 1) -> Column:
    """The same day of a later month, or that month's last day."""
    return F.add_months(day, months)


def time_supported(instants: DataFrame, dims: str, at: str) -> DataFrame:
    """`supported`: whether `at` (timestamp) is a member of the list `dims` of instants and start/end/period entries.

    One expression a row: repeated rows stay. Periods: PnD, PnW, PTnH, PTnM, PTnS by seconds; PnM and PnY by calendar months.
    """
    when = F.col(at)

    def member(entry: Column) -> Column:
        part = lambda k: F.split_part(F.trim(entry), F.lit("/"), F.lit(k))
        start, end, period = F.try_to_timestamp(part(1)), F.try_to_timestamp(part(2)), part(3)
        n = F.nullif(F.regexp_extract(period, "^PT?([0-9]+)[DWHMSY]$", 1), F.lit("")).cast("bigint")
        timed, unit = period.startswith("PT"), F.right(period, F.lit(1))
        seconds = F.when(~timed & (unit == "D"), n * 86400).when(~timed & (unit == "W"), n * 604800).when(timed & (unit == "H"), n * 3600).when(timed & (unit == "M"), n * 60).when(timed & (unit == "S"), n)
        months = F.when(~timed & (unit == "M"), n).when(~timed & (unit == "Y"), n * 12)
        gap = (F.year(when) - F.year(start)) * 12 + F.month(when) - F.month(start)
        by_month = (gap >= 0) & (gap % months == 0) & ((start + F.make_interval(months=gap)) == when)
        regular = (when >= start) & (when <= end) & (n > 0) & F.coalesce(F.timestamp_diff("SECOND", start, when) % seconds == 0, by_month)
        size = F.size(F.split(entry, "/"))
        return F.coalesce(F.when(size == 1, start == when).when(size == 3, regular), F.lit(False))

    return instants.withColumn("supported", F.coalesce(F.exists(F.split(dims, ","), member), F.lit(False)))


def date_defaults(today: Column) -> tuple[Column, Column]:
    """The last thirty days."""
    return F.date_sub(today, 30), today


def month_span(first: Column, last: Column) -> tuple[Column, Column]:
    """From the first day of the first month to the last day of the last."""
    return F.trunc(first, "month"), F.last_day(last)


def alias_list(*names: Column) -> Column:
    """All names, trimmed, without empty ones and -99, unique and sorted."""
    trimmed = F.transform(F.array(*names), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & (x != "-99"))))
