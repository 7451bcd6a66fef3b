import base64
import hashlib

import pytest

from terraloom.llm import warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, digest int")


def test_round_trip_with_hostile_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = [
        (1, "http://a\r\nX: y", "<p>é</p>", 0),
        (2, None, "<p>é</p>", 0),
        (3, "u", None, 0),
        (4, "u", "", 0),
        (5, "u", fake * 3, 0),
        (6, "u", "WARC/1.1\r\n", 0),
        (7, "u", "x" * 50_000 + "\r\n\r\n" + fake + "\r\n\r\n", 0),
        (None, "u", "only", 0),
        (2, None, "<p>é</p>", 0),
        (8, "u", "".join(f"WARC/1.1\r\nContent-Length: {40 * k}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" for k in range(50)) + "end", 0),
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        path = warc.write(rows(spark, data).coalesce(2), path=f"file://{tmp_path}/w")
        got = warc.digests(warc.read(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    main = {}
    for page, _, html, _ in data:
        main[html or ""] = max([p for p in (main.get(html or ""), page) if p is not None], default=None)
    want = []
    for page, _, html, _ in data:
        raw = (html or "").encode()
        m = main[html or ""]
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == m else "revisit", None if page == m else m))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)
    assert all(r.verified for r in got)


def test_small_payloads_and_empty_table(spark, tmp_path):
    path = warc.write(rows(spark, [(1, "u", "aa", 0), (2, "u", "aa", 0), (3, "u", "bbbb", 0), (9, "u", "bbbb", 0)]), min_revisit_bytes=3, path=f"file://{tmp_path}/a")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.digests(warc.read(spark, path)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 9), 9: ("response", None)}
    path = warc.write(rows(spark, []), path=f"file://{tmp_path}/b")
    assert warc.digests(warc.read(spark, path)).count() == 0


def test_broken_chain(spark, tmp_path):
    path = warc.write(rows(spark, [(1, "u", "aa", 0)]), path=f"file://{tmp_path}/c")
    part = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part") and p.stat().st_size)
    raw = part.read_bytes()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc").write_bytes(raw + b"WARC/1.1\r\njunk")
    with pytest.raises(ValueError):
        warc.read(spark, f"file://{tmp_path}/d")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.warc").write_bytes(b"junk" + raw)
    (tmp_path / "e" / "y.warc").write_bytes(raw)
    with pytest.raises(ValueError, match="x.warc"):
        warc.read(spark, f"file://{tmp_path}/e")


def test_damaged_payload(spark, tmp_path):
    path = warc.write(rows(spark, [(1, "u", "aabb", 0)]), path=f"file://{tmp_path}/f")
    part = next(p for p in (tmp_path / "f").iterdir() if p.name.startswith("part") and p.stat().st_size)
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.warc").write_bytes(part.read_bytes().replace(b"aabb", b"aabc"))
    with pytest.raises(Exception, match="not what its record says"):
        warc.digests(warc.read(spark, f"file://{tmp_path}/g")).collect()
