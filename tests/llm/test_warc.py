"""WARC round trip, and archives that are damaged."""

from __future__ import annotations

import glob
import gzip
import hashlib
import random
from collections import Counter

import pytest

from logwarden.llm import warc
from logwarden.llm.warc import BadRecord, member, parse, read_members, read_warc, record, write_warc

BIG = "<p>é</p>" * 400


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", "".join(rng.choices("abc <>", k=rng.randint(0, 4000)))) for i in range(80)]
    rows += [(100, "u", BIG), (101, "v", BIG), (102, None, BIG), (103, "a\r\nb: %", "x" * 999), (104, "w", "x" * 999), (105, None, None)]
    rows += [(106, "e", ""), (None, "n", BIG), (107, "once", "y" * 1000), (102, None, BIG), (None, "k", "only null" * 200)]
    rows += [(None, "l", "only null" * 200), (108, "odd", "a\0b\x1f\x8b\r\n\r\nWARC/1.1\r\n" * 60)]
    return rows


def expected(rows):
    last: dict = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 1000 and page is not None:
            last[html] = max(last.get(html, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = last.get(html) if last.get(html) != page else None
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    return Counter(out)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    write_warc(df, f"{tmp_path}/w")
    got = read_warc(spark, f"{tmp_path}/w").collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(pages())
    texts = Counter((r.page_id, r.payload.decode()) for r in got if r.record_type == "response")
    assert texts == Counter((p, h or "") for p, _, h in pages() if not (h == BIG and p != 102))
    # any gzip reader can read the archives
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/part-*"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages())


def test_empty_table_and_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "t", "digest?", 3)], "page_id long, url string, html string, digest string, last int")
    write_warc(df, f"{tmp_path}/a")
    assert read_warc(spark, f"{tmp_path}/a").count() == 1
    write_warc(df.limit(0), f"{tmp_path}/b")
    assert read_warc(spark, f"{tmp_path}/b").count() == 0


def test_members_end_with_zero():
    long = bytes(17 << 20)
    for data in (b"", b"abc", long):
        found = list(read_members(memoryview(member(data) + b"\0")))
        assert found == ([data] if data else [])


def test_damage_is_found():
    good = record(1, "u", b"payload", None, False)
    assert parse(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r", b"paylaod\r"), good[:-2], good.replace(b"WARC/1.1", b"XARC/1.1"),
                good.replace(b"Content-Length: ", b"Content-Width: "), good + b"x"):
        with pytest.raises(BadRecord):
            parse(bad)
    packed = member(good) + b"\0"
    with pytest.raises(BadRecord):
        list(read_members(memoryview(packed[:-9])))
    with pytest.raises(BadRecord):
        list(read_members(memoryview(packed + b"junk")))
    assert len(list(read_members(memoryview(packed * 3)))) == 3


def test_small_slices(monkeypatch):
    monkeypatch.setattr(warc, "SLICE", 7)
    packed = b"".join(member(record(i, "u", b"p" * i, None, False)) + b"\0" for i in range(20))
    assert [len(parse(x)["payload"]) for x in read_members(memoryview(packed))] == list(range(20))
