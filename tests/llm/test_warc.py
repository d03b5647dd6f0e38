import gzip
import hashlib
import random

import pytest

from tablewright.llm import warc
from tablewright.llm.durable import scratch
from tablewright.llm.queries import op7_warc


def expected(pages):
    first = {}
    for p, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100:
            first.setdefault(b, []).append(p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        ids = [x for x in first.get(b, []) if x is not None]
        refers = min(ids) if ids and min(ids) != p else None
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    long = "".join(rnd.choice("aé漢\r\n<>WARC/1.1") for _ in range(60000))
    pages = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "short"), (4, "u\r\nX: y", "short"), (9, "u", long), (5, "u", long), (6, "u", "z" * 100), (7, "u", "z" * 100), (8, "u", "z" * 99), (10, "u", "z" * 99)]
    pages += [(11, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (12, "u", "q" * 40000), (12, "u", "q" * 40000), (13, "u", "q" * 40000), (None, "u", "z" * 100), (None, "u", "only without id" * 9)]
    spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op7_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op7_warc(spark, str(tmp_path)).collect() == []


def test_segments_from_other_files_and_in_any_order(spark):
    path = scratch(spark, "segments")
    body = ("päge " * 9000).encode()
    digest = hashlib.sha256(body).hexdigest()
    parts = list(warc.records(1, "u", body, digest, None, segment=5000))
    assert len(parts) > 5
    rows = [(p[:-2],) for p in reversed(parts)]
    spark.createDataFrame(rows, "value binary").repartition(4).selectExpr("cast(value as string) value").write.option("lineSep", "\r\n").text(path)
    (only,) = warc.responses(warc.parsed(spark, path)).collect()
    assert bytes(only.payload) == body and only.page_id == 1


@pytest.mark.parametrize("damage", [lambda p: p[:2] + p[3:], lambda p: p[:-1], lambda p: [*p[:-1], p[-1].replace(b"Total-Length: ", b"Total-Length: 1")]])
def test_damaged_segments(damage):
    parts = [dict(f, block=b) for record in damage(list(warc.records(1, "u", b"x" * 50000, "d", None, segment=5000))) for f, b in warc.parse(record)]
    rows = [{"segment": int(p["warc-segment-number"]), "block": p["block"]} for p in parts]
    total = next((int(p["warc-segment-total-length"]) for p in parts if "warc-segment-total-length" in p), None)
    with pytest.raises(ValueError, match="segments"):
        warc.joined(rows, total)


def test_parse_gzip_members_and_breaks():
    one, two = (next(iter(warc.records(i, "u", b"abc" * 10**i, "d", None))) for i in (1, 6))
    both = list(warc.parse(gzip.compress(one) + gzip.compress(two) + gzip.compress(one * 3)))
    assert [len(b) for _, b in both] == [len(b) for _, b in warc.parse(one + two + one * 3)] and len(both) == 5
    for broken in (one[:-3], one[:40], b"GARBAGE" + one, gzip.compress(two)[:-200]):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_chunks():
    for n in (0, 1, 4096, 4097, 20000):
        assert warc.dechunked(warc.chunked(b"x" * n)) == b"x" * n
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
