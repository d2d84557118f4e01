"""WARC: exact round trip and refusals."""
import base64
import hashlib
import io

import pytest

from peakgrid.llm import warc

KIND = "page_id long, url string, html string, payload string"


def test_round_trip(spark):
    html = ["<p>é</p>", None, "", "same", "same", "same", "big " * 200_000, "a\r\n\r\nb", "same"]
    rows = [(i, f"http://x/{i}\r\n", h, "clash") for i, h in enumerate(html)] + [(None, None, "same", None), (8, "u", "same", None)]
    df = spark.createDataFrame(rows, KIND)
    path = warc.shared_path(spark, "test")
    got = warc.read_archives(warc.write_archives(df, path), path).collect()
    assert len(got) == len(rows)
    last = {}
    for page, _, h, _ in rows:
        if page is not None:
            last[h or ""] = max(last.get(h or "", -1), page)
    by_page = {}
    for r in got:
        by_page.setdefault(r.page_id, []).append(r)
    for page, _, h, _ in rows:
        data = (h or "").encode()
        for r in by_page[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            fresh = page is None or last[h or ""] == page
            assert r.record_type == ("response" if fresh else "revisit") and r.refers_to == (None if fresh else last[h or ""])
            assert r.payload == (data if fresh else None)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_reader_refuses_damage():
    good = warc.record(1, "http://x", b"payload", None) + warc.record(2, "http://y", b"", 1)
    assert [warc.parse(m)[0]["warc-type"] for m in warc.members(io.BytesIO(good))] == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good[:-9])))
    raw = next(warc.members(io.BytesIO(good)))
    for bad in (raw.replace(b"payload\r\n", b"paYload\r\n"), raw.replace(b"Content-Length: ", b"Content-Length: 1"), raw[3:]):
        with pytest.raises(ValueError):
            warc.parse(bad)
