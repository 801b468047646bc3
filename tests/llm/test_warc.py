import base64
import hashlib
import io

import pytest

from stockloom.llm import warc
from stockloom.llm.common import run_folder

PAGES = [(1, "http://a/", "<p>x</p>", "extra"), (2, "http://b/", "<p>x</p>", ""), (3, None, None, ""), (4, "http://d/\r\nX: y", "", ""), (5, "u", "é" * 300_000, ""), (5, "u", "é" * 300_000, ""), (None, "n", "<p>x</p>", ""), (6, "ü", "text\r\n\r\nWARC/1.1\r\n", "")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string")


def test_round_trip(spark):
    back = warc.read_archives(warc.write_archives(frame(spark), run_folder(spark, "t"))).collect()
    assert len(back) == len(PAGES)
    largest = {}
    for p, _, h, _ in PAGES:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h, _ in PAGES:
        h = h or ""
        again = p is None or p < largest[h]
        sha = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want.append((p, "revisit" if again else "response", len(h.encode()), sha, largest[h] if again else None, None if again else h.encode()))
    key = lambda t: repr(t[:5])
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.html is None else bytes(r.html)) for r in back), key=key) == sorted(want, key=key)
    assert {r.url for r in back if r.page_id == 4} == {"http://d/%0D%0AX: y"}


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(frame(spark, []), run_folder(spark, "t"))).count() == 0


def test_reader_finds_damage():
    good = warc.record(1, "u", b"payload " * 30_000, None)
    two = good + warc.record(2, "u", b"", 1)
    assert [r.headers["WARC-Type"] for r in warc.Reader(io.BytesIO(two))] == ["response", "revisit"]
    for bad in (two[:-9], good[: len(good) // 2], good[:40] + b"\0\0\0" + good[43:], b"no gzip at all"):
        with pytest.raises(warc.Damaged):
            list(warc.Reader(io.BytesIO(bad)))


def test_reader_checks_digests():
    import gzip

    plain = gzip.decompress(warc.record(1, "u", b"payload", None))
    for bad in (plain.replace(b"payload", b"PAYLOAD"), plain + b"more", plain.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.Damaged):
            list(warc.Reader(io.BytesIO(gzip.compress(bad))))
