import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from helixframe.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "clash") for p, u, h in rows], SCHEMA)


ROWS = [(k, f"http://h.example/{k}", f"<p>{k % 7}</p>" if k % 2 else f"é {k}") for k in range(60)] + [
    (100, None, None), (101, "http://x y\n", ""), (102, "u", "x" * 300_000), (103, "u", "\r\n\r\nbody\r\n\r\n"), (104, "u", "x" * 300_000), (104, "u", "x" * 300_000),
]


def brute(rows):
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), p)
    out = []
    for p, _, h in rows:
        data, first = (h or "").encode(), last[h or ""]
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    packages = warc.write_packages(frame(spark, ROWS))
    got = warc.read_packages(packages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    text = {p: (h or "") for p, _, h in ROWS}
    assert all(r.payload.decode() == text[r.page_id] for r in got if r.record_type == "response")
    path = packages.first().path
    with zipfile.ZipFile(path.removeprefix("file://")) as z:  # another reader agrees
        assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, warc.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert gzip.decompress(z.read(warc.ARCHIVE)).count(b"WARC/1.1\r\n") == packages.first().records
    wanted = {warc._id(got[0].page_id)}
    assert all(r[0]["WARC-Record-ID"] in wanted for p in packages.collect() for r in warc.read_package(p.path, wanted))


def test_packages_rotate(spark, monkeypatch):
    one = warc.write_packages(frame(spark, ROWS).coalesce(1)).collect()
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 2000)
    rows = warc.write_packages(frame(spark, ROWS).coalesce(1)).collect()
    assert len(rows) > len(one) == 1 and len({r.path for r in rows}) == len(rows)
    assert sum(r.records for r in rows) == len(ROWS)


def test_full_packages_lose_no_rows(spark):
    rows = ROWS + [(k, f"u{k}", f"{k} " * 50) for k in range(1000, 1400)]
    packages = warc.write_packages(frame(spark, rows).coalesce(1), package_bytes=2000)
    assert packages.count() > 20 and sum(r.records for r in packages.collect()) == len(rows)
    got = warc.read_packages(packages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)


def test_reads_zips_of_other_writers():
    for force in (False, True):
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as z:
            z.comment = b"PK\5\6 a comment that looks like an end"
            with z.open("a/ü.bin", "w", force_zip64=force) as f:
                f.write(b"payload")
            z.writestr("deflated", b"d" * 100, compress_type=zipfile.ZIP_DEFLATED)
        data = sink.getvalue()
        read_at = lambda at, n: data[at : at + n]
        members = warc.central_directory(read_at, len(data))
        at = warc.data_start(read_at, members["a/ü.bin"])
        assert data[at : at + members["a/ü.bin"].size] == b"payload"
        with pytest.raises(ValueError):
            warc.data_start(read_at, members["deflated"])
    with pytest.raises(ValueError):
        warc.central_directory(lambda at, n: b"nothing"[at : at + n], 7)


def test_empty(spark):
    assert warc.read_packages(warc.write_packages(frame(spark, []))).count() == 0
