import hashlib
import zlib

import numpy as np
import pytest

from helixframe.llm import jpeg as J


def padded(data):
    units = max(1, -(-len(data) // J.UNIT))
    return data + b"\xff" * (units * J.UNIT - len(data)), units


def payloads():
    rng = np.random.default_rng(1)
    out = [b"", b"a", b"hello " * 300, bytes(range(256)) * 5, b"\0" * 700, b"\1" * 700, b"\0\1\2" * 500, b"\xff" * 2000]
    out += [bytes(rng.integers(0, high, 3000, dtype=np.uint8)) for high in (2, 3, 5, 255)]
    out.append(bytes(rng.choice([0] * 30 + [1, 2, 200], 5000).astype(np.uint8)))
    return out


def test_round_trip_and_serial_decoder():
    made = [padded(b) for b in payloads()]
    files = J.encode_many(np.frombuffer(b"".join(p for p, _ in made), np.uint8), np.array([u for _, u in made]))
    frames = J.decode_many(files)
    images = J.tensors(frames)
    for (payload, _), file, frame, image in zip(made, files, frames, images):
        assert J.payload_of(frame).tobytes() == payload
        serial = J.decode(file)
        assert all((a == b).all() for a, b in zip(serial.blocks, frame.blocks))
        assert (J.tensor(serial) == image).all()
        alone = J.encode_many(np.frombuffer(payload, np.uint8), np.array([len(payload) // J.UNIT]))
        assert alone == [file]


def test_wide_images(monkeypatch):
    monkeypatch.setattr(J, "MCU_ROWS", 3)
    payload, units = padded(b"some text of several units " * 150)
    file = J.encode_many(np.frombuffer(payload, np.uint8), np.array([units]))[0]
    frame = J.decode_many([file])[0]
    assert frame.mcus[1] > 1 and J.payload_of(frame).tobytes() == payload
    assert (J.tensors([frame])[0] == J.tensor(J.decode(file))).all()


def test_interleaved_dc_and_end_of_band_runs():
    """A file of another shape: interleaved DC scan, no restarts, a run of ended bands."""
    dc = J.DC.segment(0, 0)
    eob = J.Huffman([0, 2] + [0] * 14, [0x00, 0x10])
    bits = ""
    code = lambda h, s: format(int(h.code[s]), f"0{int(h.size[s])}b")
    for value in (5, 0, 0):  # one MCU of three components: differences 5, 0, 0
        size = int(value).bit_length()
        bits += code(J.DC, size) + (format(value, f"0{size}b") if size else "")
    pack = lambda b: bytes(int((b + "1" * (-len(b) % 8))[k : k + 8], 2) for k in range(0, len(b), 8))
    sof = b"\xff\xc2\x00\x11\x08\x00\x08\x00\x08\x03" + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([16] * 64) + sof + dc + eob.segment(1, 0)
    data += b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x00\x00" + pack(bits)
    data += b"\xff\xda\x00\x08\x01\x01\x00\x01\x3f\x00" + pack(code(eob, 0x00)) + b"\xff\xd9"
    image = J.tensor(J.decode(data))
    assert image.shape == (8, 8, 3) and (image == 138).all()
    with pytest.raises(ValueError):
        J.decode(b"GIF89a")


def test_store(spark, tmp_path):
    texts = [None, "", "plain", "é😀" * 400, "long " * 30_000, "plain"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in J.store(docs, rgb=True).collect()}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        payload, _ = padded(data)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        image = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert J.feature(image) == r.feature
    assert rows[2][1:] == rows[5][1:] and J.store(docs.limit(0)).count() == 0
    folder = f"file://{tmp_path}/kept"
    kept = {r.doc_id: r for r in J.store(docs, folder=folder).collect()}
    for k, r in kept.items():  # the stored bytes are those that were described
        with open(r.media_path.removeprefix("file://"), "rb") as file:
            file.seek(r.media_start)
            assert file.read(r.media_bytes) == r.media == rows[k].media
    again = J.decode_media(J.store(docs).selectExpr("doc_id as id", "media").union(spark.sql("select 99L, cast(null as binary)")))
    assert {r.id: r.rgb for r in again.collect()} == {**{k: r.rgb for k, r in rows.items()}, 99: None}
