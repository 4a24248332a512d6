import hashlib
import random
import zlib

import pytest

from quillspark.llm import ogg as O


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 7, 100_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = O.padded(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[n:]) <= {255} and payload
    media = O.write(payload)
    found = O.read(media)
    assert found["payload"] == payload and found["streams"] == (2 if len(payload) else 0) and media == O.write(payload)
    own = -(-len(payload) // 576 // 2)
    assert found["seconds"] == own * 576 / O.RATE


def test_checksum():
    for n in (0, 1, 40, 300):
        data = random.Random(n).randbytes(n)
        assert O.checksum(data) == slow_checksum(data)


def test_damage_is_found():
    media = bytearray(O.write(O.padded(b"x" * 5000)))
    for at in (6, 30, 200, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            O.read(bytes(broken))
    for n in range(0, len(media), 37):
        with pytest.raises((ValueError, IndexError)):
            O.read(bytes(media[:n]))


def test_damaged_rows_and_times(spark):
    good = O.write(O.padded(b"x" * 5000))
    rows = [(1, 5000, good), (2, 5000, good[:-1]), (3, 5000, good[:40] + b"?" + good[41:]), (4, 0, None), (5, 0, b"")]
    media = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in rows], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in O.read_back(media).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 9 * 576
    assert all(got[i]["error"] and got[i]["payload_bytes"] is None for i in (2, 3, 4, 5))
    times = O.packet_times(media).collect()
    assert sum(r["error"] is not None for r in times) == 4
    for stream, n in ((0, 5), (1, 4)):
        own = sorted((r["packet"], r["seconds"], r["until"]) for r in times if r["stream"] == stream)
        assert own == [(k, k * 576 / O.RATE, (k + 1) * 576 / O.RATE) for k in range(n)]


def test_wrong_granules_are_found():
    import struct

    media = bytearray(O.write(O.padded(b"y" * 40_000)))
    pages = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    for at in pages[2:]:
        end = next((p for p in pages if p > at), len(media))
        broken = bytearray(media)
        broken[at + 6 : at + 14] = struct.pack("<q", struct.unpack_from("<q", media, at + 6)[0] + 1)
        broken[at + 22 : at + 26] = bytes(4)
        broken[at + 22 : at + 26] = struct.pack("<I", O.checksum(bytes(broken[at:end])))
        with pytest.raises(ValueError):
            O.read(bytes(broken))


def test_columns(spark, data, docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = O.op9_ogg(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = O.padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = O.read_back(O.store(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert len({r["media_sha256"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] == 1}) == 1
    assert O.read_back(O.store(no_docs)).collect() == []
