"""Media columns in Ogg: payloads stored as packets of two logical streams, and read back.

``store`` turns each text's bytes into packets of 576 eight-bit samples, dealt in turn to two logical streams, each with a
header packet, and multiplexes their pages. ``read`` verifies every page's checksum and sequence number, reassembles
packets from lacing values (also across pages), tells the streams apart by serial number, derives the time of every packet
from granule positions (a page's says where the last packet that ends on it ends) and joins the samples again.

A null text is empty; an empty text is one packet of padding. Each row is stored and read on its own, so repeated rows,
ties and empty tables need no care, and serial numbers come from the content, so equal texts give equal bytes. A file that is
damaged, cut off or null gives a row whose ``error`` says so and whose other results are null; it ends no job. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_batches

PACKET, RATE, STREAMS = 576, 8000, 2
#: Lacing values of a page; a packet takes three, so packets also go on from page to page.
LACES = 64
MAGIC = b"RawPCM8\x00"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, not reflected, from zero. It is zlib's of the bit-reversed bytes, bit-reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % PACKET or (0 if data else PACKET))


def _pages(serial: int, packets: list[bytes], granules: list[int]) -> list[tuple[int, bytes]]:
    """(position to sort by, page) of one logical stream. The first packet has a page of its own."""
    laces: list[tuple[int, bytes, int]] = []  # lacing value, its bytes, packet that ends there or -1
    for k, p in enumerate(packets[1:], 1):
        cuts = [p[i : i + 255] for i in range(0, len(p), 255)]
        if len(cuts[-1]) == 255:
            cuts.append(b"")
        laces += [(len(c), c, k if i == len(cuts) - 1 else -1) for i, c in enumerate(cuts)]
    groups = [laces[i : i + LACES] for i in range(0, len(laces), LACES)]
    out, open_packet = [], False
    head = packets[0]
    for number, group in enumerate([[(len(head), head, 0)], *groups]):
        ended = [k for _, _, k in group if k >= 0]
        granule = granules[ended[-1]] if ended else -1
        flags = 1 * open_packet | 2 * (number == 0) | 4 * (number == len(groups))
        fixed = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(group)) + bytes(n for n, _, _ in group)
        body = b"".join(c for _, c, _ in group)
        page = fixed + body
        page = page[:22] + struct.pack("<I", checksum(page)) + page[26:]
        out.append(((number, granule), page))
        open_packet = group[-1][2] < 0
    return out


def write(payload: bytes) -> bytes:
    """An Ogg file of the payload, whose length is a positive multiple of 576."""
    serial = zlib.crc32(payload)
    every = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    pages = []
    for s in range(STREAMS):
        own = every[s::STREAMS]
        head = MAGIC + struct.pack("<IHHI", RATE, s, STREAMS, len(own))
        granules = [0, *((i + 1) * PACKET for i in range(len(own)))]
        pages += [(at, s, page) for at, page in _pages((serial + s) & 0xFFFFFFFF, [head, *own], granules)]
    pages.sort(key=lambda p: (p[0][0], p[1]))
    return b"".join(p for _, _, p in pages)


def read(media: bytes) -> dict:
    """payload, and what the container says: pages, packets, streams, seconds, and by stream the samples at which packets end."""
    at, pages, streams = 0, 0, {}
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError(f"the page at byte {at} is cut off")
        mark, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no Ogg page at byte {at}")
        laces = media[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(laces)
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc or end > len(media):
            raise ValueError(f"the page at byte {at} is damaged")
        stream = streams.setdefault(serial, {"packets": [], "open": b"", "next": 0, "granule": 0, "ended": False, "ends": []})
        if number != stream["next"] or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(stream["open"]):
            raise ValueError(f"the page at byte {at} is out of order")
        part, i, before = stream["open"], 0, len(stream["packets"])
        while i < n:
            j = i
            while j < n and laces[j] == 255:
                j += 1
            size = 255 * (j - i) + (laces[j] if j < n else 0)
            part += media[body : body + size]
            body += size
            if j < n:
                stream["packets"].append(part)
                part = b""
            i = j + 1
        stream |= {"open": part, "next": number + 1, "ended": bool(flags & 4)}
        new = stream["packets"][max(before, 1) :]
        if bool(granule >= 0) != (len(stream["packets"]) > before):
            raise ValueError(f"the page at byte {at} has a granule position and no packet's end, or the reverse")
        if granule >= 0:  # backwards from the page's position, packet by packet
            ends, back = [], granule
            for p in reversed(new):
                ends.append(back)
                back -= len(p)
            if back != stream["granule"]:
                raise ValueError(f"granule positions don't match the samples on the page at byte {at}")
            stream["ends"] += ends[::-1]
            stream["granule"] = granule
        pages, at = pages + 1, end
    ordered: list = [b""] * len(streams)
    times: list = [[]] * len(streams)
    if not streams:
        raise ValueError("no Ogg page")
    for stream in streams.values():
        head = (stream["packets"] or [b""])[0]
        if len(head) < len(MAGIC) + 12:
            raise ValueError("a logical stream has no header")
        rate, index, _, count = struct.unpack_from("<IHHI", head, len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or not stream["ended"] or stream["open"] or count != len(stream["packets"]) - 1:
            raise ValueError("a logical stream is not whole")
        if not rate or not 0 <= index < len(streams) or ordered[index]:
            raise ValueError("the logical streams don't belong together")
        ordered[index], times[index] = stream["packets"][1:], [x / rate for x in stream["ends"]]
    joined: list = [b""] * sum(map(len, ordered))
    for s, packets in enumerate(ordered):
        joined[s :: len(ordered)] = packets
    seconds = max(s["granule"] for s in streams.values()) / rate
    return {"payload": b"".join(joined), "pages": pages, "packets": len(joined), "streams": len(streams), "seconds": seconds, "ends": times}


def features(found: dict) -> str:
    """Figures of the samples and their container, as text."""
    x = np.frombuffer(found["payload"], np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"streams={found['streams']};pages={found['pages']};packets={found['packets']};seconds={found['seconds']:.6f};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an Ogg file."""

    def run(batch: pa.RecordBatch) -> dict:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(d) for d in data], "media": [write(padded(d)) for d in data]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


BACK = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")


def _read(data: bytes | None) -> tuple[dict | None, str | None]:
    try:
        return read(data or b""), None
    except (ValueError, struct.error, IndexError) as e:
        return None, f"{type(e).__name__}: {e}"


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes) with digests of the payload and of the file, and features, from the stored bytes alone."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in BACK}
        for m in batch.column("media"):
            data = m.as_py()
            found, error = _read(data)
            row = [None] * 6
            if found:
                payload = found["payload"]
                row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(found)]
            for k, v in zip(out, (*row, error), strict=True):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), **out}

    return map_batches(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def packet_times(media: DataFrame) -> DataFrame:
    """(doc_id, stream, packet, seconds, until, error): when each packet of each logical stream begins and ends."""

    def run(batches):
        for batch in batches:
            for doc_id, m in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                found, error = _read(m.as_py())
                rows = [(doc_id, None, None, None, None, error)] if error else [(doc_id, s, k, t, u, None) for s, ends in enumerate(found["ends"]) for k, (t, u) in enumerate(zip([0.0, *ends], ends, strict=False))]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "stream", "packet", "seconds", "until", "error"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, stream int, packet long, seconds double, until double, error string")


def op9_ogg(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    return read_back(store(table(spark, sf_dir, "documents")))
