"""Page counts and covers of PDF files, by their structure.

A file's cross-references (tables or streams, older ones behind newer ones) say where objects are; objects may lie in
compressed object streams. Where cross-references are damaged, objects are looked for in the file. The page tree is walked
from the root, each node once, so cycles end; the cover is the first image that a page shows. Files are read in tasks,
one by one; one that can't be read is a row with an error.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_CHARS = 500

_SPACE = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]*")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_HEAD = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj\b")
_NESTED = 200


class Ref(int):
    """The number of an object that is referred to."""


class Name(bytes):
    pass


def parsed(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The object that begins at ``at``, and where it ends: names, numbers, references, strings, arrays, dictionaries, words."""
    if depth > _NESTED:
        raise ValueError("nested too deeply")
    at = _SPACE.match(data, at).end()
    c = data[at : at + 1]
    if c == b"/":
        m = _WORD.match(data, at + 1)
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0])), m.end()
    if m := _REFERENCE.match(data, at):
        return Ref(int(m[1])), m.end()
    if m := _NUMBER.match(data, at):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    if data[at : at + 2] == b"<<":
        found, at = {}, at + 2
        while True:
            at = _SPACE.match(data, at).end()
            if data[at : at + 2] == b">>":
                return found, at + 2
            key, at = parsed(data, at, depth + 1)
            if not isinstance(key, Name):
                raise ValueError("a key is no name")
            found[bytes(key)], at = parsed(data, at, depth + 1)
    if c == b"[":
        items, at = [], at + 1
        while True:
            at = _SPACE.match(data, at).end()
            if data[at : at + 1] == b"]":
                return items, at + 1
            item, at = parsed(data, at, depth + 1)
            items.append(item)
    if c == b"(":
        end, open_ = at + 1, 1
        while open_:
            if end >= len(data):
                raise ValueError("a string has no end")
            b = data[end]
            end += 2 if b == 92 else 1
            open_ += (b == 40) - (b == 41)
        return data[at + 1 : end - 1], end
    if c == b"<":
        end = data.index(b">", at)
        digits = re.sub(rb"\s", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    m = _WORD.match(data, at)
    if not m[0]:
        raise ValueError(f"no object at {at}")
    return {b"true": True, b"false": False, b"null": None}.get(m[0], m[0]), m.end()


class Pdf:
    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[int, tuple[int, int]] = {}  # (0, offset) or (object stream, index)
        self.trailer: dict = {}
        self.streams: dict[int, list[tuple[int, object]]] = {}
        try:
            self._references()
            if not isinstance(self.value(self.trailer.get(b"Root")), dict):
                raise ValueError("no root")
        except Exception:
            self._search()

    def _references(self) -> None:
        start = self.data.rfind(b"startxref")
        if start < 0:
            raise ValueError("no startxref")
        waiting, seen = [parsed(self.data, start + 9)[0]], set()
        while waiting:
            at = waiting.pop(0)
            if not isinstance(at, int) or at in seen:
                continue
            seen.add(at)
            at = _SPACE.match(self.data, at).end()
            trailer = self._table(at + 4) if self.data[at : at + 4] == b"xref" else self._stream(at)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            waiting += [trailer[k] for k in (b"XRefStm", b"Prev") if k in trailer]

    def _table(self, at: int) -> dict:
        while True:
            at = _SPACE.match(self.data, at).end()
            if self.data[at : at + 7] == b"trailer":
                return parsed(self.data, at + 7)[0]
            first, at = parsed(self.data, at)
            count, at = parsed(self.data, at)
            for k in range(first, first + count):
                m = re.compile(rb"\s*(\d{10})\s(\d{5})\s([nf])").match(self.data, at)
                at = m.end()
                if m[3] == b"n":
                    self.places.setdefault(k, (0, int(m[1])))

    def _stream(self, at: int) -> dict:
        head, data = self._object(at)
        widths, size = head[b"W"], head[b"Size"]
        index = head.get(b"Index", [0, size])
        rows = self._decoded(head, data)
        step, at = sum(widths), 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for k in range(first, first + count):
                row, at = rows[at : at + step], at + step
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                one, two = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")
                if kind == 1:
                    self.places.setdefault(k, (0, one))
                elif kind == 2:
                    self.places.setdefault(k, (one, two))
        return head

    def _search(self) -> None:
        """Objects by their heads, later ones before earlier ones, then those in object streams."""
        self.places = {int(m[1]): (0, m.start()) for m in _HEAD.finditer(self.data)}
        self.streams = {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                self.trailer |= parsed(self.data, m.end())[0]
            except (ValueError, TypeError):
                continue
        for k in list(self.places):
            try:
                head = self.value(Ref(k))
                if isinstance(head, tuple):
                    head = head[0]
                    if head.get(b"Type") == b"ObjStm":
                        for i, (number, _) in enumerate(self._inside(k)):
                            self.places.setdefault(number, (k, i))
                    elif head.get(b"Type") == b"XRef":
                        self.trailer |= head
                if isinstance(head, dict) and head.get(b"Type") == b"Catalog":
                    self.trailer.setdefault(b"Root", Ref(k))
            except Exception:
                continue
        for k in list(self.places):
            if not isinstance(self.value(self.trailer.get(b"Root")), dict) and isinstance(v := self.value(Ref(k)), dict) and v.get(b"Type") == b"Catalog":
                self.trailer[b"Root"] = Ref(k)

    def _object(self, at: int) -> tuple[object, bytes | None]:
        m = _HEAD.match(self.data, _SPACE.match(self.data, at).end())
        if not m:
            raise ValueError(f"no object at {at}")
        value, end = parsed(self.data, m.end())
        end = _SPACE.match(self.data, end).end()
        if not isinstance(value, dict) or self.data[end : end + 6] != b"stream":
            return value, None
        begin = end + 6 + (2 if self.data[end + 6 : end + 8] == b"\r\n" else 1)
        length = self.value(value.get(b"Length"))
        stop = begin + length if isinstance(length, int) else -1
        if stop < 0 or not re.match(rb"\s*endstream", self.data[stop : stop + 20]):
            stop = self.data.find(b"endstream", begin)
        if stop < 0:
            raise ValueError("a stream has no end")
        return value, self.data[begin:stop]

    def value(self, x: object) -> object:
        """What a reference refers to (a stream: its dictionary and bytes); anything else itself."""
        for _ in range(_NESTED):
            if not isinstance(x, Ref):
                return x
            where = self.places.get(int(x))
            if where is None:
                return None
            if where[0]:
                inside = self._inside(where[0])
                x = inside[where[1]][1] if where[1] < len(inside) and inside[where[1]][0] == int(x) else dict(inside).get(int(x))
            else:
                value, data = self._object(where[1])
                x = value if data is None else (value, data)
        raise ValueError("references without end")

    def _inside(self, stream: int) -> list[tuple[int, object]]:
        if stream not in self.streams:
            found = self.value(Ref(stream)) if self.places.get(stream, (1,))[0] == 0 else None
            if not isinstance(found, tuple):
                raise ValueError("no object stream")
            head, data = found
            body = self._decoded(head, data)
            at, pairs = 0, []
            for _ in range(head[b"N"]):
                number, at = parsed(body, at)
                place, at = parsed(body, at)
                pairs.append((number, place))
            self.streams[stream] = [(n, parsed(body, head[b"First"] + place)[0]) for n, place in pairs]
        return self.streams[stream]

    def _decoded(self, head: dict, data: bytes) -> bytes:
        filters, options = self.value(head.get(b"Filter")), self.value(head.get(b"DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        options = options if isinstance(options, list) else [options] * len(filters)
        for name, own in zip(filters, options, strict=False):
            if name == b"FlateDecode":
                data = zlib.decompressobj().decompress(data)
            elif name == b"ASCIIHexDecode":
                digits = re.sub(rb"\s", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise ValueError(f"unknown filter {bytes(name)!r}")
            if isinstance(own := self.value(own), dict) and own.get(b"Predictor", 1) >= 10:
                data = unpredicted(data, own.get(b"Columns", 1), own.get(b"Colors", 1) * own.get(b"BitsPerComponent", 8))
        return data

    def pages(self) -> Iterator[dict]:
        """The leaves of the page tree, in order, each node once, with the resources they inherit."""
        root = self.value(self.trailer.get(b"Root"))
        if not isinstance(root, dict):
            raise ValueError("no root")
        waiting, seen = [(root.get(b"Pages"), None)], set()
        while waiting:
            at, resources = waiting.pop()
            if isinstance(at, Ref):
                if at in seen:
                    continue
                seen.add(at)
            node = self.value(at)
            if not isinstance(node, dict):
                continue
            resources = node.get(b"Resources", resources)
            kids = self.value(node.get(b"Kids"))
            if isinstance(kids, list) and node.get(b"Type") != b"Page":
                waiting += [(k, resources) for k in reversed(kids)]
            else:
                yield node | {b"Resources": resources}

    def cover(self) -> bytes | None:
        """The first image of the first page that has one: JPEG and JPEG 2000 as they are, plain grey or RGB as PNG."""
        for page in self.pages():
            resources = self.value(page[b"Resources"])
            shown = self.value(resources.get(b"XObject")) if isinstance(resources, dict) else None
            for ref in shown.values() if isinstance(shown, dict) else ():
                found = self.value(ref)
                if isinstance(found, tuple) and found[0].get(b"Subtype") == b"Image" and (image := self._image(*found)):
                    return image
        return None

    def _image(self, head: dict, data: bytes) -> bytes | None:
        filters = self.value(head.get(b"Filter"))
        filters = filters if isinstance(filters, list) else [filters]
        if filters[-1] in (b"DCTDecode", b"JPXDecode"):
            return self._decoded({**head, b"Filter": filters[:-1], b"DecodeParms": None}, data)
        colours = {b"DeviceGray": 1, b"DeviceRGB": 3}.get(self.value(head.get(b"ColorSpace")))
        if not colours or head.get(b"BitsPerComponent") != 8:
            return None
        width, height = self.value(head[b"Width"]), self.value(head[b"Height"])
        rows, step = self._decoded(head, data), width * colours
        lines = b"".join(b"\0" + rows[i * step : (i + 1) * step] for i in range(height))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        size = struct.pack(">IIBBBBB", width, height, 8, 0 if colours == 1 else 2, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", size) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def unpredicted(data: bytes, columns: int, bits: int) -> bytes:
    """Rows whose PNG predictors are undone."""
    step, back = (columns * bits + 7) // 8, max(1, bits // 8)
    out, last = bytearray(), bytes(step)
    for at in range(0, len(data), step + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + step])
        for i in range(len(row)):
            a, b, c = row[i - back] if i >= back else 0, last[i], last[i - back] if i >= back else 0
            if kind == 4:
                nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[i] = (row[i] + (0, a, b, (a + b) // 2, nearest if kind == 4 else 0)[kind]) & 255
        last = bytes(row).ljust(step, b"\0")
        out += row
    return bytes(out)


def pdf_table(found: DataFrame, covers: bool = True) -> DataFrame:
    """(path, pages, cover, error) of files with content: null pages and an error where a file can't be read.

    A null content is such a file; so is one without a page tree. A cover that can't be read is null.
    """

    def read(content: bytes | None) -> tuple[int | None, bytes | None, str | None]:
        try:
            pdf = Pdf(content or b"")
            pages = sum(1 for _ in pdf.pages())
        except Exception as e:  # a broken file is a row, not a failed job
            return None, None, f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        try:
            return pages, pdf.cover() if covers else None, None
        except Exception:
            return pages, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pages, cover, error = read(batch.column(1)[i].as_py())
                cols = [batch.column(0).slice(i, 1), pa.array([pages], pa.int64()), pa.array([cover], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "pages", "cover", "error"])

    return found.select("path", F.col("content")).mapInArrow(run, "path string, pages long, cover binary, error string")
