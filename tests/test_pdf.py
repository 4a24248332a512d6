"""PDF files built here: both kinds of cross-references, object streams, nested trees, damage."""

import struct
import zlib

import pytest

from quillspark.sources.pdf import Pdf, pdf_table, unpredicted

JPEG = b"\xff\xd8\xff\xe0 a picture \xff\xd9"


def objects(pages, image=JPEG, cycle=False):
    """Bodies by number: a root, a tree of trees with three pages a branch, and an image on the second page."""
    branches = [range(i, min(i + 3, pages)) for i in range(0, pages, 3)]
    first = 10 + len(branches)
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Note (a \\) (b) %%) >>" % (pages, b" ".join(b"%d 0 R" % (10 + i) for i in range(len(branches))))}
    for i, branch in enumerate(branches):
        kids = b" ".join(b"%d 0 R" % (first + k) for k in branch) + (b" 2 0 R" if cycle else b"")
        out[10 + i] = b"<< /Type /Pages /Parent 2 0 R /Kids [%s] /Count %d /Resources << /ProcSet [/PDF] >> >>" % (kids, len(branch))
        for k in branch:
            shows = b" /Resources << /XObject << /Im1 5 0 R >> >>" if k == 1 else b""
            out[first + k] = b"<< /Type /Page /Parent %d 0 R%s /Hex <41 4> /#4Eame /x#20y /Box [0 0 612.5 -.5] >>" % (10 + i, shows)
    out[5] = b"<< /Type /XObject /Subtype /Image /Width 4 /Height 2 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (len(image), image)
    return out


def with_table(bodies):
    data, places = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for k, body in bodies.items():
        places[k] = len(data)
        data += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    at, size = len(data), max(bodies) + 1
    data += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % places[k] if k in places else b"0000000000 65535 f \n" for k in range(size))
    return data + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, at)


def predicted(rows, step):
    """PNG predictors of all kinds in turn."""
    out, last = b"", bytes(step)
    for n, at in enumerate(range(0, len(rows), step)):
        row, kind = rows[at : at + step], n % 5
        line = bytearray()
        for i, x in enumerate(row):
            a, b, c = row[i - 1] if i else 0, last[i], last[i - 1] if i else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind]) + bytes(line)
        last = row
    return out


def with_streams(bodies, predictor=True):
    """All but the image in an object stream, found by a cross-reference stream."""
    data = b"%PDF-1.5\n"
    places = {5: (1, len(data), 0)}
    data += b"5 0 obj\n%s\nendobj\n" % bodies[5]
    inside = {k: b for k, b in bodies.items() if k != 5}
    head, body = b"", b""
    for i, (k, b) in enumerate(inside.items()):
        head += b"%d %d " % (k, len(body))
        body += b + b"\n"
        places[k] = (2, 900, i)
    packed = zlib.compress(head + body)
    places[900] = (1, len(data), 0)
    data += b"900 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\r\n%s\nendstream\nendobj\n" % (len(inside), len(head), len(packed), packed)
    at = len(data)
    rows = b"".join(struct.pack(">BIB", *places.get(k, (0, 0, 0))) for k in range(902))
    packed = zlib.compress(predicted(rows, 6) if predictor else rows)
    options = b"/DecodeParms << /Predictor 12 /Columns 6 >> " if predictor else b""
    return data + b"901 0 obj\n<< /Type /XRef /W [1 4 1] /Size 902 /Root 1 0 R /Filter /FlateDecode %s/Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (options, len(packed), packed, at)


@pytest.mark.parametrize("pages", [1, 2, 7, 40])
def test_counts_and_covers(pages):
    for data in (with_table(objects(pages)), with_streams(objects(pages)), with_streams(objects(pages), predictor=False)):
        pdf = Pdf(data)
        assert sum(1 for _ in pdf.pages()) == pages
        assert pdf.cover() == (JPEG if pages > 1 else None)


def test_predictors():
    rows = bytes((i * 37 + i // 5) % 256 for i in range(60))
    assert unpredicted(predicted(rows, 6), 6, 8) == rows


def test_cycles_end():
    assert sum(1 for _ in Pdf(with_table(objects(7, cycle=True))).pages()) == 7


def test_an_update_comes_before_what_it_updates():
    data = with_table(objects(4))
    old = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    at = len(data)
    data += b"2 0 obj\n<< /Type /Pages /Kids [12 0 R] /Count 1 >>\nendobj\n"
    table = len(data)
    data += b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 20 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, table)
    assert sum(1 for _ in Pdf(data).pages()) == 1


def test_damage_is_searched_or_a_row(spark):
    good = with_table(objects(7))
    shifted = good.replace(b"%PDF-1.4\n", b"%PDF-1.4\n%moved\n")
    cut = good[: good.index(b"xref\n0")]
    streams = with_streams(objects(5)).rsplit(b"startxref", 1)[0]
    grey = objects(2)
    raw = zlib.compress(bytes(range(8)))
    grey[5] = b"<< /Subtype /Image /Width 4 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(raw), raw)
    odd = objects(2)
    odd[5] = odd[5].replace(b"DCTDecode", b"Unknown")
    rows = [("good", good), ("shifted", shifted), ("cut", cut), ("streams", streams), ("grey", with_table(grey)), ("odd", with_table(odd)), ("text", b"no file at all"), ("empty", b""), ("null", None), ("deep", b"startxref 0 " + b"1 0 obj " + b"[" * 5000)]
    got = {r["path"]: r for r in pdf_table(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {p: r["pages"] for p, r in got.items()} == {"good": 7, "shifted": 7, "cut": 7, "streams": 5, "grey": 2, "odd": 2, "text": None, "empty": None, "null": None, "deep": None}
    assert all((r["error"] is None) == (r["pages"] is not None) for r in got.values())
    assert got["cut"]["cover"] == JPEG and got["odd"]["cover"] is None
    png = bytes(got["grey"]["cover"])
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (4, 2) and zlib.decompress(png[41:-16]) == b"\0\0\1\2\3\0\4\5\6\7"
