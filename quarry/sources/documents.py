"""PDF files of one picture: a JPEG is put on a page byte for byte, and what was written is read again. After the public ISO 32000."""

from __future__ import annotations

import re

from quarry.operators.pictures import segments

# Points a pixel takes, and the longest side of a page.
POINTS, LONGEST = 0.75, 14_400
SPACES = {1: b"/DeviceGray", 3: b"/DeviceRGB"}


class Unfit(ValueError):
    """The picture can't be put on a page as it is; the text says why."""


def page_size(width: int, height: int) -> tuple[float, float]:
    scale = min(POINTS, LONGEST / max(width, height))
    return width * scale, height * scale


def jpeg_page(data: bytes) -> bytes:
    """A document of one page that shows the JPEG, whose bytes are not touched: it must stand upright and be gray or of three components."""
    found = segments(data)
    if found["reason"] or found["orientation"] != 1 or found["components"] not in SPACES:
        raise Unfit(found["reason"] or "turned or of unknown colours")
    width, height = page_size(found["width"], found["height"])
    drawn = f"q {width:.4f} 0 0 {height:.4f} 0 0 cm /P Do Q".encode()
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
        f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {width:.4f} {height:.4f}]/Resources<</XObject<</P 5 0 R>>>>/Contents 4 0 R>>".encode(),
        b"<</Length %d>>\nstream\n%s\nendstream" % (len(drawn), drawn),
        b"<</Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace%s/BitsPerComponent 8/Filter/DCTDecode/Length %d>>\nstream\n%s\nendstream" % (found["width"], found["height"], SPACES[found["components"]], len(data), data),
    ]
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    out += b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    made = bytes(out)
    if facts(made)[0] != 1:
        raise Unfit("the document does not read back")
    return made


def facts(data: bytes) -> tuple[int, tuple[float, float] | None, list[bytes]]:
    """Pages, the first one's size, and the picture streams of a document with a plain table of objects; raises Unfit for others."""
    start = re.search(rb"startxref\s+(\d+)\s+%%EOF\s*$", data[-1024:])
    if not data.startswith(b"%PDF-") or not start:
        raise Unfit("corrupt")
    head = re.match(rb"xref\s+0 (\d+)\s+", data[int(start[1]) : int(start[1]) + 64])
    if not head:
        raise Unfit("unsupported")
    at, pages, size, streams = int(start[1]) + head.end(), 0, None, []
    for k in range(int(head[1])):
        place, kind = int(data[at + 20 * k : at + 20 * k + 10]), data[at + 20 * k + 17 : at + 20 * k + 18]
        if kind != b"n":
            continue
        named = re.match(rb"\d+ \d+ obj\s+<<", data[place : place + 64])
        if not named:
            raise Unfit("corrupt")
        body = re.match(rb"(?s).*?(?:>>\s*endobj|>>\s*stream\r?\n)", data[place : place + 65_536])
        if not body:
            raise Unfit("corrupt")
        if re.search(rb"/Type\s*/Page(?![A-Za-z])", body[0]):
            pages += 1
            box = re.search(rb"/MediaBox\s*\[\s*0 0 ([\d.]+) ([\d.]+)\s*\]", body[0])
            size = size or (box and (float(box[1]), float(box[2])))
        if b"/Subtype/Image" in body[0]:
            length = int(re.search(rb"/Length (\d+)", body[0])[1])
            streams.append(data[place + body.end() : place + body.end() + length])
    return pages, size, streams
