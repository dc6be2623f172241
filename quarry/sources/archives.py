"""ZIP archives as rows: directory scan, verified inflation, rewriting. After the public PKWARE APPNOTE.

Errors are data: a file that can't be read gives one row with its reason.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Signatures and limits.
EOCD, EOCD64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
MOST_ENTRIES, MOST_DIRECTORY, LARGE = 500_000, 256 << 20, 128 << 20
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PACKED = re.compile(r"(?i)\.(jpe?g|png|gif|webp|avif|heic|mp[34]|m4[av]|mov|mkv|webm|aac|ogg|opus|flac|zip|7z|rar|gz|bz2|xz|zst|docx|xlsx|pptx|pdf)$")


class Corrupt(ValueError):
    """The archive can't be read; the text is the reason."""


def latin(raw: bytes) -> str:
    """Windows-1252, whose five unused bytes stand for controls."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


def directory(data: bytes) -> list[dict]:
    """The entries of the central directory, in order. Data before the archive is allowed; spanned archives, and directories beyond the limits, are not."""
    low = max(0, len(data) - 65_577)
    at = data.rfind(EOCD, low)
    while at >= 0 and not (at + 22 <= len(data) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] <= len(data)):
        at = data.rfind(EOCD, low, at)
    if at < 0:
        raise Corrupt("no end of central directory")
    disk, first, here, count, size, offset = struct.unpack_from("<4H2I", data, at + 4)
    end = at
    if at >= 20 and data[at - 20 : at - 16] == LOCATOR64:
        place = struct.unpack_from("<Q", data, at - 12)[0]
        place = place if data[place : place + 4] == EOCD64 else data.rfind(EOCD64, 0, at)
        if place < 0:
            raise Corrupt("no zip64 end record")
        disk, first, here, count, size, offset = struct.unpack_from("<2I4Q", data, place + 16)
        end = place
    if disk or first or here != count:
        raise Corrupt("spanned")
    if count > MOST_ENTRIES or size > MOST_DIRECTORY:
        raise Corrupt("too large")
    shift = end - (offset + size)
    if shift < 0:
        raise Corrupt("directory outside the file")
    out, at = [], offset + shift
    for index in range(count):
        if data[at : at + 4] != ENTRY or at + 46 > end:
            raise Corrupt("bad directory entry")
        made, needed, flags, method, time, date, crc, csize, usize, n, x, c, start, internal, external, local = struct.unpack_from("<6H3I5H2I", data, at + 4)
        name, extra, comment = (data[at + 46 + a : at + 46 + b] for a, b in ((0, n), (n, n + x), (n + x, n + x + c)))
        usize, csize, local = wide(extra, usize, csize, local)
        text = name.decode("utf-8", "replace") if flags & 0x800 else latin(name)
        out.append({"index": index, "name": text, "name_bytes": name, "made_by": made, "needed": needed, "flags": flags, "method": method, "time": time, "date": date, "crc": crc, "csize": csize, "usize": usize, "internal": internal, "external": external, "offset": local + shift, "extra": extra, "comment": comment, "readable": not flags & 1 and method in (0, 8) and not (text.endswith("/") and usize == 0)})
        at += 46 + n + x + c
    return out


def wide(extra: bytes, *values: int) -> list[int]:
    """The zip64 field holds, in order, those of the values that don't fit 32 bits."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            field, k = extra[at + 4 : at + 4 + size], 0
            for i, value in enumerate(out):
                if value == FULL32 and k + 8 <= len(field):
                    out[i] = struct.unpack_from("<Q", field, k)[0]
                    k += 8
                    if out[i] > (1 << 53) - 1:
                        raise Corrupt("number too large")
        at += 4 + size
    return out


def body(data: bytes, entry: dict) -> bytes:
    """The stored bytes of an entry, after its local header, whose name must be the directory's."""
    at = entry["offset"]
    if data[at : at + 4] != LOCAL or at + 30 > len(data):
        raise Corrupt("bad local header")
    n, x = struct.unpack_from("<2H", data, at + 26)
    if data[at + 30 : at + 30 + n] != entry["name_bytes"]:
        raise Corrupt("unsafe-paths")
    start = at + 30 + n + x
    if start + entry["csize"] > len(data):
        raise Corrupt("entry outside the file")
    return data[start : start + entry["csize"]]


def budget(size: int) -> int:
    return min(64 << 30, max(2 << 30, 200 * size))


def content(data: bytes, entry: dict, left: int) -> bytes:
    """An entry's bytes. More than it declares, a ratio over 1000 beyond 64 MiB, more than the archive's budget, and a wrong size or checksum are errors."""
    raw = body(data, entry)
    if entry["method"] == 8:
        most = min(entry["usize"] + 1024, left)
        try:
            raw = zlib.decompressobj(-15).decompress(raw, most + 1)
        except zlib.error as error:
            raise Corrupt(str(error)) from error
        if len(raw) > most or len(raw) > 64 << 20 and len(raw) / max(1, entry["csize"]) > 1000:
            raise Corrupt("bomb")
    if len(raw) != entry["usize"] or zlib.crc32(raw) != entry["crc"]:
        raise Corrupt("validation")
    return raw


ENTRY_SCHEMA = "file_id string, index int, name string, made_by int, needed int, flags int, method int, time int, date int, crc long, csize long, usize long, internal int, external long, offset long, readable boolean, reason string"
KINDS = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
FIELDS = [f.split()[0] for f in ENTRY_SCHEMA.split(", ")]


def entries(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """One row per archive entry; a file that isn't a readable archive gives one row with a reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [{**e, "file_id": key} for e in directory(data or b"")]
                except (Corrupt, struct.error) as error:
                    rows = [{"file_id": key, "reason": str(error) or "corrupt"}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(FIELDS, KINDS, strict=True)], FIELDS)

    return files.select(F.col(id_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(run, ENTRY_SCHEMA)


def assemble(parts: list[tuple[dict, bytes]], comment: bytes = b"") -> bytes:
    """An archive of (entry, stored bytes): local headers, directory and end records; zip64 fields only where a number needs them."""
    out, tail = bytearray(), bytearray()
    for e, raw in parts:
        flags, sizes = e["flags"] & 0x800, (e["usize"], e["csize"])
        big = max(sizes) >= FULL32
        extra = struct.pack("<2H2Q", 1, 16, *sizes) if big else b""
        needed, stored = 45 if big else 20, (FULL32, FULL32) if big else sizes
        offset = len(out)
        out += LOCAL + struct.pack("<5H3I2H", needed, flags, e["method"], e["time"], e["date"], e["crc"], stored[1], stored[0], len(e["name_bytes"]), len(extra)) + e["name_bytes"] + extra + raw
        far = offset >= FULL32
        more = extra if not far else struct.pack("<2H", 1, 16 * big + 8) + (extra[4:] if big else b"") + struct.pack("<Q", offset)
        tail += ENTRY + struct.pack("<6H3I5H2I", e["made_by"], 45 if big or far else 20, flags, e["method"], e["time"], e["date"], e["crc"], stored[1], stored[0], len(e["name_bytes"]), len(more), len(e["comment"]), 0, e["internal"], e["external"], FULL32 if far else offset) + e["name_bytes"] + more + e["comment"]
    start, n = len(out), len(parts)
    out += tail
    if n >= FULL16 or start >= FULL32 or len(tail) >= FULL32:
        place = len(out)
        out += EOCD64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, len(tail), start) + LOCATOR64 + struct.pack("<IQI", 0, place, 1)
    out += EOCD + struct.pack("<4H2IH", 0, 0, min(n, FULL16), min(n, FULL16), min(len(tail), FULL32), min(start, FULL32), len(comment)) + comment
    return bytes(out)


def rewrite(data: bytes, transform=None, policy=None) -> tuple[bytes, set[int]]:
    """The archive with every entry deflated where that is smaller, and the indices whose content `transform` (name, bytes -> bytes or None) has changed. policy (entry -> copy, pack or transform) says what happens to an entry; without one all are packed, and transformed if there is a transform. Unreadable entries, and large ones that are packed already, keep their stored bytes."""
    found, parts, changed, left = directory(data), [], set(), budget(len(data))
    for e in found:
        raw = body(data, e)
        way = policy(e) if policy else "transform"
        if not e["readable"] or way == "copy" or e["usize"] > LARGE and (e["method"] == 8 or PACKED.search(e["name"])):
            parts.append((e, raw))
            continue
        before = content(data, e, left)
        left -= len(before)
        after = transform(e["name"], before) if transform and way == "transform" else None
        after = before if after is None else after
        deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
        packed = deflate.compress(after) + deflate.flush()
        method, stored = (8, packed) if len(packed) < len(after) else (0, after)
        if after == before and len(stored) >= e["csize"]:
            parts.append((e, raw))
            continue
        if after != before:
            changed.add(e["index"])
        parts.append((e | {"method": method, "crc": zlib.crc32(after), "usize": len(after), "csize": len(stored)}, stored))
    return assemble(parts), changed


def png_chunks(data: bytes) -> list[tuple[str, int, int]]:
    """Type, place of the data and length of each chunk."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Corrupt("unreadable")
    out, at = [], 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise Corrupt("unreadable")
        out.append((kind.decode("latin-1"), at + 8, size))
        at += 12 + size
    return out


def recompress_png(data: bytes, strip: tuple[str, ...] = (), most: int = 256 << 20) -> bytes | None:
    """The picture with its image data deflated anew into one chunk, and without the chunks in strip; None if that isn't smaller or it is animated."""
    chunks = png_chunks(data)
    if any(kind == "acTL" for kind, _, _ in chunks):
        return None
    pixels = zlib.decompressobj().decompress(b"".join(data[at : at + size] for kind, at, size in chunks if kind == "IDAT"), most)
    out, written = [data[:8]], False
    for kind, at, size in chunks:
        if kind == "IDAT":
            if written:
                continue
            body_, written = b"IDAT" + zlib.compress(pixels, 9), True
        elif kind in strip:
            continue
        else:
            body_ = data[at - 4 : at + size]
        out.append(struct.pack(">I", len(body_) - 4) + body_ + struct.pack(">I", zlib.crc32(body_)))
    made = b"".join(out)
    return made if len(made) < len(data) else None


def png_info(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, width, height, animated and the types of the chunks, in order; all null for what is no PNG or breaks off before its size. A chunk beyond the end of the file ends the list."""

    def info(data: bytes | None) -> tuple:
        if not data or data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 24:
            return None, None, None, None
        kinds, at = [], 8
        while at + 12 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            kinds.append(kind.decode("latin-1"))
            at += 12 + size
        return (*struct.unpack_from(">2I", data, 16), "acTL" in kinds, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()))
        for batch in batches:
            found = [info(data) for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], [key, "width", "height", "animated", "chunks"])

    base = files.select(key, F.col(content).cast("binary").alias(content))
    return base.mapInArrow(run, f"`{key}` {base.schema[key].dataType.simpleString()}, width long, height long, animated boolean, chunks array<string>")
