"""Operator 3: TIFF as a media column. Walks image directories, decodes strips and tiles (none, PackBits, LZW, deflate), undoes predictors and emits one row per page.

Codecs follow the public TIFF 6.0 specification and its deflate supplement. Values are 8- or 16-bit samples, interleaved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import by_row

# Fixed values of the format: tags, compressions and the sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I"}

RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


class Broken(ValueError):
    """The file can't be decoded; the text says why."""


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(until: int) -> None:
        for k in range(at, until, 128):
            out.append(bytes([min(128, until - k) - 1]) + data[k : min(until, k + 128)])

    for run in RUNS.finditer(data):
        literal(run.start())
        at = run.end()
        out.append(bytes([257 - (at - run.start())]) + run[1])
    literal(len(data))
    return b"".join(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while at < len(data) and made < size:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
            continue
        made += len(out[-1])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early, and the table is cleared when full."""
    table: dict[int, int] = {}
    acc, bits, width, following = 256, 9, 9, 258
    prefix = -1
    out = bytearray()
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        acc, bits = acc << width | prefix, bits + width
        table[key] = following
        following += 1
        if following == 4095:
            acc, bits = acc << width | 256, bits + width
            table.clear()
            width, following = 9, 258
        elif following == (1 << width):
            width += 1
        if bits >= 512:
            keep = bits & 7
            out += (acc >> keep).to_bytes(bits >> 3, "big")
            acc, bits = acc & ((1 << keep) - 1), keep
        prefix = byte
    if prefix >= 0:
        acc, bits = acc << width | prefix, bits + width
        following += 1
        if following == (1 << width) and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) >> 3, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, acc, bits, last = list(first), 9, 0, 0, None
    out, made, at = [], 0, 0
    while made < size:
        if bits < width:
            more = data[at : at + 32]
            if not more:
                break
            acc, bits, at = (acc & ((1 << bits) - 1)) << (8 * len(more)) | int.from_bytes(more, "big"), bits + 8 * len(more), at + len(more)
            if bits < width:
                break
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            if code >= 256:
                raise Broken("lzw: no such code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise Broken("lzw: no such code")
            table.append(last + entry[:1])
            if len(table) + 1 == 1 << width and width < 12:
                width += 1
        out.append(entry)
        made += len(entry)
        last = entry
    return b"".join(out)


def difference(rows: np.ndarray) -> np.ndarray:
    """Horizontal differencing of (rows, width, samples), modulo the sample's range."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def undo(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=1, dtype=rows.dtype)


def compress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 6)
    raise Broken(f"compression {compression}")


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data[:size]
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)  # never more than the page holds
        except zlib.error as error:
            raise Broken(f"deflate: {error}") from error
    else:
        raise Broken(f"compression {compression}")
    if len(out) < size:
        raise Broken("too few bytes in a strip or tile")
    return out[:size]


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, rows: int = 128, order: str = "<") -> bytes:
    """A TIFF of pages of shape (height, width, samples), uint8 or uint16, in strips of so many rows or in square tiles (a multiple of 16)."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for page in pages:
        height, width, samples = page.shape
        kind = page.dtype.newbyteorder(order)
        blocks = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile, samples), page.dtype)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for block in blocks:
            data = compress((difference(block) if predictor == 2 else block).astype(kind).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * page.dtype.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, code, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODE[code]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and fields of each image directory; a directory that is linked twice ends the walk."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise Broken("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise Broken("no TIFF header")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for k in range(n):
                tag, code, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if code not in TYPE_CODE:
                    continue
                size = TYPE_SIZE[code] * count
                place = at + 10 + 12 * k
                if size > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                if place + size > len(data):
                    raise Broken("a field lies outside the file")
                fields[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[code]}", data, place)
            (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except struct.error as error:
            raise Broken("a directory lies outside the file") from error
        yield order, fields
        at = following


#: The most bytes that one stored byte can stand for: two of PackBits repeat a byte 128 times, a deflate code of two bits stands for 258 bytes, a code of LZW (9 bits at least) for a string of at most 4096.
EXPANSION = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 3641}


def page(data: bytes, order: str, fields: dict[int, tuple], most: int | None) -> np.ndarray:
    """One page as (height, width, samples). Nothing is allocated that the stored bytes can't fill; most: bytes that a page and a tile may have, any number if None."""
    one = lambda tag, default=None: (fields.get(tag) or (default,))[0]
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), set(fields.get(BITS, (1,)))
    if not width or not height or not samples:
        raise Broken("no size")
    if bits not in ({8}, {16}) or one(PLANAR, 1) != 1:
        raise Broken("only interleaved samples of 8 or 16 bits")
    kind = np.dtype(np.uint8 if bits == {8} else np.uint16)
    if most is not None and width * height * samples * kind.itemsize > most:
        raise Broken("page too large")
    predictor, compression = one(PREDICTOR, 1), one(COMPRESSION, 1)
    if compression not in EXPANSION:
        raise Broken(f"compression {compression}")
    if predictor not in (1, 2):
        raise Broken(f"predictor {predictor}")
    tiled = TILE_OFFSETS in fields
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, counts = (fields.get(TILE_OFFSETS), fields.get(TILE_COUNTS)) if tiled else (fields.get(STRIP_OFFSETS), fields.get(STRIP_COUNTS))
    if not w or not h or not offsets or not counts:
        raise Broken("no strips or tiles")
    across, down = -(-width // w), -(-height // h)
    if min(len(offsets), len(counts)) < across * down:
        raise Broken("too few strips or tiles")
    for k in range(across * down):
        need = (h if tiled else min(h, height - k * h)) * w * samples * kind.itemsize
        if most is not None and need > max(most, 1 << 16):
            raise Broken("tile too large")
        if need > EXPANSION[compression] * max(0, min(counts[k], len(data) - offsets[k])) + 258:
            raise Broken("too few bytes in a strip or tile")
    out = np.empty((height, width, samples), kind)
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        raw = expand(data[offsets[k] : offsets[k] + counts[k]], compression, rows * w * samples * kind.itemsize)
        block = np.frombuffer(raw, kind.newbyteorder(order)).astype(kind).reshape(rows, w, samples)
        if predictor == 2:
            block = undo(block)
        out[y : y + h, x : x + w] = block[: height - y, : width - x]
    return out


def read(data: bytes, most: int | None = None) -> list[np.ndarray]:
    """All pages of a file; raises Broken."""
    return [page(data, order, fields, most) for order, fields in directories(data)]


def pages(files: DataFrame, id_col: str, content_col: str, most: int | None = None) -> DataFrame:
    """One row per page: id, page, width, height, samples, bits, compression, predictor, pixels (row by row, little-endian) and error.

    A page that can't be decoded has null pixels and its reason in error, as has, only if `most` is given, one of more than that many bytes; a page takes memory in proportion to its stored bytes, see EXPANSION; a file without a readable header, null and empty content give one row with page null. Repeated rows stay. Other columns are not read.
    """
    columns = {"id": pa.int64(), "page": pa.int32(), "width": pa.int64(), "height": pa.int64(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "pixels": pa.binary(), "error": pa.string()}
    schema = pa.schema(list(columns.items()))

    def rows(key: int, data: bytes | None) -> Iterator[tuple]:
        walk, k = directories(data or b""), 0
        while True:
            try:
                order, fields = next(walk)
            except StopIteration:
                return
            except Broken as error:
                yield (key, None, *[None] * 7, str(error))
                return
            about = [(fields.get(t) or (d,))[0] for t, d in ((WIDTH, None), (HEIGHT, None), (SAMPLES, 1), (BITS, 1), (COMPRESSION, 1), (PREDICTOR, 1))]
            try:
                pixels = page(data, order, fields, most)
                yield (key, k, *about, pixels.astype(pixels.dtype.newbyteorder("<")).tobytes(), None)
            except Broken as error:
                yield (key, k, *about, None, str(error))
            k += 1

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: pixels of one file are held, not of a batch
                found = list(rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), columns.values(), strict=True)], schema=schema)

    return files.select(files[id_col].cast("long").alias("id"), files[content_col].cast("binary").alias("content")).mapInArrow(run, "id long, page int, width long, height long, samples int, bits int, compression int, predictor int, pixels binary, error string")


#: Bytes of a page that a text is stored in; longer texts take several pages.
PAGE_BYTES = 1 << 20
SIDE = 64


def store(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, padded with zeros to a positive multiple of 64, as a TIFF of 64 samples a row. The text's checksum picks the compression, the predictor and strips or tiles, so all of them are in use and equal texts are stored alike."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    raw += b"\0" * (-n % SIDE or (SIDE if not n else 0))
    pick = zlib.crc32(raw)
    compression = (LZW, PACKBITS, PACKBITS, NONE, DEFLATE, DEFLATE, DEFLATE, OLD_DEFLATE)[pick & 7]
    cut = [np.frombuffer(raw[k : k + PAGE_BYTES], np.uint8).reshape(-1, SIDE, 1) for k in range(0, len(raw), PAGE_BYTES)]
    return write(cut, compression, 1 + (pick >> 3 & 1), SIDE if pick >> 4 & 1 else None, order="<>"[pick >> 5 & 1]), n


def feature(stored: list[np.ndarray]) -> str:
    """Pages, rows, mean sample, distinct samples and mean step along a row, of all pages together; exact integers, scaled by 1000."""
    rows = sum(len(x) for x in stored)
    total = sum(int(x.sum(dtype=np.int64)) for x in stored)
    counts = sum(np.bincount(x.reshape(-1), minlength=256) for x in stored)
    steps = sum(int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64)) for x in stored)
    return f"pages={len(stored)};rows={rows};mean={1000 * total // (rows * SIDE)};distinct={int((counts > 0).sum())};step={1000 * steps // (rows * (SIDE - 1))}"


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as a TIFF, reads the stored bytes back page by page and describes them.

    A null text counts as empty: 64 zero bytes. Repeated rows stay, a null id stays null, other columns are not read. Rows are independent; nothing is shuffled.
    """
    columns = {id_col: pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def row(key, text):
        media, n = store(text)
        stored = read(media)
        payload = b"".join(x.tobytes() for x in stored)
        return key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stored)

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias(text_col)).mapInArrow(by_row(columns, row), f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
