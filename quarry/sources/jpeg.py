"""JPEG files without loss: entropy decoding to coefficients, and coding of the same coefficients anew with optimal prefix codes, sequential or progressive, whichever is smaller. After the public ITU T.81.

Coefficients are kept block by block in zigzag order; nothing is dequantised, so what comes out shows the same picture bit for bit.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from quarry.operators.pictures import BARE, FRAMES, MOST_PIXELS, canonical, code_lengths, orientation

# Markers.
SOI, EOI, SOS, DQT, DHT, DRI, DNL, COM, APP0, APP14 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xDC, 0xFE, 0xE0, 0xEE
#: Longest run of ended blocks that one symbol takes, and blocks of one interleaved unit.
MOST_RUN, MOST_UNIT = 0x7FFF, 10


class Unfit(ValueError):
    """The file can't be decoded here; the text says why."""


@dataclass
class Component:
    name: int
    across: int
    down: int
    quantiser: int
    visible: tuple[int, int] = (0, 0)
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Picture:
    width: int
    height: int
    progressive: bool
    components: list[Component]
    header: list[tuple[int, bytes]]
    quantisers: dict[int, bytes]

    def units(self) -> tuple[int, int]:
        """Interleaved units across and down."""
        a, d = max(c.across for c in self.components), max(c.down for c in self.components)
        return -(-self.width // (8 * a)), -(-self.height // (8 * d))


def lookup(counts: bytes, values: bytes) -> list[int]:
    """What the next 16 bits mean: a symbol times 32 plus its code's length, or 0, from the numbers of codes by length and the symbols in order."""
    table, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - length)
            at = code << (16 - length)
            if at + span > 65536 or k >= len(values):
                raise Unfit("bad code table")
            table[at : at + span] = [values[k] << 5 | length] * span
            code, k = code + 1, k + 1
        code <<= 1
    return table


class Reader:
    """Bits of one stretch of entropy-coded data; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self):
        chunk = self.data[self.at : self.at + 6]
        if self.at > len(self.data) + 64:
            raise Unfit("data ends early")
        self.at += 6
        self.held = self.held << 48 | int.from_bytes(chunk.ljust(6, b"\0"), "big")
        self.n += 48

    def bits(self, n: int) -> int:
        if not n:
            return 0
        if self.n < n:
            self.fill()
        self.n -= n
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        found = table[self.held >> (self.n - 16)]
        if not found:
            raise Unfit("bad code")
        self.n -= found & 31
        self.held &= (1 << self.n) - 1
        return found >> 5

    def number(self, n: int) -> int:
        """A value of this magnitude category."""
        value = self.bits(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def places(picture: Picture, chosen: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Units of a scan, each as its blocks (which of the chosen, row, column): one component goes block by block over what is visible, several go unit by unit."""
    if len(chosen) == 1:
        rows, columns = picture.components[chosen[0]].visible
        for y in range(rows):
            for x in range(columns):
                yield [(0, y, x)]
        return
    wide, high = picture.units()
    shape = [(k, picture.components[c].across, picture.components[c].down) for k, c in enumerate(chosen)]
    for v in range(high):
        for u in range(wide):
            yield [(k, v * d + y, u * a + x) for k, a, d in shape for y in range(d) for x in range(a)]


def decode(data: bytes) -> Picture:
    """The coefficients of a sequential or progressive file of 8-bit samples; raises Unfit for any other, and for faults."""
    if data[:2] != b"\xff\xd8":
        raise Unfit("unreadable")
    at, picture, header, quantisers, interval = 2, None, [], {}, 0
    tables: dict[int, list[int]] = {}
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise Unfit("corrupt")
            marker = data[at + 1]
            if marker == EOI:
                break
            if marker in BARE:
                at += 2
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise Unfit("corrupt")
            at += 2 + size
            if marker == DQT:
                k = 0
                while k < len(body):
                    n = 65 + 64 * (body[k] >> 4)
                    quantisers[body[k] & 15] = body[k : k + n]
                    k += n
            elif marker == DHT:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    tables[body[k]] = lookup(counts, body[k + 17 : k + 17 + sum(counts)])
                    k += 17 + sum(counts)
            elif marker == DRI:
                (interval,) = struct.unpack(">H", body)
            elif marker == DNL or 0xC0 <= marker <= 0xCF and marker not in FRAMES and marker not in (0xC4, 0xC8, 0xCC):
                raise Unfit("unsupported")
            elif marker in FRAMES:
                if picture:
                    raise Unfit("unsupported")
                picture = frame(marker, body)
            elif marker == SOS:
                if not picture:
                    raise Unfit("corrupt")
                at = scan(picture, data, at, body, tables, interval)
            elif 0xE0 <= marker <= 0xEF or marker == COM:
                header.append((marker, body))
    except (IndexError, struct.error) as error:
        raise Unfit("corrupt") from error
    if not picture:
        raise Unfit("corrupt")
    picture.header, picture.quantisers = header, quantisers
    if any(c.quantiser not in quantisers for c in picture.components):
        raise Unfit("corrupt")
    return picture


def frame(marker: int, body: bytes) -> Picture:
    bits, height, width, n = struct.unpack_from(">BHHB", body)
    if bits != 8 or not 1 <= n <= 4 or len(body) != 6 + 3 * n:
        raise Unfit("unsupported")
    if not width or not height:
        raise Unfit("corrupt")
    if width * height > MOST_PIXELS:
        raise Unfit("too-large")
    parts = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
    if any(not 1 <= c.across <= 4 or not 1 <= c.down <= 4 for c in parts):
        raise Unfit("corrupt")
    picture = Picture(width, height, marker == 0xC2, parts, [], {})
    wide, high = picture.units()
    a, d = max(c.across for c in parts), max(c.down for c in parts)
    for c in parts:
        c.visible = (-(-(-(-height * c.down // d)) // 8), -(-(-(-width * c.across // a)) // 8))
        c.blocks = np.zeros((high * c.down, wide * c.across, 64), np.int32)
    return picture


def scan(picture: Picture, data: bytes, at: int, body: bytes, tables: dict[int, list[int]], interval: int) -> int:
    """Decodes one scan into the picture's blocks; where the next marker stands."""
    n = body[0]
    if len(body) != 4 + 2 * n:
        raise Unfit("corrupt")
    names = {c.name: k for k, c in enumerate(picture.components)}
    chosen = [names.get(body[1 + 2 * k], -1) for k in range(n)]
    dc, ac = ([tables.get(high << 4 | (body[2 + 2 * k] >> 4 if not high else body[2 + 2 * k] & 15)) for k in range(n)] for high in (0, 1))
    start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if not picture.progressive:
        start, end, high, low = 0, 63, 0, 0
    if -1 in chosen or not chosen or end > 63 or start > end or picture.progressive and start == 0 < end or start and n > 1:
        raise Unfit("corrupt")
    if start == 0 and not high and None in dc or end and None in ac:
        raise Unfit("corrupt")
    # stretches between restart markers
    stretches, begin = [], at
    while True:
        at = data.index(b"\xff", at) if data.find(b"\xff", at) >= 0 else len(data)
        if at + 1 >= len(data):
            raise Unfit("data ends early")
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            stretches.append(data[begin:at])
            at += 2
            begin = at
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            stretches.append(data[begin:at].rstrip(b"\xff") if data[at - 1] == 0xFF else data[begin:at])
            break
    readers = iter(stretches)
    reader, last, run, blocks = Reader(next(readers)), [0] * n, 0, [picture.components[c].blocks for c in chosen]
    for count, unit in enumerate(places(picture, chosen)):
        if interval and count and count % interval == 0:
            following = next(readers, None)
            if following is None:
                raise Unfit("data ends early")
            reader, last, run = Reader(following), [0] * n, 0
        for k, y, x in unit:
            block = blocks[k][y, x]
            if start == 0:
                if high:
                    block[0] |= reader.bits(1) << low
                else:
                    last[k] += reader.number(reader.symbol(dc[k]) & 15)
                    block[0] = last[k] << low
                if end == 0:
                    continue
            if high:
                run = refined(reader, ac[k], block, start, end, 1 << low, run)
                continue
            if run:
                run -= 1
                continue
            at_ = max(start, 1)
            while at_ <= end:
                symbol = reader.symbol(ac[k])
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    at_ += zeros
                    if at_ > end:
                        raise Unfit("bad code")
                    block[at_] = reader.number(size) << low if low == 0 else reader.number(size) * (1 << low)
                    at_ += 1
                elif zeros == 15:
                    at_ += 16
                elif not picture.progressive:
                    break
                else:
                    run = (1 << zeros) + reader.bits(zeros) - 1
                    break
    return at


def refined(reader: Reader, table: list[int], block: np.ndarray, start: int, end: int, bit: int, run: int) -> int:
    """One more bit of a block's coefficients; the blocks of the run of ended ones that are left."""
    values, at = block.tolist(), start

    def correct(k):
        if reader.bits(1) and not abs(values[k]) & bit:
            values[k] += bit if values[k] > 0 else -bit

    if not run:
        while at <= end:
            symbol = reader.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = bit if reader.bits(1) else -bit
            elif zeros < 15:
                run = (1 << zeros) + reader.bits(zeros)
                break
            while at <= end:
                if values[at]:
                    correct(at)
                elif zeros:
                    zeros -= 1
                else:
                    break
                at += 1
            if new:
                if at > end:
                    raise Unfit("bad code")
                values[at] = new
            at += 1
    if run:
        for k in range(at, end + 1):
            if values[k]:
                correct(k)
        run -= 1
    block[:] = values
    return run


class Scan:
    """The symbols and raw bits of a scan, gathered first so that their codes can be made to measure."""

    def __init__(self):
        self.items: list[tuple[int, int, int, int]] = []  # table (-1: none), symbol, raw bits, how many

    def symbol(self, table: int, symbol: int, raw: int = 0, n: int = 0):
        self.items.append((table, symbol, raw, n))

    def number(self, table: int, zeros: int, value: int):
        n = abs(value).bit_length()
        if n > 15:
            raise Unfit("a coefficient is out of range")
        self.symbol(table, zeros << 4 | n, value if value > 0 else value + (1 << n) - 1, n)

    def written(self) -> tuple[dict[int, dict[int, int]], bytes]:
        """Code lengths by table, and the stuffed bytes."""
        counts: dict[int, Counter] = {}
        for table, symbol, _, _ in self.items:
            if table >= 0:
                counts.setdefault(table, Counter())[symbol] += 1
        lengths = {table: code_lengths(found) for table, found in counts.items()}
        codes = {table: {s: (code, of[s]) for s, code in canonical(of).items()} for table, of in lengths.items()}
        held, n, out = 0, 0, []
        for table, symbol, raw, size in self.items:
            if table >= 0:
                code, length = codes[table][symbol]
                held, n = held << length | code, n + length
            held, n = held << size | raw, n + size
            if n > 4096:
                keep = n & 7
                out.append((held >> keep).to_bytes((n - keep) // 8, "big"))
                held, n = held & ((1 << keep) - 1), keep
        pad = -n % 8
        out.append(((held << pad) | ((1 << pad) - 1)).to_bytes((n + pad) // 8, "big"))
        return lengths, b"".join(out).replace(b"\xff", b"\xff\x00")


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def coded(picture: Picture, chosen: list[int], start: int, end: int, high: int, low: int, progressive: bool) -> bytes:
    """One scan with its code tables. Tables: 0 and 1 for first coefficients, 16 and 17 for the others; the first component has its own."""
    scan_, last, run, pending = Scan(), [0] * len(chosen), 0, []
    blocks = [picture.components[c].blocks for c in chosen]
    own = [min(c, 1) for c in chosen]

    def ended():
        nonlocal run, pending
        if run:
            n = run.bit_length() - 1
            scan_.symbol(16 + own[0], n << 4, run - (1 << n), n)
            run = 0
        for bit in pending:
            scan_.symbol(-1, 0, bit, 1)
        pending = []

    for unit in places(picture, chosen):
        for k, y, x in unit:
            values = blocks[k][y, x].tolist()
            if start == 0:
                if high:
                    scan_.symbol(-1, 0, values[0] >> low & 1, 1)
                else:
                    first = values[0] >> low
                    scan_.number(own[k], 0, first - last[k])
                    last[k] = first
                if end == 0:
                    continue
            table, zeros = 16 + own[k], 0
            cut = [(abs(v) >> low) * (1 if v > 0 else -1) for v in values]
            stop = next((j for j in range(end, max(start, 1) - 1, -1) if (abs(cut[j]) == 1 if high else cut[j])), 0)
            if high:
                bits: list[int] = []
                for j in range(start, end + 1):
                    size = abs(cut[j])
                    if not size:
                        zeros += 1
                        continue
                    while zeros > 15 and j <= stop:
                        ended()
                        scan_.symbol(table, 0xF0)
                        for bit in bits:
                            scan_.symbol(-1, 0, bit, 1)
                        bits, zeros = [], zeros - 16
                    if size > 1:
                        bits.append(size & 1)
                        continue
                    ended()
                    scan_.symbol(table, zeros << 4 | 1, int(cut[j] > 0), 1)
                    for bit in bits:
                        scan_.symbol(-1, 0, bit, 1)
                    bits, zeros = [], 0
                if zeros or bits:
                    run += 1
                    pending += bits
                    if run == MOST_RUN or len(pending) > 900:
                        ended()
                continue
            for j in range(max(start, 1), stop + 1):
                if not cut[j]:
                    zeros += 1
                    continue
                ended()
                while zeros > 15:
                    scan_.symbol(table, 0xF0)
                    zeros -= 16
                scan_.number(table, zeros, cut[j])
                zeros = 0
            if stop < end:
                if not progressive:
                    scan_.symbol(table, 0)
                else:
                    run += 1
                    if run == MOST_RUN:
                        ended()
    ended()
    lengths, raw = scan_.written()
    out = b""
    for table, of in sorted(lengths.items()):
        per = Counter(of.values())
        out += segment(DHT, bytes([table, *(per.get(k, 0) for k in range(1, 17))]) + bytes(of))
    body = bytes([len(chosen)]) + b"".join(bytes([picture.components[c].name, own[k] << 4 | own[k]]) for k, c in enumerate(chosen)) + bytes([start, end, high << 4 | low])
    return out + segment(SOS, body) + raw


def script(picture: Picture, progressive: bool) -> list[tuple[list[int], int, int, int, int]]:
    """Scans of a file: which components, from and to which coefficient, and between which bits."""
    n = len(picture.components)
    groups = [list(range(n))] if n > 1 and sum(c.across * c.down for c in picture.components) <= MOST_UNIT else [[k] for k in range(n)]
    if not progressive:
        return [(group, 0, 63, 0, 0) for group in groups]
    first = [(group, 0, 0, 0, 1) for group in groups]
    rough = [([k], 1, 63 if k else 5, 0, 1 if k else 2) for k in range(n)] + [([0], 6, 63, 0, 2), ([0], 1, 63, 2, 1)]
    return [*first, *rough, *((group, 0, 0, 1, 0) for group in groups), *(([k], 1, 63, 1, 0) for k in reversed(range(n)))]


def exif(value: int) -> bytes:
    """The smallest Exif body that tells an orientation."""
    return b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, value, 0, 0)


def kept(header: list[tuple[int, bytes]], strip: bool) -> list[tuple[int, bytes]]:
    """A file's application segments and comments; without metadata only what shows: JFIF, colour profiles, Adobe's transform, and the orientation in a body made anew."""
    if not strip:
        return header
    out = [(m, b) for m, b in header if m == APP0 and b[:5] == b"JFIF\0" or m == 0xE2 and b[:12] == b"ICC_PROFILE\0" or m == APP14 and b[:5] == b"Adobe"]
    turned = next((o for m, b in header if m == 0xE1 and (o := orientation(b, 0, len(b))) != 1), 1)
    return out + ([(0xE1, exif(turned))] if turned != 1 else [])


def encode(picture: Picture, progressive: bool, strip: bool = False) -> bytes:
    """The picture's coefficients as a file with optimal codes."""
    out = [b"\xff\xd8", *(segment(m, b) for m, b in kept(picture.header, strip)), *(segment(DQT, body) for _, body in sorted(picture.quantisers.items()))]
    parts = b"".join(bytes([c.name, c.across << 4 | c.down, c.quantiser]) for c in picture.components)
    out.append(segment(0xC2 if progressive else 0xC0 if max(b[0] >> 4 for b in picture.quantisers.values()) == 0 else 0xC1, struct.pack(">BHHB", 8, picture.height, picture.width, len(picture.components)) + parts))
    out += [coded(picture, *step, progressive) for step in script(picture, progressive)]
    return b"".join(out) + b"\xff\xd9"


def coefficients(data: bytes) -> list[np.ndarray] | None:
    """The visible blocks of each component; None for what can't be decoded. Padding to whole units is left out."""
    try:
        picture = decode(data)
    except Unfit:
        return None
    return [c.blocks[: c.visible[0], : c.visible[1]] for c in picture.components]


def same_coefficients(a: bytes, b: bytes) -> bool:
    x, y = coefficients(a), coefficients(b)
    return x is not None and y is not None and len(x) == len(y) and all(p.shape == q.shape and (p == q).all() for p, q in zip(x, y, strict=True))


def smaller(data: bytes, strip: bool = False) -> bytes | None:
    """The smaller of the sequential and the progressive form, of equals the sequential; None if neither is smaller than the file."""
    picture = decode(data)
    made = min((encode(picture, way, strip) for way in (False, True)), key=len)
    return made if len(made) < len(data) else None
