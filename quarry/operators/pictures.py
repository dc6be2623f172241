"""Pictures: resampling by the pixels that each reaches, the segments of a JPEG file, and optimal prefix codes. After the public ITU T.81 and Exif specifications."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Markers without a body, and of frames that are read.
BARE, FRAMES = {0x01, *range(0xD0, 0xD9)}, {0xC0, 0xC1, 0xC2}
MOST_PIXELS, LONGEST_CODE, RESERVED = 120_000_000, 16, 256
#: More than rounding can move a place, in pixels.
SLACK = 1e-6
SEGMENTS = "array<struct<marker:int,at:int,size:int>>"


def upsample(image: DataFrame, key: str, width: int, height: int, value: str = "v") -> DataFrame:
    """key, y, x, value of every picture resampled to width by height, bilinear with pixel centres and clamped edges.

    Each new pixel is a weighted sum of up to four. Pixels are shuffled once, by picture, to learn its size from a window; each then lists the new pixels that it reaches, and these are summed where they are. No table of taps is joined: its size can't be estimated, so that it might be broadcast. All of this spills; one picture is one task's. Null pixels add nothing, and a new pixel that only null ones reach is null; pictures may differ in size, and a null key is a picture of its own.
    """
    whole = Window.partitionBy(key)
    rows = image.select(key, "y", "x", F.col(value).cast("double").alias("_v"), (F.max("x").over(whole) + 1).alias("_w"), (F.max("y").over(whole) + 1).alias("_h"))
    for name, size, count in (("x", "_w", width), ("y", "_h", height)):
        at, to = F.col(name), f"_{name}"
        reach = lambda shift, size=size, count=count, at=at: (at + shift) * F.lit(float(count)) / F.col(size) - 0.5
        first = F.when(at <= 1, 0).otherwise(F.least(F.lit(count - 1), F.greatest(F.lit(0), F.ceil(reach(-0.5) - SLACK)))).cast("int")
        last = F.when(at >= F.col(size) - 1, count - 1).otherwise(F.least(F.lit(count - 1), F.greatest(first, F.floor(reach(1.5) + SLACK)))).cast("int")
        rows = rows.select("*", F.explode(F.sequence(first, last)).alias(to))  # a few too many
        place = F.least(F.greatest((F.col(to) + 0.5) * F.col(size) / count - 0.5, F.lit(0.0)), (F.col(size) - 1).cast("double"))
        step, part = at - F.floor(place), place - F.floor(place)
        rows = rows.where(step.isin(0, 1)).withColumn(f"_s{name}", F.when(step == 0, 1 - part).otherwise(part))
    return rows.groupBy(key, F.col("_y").alias("y"), F.col("_x").alias("x")).agg(F.sum(F.col("_v") * F.col("_sx") * F.col("_sy")).alias(value))


def orientation(data: bytes, at: int, size: int) -> int:
    """The orientation tag of an Exif segment's body, in either byte order; 1 if it has none or is malformed."""
    body = data[at : at + size]
    if body[:6] != b"Exif\0\0" or len(body) < 14:
        return 1
    tiff = body[6:]
    order = "<" if tiff[:1] == b"I" else ">"
    try:
        start = struct.unpack_from(order + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(order + "H", tiff, start)[0]):
            tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, start + 2 + 12 * k)
            if tag == 0x0112:
                return value
    except struct.error:
        pass
    return 1


def segments(data: bytes) -> dict:
    """Size, components, kind and orientation of a JPEG file and its segments up to the first scan; reason says why it can't be read."""
    out: dict = {"width": None, "height": None, "components": None, "progressive": None, "orientation": 1, "segments": [], "reason": None}
    if data[:2] != b"\xff\xd8":
        return out | {"reason": "unreadable"}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return out | {"reason": "corrupt"}
        marker = data[at + 1]
        if marker == 0xFF or marker in BARE:  # fill bytes, markers without a body
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            return out | {"reason": "corrupt"}
        out["segments"].append({"marker": marker, "at": at, "size": size + 2})
        if marker == 0xE1 and out["orientation"] == 1:
            out["orientation"] = orientation(data, at + 4, size - 2)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if marker not in FRAMES or size < 8 or data[at + 4] != 8:
                return out | {"reason": "unsupported"}
            out["height"], out["width"], out["components"] = struct.unpack_from(">HHB", data, at + 5)
            out["progressive"] = marker == 0xC2
            if not out["width"] or not out["height"] or not 1 <= out["components"] <= 4:
                return out | {"reason": "corrupt"}
            if out["width"] * out["height"] > MOST_PIXELS:
                return out | {"reason": "too-large"}
        if marker == 0xDA:
            break
        at += 2 + size
    return out if out["width"] else out | {"reason": "corrupt"}


def jpeg_info(files: DataFrame, key: str, content: str) -> DataFrame:
    """key and what `segments` finds, one row per file; null contents are unreadable. Nothing is shuffled."""
    base = files.select(key, F.col(content).cast("binary").alias("content"))
    names = ("width", "height", "components", "progressive", "orientation", "segments", "reason")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.struct([("marker", pa.int32()), ("at", pa.int32()), ("size", pa.int32())])), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(data or b"") for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[n] for f in found], t) for n, t in zip(names, kinds, strict=True))], [key, *names])

    kind = base.schema[key].dataType.simpleString()
    return base.mapInArrow(run, f"`{key}` {kind}, width int, height int, components int, progressive boolean, orientation int, segments {SEGMENTS}, reason string")


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of an optimal prefix code with at most LONGEST_CODE bits, in which no code is all ones.

    A reserved symbol of count 1 takes the all-ones code. Of equal counts the larger symbol is merged first; a merged pair goes by the symbol that was taken first. Codes that come out too long are shortened pair by pair as in the standard's annex K.
    """
    heap = [(n, -s, (s,)) for s, n in counts.items() if n > 0] + [(1, -RESERVED, (RESERVED,))]
    heapq.heapify(heap)
    depth = dict.fromkeys((s for _, _, group in heap for s in group), 0)
    while len(heap) > 1:
        n, place, group = heapq.heappop(heap)
        m, _, other = heapq.heappop(heap)
        for s in (*group, *other):
            depth[s] += 1
        heapq.heappush(heap, (n + m, place, group + other))
    per = [0] * (max(depth.values(), default=0) + 2)
    for length in depth.values():
        per[length] += 1
    for length in range(len(per) - 1, LONGEST_CODE, -1):
        while per[length] > 0:
            free = length - 2
            while not per[free]:
                free -= 1
            per[length] -= 2
            per[length - 1] += 1
            per[free + 1] += 2
            per[free] -= 1
    longest = max((k for k, n in enumerate(per) if n), default=0)
    if longest:
        per[longest] -= 1  # the reserved symbol's
    ordered = iter(sorted((s for s in depth if s != RESERVED), key=lambda s: (depth[s], s)))
    return {next(ordered): length for length in range(1, len(per)) for _ in range(per[length])}


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Codes by symbol: counted up from zero through the lengths, symbols in the order given."""
    code, last, out = 0, 0, {}
    for s, length in lengths.items():
        code <<= length - last
        out[s], last = code, length
        code += 1
    return out


def prefix_codes(symbols: DataFrame, key: str, symbol: str, weight: str | None = None) -> DataFrame:
    """key, symbol (0 to 255), count, length and code; weight: how often a row's symbol stands, once without it. Symbols are counted by an aggregation with partial results, so a table's group has 256 rows at most; symbols out of range or null are left out."""
    counted = symbols.where(F.col(symbol).between(0, 255)).groupBy(F.col(key), F.col(symbol).cast("int").alias("symbol")).agg((F.sum(weight) if weight else F.count("*")).alias("count"))

    def build(table: pa.Table) -> pa.Table:
        counts = dict(zip(table["symbol"].to_pylist(), table["count"].to_pylist(), strict=True))
        lengths = code_lengths(counts)
        codes = canonical(lengths)
        return pa.table({key: table[key].slice(0, 1).take(pa.array([0] * len(lengths))), "symbol": pa.array(lengths, pa.int32()), "count": pa.array([counts[s] for s in lengths], pa.int64()), "length": pa.array(lengths.values(), pa.int32()), "code": pa.array(codes.values(), pa.int32())})

    kind = counted.schema[key].dataType.simpleString()
    return counted.groupBy(key).applyInArrow(build, f"`{key}` {kind}, symbol int, count long, length int, code int")


def network_input(channels: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """key, place and x of a segmentation network's input, from bytes of pixels with four channels each: planes of red, green and blue, divided by the picture's brightest value (1 at least), centred on 0.5."""
    colours = channels.where(F.col(index) % 4 < 3)
    most = colours.groupBy(F.col(key).alias("_k")).agg(F.greatest(F.lit(1), F.max(value)).alias("_most"))
    counts = channels.groupBy(F.col(key).alias("_c")).agg(F.floor(F.count("*") / 4).alias("_n"))
    both = colours.join(most, F.col(key) == F.col("_k")).join(counts, F.col(key) == F.col("_c"))
    return both.select(key, ((F.col(index) % 4) * F.col("_n") + F.floor(F.col(index) / 4)).cast("int").alias("place"), (F.col(value) / F.col("_most") - 0.5).alias("x"))


def opacity(channels: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """key, opaque (every fourth channel is full) and transparent (one is not)."""
    return channels.where(F.col(index) % 4 == 3).groupBy(key).agg(F.bool_and(F.col(value) == 255).alias("opaque"), F.bool_or(F.col(value) < 255).alias("transparent"))


def symbol_counts(texts: DataFrame, group: str, text: str) -> DataFrame:
    """group, symbol and n: how often each byte of the whole texts stands. A task counts its rows' bytes and sends at most 256 rows a group; null texts have none, a null group is one."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held = {}
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value:
                    counts = np.bincount(np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
                    held[key] = held[key] + counts if key in held else counts
            if len(held) >= 10_000:
                yield from sent(held)
                held = {}
        yield from sent(held)

    def sent(held):
        for key, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], [group, "symbol", "n"])

    partial = texts.select(F.col(group).cast("string").alias(group), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{group}` string, symbol int, n long")
    return partial.groupBy(group, "symbol").agg(F.sum("n").alias("n"))
