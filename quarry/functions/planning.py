"""Plans made before a file is touched: output names, formats on offer, sizes of pages and videos, watermark placement. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import scalars as S

# Formats on offer by family, in the order shown, and the format that an extension stands for where the two differ.
TARGETS = {"image": ("jpg", "png", "webp", "pdf"), "pdf": ("jpg", "png", "webp"), "video": ("mp4", "webm", "m4a", "wav"), "audio": ("m4a", "wav", "webm")}
ALIASES = {"jpeg": "jpg", "jfif": "jpg"}
# What a task adds to a name; bits per pixel, longest short side and audio rate by mode.
SUFFIXES = {"compress": ".compressed", "removebg": ".nobg"}
VIDEO = {"balanced": (0.06, 1080, 128_000), "compact": (0.035, 720, 96_000)}
LONGEST_LABEL = 120


def literal_array(values, kind: str = "array<string>") -> Column:
    return F.array(*map(F.lit, values)).cast(kind)


def targets(name: Column) -> Column:
    """What a file can be converted to: its family's formats, in order, without the one it already has; empty for other families."""
    own = S.extension(name)
    for alias, real in ALIASES.items():
        own = F.when(own == alias, real).otherwise(own)
    offered = literal_array(())
    for family, formats in TARGETS.items():
        offered = F.when(S.category(name) == family, literal_array(formats)).otherwise(offered)
    return F.when((S.category(name) == "pdf"), offered).otherwise(F.filter(offered, lambda t: t != own))


def stem(name: Column) -> Column:
    """A safe name without its last extension, never empty."""
    short = F.regexp_replace(S.safe_name(name), r"\.[^.]*$", "")
    return F.when(short == "", "file").otherwise(short)


def output_name(name: Column, task: Column, extension: Column) -> Column:
    added = F.lit("")
    for of, suffix in SUFFIXES.items():
        added = F.when(task == of, suffix).otherwise(added)
    return F.concat(stem(name), added, F.lit("."), extension)


def numbered_name(base: Column, k: Column, count: Column, extension: str, least: int) -> Column:
    """base-NN.extension with as many digits as the count has, at least `least`; base.extension if there is one only."""
    digits = F.greatest(F.lit(least), F.length(count.cast("string")))
    padded = F.concat(F.repeat(F.lit("0"), digits - F.length(k.cast("string"))), k.cast("string"))
    return F.when(count == 1, F.concat(base, F.lit("." + extension))).otherwise(F.concat(base, F.lit("-"), padded, F.lit("." + extension)))


def render_scale(width: Column, height: Column) -> Column:
    """150 dots an inch, within 6000 on the longer side and 36 million in all."""
    return F.least(F.lit(150 / 72), 6000 / F.greatest(width, height), F.sqrt(F.lit(36e6) / (width * height)))


def video_plan(mode: Column, width: Column, height: Column, rate: Column, bits: Column) -> list[Column]:
    """reason, width, height, fps and bitrate of a video; rate: frames a second or null, bits: the source's bits a second. The plan is null where there is a reason against it."""
    pick = lambda k: F.when(mode == "balanced", float(VIDEO["balanced"][k])).otherwise(float(VIDEO["compact"][k]))
    reason = F.when(mode == "lossless", "video-lossless").when(width.cast("double") * height > 7680 * 4320, "too-large")
    fps = F.least(F.lit(60), F.greatest(F.lit(1), S.half_up(F.coalesce(F.nullif(rate, F.lit(0.0)), F.lit(30.0)))))
    scale = F.least(F.lit(1.0), pick(1) / F.least(width, height))
    w, h = S.even(width * scale), S.even(height * scale)
    bitrate = F.greatest(F.lit(250_000), F.least(S.half_up(w * h * fps * pick(0)), S.half_up(bits * 0.85)))
    return [reason.alias("reason"), *(F.when(reason.isNull(), c).cast("long").alias(n) for n, c in (("width", w), ("height", h), ("fps", fps), ("bitrate", bitrate)))]


def keeps_audio(mode: Column, codec: Column, bits: Column) -> Column:
    """Whether an audio track is copied as it is: a compact codec at a rate near the preset's. An unknown rate is too much."""
    limit = F.when(mode == "balanced", VIDEO["balanced"][2] * 1.25).otherwise(VIDEO["compact"][2] * 1.25)
    return F.coalesce(codec.isin("aac", "opus") & (bits <= limit), F.lit(False))


def watermark_label(text: Column) -> Column:
    """Plain quotes, single spaces, at most 120 characters; characters that the standard fonts lack become question marks. Null if nothing is left."""
    plain = F.translate(text, "‘’“”", "''\"\"")
    plain = F.regexp_replace(plain, r"(?U)[\s\x{FEFF}]+", " ")
    plain = F.substring(F.trim(plain), 1, LONGEST_LABEL)
    return F.nullif(F.regexp_replace(plain, r"[^\x20-\x7E\x{A0}-\x{FF}]", "?"), F.lit(""))


def watermark(width: Column, height: Column, unit: Column, size: Column, opacity: Column) -> list[Column]:
    """size, x, y, angle (degrees) and alpha of a label along a page's diagonal, centred; unit: the label's width at size 1."""
    angle = F.atan2(height, width)
    fits = F.least(size, F.hypot(width, height) * 0.8 / F.greatest(F.lit(1.0), unit))
    half = unit * fits / 2
    x = width / 2 - half * F.cos(angle) + fits / 3 * F.sin(angle)
    y = height / 2 - half * F.sin(angle) - fits / 3 * F.cos(angle)
    return [fits.alias("size"), x.alias("x"), y.alias("y"), F.degrees(angle).alias("angle"), F.least(F.lit(0.9), F.greatest(F.lit(0.05), opacity)).alias("alpha")]


def dabs(x0: Column, y0: Column, x1: Column, y1: Column, radius: Column) -> Column:
    """The points, as an array of structs, that a brush stroke leaves between two positions: a quarter of the radius apart at most, the last at the end."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(x1 - x0, y1 - y0) / F.greatest(F.lit(1.0), radius / 4))).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct((x0 + (x1 - x0) * k / n).alias("x"), (y0 + (y1 - y0) * k / n).alias("y")))
