"""Whole-file engines: bytes in; a candidate, a reason or both out. One registry entry per kind, and the keep-only-if-smaller-and-verified decision as expressions."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.functions import rules, scalars as S
from quarry.operators import packages
from quarry.sources import archives, jpeg, pdf

# Chunks that a picture can lose without changing how it looks; elements of an office package's metadata parts that are emptied.
PNG_METADATA = ("tEXt", "zTXt", "iTXt", "eXIf", "tIME")


CLEARED = {"docProps/core.xml": ("dc:creator", "cp:lastModifiedBy", "cp:keywords", "dc:description", "cp:category"), "docProps/app.xml": ("Company", "Manager", "HyperlinkBase")}


def office_name(names: list[str]) -> tuple[str, bool] | None:
    """The short name of an office package's kind and whether it holds macros; None for other archives."""
    kind = next((short for folder, short in packages.FOLDERS if any(n.startswith(folder) for n in names)), None)
    return (kind, any(re.search(r"(?i)(^|/)vbaProject\.bin$", n) for n in names)) if kind and packages.TYPES_PART in names else None


def emptied(raw: bytes, tags: tuple[str, ...]) -> bytes | None:
    """An XML part with these elements' text taken out; None if it is large, not UTF-8 or has none of them."""
    if len(raw) > packages.MOST_METADATA:
        return None
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    out = text
    for tag in tags:
        head, close, at, made = f"<{tag}>", f"</{tag}>", 0, []
        while (start := out.find(head, at)) >= 0 and (end := out.find(close, start)) >= 0:
            made.append(out[at : start + len(head)])
            at = end
        out = "".join(made) + out[at:]
    return out.encode() if out != text else None


def office_engine(data: bytes, found: list[dict], macro: bool, allow_macros: bool = False, strip: bool = False) -> tuple[bytes | None, list[tuple[str, bool]]]:
    """A package with its parts packed anew, its pictures optimised without loss and, if asked for, its metadata emptied. Macros and what belongs to signatures stay byte for byte; a signed package is only packed."""
    if macro and not allow_macros:
        raise archives.Corrupt("macro")
    signed = any(e["name"].startswith("_xmlsignatures/") for e in found)

    def policy(e):
        name = e["name"]
        if re.search(rules.VERBATIM, name):
            return "copy"
        return "transform" if not signed and (re.search(rules.MEDIA, name) or strip and name in CLEARED) else "pack"

    def transform(name, raw):
        if name in CLEARED:
            return emptied(raw, CLEARED[name])
        try:  # any doubt keeps the picture
            made, checks = (png_engine if name.lower().endswith(".png") else jpeg_engine)(raw, strip)
        except (archives.Corrupt, zlib.error, struct.error, IndexError, ValueError):
            return None
        return made if made is not None and all(ok for _, ok in checks) else None

    return checked(data, *archives.rewrite(data, transform, policy))


def zip_engine(data: bytes) -> tuple[bytes | None, list[tuple[str, bool]]]:
    found = archives.directory(data)
    names = [e["name"] for e in found]
    if unsafe(names):
        raise archives.Corrupt("unsafe-paths")
    if office := office_name(names):
        return office_engine(data, found, office[1])
    first = lambda e: "copy" if e["index"] == 0 and e["name"] == "mimetype" else "pack"
    return checked(data, *archives.rewrite(data, policy=first))


def unsafe(names: list[str]) -> bool:
    """Whether any name could leave its folder or clash with a device, a trimmed name or, but for case, slashes and accents, with another."""
    device = re.compile(rf"(?i)({S.DEVICES})(\..*)?$")
    for name in names:
        parts = re.split(r"[\\/]", re.sub(r"[\\/]$", "", name))
        if re.match(r"[\\/]", name) or re.search(r"[\x00-\x1F:]", name) or any(p == ".." or device.match(p) or (p != "." and re.search(r"[. ]$", p)) for p in parts):
            return True
    folded = [unicodedata.normalize("NFC", n).lower().replace("\\", "/") for n in names]
    return len(set(folded)) < len(folded)


def checked(data: bytes, made: bytes, changed: set[int]) -> tuple[bytes, list[tuple[str, bool]]]:
    """A rewritten archive with its proofs against the one before."""
    before, after = archives.directory(data), archives.directory(made)
    same = len(before) == len(after) and all(a[k] == b[k] for a, b in zip(before, after, strict=True) for k in ("name", "external", "time", "date") + (() if a["index"] in changed else ("crc", "usize")))
    left = archives.budget(len(made))
    opens = all(archives.content(made, e, left) is not None for e in after if e["readable"])
    return made, [("same entries", same), ("every entry opens", opens)]


def png_engine(data: bytes, strip: bool = False) -> tuple[bytes | None, list[tuple[str, bool]]]:
    made = archives.recompress_png(data, PNG_METADATA if strip else ())
    if made is None:
        return None, []
    pixels = lambda x: zlib.decompress(b"".join(x[a : a + n] for k, a, n in archives.png_chunks(x) if k == "IDAT"))
    return made, [("same pixels", pixels(made) == pixels(data))]


def jpeg_engine(data: bytes, strip: bool = False) -> tuple[bytes | None, list[tuple[str, bool]]]:
    try:
        made = jpeg.smaller(data, strip)
    except jpeg.Unfit as error:
        raise archives.Corrupt(str(error)) from error
    return made, [] if made is None else [("same coefficients", jpeg.same_coefficients(data, made))]


def pdf_engine(data: bytes) -> tuple[bytes | None, list[tuple[str, bool]]]:
    try:
        return pdf.compress(data)
    except pdf.Unfit as error:
        raise archives.Corrupt(str(error)) from error


#: A new format is one function here.
ENGINES: dict[str, Callable[[bytes], tuple[bytes | None, list[tuple[str, bool]]]]] = {"zip": zip_engine, "png": png_engine, "jpeg": jpeg_engine, "pdf": pdf_engine}
SCHEMA = "file_id string, candidate binary, checks array<struct<label:string,ok:boolean>>, failure string"


def compress(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, kind, format, optimized, reason, input_size, output_size, checks, sha256_in, sha256_out, crc32 and output (the file to keep) of each file.

    Files are dispatched by their first bytes. A failed check is `validation`; a candidate above 99 % of the input is `already-optimal`; a kind without an engine is `unsupported`; a file that can't be parsed is `corrupt` or has its own reason. One file's failure never fails a task.
    """
    kind, fmt = S.sniff("content")
    rows = files.select(F.col(id_col).cast("string").alias("file_id"), F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).alias("content")).withColumn("kind", kind).withColumn("format", fmt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, format_ in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                made, checks, failure = None, [], None
                try:
                    made, checks = ENGINES[format_](data)
                except archives.Corrupt as error:
                    failure = str(error) if str(error) in ("unsafe-paths", "validation", "unreadable", "macro", "unsupported", "too-large", "encrypted", "signed") else "corrupt"
                except (zlib.error, struct.error, IndexError, ValueError):
                    failure = "corrupt"
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([data], pa.binary()), pa.array([made], pa.binary()), pa.array([[{"label": a, "ok": b} for a, b in checks]], pa.list_(pa.struct([("label", pa.string()), ("ok", pa.bool_())]))), pa.array([failure], pa.string())], ["file_id", "content", "candidate", "checks", "failure"])

    known = rows.where(F.col("format").isin(*ENGINES))
    done = known.select("file_id", "content", "format").mapInArrow(run, SCHEMA.replace("candidate", "content binary, candidate")).withColumn("kind", S.sniff("content")[0]).withColumn("format", S.sniff("content")[1])
    other = rows.where(~F.col("format").isin(*ENGINES)).select("file_id", "content", F.lit(None).cast("binary").alias("candidate"), F.expr("CAST(array() AS array<struct<label:string,ok:boolean>>)").alias("checks"), F.lit("unsupported").alias("failure"), "kind", "format")
    both = done.unionByName(other)
    size, out = F.octet_length("content").cast("long"), F.octet_length("candidate").cast("long")
    reason = F.when(F.col("failure").isNotNull(), F.col("failure")).when(~F.forall("checks", lambda c: c["ok"]), "validation").when(F.col("candidate").isNull() | (out > size * 0.99), "already-optimal")
    decided = both.withColumn("reason", reason)
    kept = F.when(F.col("reason").isNull(), F.col("candidate")).otherwise(F.col("content"))
    return decided.select("file_id", "kind", "format", F.col("reason").isNull().alias("optimized"), "reason", size.alias("input_size"), F.when(F.col("reason").isNull(), out).alias("output_size"), "checks", F.sha2("content", 256).alias("sha256_in"), F.sha2(kept, 256).alias("sha256_out"), F.crc32(kept).alias("crc32"), kept.alias("output"))
