"""Scalar operators on file names, bytes, sizes and settings, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File name extensions by family, in the order in which families are listed.
FAMILIES = {
    "image": ("jpg", "jpeg", "jfif", "png", "webp", "avif", "heic", "heif", "bmp", "tif", "tiff", "gif", "svg"),
    "pdf": ("pdf",),
    "presentation": ("pptx", "pptm", "odp"),
    "spreadsheet": ("xlsx", "xlsm", "ods"),
    "document": ("docx", "docm", "odt"),
    "video": ("mp4", "m4v", "mov", "mkv", "webm"),
    "audio": ("wav", "mp3", "m4a", "ogg", "opus", "flac"),
    "archive": ("zip",),
}
#: Signatures of the first bytes, tried in this order; (kind, format, SQL over `content`).
SIGNATURES = (
    ("image", "jpeg", "substring(content, 1, 3) = X'FFD8FF'"),
    ("image", "png", "substring(content, 1, 8) = X'89504E470D0A1A0A'"),
    ("image", "webp", "substring(content, 1, 4) = X'52494646' AND substring(content, 9, 4) = X'57454250'"),
    ("image", "gif", "substring(content, 1, 4) = X'47494638'"),
    ("image", "bmp", "substring(content, 1, 2) = X'424D' AND octet_length(content) > 26 AND substring(content, 15, 1) >= X'0C' AND substring(content, 16, 1) = X'00'"),
    ("audio", "wav", "substring(content, 1, 4) = X'52494646' AND substring(content, 9, 4) = X'57415645'"),
    ("audio", "ogg", "substring(content, 1, 4) = X'4F676753'"),
    ("audio", "flac", "substring(content, 1, 4) = X'664C6143'"),
    ("audio", "mp3", "substring(content, 1, 3) = X'494433' OR (substring(content, 1, 1) = X'FF' AND conv(hex(substring(content, 2, 1)), 16, 10) & 230 = 226)"),
    ("image", "avif", "substring(content, 5, 4) = X'66747970' AND substring(content, 9, 3) = X'617669'"),
    ("image", "heic", "substring(content, 5, 4) = X'66747970' AND substring(content, 9, 3) IN (X'686569', X'6D6966', X'6D7366')"),
    ("audio", "m4a", "substring(content, 5, 4) = X'66747970' AND substring(content, 9, 4) IN (X'4D344120', X'4D344220')"),
    ("video", "mp4", "substring(content, 5, 4) = X'66747970'"),
    ("video", "mkv", "substring(content, 1, 4) = X'1A45DFA3'"),
    ("pdf", "pdf", "instr(decode(substring(content, 1, 1024), 'ISO-8859-1'), '%PDF-') > 0"),
    ("zip", "zip", "substring(content, 1, 4) IN (X'504B0304', X'504B0506')"),
)
# Names that stand for devices.
DEVICES = r"con|prn|aux|nul|conin\$|conout\$|com[0-9¹²³]|lpt[0-9¹²³]"
BIDI = "\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}"
MIB, GIB = 1 << 20, 1 << 30


def case_sql(pick: int) -> str:
    return "CASE " + " ".join(f"WHEN {s[2]} THEN '{s[pick]}'" for s in SIGNATURES) + (" ELSE 'other' END" if pick == 0 else " ELSE '' END")


def sniff(content: str) -> tuple[Column, Column]:
    """kind and format of the bytes in a column; the first signature that fits wins."""
    return tuple(F.expr(case_sql(k).replace("content", f"`{content}`")) for k in (0, 1))


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; the whole name without one."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def category(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for family, all_ in FAMILIES.items() for e in all_ for x in (e, family)))
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit("other"))


def nfc(name: Column) -> Column:
    """A name in composed form (NFC). Spark has no function for it, but the library that it brings for its collations has; names in ASCII pass as they are. Spark takes a reflected call for one that may differ each time, so that it can't stand in a join's condition."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), name, F.lit(False))
    return F.when(F.octet_length(name) == F.char_length(name), name).when(name.isNotNull(), composed)


def utf16_head(text: Column, units: int) -> Column:
    """The first so many UTF-16 units; a pair that would be parted goes."""
    wide = F.encode(text, "UTF-16BE")
    last = F.conv(F.hex(F.substring(wide, 2 * units - 1, 1)), 16, 10).cast("int")
    head = lambda n: F.decode(F.substring(wide, 1, 2 * n), "UTF-16BE")
    return F.when(F.octet_length(wide) <= 2 * units, text).when(last.between(0xD8, 0xDB), head(units - 1)).otherwise(head(units))


def safe_name(name: Column) -> Column:
    """A name that any file system takes: composed (NFC); controls and direction marks go, separators become underscores, leading dots and outer white space go, 200 UTF-16 units at most, never empty."""

    def clean(x):
        x = F.regexp_replace(x, f"[\\x00-\\x1F\\x7F{BIDI}]", "")
        x = F.regexp_replace(x, r'[\\/:*?"<>|]', "_")
        x = F.regexp_replace(x, "(?U)^[.\\s\\x{FEFF}]+", "")
        return F.regexp_replace(x, "(?U)[\\s\\x{FEFF}]+$", "")

    x = F.array(nfc(name))
    for step in (clean, lambda x: utf16_head(x, 200), lambda x: F.when(F.coalesce(x, F.lit("")) == "", "file").otherwise(x)):
        x = F.transform(x, step)  # binds what it takes, so that no step is worked out twice
    return F.get(x, F.lit(0))


def unsafe_name(name: Column) -> Column:
    """Whether an archive entry's name could leave its folder or clash with a device or a trimmed name."""
    parts = F.split(F.regexp_replace(name, r"[\\/]$", ""), r"[\\/]")
    bad = F.exists(parts, lambda p: (p == "..") | p.rlike(f"(?i)^({DEVICES})(\\..*)?$") | ((p != ".") & p.rlike(r"[. ]$")))
    return name.rlike(r"^[\\/]") | name.rlike(r"[\x00-\x1F:]") | bad


def version(text: Column) -> Column:
    """The first three parts as an array that compares: each the number that it begins with, else 0."""
    parts = F.split(text, r"\.")
    return F.array(*(F.coalesce(F.regexp_extract(F.get(parts, k), r"^\s*([+-]?[0-9]+)", 1).try_cast("double"), F.lit(0.0)) for k in range(3)))


def newer(a: Column, b: Column) -> Column:
    return version(a) > version(b)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def human_bytes(n: Column) -> Column:
    """Decimal units to terabytes; no digit for plain bytes and from 100 on, else one; thousands are grouped. Any numeric column; figures beyond a long are decimals."""
    cases = F.lit(None).cast("string")
    whole = lambda x: F.when(x < 2.0**53, half_up(x).cast("double")).otherwise(x)  # noqa: E731  (from there on doubles are whole, and may exceed a long)
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        value = (n / F.lit(1000.0**k)).cast("double")
        shown = F.when((F.lit(k) == 0) | (value >= 100), F.format_number(whole(value), 0)).otherwise(F.format_number(half_up(value * 10) / 10, 1))
        shown = F.concat(shown, F.lit(" " + unit))
        cases = F.when(n >= F.lit(1000.0**k), shown).otherwise(cases) if k else shown
    return cases


def memory_cost(task: Column, kind: Column, format_: Column, size: Column, width: Column, height: Column) -> Column:
    """Bytes of memory that a task on a file is expected to take; infinity for a JPEG or PNG whose dimensions can't be read. Dimensions of other formats are not looked at."""
    measured = format_.isin("jpeg", "png")
    area = F.when(measured, width.cast("double") * height)
    return (
        F.when(task == "removebg", GIB + F.coalesce(area * 12, size * 8.0))
        .when((task == "convert") & kind.isin("video", "audio"), 512.0 * MIB)
        .when((task == "convert") & (kind == "pdf"), size * 3.0 + 256 * MIB)
        .when(task == "convert", F.coalesce(area * 12 + size * 2, F.greatest(F.lit(256.0 * MIB), size * 20.0)))
        .when(measured, F.coalesce(area * 16 + size * 2, F.lit(float("inf"))))
        .when(kind == "pdf", size * 4.0)
        .when(kind == "zip", F.least(size.cast("double"), F.lit(128.0 * MIB)) * 3)
        .when(kind == "video", F.lit(512.0 * MIB))
        .otherwise(size * 2.0)
    )


def memory_budget(gigabytes: Column) -> Column:
    """A quarter of the memory, between 512 MiB and 2 GiB; 8 GB where it is not known."""
    return F.least(F.lit(2.0 * GIB), F.greatest(F.lit(512.0 * MIB), F.coalesce(gigabytes, F.lit(8.0)) * GIB / 4))


def quarter_turn(angle: Column) -> Column:
    return F.pmod(half_up(angle / 90) * 90, F.lit(360)).cast("int")


def even(n: Column) -> Column:
    return F.greatest(F.lit(2), half_up(n / 2) * 2)


# The settings' fields, their allowed values and, first, their defaults.
SETTINGS = {
    "task": ("compress", "convert", "removebg", "pdf"),
    "mode": ("lossless", "balanced", "compact"),
    "imageTarget": ("jpg", "png", "webp", "pdf"),
    "mediaTarget": ("mp4", "webm", "m4a", "wav"),
}
# What an application's own files end in.
ASSET = r"(?i)\.(m?js|wasm|onnx|bcmap|pfb|ttf|css|woff2?|svg|png|ico|webmanifest|json|html)$"


def sanitise(text: Column) -> list[Column]:
    """Settings from JSON text: a field of the outermost object that is not one of its values takes its default, a flag that is not true or false is false. Text that is no JSON object gives defaults alone. Values are compared with their types: the text "true" is not true."""
    parsed = F.try_parse_json(text)

    def field(name, kind):
        typed = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == kind
        return F.when(typed, F.try_variant_get(parsed, f"$.{name}", kind.lower()))

    out = [F.when(field(name, "STRING").isin(*values), field(name, "STRING")).otherwise(values[0]).alias(name) for name, values in SETTINGS.items()]
    return out + [F.coalesce(field(name, "BOOLEAN"), F.lit(False)).alias(name) for name in ("stripMetadata", "allowMacros")]


def page_ranges(text: Column, pages: Column) -> Column:
    """Groups of 0-based pages from text such as `1-3, 5, 8-`; null as a whole if any part is wrong or nothing is asked for."""
    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    low = lambda p: F.regexp_extract(p, r"^(\d{1,9})", 1).try_cast("int")
    right = lambda p: F.regexp_extract(p, r"-\s*(\d{1,9})$", 1).try_cast("int")
    high = lambda p: F.when(p.rlike(r"-$"), pages).when(p.contains("-"), right(p)).otherwise(low(p))
    good = lambda p: F.coalesce(p.rlike(r"^\d{1,9}(\s*-\s*\d{0,9})?$") & (low(p) >= 1) & (low(p) <= high(p)) & (high(p) <= pages), F.lit(False))
    groups = F.transform(F.filter(parts, good), lambda p: F.sequence(low(p) - 1, high(p) - 1))
    return F.when((F.size(parts) > 0) & F.forall(parts, good), groups)


def egress(url: Column, method: Column, origin: Column, strict: bool = True) -> Column:
    """Why a request is refused; null if it may go out. A blob or data URL may only be read; all else must be a plain read of an asset of the own origin, without a query string."""
    own = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([a-z]+:)", 1)
    out = F.when(scheme.isin("blob:", "data:"), F.when(method != "GET", F.concat(method, F.lit(" on "), scheme))).when(own != origin, "cross-origin").when(~method.isin("GET", "HEAD"), F.concat(method, F.lit(" not permitted")))
    if strict:
        out = out.when(url.rlike(r"\?[^#]"), "query strings not permitted").when((path != "") & ~path.endswith("/") & ~path.rlike(ASSET), "not an application file")
    return out
