"""Decisions as Catalyst expressions: what happens to an entry, a picture, a stream, a request; why a file is left alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of payloads that are packed already; parts of an office package that are copied as they are, that are active, that are pictures, that hold metadata; words that mark a sensitivity label.
PACKED = r"(?i)\.(jpe?g|png|gif|webp|avif|heic|mp[34]|m4[av]|mov|mkv|webm|aac|ogg|opus|flac|zip|7z|rar|gz|bz2|xz|zst|docx|xlsx|pptx|pdf)$"
VERBATIM = r"(?i)(^|/)(vbaProject\.bin|vbaData\.xml)$|/(embeddings|activeX|customUI)/|^_xmlsignatures/"
ACTIVE = r"(?i)(^|/)(vbaProject\.bin|vbaData\.xml|connections\.xml)$|/(activeX|embeddings|macrosheets|externalLinks)/|oleObject"
MEDIA = r"(?i)^(ppt|xl|word)/media/[^/]+\.(png|jpe?g)$"
METADATA_PARTS = ("docProps/core.xml", "docProps/app.xml")
LABEL = r"(?i)MSIP_Label|Classification|Sensitivity|Confidentiality"
MOST_BEST, LEAST_STREAM, MOST_LABEL = 128 << 20, 256, 64 << 20
MOST_PIXELS, MOST_PIXELS_REMOVEBG = 120_000_000, 64_000_000
UNPACKED_TYPES = ("Metadata", "XRef", "ObjStm")
#: Shares of a picture beyond which no subject counts as found, and the ends of the stretch of a mask.
COVERAGE, CLIP = (0.005, 0.995), (0.04, 0.96)
FORMATS = {"jpg": "jpeg", "png": "png", "webp": "webp", "pdf": "pdf"}


def head(content: Column, n: int = 4096) -> Column:
    """The first bytes, as dispatch reads them."""
    return F.substring(content, 1, n)


def byte_range(content: Column, start: Column, end: Column) -> Column:
    """Bytes from start (from 0) up to end, as far as there are any."""
    return F.when(end > start, F.substring(content, start.cast("int") + 1, (end - start).cast("int"))).otherwise(F.lit(b""))


def percent_saved(before: Column, after: Column) -> Column:
    """How much smaller, as text: whole percents from ten on, else at most one digit."""
    share = 100 * (1 - after / before)
    whole, tenth = F.floor(share + 0.5), F.floor(share * 10 + 0.5) / 10
    shown = F.when(share >= 10, whole.cast("long").cast("string")).when(tenth == F.floor(tenth), tenth.cast("long").cast("string")).otherwise(tenth.cast("decimal(4,1)").cast("string"))
    return F.concat(F.lit("-"), shown, F.lit("%"))


def plain_extension(path: Column) -> Column:
    """One to eight letters or digits after the last dot, lower-cased; null without."""
    found = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(found != "", found)


def with_extension(name: Column, path: Column, source: Column) -> Column:
    """A result's name with an extension: its own, else that of its path, its given name or its source, in this order; `file` where nothing is left of it."""
    clean = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+", ""), r"(?U)[.\s]+$", "")
    found = F.coalesce(plain_extension(path), plain_extension(name), plain_extension(source))
    base = F.when(clean == "", "file").otherwise(clean)
    return F.when(clean.rlike(r"\.[^.]+$") | found.isNull(), base).otherwise(F.concat(base, F.lit("."), found))


def is_svg(mime: Column, name: Column) -> Column:
    return F.coalesce(mime == "image/svg+xml", F.lit(False)) | F.coalesce(F.lower(name).endswith(".svg"), F.lit(False))


def magnitude(value: Column) -> Column:
    """Bits of a number's absolute value; 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value).cast("long"))))


def table_index(component: Column) -> Column:
    """The first component has a code table of its own, all others share one."""
    return F.least(component, F.lit(1))


def fresh_pages(count: Column) -> Column:
    """A document's pages before any edit: index, rotation and whether it is deleted."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("index"), F.lit(0).alias("rotation"), F.lit(False).alias("deleted")))


def entry_action(name: Column, readable: Column, usize: Column, method: Column, policy: Column) -> Column:
    """What a rewrite does with an archive's entry: copy its record, stream it through a compressor, transform or pack it."""
    large = usize > MOST_BEST
    return F.when(~readable | (policy == "copy"), "copy").when(large & ((method == 8) | name.rlike(PACKED)), "copy").when(large, "stream").otherwise(policy)


def stored_as(is_new: Column, csize: Column, size: Column, packed: Column) -> Column:
    """How a packed entry is written: copied if its content is the same and no form is smaller than its record; else deflated where that is smaller than the content, or stored."""
    return F.when(~is_new & (F.least(packed, size) >= csize), "copy").when(packed < size, "deflate").otherwise("store")


def first_entry_policy(index: Column, name: Column) -> Column:
    """Document packages begin with their type, which is copied as it is."""
    return F.when((index == 0) & (name == "mimetype"), "copy").otherwise("pack")


def office_policy(name: Column, signed: Column, strip: Column) -> Column:
    """What happens to an office package's part. In a signed package nothing is transformed."""
    changes = ~signed & (name.rlike(MEDIA) | (strip & name.isin(*METADATA_PARTS)))
    return F.when(name.rlike(VERBATIM), "copy").when(changes, "transform").otherwise("pack")


def best_candidate(original: Column, lossless: Column, lossy: Column) -> Column:
    """lossless, lossy or null: a lossy form must be a tenth smaller than the lossless one, if there is one, and what wins smaller than the original."""
    choice = F.when(lossy.isNotNull() & (lossless.isNull() | (lossy < lossless * 0.9)), "lossy").when(lossless.isNotNull(), "lossless")
    size = F.when(choice == "lossy", lossy).when(choice == "lossless", lossless)
    return F.when(size < original, choice)


def image_limits(width: Column, height: Column, animated: Column, removebg: Column) -> Column:
    """Why a picture is left alone, or null."""
    area, most = width.cast("double") * height, F.when(removebg, MOST_PIXELS_REMOVEBG).otherwise(MOST_PIXELS)
    return F.when(area.isNull(), "unreadable").when(animated, "animated").when(area > most, "too-large")


def same_format(target: Column, format_: Column, name: Column) -> Column:
    """Whether a picture has the wanted format already; one that was drawn from an SVG keeps that name and doesn't."""
    wanted = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair)), target), F.lit(""))
    return (wanted == format_) & ~F.lower(name).endswith(".svg")


def stream_eligible(filters: Column, type_: Column, size: Column, packed: Column, old: Column) -> Column:
    """Which way a document's stream goes: `jpeg` for a lone DCT filter, `deflate` if it has none or a lone Flate filter and is worth it, else null. size: its plain bytes, null if they can't be read."""
    worth = size.between(LEAST_STREAM, MOST_BEST) & ~F.coalesce(type_.isin(*UNPACKED_TYPES), F.lit(False)) & (packed < old * 0.99)
    lone = F.when(F.size(filters) == 1, F.get(filters, F.lit(0)))
    return F.when(lone == "DCTDecode", "jpeg").when(((F.size(filters) == 0) | (lone == "FlateDecode")) & worth, "deflate")


def gray(space: Column, components: Column) -> Column:
    """true for gray, false for RGB, null where the colours are not known: by device space, or by the number of an ICC profile's components."""
    icc = space == "ICCBased"
    return F.when((space == "DeviceGray") | (icc & (components == 1)), True).when((space == "DeviceRGB") | (icc & (components == 3)), False)


def lossy_image(gray_: Column, width: Column, height: Column, own_width: Column, own_height: Column, decode: Column, colour_key: Column, mask: Column) -> Column:
    """Whether a document's picture may be made anew with losses: colours known, declared size its own, not too large, no value mapping and no colour-key mask, and not a mask itself."""
    fits = gray_.isNotNull() & (width == own_width) & (height == own_height) & (width.cast("double") * height <= MOST_PIXELS)
    return F.coalesce(fits & ~decode & ~colour_key & ~mask, F.lit(False))


def may_hold_label(text: Column, filtered: Column) -> Column:
    """Whether metadata must be kept for a sensitivity label: always if it is packed or too large to read; labels in two-byte text show once zeros are gone."""
    return filtered | (F.octet_length(text) > MOST_LABEL) | text.rlike(LABEL) | F.replace(text, F.lit("\0"), F.lit("")).rlike(LABEL)


def no_subject(coverage: Column) -> Column:
    return F.when(~coverage.between(*COVERAGE), "no-subject")


def clipped(value: Column) -> Column:
    """A mask's value stretched so that haze at both ends goes."""
    low, high = CLIP
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def refine_radius(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(F.greatest(width, height) / 320 + 0.5).cast("int"))


def bad_pages(indices: Column, count: Column) -> Column:
    """`invalid` unless there are pages asked for and each is one of the document's."""
    good = F.coalesce((F.size(indices) > 0) & F.forall(indices, lambda k: k.between(0, count - 1)), F.lit(False))
    return F.when(~good, "invalid")


def same_duration(before: Column, after: Column) -> Column:
    """Half a second, or a hundredth, may be lost or gained."""
    return F.abs(after - before) <= F.greatest(F.lit(0.5), before * 0.01)


def queue_state(status: Column, held: Column, has_result: Column) -> Column:
    """pending while an item waits without being held, or works; savable when it is done with a result; else idle."""
    return F.when(((status == "waiting") & ~held) | (status == "working"), "pending").when((status == "done") & has_result, "savable").otherwise("idle")


def ready(guard: Column, headers: Column, stale: Column) -> Column:
    """The three-way gate before anything is taken in."""
    return headers & (guard != "failed") & ~stale


def password_reason(opened: Column, asked: Column, code: Column) -> Column:
    """Why a document did not open: a wrong password (code 2), one that is needed (any other code while one is asked for), or a fault."""
    return F.when(~opened, F.when(asked & (code == 2), "password-wrong").when(asked, "password").otherwise("corrupt"))


def picked(edited: Column, optimised: Column, original: Column) -> Column:
    """The bytes that are saved: the edited ones, else the optimised, else the original."""
    return F.coalesce(edited, optimised, original)


def worker_policy(url: Column, method: Column, navigation: Column, origin: Column, listed: Column) -> Column:
    """Why a service worker blocks a request; null if it serves it. Only plain reads of the own origin pass; a navigation gets the application's page, anything else must be a listed file without a query string."""
    own = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.when(own != origin, "cross-origin").when(~method.isin("GET", "HEAD"), F.concat(method, F.lit(" not permitted"))).when(navigation, F.lit(None)).when(url.rlike(r"^[^#]*\?[^#]"), "query strings not permitted").when(~listed, "not an application file")
