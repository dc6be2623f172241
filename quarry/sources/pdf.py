"""PDF files as objects: reading, a lossless rewrite, and page work (merge, pick, split, rotate). After the public ISO 32000.

Objects are found by their headers, the last of a number counts, and object streams are opened; numbers, strings and keywords keep their spelling. Files that are encrypted or signed, or that don't hold together, are refused with a reason.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

from quarry.functions import rules
from quarry.sources import jpeg


class Unfit(ValueError):
    """The file can't be worked on; the text is the reason."""


class Name(bytes):
    """A name with its slash."""


class Plain(bytes):
    """A number, string or keyword as it was spelled."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Item:
    value: object
    stream: bytes | None = None


SPACE = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*")
NAME = re.compile(rb"/[^\x00\t\n\f\r ()<>\[\]{}/%]*")
REF = re.compile(rb"(\d+)[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+R(?![A-Za-z0-9])")
WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
HEX = re.compile(rb"<[0-9A-Fa-f\x00\t\n\f\r ]*>")
INSIDE = re.compile(rb"[^()\\]*(?:\\.[^()\\]*)*", re.S)
HEADER = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\f\r ]+\d{1,5}[\x00\t\n\f\r ]+obj(?![A-Za-z])")
#: Inflated bytes of one stream, and of those that are merged at least.
MOST, LEAST = 128 << 20, 512
INHERITED = (b"/Resources", b"/MediaBox", b"/CropBox", b"/Rotate")


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The object that begins here, and where it ends."""
    at = SPACE.match(data, at).end()
    head = data[at : at + 2]
    if depth > 200 or not head:
        raise Unfit("corrupt")
    if head == b"<<" or head[:1] == b"[":
        close, found = (b">>", {}) if head == b"<<" else (b"]", [])
        at += len(close)
        while True:
            at = SPACE.match(data, at).end()
            if data.startswith(close, at):
                return found, at + len(close)
            if isinstance(found, dict):
                key = NAME.match(data, at)
                if not key:
                    raise Unfit("corrupt")
                found[key[0]], at = value(data, key.end(), depth + 1)
            else:
                item, at = value(data, at, depth + 1)
                found.append(item)
    if head[:1] == b"(":
        start, open_ = at, 0
        while True:
            mark = data[at : at + 1]
            open_ += (mark == b"(") - (mark == b")")
            if mark not in (b"(", b")"):
                raise Unfit("corrupt")
            at += 1
            if not open_:
                return Plain(data[start:at]), at
            at = INSIDE.match(data, at).end()
    for pattern, kind in ((HEX, Plain), (NAME, Name), (REF, Ref), (WORD, Plain)):
        if found := pattern.match(data, at):
            return (Ref(int(found[1])) if kind is Ref else kind(found[0])), found.end()
    raise Unfit("corrupt")


def spelled(item: object) -> bytes:
    if isinstance(item, dict):
        return b"<<" + b"".join(k + b" " + spelled(v) for k, v in item.items()) + b">>"
    if isinstance(item, list):
        return b"[" + b" ".join(map(spelled, item)) + b"]"
    return b"%d 0 R" % item.number if isinstance(item, Ref) else bytes(item)


def links(item: object):
    """All references inside an object."""
    if isinstance(item, Ref):
        yield item.number
    for part in item.values() if isinstance(item, dict) else item if isinstance(item, list) else ():
        yield from links(part)


def replaced(item: object, by) -> object:
    """The object with each reference given by a function of its number."""
    if isinstance(item, Ref):
        return by(item.number)
    if isinstance(item, dict):
        return {k: replaced(v, by) for k, v in item.items()}
    return [replaced(v, by) for v in item] if isinstance(item, list) else item


class Document:
    def __init__(self, objects: dict[int, Item], trailer: dict):
        self.objects, self.trailer = objects, trailer

    def get(self, item: object) -> object:
        for _ in range(50):
            if not isinstance(item, Ref):
                return item
            item = self.objects[item.number].value if item.number in self.objects else Plain(b"null")
        raise Unfit("corrupt")

    def filters(self, item: Item) -> list[bytes]:
        found = self.get(item.value.get(b"/Filter", []))
        return [bytes(self.get(f)) for f in found] if isinstance(found, list) else [bytes(found)]

    def signed(self) -> bool:
        for item in self.objects.values():
            if isinstance(item.value, dict) and (b"/ByteRange" in item.value and b"/Contents" in item.value or self.get(item.value.get(b"/Type")) in (b"/Sig", b"/DocTimeStamp")):
                return True
        form = self.get(self.get(self.trailer.get(b"/Root")).get(b"/AcroForm"))
        flags = self.get(form.get(b"/SigFlags")) if isinstance(form, dict) else None
        return isinstance(flags, Plain) and flags.isdigit() and int(flags) & 1 == 1

    def pages(self) -> list[tuple[int, dict]]:
        """Number and dictionary of each page in order, with what it inherits."""
        out, seen = [], set()

        def walk(ref, above):
            node = self.get(ref)
            if not isinstance(ref, Ref) or not isinstance(node, dict) or ref.number in seen:
                raise Unfit("corrupt")
            seen.add(ref.number)
            own = above | {k: node[k] for k in INHERITED if k in node}
            if b"/Kids" in node:
                for kid in self.get(node[b"/Kids"]):
                    walk(kid, own)
            else:
                out.append((ref.number, node | own))

        walk(self.get(self.trailer.get(b"/Root"))[b"/Pages"], {})
        return out

    def live(self) -> set[int]:
        """Objects that can be reached from the trailer."""
        front, seen = set(links(self.trailer)), set()
        while front:
            seen |= front
            front = {n for k in front if k in self.objects for n in links(self.objects[k].value)} - seen
        return seen & set(self.objects)

    def save(self) -> bytes:
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        for number, item in sorted(self.objects.items()):
            places[number] = len(out)
            body = item.value
            if item.stream is not None:
                body = {k: v for k, v in body.items() if k != b"/Length"} | {b"/Length": Plain(b"%d" % len(item.stream))}
            out += b"%d 0 obj\n" % number + spelled(body) + (b"" if item.stream is None else b"\nstream\n" + item.stream + b"\nendstream") + b"\nendobj\n"
        size, table = max(places, default=0) + 1, len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        out += b"".join(b"%010d 00000 n \n" % places[k] if k in places else b"0000000000 65535 f \n" for k in range(1, size))
        trailer = {k: v for k, v in self.trailer.items() if k in (b"/Root", b"/Info", b"/ID")} | {b"/Size": Plain(b"%d" % size)}
        return bytes(out + b"trailer\n" + spelled(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % table)


def inflated(data: bytes, most: int = MOST) -> bytes:
    """What a zlib stream holds; more than `most` bytes are refused."""
    reader = zlib.decompressobj()
    out = reader.decompress(data, most + 1)
    if len(out) > most or not reader.eof:
        raise zlib.error("too long or cut off")
    return out


def guarded(work):
    """Whatever a malformed file runs into is told as `corrupt`."""

    @functools.wraps(work)
    def run(*arguments, **named):
        try:
            return work(*arguments, **named)
        except (KeyError, IndexError, TypeError, AttributeError, ValueError, RecursionError, zlib.error) as error:
            raise error if isinstance(error, Unfit) else Unfit("corrupt") from error

    return run


@guarded
def load(data: bytes) -> Document:
    """The document's objects; raises Unfit with `corrupt` or `encrypted`."""
    if b"%PDF-" not in data[:1024]:
        raise Unfit("corrupt")
    objects: dict[int, Item] = {}
    trailers: list[tuple[int, dict]] = []
    late, at = [], 0
    while head := HEADER.search(data, at):
        try:
            item, at = value(data, head.end())
        except Unfit:
            at = head.end()
            continue
        stream, start = None, SPACE.match(data, at).end()
        if isinstance(item, dict) and data.startswith(b"stream", start):
            start += 6 + (2 if data[start + 6 : start + 8] == b"\r\n" else 1)
            length = item.get(b"/Length")
            size = int(length) if isinstance(length, Plain) else None
            if size is None or not re.match(rb"\s*endstream", data[start + size : start + size + 20]):
                end = data.find(b"endstream", start)
                if end < 0:
                    raise Unfit("corrupt")
                size = end - start
                late.append((int(head[1]), start, length, size))
            stream, at = data[start : start + size], start + size
        objects[int(head[1])] = Item(item, stream)
        if isinstance(item, dict) and item.get(b"/Type") == b"/XRef":
            trailers.append((head.start(), item))
    for number, start, length, _ in late:  # lengths that other objects tell
        told = objects.get(length.number) if isinstance(length, Ref) else None
        if told and isinstance(told.value, Plain) and told.value.isdigit() and re.match(rb"\s*endstream", data[start + int(told.value) : start + int(told.value) + 20]):
            objects[number].stream = data[start : start + int(told.value)]
        else:
            objects[number].stream = re.sub(rb"\r?\n$|\r$", b"", objects[number].stream)
    for found in re.finditer(rb"(?<![A-Za-z])trailer(?![A-Za-z])", data):
        try:
            trailers.append((found.start(), value(data, found.end())[0]))
        except Unfit:
            continue
    trailer: dict = {}
    for _, part in sorted(trailers, key=lambda t: t[0]):
        trailer |= {k: part[k] for k in (b"/Root", b"/Info", b"/ID", b"/Encrypt") if k in part}
    if b"/Encrypt" in trailer:
        raise Unfit("encrypted")
    document = Document(objects, trailer)
    for number, item in list(objects.items()):
        if isinstance(item.value, dict) and item.value.get(b"/Type") == b"/ObjStm":
            raw = inflated(item.stream) if document.filters(item) == [b"/FlateDecode"] else item.stream
            first = int(document.get(item.value[b"/First"]))
            pairs = list(map(int, raw[:first].split()))
            for inner, place in zip(pairs[::2], pairs[1::2], strict=True):
                if inner not in objects:
                    objects[inner] = Item(value(raw, first + place)[0])
            del objects[number]
        elif isinstance(item.value, dict) and item.value.get(b"/Type") == b"/XRef":
            del objects[number]
    if not isinstance(document.get(trailer.get(b"/Root")), dict):
        raise Unfit("corrupt")
    document.pages()
    return document


def merge_equal(document: Document) -> int:
    """Streams with equal dictionaries and bytes become one, the first; how many went."""
    first, alias = {}, {}
    for number, item in sorted(document.objects.items()):
        if item.stream is not None and len(item.stream) >= LEAST:
            keep = first.setdefault((len(item.stream), spelled(item.value), item.stream), number)
            if keep != number:
                alias[number] = keep
    if alias:
        for item in document.objects.values():
            item.value = replaced(item.value, lambda n: Ref(alias.get(n, n)))
    return len(alias)


@guarded
def compress(data: bytes, strip: bool = False) -> tuple[bytes | None, list[tuple[str, bool]]]:
    """The document with its streams packed anew where that is smaller, pictures without loss, equal streams merged and unused objects gone; None if it isn't smaller."""
    document = load(data)
    if document.signed():
        raise Unfit("signed")
    count = len(document.pages())
    for item in document.objects.values():
        if item.stream is None:
            continue
        way = document.filters(item)
        if way == [b"/DCTDecode"]:
            try:
                item.stream = jpeg.smaller(item.stream) or item.stream
            except jpeg.Unfit:
                pass
        elif way in ([], [b"/FlateDecode"]) and bytes(document.get(item.value.get(b"/Type", b""))).lstrip(b"/").decode("latin-1") not in rules.UNPACKED_TYPES:
            try:
                raw = inflated(item.stream) if way else item.stream
            except zlib.error:
                continue
            packed = zlib.compress(raw, 9)
            if rules.LEAST_STREAM <= len(raw) <= MOST and len(packed) < len(item.stream) * 0.99:
                item.stream = packed
                item.value = item.value | {b"/Filter": Name(b"/FlateDecode")}
    if strip:
        without_metadata(document)
    merge_equal(document)
    live = document.live()
    document.objects = {k: v for k, v in document.objects.items() if k in live}
    made = document.save()
    if len(made) >= len(data):
        return None, []
    return made, [("same pages", len(load(made).pages()) == count)]


def without_metadata(document: Document) -> None:
    """Author, producer and the metadata packet go; what may be a sensitivity label stays."""
    root = document.get(document.trailer[b"/Root"])
    packet = root.get(b"/Metadata")
    item = document.objects.get(packet.number) if isinstance(packet, Ref) else None
    label = re.compile(rules.LABEL.encode())
    if packet is not None and item and item.stream is not None and b"/Filter" not in item.value and len(item.stream) <= rules.MOST_LABEL and not label.search(item.stream) and not label.search(item.stream.replace(b"\0", b"")):
        del root[b"/Metadata"]
    info = document.get(document.trailer.get(b"/Info"))
    if isinstance(info, dict):
        for key in [k for k in info if k != b"/Title" and not label.search(k)]:
            del info[key]


def picked(sources: list[tuple[Document, list[tuple[int, int]]]]) -> Document:
    """A new document of pages (index, turn in degrees) of one or more documents, in the order asked for; repeats are pages of their own that share what they show."""
    made = Document({1: Item({}), 2: Item({})}, {b"/Root": Ref(1)})
    kids = []
    for document, spec in sources:
        pages, known = document.pages(), {}
        if not spec or any(not 0 <= k < len(pages) for k, _ in spec):
            raise Unfit("invalid")
        numbers = {number for number, _ in pages}
        for index, turn in spec:
            page = {k: v for k, v in pages[index][1].items() if k not in (b"/Parent", b"/Annots", b"/B", b"/StructParents")}
            now = document.get(page.get(b"/Rotate", Plain(b"0")))
            page[b"/Rotate"] = Plain(b"%d" % ((int(now) + turn) % 360))
            number = len(made.objects) + 1
            made.objects[number] = Item({})
            kids.append(Ref(number))
            waiting = []

            def copy(n):
                if n not in document.objects or n in numbers:  # pages are reached through the new tree alone
                    return Plain(b"null")
                if n not in known:
                    known[n] = len(made.objects) + 1
                    made.objects[known[n]] = Item(None, document.objects[n].stream)
                    waiting.append(n)
                return Ref(known[n])

            made.objects[number].value = replaced(page, copy) | {b"/Parent": Ref(2)}
            while waiting:
                n = waiting.pop()
                made.objects[known[n]].value = replaced(document.objects[n].value, copy)
    made.objects[1].value = {b"/Type": Name(b"/Catalog"), b"/Pages": Ref(2)}
    made.objects[2].value = {b"/Type": Name(b"/Pages"), b"/Kids": kids, b"/Count": Plain(b"%d" % len(kids))}
    return made


@guarded
def merged(files: list[bytes]) -> bytes:
    documents = [load(f) for f in files]
    return picked([(d, [(k, 0) for k in range(len(d.pages()))]) for d in documents]).save()


@guarded
def split(data: bytes, groups: list[list[int]]) -> list[bytes]:
    document = load(data)
    return [picked([(document, [(k, 0) for k in group])]).save() for group in groups]
