"""Operator 1: removal of repeated 100-byte strings by a distributed merge sort of suffixes that knows common prefixes.

Which suffixes take part. Every window of SPAN bytes belongs to the suffix at its anchor, the position in it with the smallest hash of the next GRAM bytes (the leftmost of equals). Equal windows have equal anchors, so a window can only repeat if its anchor's gram does. Grams are counted over all documents, and only suffixes at repeated grams are sorted: the first step of prefix-doubling string sorters, which finds by hashing which suffixes have no equal prefix elsewhere and leaves them out.

The sort. Tasks sort the suffixes of their documents (from the anchor on, then what lies before it, as far as windows reach) into runs, keep the first of equal ones, and exchange runs front-coded: each suffix as the length of the prefix it shares with the one before it, and the rest. Buckets merge their runs with a loser tree that holds each run's known common prefix with the last winner; two suffixes are compared only beyond it. In the merged order suffixes of one gram are neighbours; windows of suffixes that are not equal as a whole are told apart there, byte for byte.

A gram with very many places, such as a common line's, would put them all into one bucket. Its windows are sorted as suffixes of their own instead, from their first byte on: equal ones collapse in every task, the others spread over all buckets.

Tasks take documents in order, so whatever they have met before is the earlier place, and a text that they have met as a whole is a repeat as a whole. What is found leaves tasks as merged ranges, one row for each document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import cut, shuffle_partitions
from quarry.llm.words import BYTE, _mixed

SPAN, GRAM = 100, 32
#: Places of a gram from which its windows are sorted one by one.
FREQUENT = 2000
#: Bytes of text hashed at a time, and of suffixes in a run.
PIECE, RUN = 1 << 19, 12 << 20
#: Whole texts that a task remembers, by digest; what it doesn't remember is found by its windows.
WHOLE = 1 << 20
LOW = -(1 << 63)


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of bytes its gram's hash (57 bits) and its anchor's place, from the window's start."""
    value, step, factor = BYTE[data], 1, np.uint64(0x9E3779B97F4A7C15 | 1)
    while step < gram:  # the hash of 2k bytes from those of k
        value = value[:-step] * factor + value[step:]
        factor, step = factor * factor, 2 * step
    value = _mixed(value) & ~np.uint64(127)
    wide, reach = span - gram + 1, 1
    while 2 * reach <= wide:  # low bits hold the place, so equal hashes are won by the leftmost
        value, reach = np.minimum(value[:-reach], value[reach:] + np.uint64(reach)), 2 * reach
    if wide > reach:
        value = np.minimum(value[: len(value) - (wide - reach)], value[wide - reach :] + np.uint64(wide - reach))
    return value >> np.uint64(7), (value & np.uint64(127)).astype(np.int64)


def ranges(texts: list[bytes], span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal ranges of windows with one anchor, as arrays: index of the text, first window, windows less one, anchor from the first window, gram. Short texts are hashed together, long ones in pieces."""
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        joined = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
        ends = np.cumsum([len(part) for _, _, part in group])
        grams, places = anchors(joined, span)
        starts = np.arange(len(grams))
        owner = np.searchsorted(ends, starts, "right")
        inside = starts + span <= ends[owner]
        starts, owner, grams, places = starts[inside], owner[inside], grams[inside], places[inside]
        at = starts + places
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        last = np.append(new[1:], len(starts)) - 1
        base = (ends - np.array([len(part) for _, _, part in group]) - np.array([shift for _, shift, _ in group]))[owner[new]]
        return np.array([i for i, _, _ in group])[owner[new]], starts[new] - base, starts[last] - starts[new], places[new], grams[new]

    for i, text in enumerate(texts):
        for shift in range(0, max(1, len(text) - span + 1), PIECE):
            part = text[shift : shift + PIECE + span - 1]
            if len(part) >= span:
                group.append((i, shift, part))
                size += len(part)
            if size >= PIECE:
                yield flush()
                group, size = [], 0
    if group:
        yield flush()


# A place is packed into a long: first window (31 bits), the text's mark (16), windows less one (7), anchor (7), frequent (1).


def pack(first, mark, more, anchor):
    return first << 31 | mark << 15 | more << 8 | anchor << 1


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, mark (16 bits of the text's hash, to tell apart rows of one id) and text, a null as empty. A row with a null id gets a number below all ids, made of 62 bits of its text's hash, so that such rows are spread and are documents of their own."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.col(f"`{id_col}`").cast("long")
    key = F.when(key < LOW // 2, F.raise_error(F.lit("ids below -2^62 are taken by rows without an id")).cast("long")).otherwise(key)
    return docs.select(F.coalesce(key, F.lit(LOW) + F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 2)).alias("doc"), F.pmod(F.xxhash64(text), F.lit(65536)).cast("int").alias("mark"), text.alias("text"))


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[bytes, int]], pa.Scalar]]:
    """doc, mark, the different packed texts of both in order with the number of their rows, and the last column's value, from rows sorted by doc and mark. Texts of one id whose marks are equal are told apart by their order."""
    key, texts, value = None, {}, None
    for batch in batches:
        docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for r in range(batch.num_rows):
            here = int(docs[r]), int(marks[r])
            if here != key:
                if texts:
                    yield *key, sorted(texts.items()), value
                key, texts, value = here, {}, batch.column(3)[r]
            packed = batch.column(2)[r].as_py()
            texts[packed] = texts.get(packed, 0) + 1
    if texts:
        yield *key, sorted(texts.items()), value


def own_places(raw: bytes, packs: np.ndarray, alone: bool) -> np.ndarray:
    """The places (sorted) among packs that are the text's; where others have its id and mark, those that its own bytes give."""
    packs = np.unique(packs)  # repeated rows give each place again
    if alone:
        return packs
    mine = {(int(f), int(m), int(a)) for _, first, more, anchor, _ in ranges([raw]) for f, m, a in zip(first, more, anchor, strict=True)}
    return np.array([x for x in packs.tolist() if (x >> 31, x >> 8 & 127, x >> 1 & 127) in mine], np.int64)


def ranged(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """doc, mark and merged ranges (pairs of first window and windows less one) from places of repeats (doc, mark, first, more)."""
    x = np.array(found, np.int64).reshape(-1, 4)
    x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
    head = np.ones(len(x), bool)
    head[1:] = (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])
    of = np.cumsum(head) - 1
    # the farthest window so far in each document: offsets by document keep running maxima apart
    far = np.maximum.accumulate(x[:, 2] + x[:, 3] + (of << 32)) - (of << 32)
    new = head.copy()
    new[1:] |= x[1:, 2] > far[:-1] + 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(x)) - 1 if len(at) else at
    pairs = np.column_stack([x[at, 2], far[last] - x[at, 2]]).astype("<u4")
    docs = np.flatnonzero(head[at])
    ends = np.append(docs[1:], len(at))
    return pa.RecordBatch.from_arrays([pa.array(x[at[docs], 0]), pa.array(x[at[docs], 1].astype(np.int32)), pa.array([pairs[a:b].tobytes() for a, b in zip(docs, ends, strict=True)], pa.binary())], ["doc", "mark", "ranges"])


def deflated(batches):
    for batch in batches:
        packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 4) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc", "mark", "packed"])


def places(rows: DataFrame) -> DataFrame:
    """gram, doc, place of every range of windows."""

    def run(batches):
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for i, first, more, anchor, gram in ranges(texts):
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(docs[i]), pa.array(pack(first, marks[i], more, anchor))], ["gram", "doc", "place"])

    return rows.mapInArrow(run, "gram long, doc long, place long")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Bytes that a and b share from the start, of which `known` are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """A sorted run of suffixes, front-coded: for each the shared length, the rest's length, the anchor's offset, the place."""

    @staticmethod
    def coded(entries: list[tuple[bytes, int, tuple[int, int, int]]]) -> bytes:
        last, shared, rest = b"", [], []
        for text, _, _ in entries:
            k = common_prefix(last, text, 0)
            shared.append(k)
            rest.append(text[k:])
            last = text
        n = len(entries)
        parts = [np.array(shared, "<u2"), np.array([len(r) for r in rest], "<u2"), np.array([o for _, o, _ in entries], np.uint8), np.array([p[0] for _, _, p in entries], "<i8"), np.array([p[1] for _, _, p in entries], "<u4"), np.array([p[2] for _, _, p in entries], "<u4")]
        return zlib.compress(n.to_bytes(4, "little") + b"".join(p.tobytes() for p in parts) + b"".join(rest), 4)

    @staticmethod
    def decoded(block: bytes) -> Iterator[tuple[int, bytes, int, tuple[int, int, int]]]:
        block = zlib.decompress(block)
        n, at, columns = int.from_bytes(block[:4], "little"), 4, []
        for kind in ("<u2", "<u2", np.uint8, "<i8", "<u4", "<u4"):
            column = np.frombuffer(block, kind, n, at)
            at += column.nbytes
            columns.append(column.tolist())
        text = b""
        for shared, size, offset, doc, mark, first in zip(*columns, strict=True):
            text = text[:shared] + block[at : at + size]
            at += size
            yield shared, text, offset, (doc, mark, first)


def merge(blocks: list[bytes]) -> Iterator[tuple[int, bytes, int, tuple[int, int, int]]]:
    """All suffixes of the runs in order, each with the prefix it shares with the one before it, by a loser tree.

    tree[1:] holds the losers of the inner matches, each with the prefix it shares with the winner of its last match. Of two players the one that shares more with the last winner is smaller, and what the other shares stays; only if both share equally much they are compared, from there on.
    """
    runs = [Run.decoded(b) for b in blocks]
    width = 1
    while width < len(runs):
        width *= 2
    head: list[tuple | None] = [next(r, None) for r in runs] + [None] * (width - len(runs))
    known = [0] * width  # shared with the last winner
    tree = [-1] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) and the loser's known prefix set."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        s, t, k = x[1], y[1], known[a]
        k = common_prefix(s, t, k)
        if s[k : k + 1] <= t[k : k + 1]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    winners = list(range(width))
    size = width
    level = winners
    while size > 1:
        following = []
        for i in range(0, size, 2):
            w, loser = play(level[i], level[i + 1])
            tree[(size + i) // 2] = loser
            following.append(w)
        level, size = following, size // 2
    best = level[0]
    while head[best] is not None:
        _, text, offset, place = head[best]
        yield known[best], text, offset, place
        head[best] = following_ = next(runs[best], None) if best < len(runs) else None
        known[best] = following_[0] if following_ else 0  # its run's own front coding: shared with the suffix that just won
        at = (best + width) // 2
        while at:
            best, tree[at] = play(best, tree[at])
            at //= 2


def sorted_runs(buckets: int):
    """The map side: (doc, mark, text, places), sorted by doc and mark, to blocks by bucket; a suffix that the task has met already is a repeat at once."""

    def run(batches):
        runs: dict[tuple[bytes, int], tuple[int, int, int]] = {}
        homes: dict[tuple[bytes, int], int] = {}
        whole: set[bytes] = set()
        again: list[pa.RecordBatch] = []
        held = 0

        def flush():
            dealt: dict[int, list] = {}
            for key, place in runs.items():
                dealt.setdefault(homes[key], []).append((*key, place))
            for bucket, entries in dealt.items():
                entries.sort()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([Run.coded(entries)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names)
            if again:
                made = pa.Table.from_batches(again).combine_chunks()
                home = pa.array((made["doc"].to_numpy() % buckets).astype(np.int32))
                yield from pa.table({"bucket": home, "block": pa.nulls(len(home), pa.binary()), "doc": made["doc"], "mark": made["mark"], "ranges": made["ranges"]}).to_batches()

        names = ["bucket", "block", "doc", "mark", "ranges"]
        for doc, mark, texts, value in by_document(batches):
            packs = value.values.field(0).to_numpy()
            grams = dict(zip(packs.tolist(), value.values.field(1).to_numpy().tolist(), strict=True))
            packs = packs[(packs >> 15 & 65535) == mark]  # without those of other rows with this id
            for k, (packed, _) in enumerate(texts):
                raw, name, found = zlib.decompress(packed), mark | k << 16, []
                digest = hashlib.blake2b(packed, digest_size=16).digest()
                if digest in whole:
                    if len(raw) >= SPAN:
                        again.append(ranged([(doc, name, 0, len(raw) - SPAN)]))
                    continue
                if len(whole) < WHOLE:
                    whole.add(digest)
                for packed_place in own_places(raw, packs, len(texts) == 1).tolist():
                    first, more, anchor = packed_place >> 31, packed_place >> 8 & 127, packed_place >> 1 & 127
                    if packed_place & 1:
                        entries = [(b"\1" + raw[s : s + SPAN], 0, s, None) for s in range(first, first + more + 1)]
                    else:
                        at = first + anchor
                        entries = [(b"\0" + raw[at : first + more + SPAN] + raw[first:at], anchor, first, grams[packed_place] % buckets)]
                    for text, offset, start, home in entries:
                        key = (text, offset)
                        if key in runs:
                            found.append((doc, name, start, 0 if packed_place & 1 else more))
                        else:
                            runs[key] = doc, name, start
                            homes[key] = zlib.crc32(text) % buckets if home is None else home
                            held += len(text) + 200
                if found:
                    again.append(ranged(found))
                    held += 100 + again[-1].nbytes
                if held >= RUN * 4:
                    yield from flush()
                    runs.clear()
                    homes.clear()
                    again.clear()
                    held = 0
        yield from flush()

    return run


def repeated(members: list[tuple[bytes, int, tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, int]]:
    """doc, mark, first window, windows less one of the repeats among suffixes of one gram. Suffixes that are equal as a whole are settled by place; windows of the first of each are looked up byte for byte."""
    if len(members) < 2:
        return
    members.sort(key=lambda m: m[2])
    whole, windows, alone = {}, set(), len({m[:2] for m in members}) == 1
    for text, offset, place in members:
        known = whole.get((text, offset))
        more = len(text) - 1 - SPAN
        if known is not None:
            if known != place:
                yield (*place, more)
            continue
        whole[text, offset] = place
        if alone:
            continue
        cut = len(text) - offset
        content = text[cut:] + text[1:cut]
        start = None
        for s in range(more + 1):
            window = content[s : s + SPAN]
            if window in windows:
                start = s if start is None else start
            else:
                windows.add(window)
                if start is not None:
                    yield place[0], place[1], place[2] + start, s - 1 - start
                    start = None
        if start is not None:
            yield place[0], place[1], place[2] + start, more - start


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reduce side of one bucket: doc, mark and merged ranges of the repeats; one row for each document and batch of what is found."""
    blocks = []
    for batch in batches:
        blocks += [b for b in batch.column("block").to_pylist() if b is not None]
        passed = batch.select(["doc", "mark", "ranges"]).filter(batch.column("ranges").is_valid())
        if passed.num_rows:
            yield passed
    out: list[tuple[int, int, int, int]] = []
    members: list[tuple] = []
    least = None  # of equal frequent windows: the first place
    for shared, text, offset, place in merge(blocks):
        if text[0]:
            if members:
                out += repeated(members)
                members = []
            if least is not None and shared == len(text):
                if place != least:
                    out.append((*max(place, least), 0))
                    least = min(place, least)
            else:
                least = place
        else:
            if shared <= GRAM and members:
                out += repeated(members)
                members = []
            members.append((text, offset, place))
        if len(out) >= 500_000:
            yield ranged(out)
            out = []
    out += repeated(members)
    if out:
        yield ranged(out)


def strip(raw: bytes, firsts: np.ndarray, lasts: np.ndarray) -> tuple[int, int, bytes]:
    """n_removed, n_spans and the bytes that stay, from windows firsts..lasts (window starts, inclusive)."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, lasts + SPAN, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes).

    Each byte goes that a SPAN-byte string covers which also starts earlier: in a document with a smaller id, or in the same document further ahead. Strings are judged on the input. Null and empty texts, and texts shorter than SPAN, lose nothing. Rows with a null id come before all others; those with different texts are documents of their own, in the order of a hash. Rows with an equal id and text are one document and give equal rows; of rows with an equal id and other texts one, by a hash, counts as the earlier document. Ids below -2^62 are refused. An empty table gives none. Other columns are not read.

    Exchanges: the grams' hashes, once for their counts and once with places; the repeated grams, from the checkpoint folder; places of repeated grams by document; the texts, by document, once (both joins share that exchange); front-coded runs; merged ranges. The join of grams may have a gram with a third of all rows; adaptive execution splits it.
    """
    rows = rows_of(docs, id_col, text_col)
    every = places(rows)
    sent = rows.mapInArrow(deflated, "doc long not null, mark int, packed binary")
    often = cut(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))  # written, so that both sides of the join are exchanges of their own, which adaptive execution can split
    shared = every.join(often, "gram").select("doc", "gram", (F.col("place") + (F.col("n") > FREQUENT).cast("long")).alias("place")).repartition(shuffle_partitions(docs), "doc")
    by_doc = shared.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("place", "gram")).alias("places"))
    with_text = sent.join(by_doc.hint("shuffle_hash"), sent["doc"] == by_doc["_doc"]).select("doc", "mark", "packed", "places").sortWithinPartitions("doc", "mark")
    buckets = 2 * shuffle_partitions(docs)
    runs = with_text.mapInArrow(sorted_runs(buckets), "bucket int, block binary, doc long, mark int, ranges binary")
    repeats = runs.groupBy("bucket").applyInArrow(merged_group, "doc long, mark int, ranges binary")
    found = repeats.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("mark", "ranges")).alias("found"))
    joined = sent.join(found.hint("shuffle_hash"), sent["doc"] == found["_doc"], "left").select("doc", "mark", "packed", "found").sortWithinPartitions("doc", "mark")
    columns = {id_col: pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if keep_text else {})

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), columns.values(), strict=True)], list(columns))

    def run(batches):
        out, held = [], 0
        for doc, mark, texts, value in by_document(batches):
            of = {}
            if value.is_valid:
                for name, part in zip(value.values.field(0).to_pylist(), value.values.field(1).to_pylist(), strict=True):
                    of.setdefault(name, []).append(np.frombuffer(part, "<u4").reshape(-1, 2).astype(np.int64))
            for k, (packed, times) in enumerate(texts):
                raw = zlib.decompress(packed)
                removed, spans, kept = 0, 0, raw
                if mine := of.get(mark | k << 16):
                    both = np.concatenate(mine)
                    removed, spans, kept = strip(raw, both[:, 0], both[:, 0] + both[:, 1])
                out += [(None if doc < LOW // 2 else doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] * keep_text))] * times
                held += len(kept) * keep_text
                if len(out) >= 10_000 or held >= RUN:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def merged_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from merged(batches)
