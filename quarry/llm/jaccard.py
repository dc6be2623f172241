"""Operator 2: exact n-gram Jaccard join with set-relation skipping.

Documents become sets of word shingles; equal sets are one class. Shingles are ordered by document frequency (frequent ones last, the rest by hash), and only a set's prefix is indexed, so that sets that link share an indexed shingle.

Index lists are sorted by set size and cut into blocks that know how far their entries reach: an entry at a position of a set leaves so many shingles, itself included, that its partner's size can't be above its reach if this is the first shingle that both share. A set visits only the run of its size range, and in it only blocks that reach its own size. A pair that links passes at the first shingle that it shares.

Answers are derived from those of a similar set: each set is compared with one hub, the set of its lists that shares most with it; what it lacks of the hub and what it has beyond are kept as its answer. Sets that link with their hub are connected without any comparison among each other. For two sets of one hub both answers bound their overlap: they link for certain, can't link, or (only then) are compared. Lists whose sets are all connected by then are dropped as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import by_row, components, cut, shuffle_partitions, unpacked
from quarry.llm.words import shingles, word_hashes

#: Distinct frequent shingles are at most so many: a shingle is frequent if its count is above the count of all shingles divided by this.
FREQUENT = 1 << 20
#: Shingles counted in a task's memory before they are sent on.
HELD = 1_000_000
#: Entries of one side of a pair of list parts that a task holds; longer lists are dealt to parts by hash.
PART = 4096
#: Entries of a list's block, which is skipped as one.
BLOCK = 64
#: Up to so many classes are told to all tasks when their sets are made again; for more, texts are exchanged.
TOLD = 200_000


def prefix_size(n: int, threshold: tuple[int, int]) -> int:
    return n - -(-n * threshold[0] // threshold[1]) + 1


def set_of(text: str | None, words: int) -> np.ndarray:
    return shingles(word_hashes((text or "").encode("utf-8", "surrogatepass")), words)


def frequencies(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit fingerprints of the frequent shingles, sorted, and their counts over all documents. Tasks send sorted fingerprints as 16-bit gaps, by bucket; the result has at most FREQUENT entries."""
    buckets = min(4096, max(16, 1 << (4 * shuffle_partitions(docs) - 1).bit_length()))
    width = (1 << 32) // buckets

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        counts = np.minimum(counts, 65535).astype("<u2")
        cuts = np.searchsorted(values, np.arange(0, buckets + 1, dtype=np.uint64) * width)
        ks = np.flatnonzero(np.diff(cuts))
        gaps, ones = [], []
        for k in ks:
            part = values[cuts[k] : cuts[k + 1]].astype(np.int64) - int(k) * width
            gap = np.diff(part, prepend=0)
            wide = gap >= 65535
            if wide.any():  # a gap that 16 bits can't hold is sent as 65535 and in full
                gaps.append(np.concatenate([[1], np.minimum(gap, 65535)]).astype("<u2").tobytes() + gap[wide].astype("<u4").tobytes())
            else:
                gaps.append(np.concatenate([[0], gap]).astype("<u2").tobytes())
            c = counts[cuts[k] : cuts[k + 1]]
            ones.append(c.astype(np.uint8).tobytes() if c.max() < 256 else c.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(np.diff(cuts)[ks], pa.int32()), pa.array(gaps, pa.binary()), pa.array(ones, pa.binary())], ["bucket", "n", "gaps", "counts"])

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                found = (set_of(text.as_py(), words) >> np.uint64(32)).astype(np.uint32)
                held.append(found)
                n += len(found)
                if n >= HELD:
                    yield from packed(held)
                    held, n = [], 0
        if n:
            yield from packed(held)

    def merged(key, tables):
        values, counts = [], []
        for batch in tables:
            for n, gaps, ones in zip(*(batch.column(c).to_pylist() for c in ("n", "gaps", "counts")), strict=True):
                gap = np.frombuffer(gaps, "<u2", n + 1)[1:].astype(np.int64)
                wide = gap == 65535
                gap[wide] = np.frombuffer(gaps, "<u4", int(wide.sum()), 2 * n + 2)
                values.append(np.cumsum(gap))
                counts.append(np.frombuffer(ones, np.uint8 if len(ones) == n else "<u2").astype(np.int64))
        all_, c = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(all_, kind="stable")
        all_, c = all_[order], c[order]
        starts = np.flatnonzero(np.diff(all_, prepend=-1))
        sums = np.add.reduceat(c, starts)
        yield pa.RecordBatch.from_arrays([pa.array(all_[starts] + key[0].as_py() * width, pa.int64()), pa.array(sums, pa.int64())], ["value", "count"])

    sent = docs.select(text_col).mapInArrow(count, "bucket int, n int, gaps binary, counts binary")
    # the total first picks the bar; both come from one written table of the sums that may pass it
    sums = cut(sent.groupBy("bucket").applyInArrow(lambda key, t: merged_table(key, t, merged), "value long, count long, total long"))
    total = sums.agg(F.sum("total")).first()[0] or 0
    found = sums.where(F.col("value").isNotNull() & (F.col("count") > max(64, total // FREQUENT))).select("value", "count").toPandas().sort_values("value")
    return found["value"].to_numpy(np.uint32), found["count"].to_numpy(np.int64)


def merged_table(key, table: pa.Table, merged) -> pa.Table:
    """The bucket's sums above the smallest bar, and one row with its total."""
    batch = next(merged(key, table.to_batches()))
    value, count = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    keep = count > 64
    return pa.table({"value": pa.array([*value[keep].tolist(), None], pa.int64()), "count": pa.array([*count[keep].tolist(), 0], pa.int64()), "total": pa.array([*([0] * int(keep.sum())), int(count.sum())], pa.int64())})


def identity(found: np.ndarray) -> int:
    """A 64-bit number of a set; with the set's size it names a class."""
    with np.errstate(over="ignore"):
        x = int((found * (found | np.uint64(1))).sum(dtype=np.uint64)) ^ int(np.bitwise_xor.reduce(found * np.uint64(0xD6E8FEB86659FD93)))
    return x - (1 << 64) if x >= 1 << 63 else x


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: tuple[int, int], frequent) -> DataFrame:
    """id, hash (the text's), n, sid and prefix (in the global order) of every row. A task sends a set's prefix once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT entries

    def run(batches):
        values, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            out = []
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = set_of(text.as_py(), words)
                if not len(found):
                    out.append((key, mark, 0, None, None))
                    continue
                sid = identity(found)
                if sid in seen:
                    out.append((key, mark, len(found), sid, None))
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                rank = np.zeros(len(found), np.int64)
                if len(values):
                    prints = (found >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(values, prints), len(values) - 1)
                    rank = np.where(values[at] == prints, counts[at], 0)
                size = prefix_size(len(found), threshold)
                first = np.lexsort((found, rank))[:size] if rank.any() else np.arange(size)
                out.append((key, mark, len(found), sid, found[first].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * len(columns), columns.values(), strict=True)], list(columns))

    columns = {"id": pa.int64(), "hash": pa.int64(), "n": pa.int64(), "sid": pa.int64(), "prefix": pa.list_(pa.int64())}
    return marked(docs, id_col, text_col).mapInArrow(run, "id long, hash long, n long, sid long, prefix array<long>")


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash (the text's) and text of every row: what tells rows apart, with or without an id."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text.alias("text"))


def reach(n: str, pos: str, threshold: tuple[int, int]):
    """The size of the largest set that can link with a set of n shingles if the first shingle that both share stands at this position of it."""
    p, q = threshold
    return F.floor((F.col(n) * q - F.col(pos) * (p + q)) / p)


def promising(pairs: DataFrame, shared: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that can link by what their prefixes share: beyond the prefix that ends first, that set has only ceil(t n) - 1 shingles more."""
    p, q = threshold
    prefixes = shared.groupBy("sid").agg(F.first("n").alias("n"), F.collect_list("tok").alias("toks"))
    left = prefixes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("x"))
    right = prefixes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("x", "y")))
    most = F.greatest(F.ceil(F.col("na") * p / q), F.ceil(F.col("nb") * p / q)) - 1
    return both.where((F.col("c") + most) * (p + q) >= (F.col("na") + F.col("nb")) * p).select("a", "b")


def answers(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """na, nb and shared, the size of the exact intersection, of each pair (a, b) of classes. Rows of one pair hold two sets at most; nothing is grouped."""

    def count(a, b, x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return a, b, len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))

    left = members.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    right = members.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(by_row(dict.fromkeys(("a", "b", "na", "nb", "shared"), pa.int64()), count), "a long, b long, na long, nb long, shared long")


def linked(threshold: tuple[int, int]):
    p, q = threshold
    return F.col("shared") * (p + q) >= (F.col("na") + F.col("nb")) * p


class Entries:
    """A list, or two parts of one, sorted by size: columns n, reach, sid, component, hub, size of the hub, lack, more, part."""

    def __init__(self, columns: np.ndarray, threshold: tuple[int, int]):
        self.n, self.reach, self.sid, self.component, self.hub, self.hub_n, self.lack, self.more, self.part = columns
        self.p, self.q = threshold

    def pairs(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """a, b and whether they link for certain, of pairs of unconnected sets that may link."""
        size, ends = len(self.n), (np.arange(0, len(self.n), BLOCK))
        tops = np.maximum.reduceat(self.reach, ends)
        starts = np.searchsorted(self.n, -(-self.n * self.p // self.q))  # earlier entries below are too small
        least = self.n[starts.clip(max=size - 1)]
        for j in np.flatnonzero((np.arange(size) > starts) & (self.reach >= least)):
            blocks = np.arange(starts[j] // BLOCK, j // BLOCK + 1)
            blocks = blocks[tops[blocks] >= self.n[j]]  # others don't reach this size from their positions
            if not len(blocks):
                continue
            i = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            i = i[(i >= starts[j]) & (i < j)]
            fits = (self.reach[i] >= self.n[j]) & (self.n[i] <= self.reach[j]) & (self.component[i] != self.component[j])
            if first != last:
                fits &= self.part[i] != self.part[j]
            i = i[fits & (self.hub[i] != self.sid[j]) & (self.sid[i] != self.hub[j])]  # pairs with a hub are answered
            if not len(i):
                continue
            need = -(-(self.n[i] + self.n[j]) * self.p // (self.p + self.q))
            same = self.hub[i] == self.hub[j]
            most = self.hub_n[j] - np.maximum(self.lack[i], self.lack[j]) + np.minimum(self.more[i], self.more[j])
            least_ = self.hub_n[j] - self.lack[i] - self.lack[j]
            may = ~same | (most >= need)
            yield self.sid[i][may], np.full(int(may.sum()), self.sid[j]), (same & (least_ >= need))[may]


def enumerate_pairs(lists: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """a, b and sure of the pairs of unconnected sets that may link. A list is dealt to parts of at most about PART entries; a task takes two parts at a time, however long the list is."""
    names = ["n", "reach", "sid", "component", "hub", "hub_n", "lack", "more", "part"]

    def run(batches):
        key, held, found = None, [], {}

        def pairs():
            columns = np.concatenate(held, axis=1)
            for a, b, sure in Entries(columns, threshold).pairs(key[1], key[2]):
                for x, y, z in zip(a.tolist(), b.tolist(), sure.tolist(), strict=True):
                    found[(x, y) if x < y else (y, x)] = z

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.bool_())], ["a", "b", "sure"])
            found.clear()
            return out

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("tok", "first", "last")])
            columns = np.stack([batch.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if x == y:
                    continue
                if (here := tuple(keys[x])) != key:
                    if held:
                        pairs()
                    key, held = here, []
                held.append(columns[:, x:y])
                if len(found) >= 100_000:
                    yield flush()
        if held:
            pairs()
        if found:
            yield flush()

    by_list = Window.partitionBy("tok")
    # lists of connected sets go as a whole
    open_ = lists.withColumn("low", F.min("component").over(by_list)).withColumn("high", F.max("component").over(by_list)).withColumn("parts", F.ceil(F.count("*").over(by_list) / PART).cast("long")).where("low <> high")
    own = open_.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("first", F.least("part", "other")).withColumn("last", F.greatest("part", "other"))
    dealt = paired.select("tok", "first", "last", *names).repartition(shuffle_partitions(lists), "tok", "first", "last").sortWithinPartitions("tok", "first", "last", "n", "sid")
    made = dealt.mapInArrow(run, "a long, b long, sure boolean")
    return made.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: tuple[int, int] = (85, 100), detail: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included); with detail also text_hash and class_id, one number for all rows that are connected (null for empty sets).

    Words are runs of bytes other than the space and the controls from tab to carriage return, A-Z lower-cased. A text with fewer words than a shingle has its whole sequence as one; null and empty texts, and texts without words, have an empty set, link with nothing and are their own component. Two sets link when intersection * threshold[1] >= threshold[0] * union. Links and components are exact (up to collisions of 64-bit hashes). Repeated rows are rows of one class; a row with a null id takes part under its class and connects others, and gets the smallest id that it reaches, or null. An empty table gives none. Other columns are not read.
    """
    p, q = threshold
    frequent = frequencies(docs, text_col, words)
    rows = cut(sets(docs, id_col, text_col, words, threshold, frequent))
    base = rows.where("sid is not null")
    # of each class one row whose text its set is made from again: that of the smallest id, if it has any
    reps = base.groupBy("sid", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("rep")).select("sid", "n", F.col("rep.id").alias("rep"), F.col("rep.hash").alias("hash"))
    classes = base.where("prefix is not null").select("sid", "n", F.posexplode("prefix").alias("pos", "tok")).distinct()
    # only lists with two sets matter; a frequent shingle stands in a prefix only where hardly anything else does
    by_token = Window.partitionBy("tok")
    shared = cut(classes.withColumn("low", F.min("sid").over(by_token)).withColumn("high", F.max("sid").over(by_token)).where("low <> high").select("tok", "sid", "n", reach("n", "pos", threshold).alias("reach")))
    # the hub of a list is its set with the fewest shingles of its own, so the one most like the others
    own = shared.groupBy(F.col("sid").alias("_sid")).agg((F.first("n") - F.ceil(F.first("n") * p / q) + 1 - F.count("*")).alias("u"))
    hub = F.min(F.struct("u", "n", "sid", "reach")).over(by_token)
    near = shared.join(own, shared["sid"] == own["_sid"]).withColumn("h", hub).where("h.sid <> sid and h.n <= reach and n <= h.reach").where((F.least("n", "h.n") * q >= F.greatest("n", "h.n") * p)).select("sid", F.col("h.sid").alias("hub"))
    chosen = near.groupBy("sid", "hub").agg(F.count("*").alias("c")).groupBy("sid").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))

    def fetch(wanted: DataFrame) -> DataFrame:
        """sid and tokens of the wanted classes, made again from their rows' texts."""
        texts = cut(wanted.distinct().join(reps, "sid").select("sid", F.col("rep").alias("_id"), F.col("hash").alias("_hash")))
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
        if texts.count() <= TOLD:
            both = marked(docs, id_col, text_col).join(F.broadcast(texts), same).select("sid", "text").mapInArrow(by_row({"sid": pa.int64(), "tokens": pa.binary()}, lambda sid, text: tokens(sid, text)), "sid long, tokens binary")
        else:
            packed = marked(docs, id_col, text_col).mapInArrow(by_row({"id": pa.int64(), "hash": pa.int64(), "packed": pa.binary()}, lambda key, mark, text: (key, mark, zlib.compress((text or "").encode("utf-8", "surrogatepass"), 4))), "id long, hash long, packed binary")
            both = packed.join(texts.hint("shuffle_hash"), same).select("sid", "packed").mapInArrow(by_row({"sid": pa.int64(), "tokens": pa.binary()}, lambda sid, packed: tokens(sid, unpacked(packed))), "sid long, tokens binary")
        return both.where("tokens is not null").groupBy("sid").agg(F.first("tokens").alias("tokens"))

    def tokens(sid, text):
        found = set_of(text, words)
        return sid, found.tobytes() if len(found) and identity(found) == sid else None

    starred = cut(promising(chosen.select(F.col("sid").alias("a"), F.col("hub").alias("b")), shared, threshold))
    told = cut(answers(starred, fetch(starred.select(F.col("a").alias("sid")).union(starred.select("b")))))
    edges = told.where(linked(threshold)).select("a", "b")
    joined = components(edges)
    told = told.select(F.col("a").alias("sid"), F.col("b").alias("hub"), F.col("nb").alias("hub_n"), (F.col("nb") - F.col("shared")).alias("lack"), (F.col("na") - F.col("shared")).alias("more"))
    known = shared.join(joined.withColumnRenamed("node", "sid"), "sid", "left").join(told, "sid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    known = known.select("tok", "n", "reach", "sid", F.coalesce("component", "sid").alias("component"), F.coalesce("hub", "sid").alias("hub"), F.coalesce("hub_n", "n").alias("hub_n"), zero("lack"), zero("more"))
    rest = cut(enumerate_pairs(known, threshold))
    if not rest.isEmpty():
        open_ = cut(promising(rest.where("not sure").select("a", "b"), shared, threshold))
        sure = rest.where("sure").select("a", "b")
        more = cut(answers(open_, fetch(open_.select(F.col("a").alias("sid")).union(open_.select("b")))).where(linked(threshold)).select("a", "b").union(sure))
        if not more.isEmpty():
            # the components so far are one edge a set, so they are extended, not made again
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    of_class = reps.join(joined.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "n", "rep", F.coalesce("component", "sid").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = of_class.join(smallest, "component").select("sid", "n", "component", "component_id")
    found = rows.select("id", "hash", "n", "sid").join(answer, ["sid", "n"], "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *([F.col("hash").alias("text_hash"), F.col("component").alias("class_id")] if detail else []))
