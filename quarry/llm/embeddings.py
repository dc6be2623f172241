"""Operator 8: near-duplicate embeddings by a forest of random-projection trees with spill overlap. Vectors are compared inside leaves, links are verified by cosine in double precision, and linked vectors are united.

Each tree splits a label's vectors at the median of a random projection; vectors within a margin of the median go to both sides. The directions follow from a seed, so no index is kept or sent. A node that spilling keeps nearly whole is one dense cluster: it stays a leaf, however large, and is compared in blocks.

A label whose vectors fit a task is sent there once, and the whole forest is grown and compared there. Larger labels are split level by level, with medians from a mergeable sketch over all rows of a node; rows carry the few projections that their levels take, and their vectors meet once a leaf.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import by_row, components, cut

TREES, LEAF, DEPTH = 8, 512, 40
#: Half the width of the strip that goes to both sides, on unit vectors; in units of 1 / sqrt(dimensions).
MARGIN = 0.24
#: A child with more than this share of its parent's rows has not been split; after so many of them in a row the node is dense.
DENSE, TRIES = 0.8, 2
#: Rows of one side of a block comparison.
BLOCK = 1024
#: Numbers in the vectors of a label that one task takes: 16 MB of doubles.
FIT = 1 << 21
#: Up to so many large labels are told to all tasks; more are joined by an exchange.
TOLD = 10_000
SEED = 20260101


def unit(values) -> np.ndarray | None:
    """The vector in double precision, scaled to length 1; None where it links with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    size = np.abs(x).max()
    if size == 0:
        return None
    x = x / size
    return x / np.sqrt(x @ x)


def directions(dimensions: int) -> np.ndarray:
    x = np.random.default_rng([SEED, dimensions]).standard_normal((TREES * DEPTH, dimensions))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(dimensions)


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dimensions, two halves of a digest of the unit vector, and data (the numbers as they came, in bytes); null dimensions where a vector links with nothing."""
    values = F.col(f"`{vector_col}`")
    single = vectors.select(values).schema[0].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    columns = {"vec_id": pa.int64(), "label": pa.string(), "dimensions": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "data": pa.binary()}

    def row(key, label, given):
        x = unit(given)
        if x is None:
            return key, label, None, None, None, None
        digest = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
        return key, label, len(x), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), np.array(given, kind).tobytes()

    made = vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("string"), values)
    return made.mapInArrow(by_row(columns, row), "vec_id long, label string, dimensions int, k1 long, k2 long, data binary")


def units(data, dimensions: int) -> np.ndarray:
    """Unit vectors, in rows, from bytes of single or double numbers."""
    return np.stack([unit(np.frombuffer(d, "<f4" if len(d) == 4 * dimensions else "<f8")) for d in data])


def grown(x: np.ndarray) -> list[np.ndarray]:
    """The leaves of all trees over these unit vectors, as arrays of row numbers."""
    out = []
    for tree in range(TREES):
        p = x @ directions(x.shape[1])[tree * DEPTH : (tree + 1) * DEPTH].T
        nodes = [(np.arange(len(x)), 0, 0, 0)]
        while nodes:
            rows, level, parent, failed = nodes.pop()
            failed = failed + 1 if len(rows) > DENSE * parent > 0 else 0
            if len(rows) <= LEAF or failed >= TRIES or level == DEPTH:
                out.append(rows)
                continue
            at = p[rows, level]
            middle = np.median(at)
            nodes += [(rows[side], level + 1, len(rows), failed) for side in (at <= middle + MARGIN, at > middle - MARGIN)]
    return out


def linked(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, limit: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many vectors each row links with beyond its own class, and edges that span the linked rows: of pairs that meet in a leaf, block against block; a pair counts in the first leaf where it meets."""
    leaves = grown(x)
    of: list[list[int]] = [[] for _ in ids]
    for k, rows in enumerate(leaves):
        for r in rows.tolist():
            of[r].append(k)
    counts, root, edges = np.zeros(len(ids), np.int64), list(range(len(ids))), []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, rows in enumerate(leaves):
        together = set(of[rows[0]])
        for r in rows[1:].tolist():
            together &= set(of[r])
            if len(together) == 1:
                break
        if min(together) < k:  # all its pairs have met before, as those of a dense node do that each tree finds
            continue
        cuts = range(0, len(rows), BLOCK)
        for a in cuts:
            for b in cuts:
                if b < a:
                    continue
                left, right = rows[a : a + BLOCK], rows[b : b + BLOCK]
                close = x[left] @ x[right].T >= limit
                if a == b:
                    np.fill_diagonal(close, False)
                i, j = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                if not len(i):
                    continue
                left, right, close = left[i], right[j], close[np.ix_(i, j)]
                earlier = sorted({leaf for r in {*left.tolist(), *right.tolist()} for leaf in of[r] if leaf < k})
                place = {leaf: n for n, leaf in enumerate(earlier)}
                met = [np.zeros((len(side), len(earlier)), np.float32) for side in (left, right)]
                for side, matrix in zip((left, right), met, strict=True):
                    for n, r in enumerate(side.tolist()):
                        matrix[n, [place[leaf] for leaf in of[r] if leaf < k]] = 1
                new = close & ~((met[0] @ met[1].T) > 0) if earlier else close
                np.add.at(counts, left, new @ sizes[right])
                if a != b:
                    np.add.at(counts, right, new.T @ sizes[left])
                for n, r in enumerate(left.tolist()):
                    for q in right[np.flatnonzero(new[n])].tolist():
                        u, v = find(r), find(q)
                        if u != v:
                            root[max(u, v)] = min(u, v)
                            edges.append((int(ids[r]), int(ids[q])))
    return counts, edges


def answer(ids, counts, edges):
    """Links of rows, and edges, in one shape: a, b (null for a row's links) and links."""
    import pandas as pd

    some = np.flatnonzero(counts)
    return pd.DataFrame({"a": np.concatenate([ids[some], [e[0] for e in edges]]).astype("int64"), "b": pd.array([None] * len(some) + [int(e[1]) for e in edges], dtype="Int64"), "links": np.concatenate([counts[some], np.zeros(len(edges), np.int64)]).astype("int64")})


def within(pdf, limit: float):
    """A label's links, its forest grown in the task."""
    pdf = pdf.sort_values("id", ignore_index=True)
    ids, sizes = pdf["id"].to_numpy(), pdf["size"].to_numpy()
    return answer(ids, *linked(ids, sizes, units(pdf["data"], int(pdf["dimensions"][0])), limit))


def leaves(points: DataFrame, most: int) -> DataFrame:
    """id, leaf, rows for each tree and leaf that a point (id, label, dimensions, data) falls into; most: rows of the largest label."""
    known: dict[int, np.ndarray] = {}
    deep = min(DEPTH, math.ceil(math.log2(max(most / LEAF, 2)) * 1.6) + 4)  # spilling makes a tree deeper than halving would

    def project(key, label, dimensions, data):
        if dimensions not in known:
            known[dimensions] = directions(dimensions).reshape(TREES, DEPTH, dimensions)[:, :deep].reshape(TREES * deep, dimensions)
        return key, f"{dimensions}:{label}", (known[dimensions] @ units([data], dimensions)[0]).astype(np.float32).tolist()

    rows = points.select("id", "label", "dimensions", "data").mapInArrow(by_row({"id": pa.int64(), "label": pa.string(), "p": pa.list_(pa.float32())}, project), "id long, label string, p array<float>")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    active = cut(rows.select("id", "label", tree, "p").select("id", "label", "tree", F.slice("p", F.col("tree") * deep + 1, deep).alias("p"), F.lit("").alias("path"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("failed")))
    node, done = ["label", "tree", "path"], None
    for level in range(deep + 1):
        # the projection of this level is the first of those that are left
        at = F.coalesce(F.get("p", F.lit(0)), F.lit(0.0))
        nodes = active.groupBy(*node).agg(F.count("*").alias("rows"), F.percentile_approx(at, F.lit(0.5), F.lit(1000)).alias("middle"))
        named = [F.col(c).alias(f"n_{c}") for c in node]
        nodes = nodes.select(*named, "rows", "middle")
        joined = active.join(nodes, [active[c] == nodes[f"n_{c}"] for c in node])
        failed = F.when(F.col("rows") > DENSE * F.col("parent"), F.col("failed") + 1).otherwise(0)
        joined = joined.withColumn("fails", failed).withColumn("ends", (F.col("rows") <= LEAF) | (F.col("fails") >= TRIES) | F.lit(level == deep))
        low, high = at <= F.col("middle") + MARGIN, at > F.col("middle") - MARGIN
        sides = F.when(F.col("ends"), F.array(F.lit(""))).otherwise(F.filter(F.array(F.when(low, F.lit("0")), F.when(high, F.lit("1"))), lambda s: s.isNotNull()))
        rest = F.when(~F.col("ends"), F.slice("p", 2, deep)).alias("p")
        moved = cut(joined.select("id", "label", "tree", rest, F.explode(sides).alias("side"), "path", "rows", "fails", "ends").select("id", "label", "tree", "p", F.concat("path", "side").alias("path"), F.col("rows").alias("parent"), F.col("fails").alias("failed"), "ends"))
        ended = moved.where("ends").select("id", F.xxhash64(*node).alias("leaf"), F.col("parent").alias("rows"))
        done = ended if done is None else done.union(ended)
        active = moved.where("not ends").drop("ends")
        if active.isEmpty():
            break
    return done


def compare(pdf, limit: float):
    """Links inside one block pair of a leaf: for each vector the links that this leaf is the first to find, and edges that span the leaf's linked vectors."""
    import pandas as pd

    pdf = pdf.sort_values(["block", "id"], ignore_index=True)
    first, last = int(pdf["first"][0]), int(pdf["last"][0])
    ids, sizes = pdf["id"].to_numpy(), pdf["size"].to_numpy()
    left = np.flatnonzero(pdf["block"] == first)
    right = left if first == last else np.flatnonzero(pdf["block"] == last)
    empty = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="Int64"), "links": pd.Series([], dtype="int64")})
    if not len(left) or not len(right):
        return empty
    x = units(pdf["data"], int(pdf["dimensions"][0]))
    close = x[left] @ x[right].T >= limit
    if first == last:
        np.fill_diagonal(close, False)
    if not close.any():
        return empty
    here = pdf["leaf"][0]
    other = sorted({leaf for all_ in pdf["leaves"] for leaf in all_ if leaf < here})
    new = close
    if other:
        place = {leaf: k for k, leaf in enumerate(other)}
        member = np.zeros((len(pdf), len(other)), np.float32)
        for i, all_ in enumerate(pdf["leaves"]):
            member[i, [place[leaf] for leaf in all_ if leaf < here]] = 1
        new = close & ~((member[left] @ member[right].T) > 0)
    counts = np.zeros(len(pdf), np.int64)
    np.add.at(counts, left, new @ sizes[right])
    if first != last:
        np.add.at(counts, right, new.T @ sizes[left])
    root = list(range(len(pdf)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for k in range(len(left)):
        for j in right[np.flatnonzero(close[k])]:
            a, b = find(int(left[k])), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((ids[left[k]], ids[j]))
    return answer(ids, counts, edges)


def across(points: DataFrame, most: int, limit: float) -> DataFrame:
    """The links of labels that don't fit a task: leaf by leaf, large leaves block against block."""
    found = leaves(points, most)
    by_id = found.groupBy("id").agg(F.collect_set("leaf").alias("leaves"), F.collect_set(F.struct("leaf", "rows")).alias("at"))
    full = by_id.join(points.select("id", "size", "dimensions", "data"), "id").select("id", "size", "dimensions", "data", "leaves", F.explode("at").alias("x")).select("id", "size", "dimensions", "data", "leaves", "x.leaf", F.ceil(F.col("x.rows") / BLOCK).cast("int").alias("blocks"))
    own = full.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("first", F.least("block", "other")).withColumn("last", F.greatest("block", "other"))
    return paired.groupBy("leaf", "first", "last").applyInPandas(lambda pdf: compare(pdf, limit), LINKS)


LINKS = "a long, b long, links long"


def near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = 0.93) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least `limit`. Null, empty, zero and non-finite vectors, vectors with a null component and rows with a null label or id link with nothing: no links, a component of their own. Vectors of different length never link. Equal vectors (by a 128-bit digest) are one class: they link with each other, and each with what its class links with. Repeated ids are rows of their own with equal ids. An empty table gives none. Other columns are not read.

    Links between different vectors are those the forest finds (recall is tested against brute force); a link found in several leaves counts in the first. Only counts and spanning edges leave a task. A leaf of more than BLOCK rows is compared exactly, block against block.
    """
    rows = classes(vectors, id_col, vector_col, label_col)
    good = rows.where("dimensions is not null and label is not null and vec_id is not null")
    points = cut(good.groupBy("label", "dimensions", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("data").alias("data")))
    large = cut(points.groupBy("label", "dimensions").agg(F.count("*").alias("rows")).where(F.col("rows") * F.col("dimensions") > FIT))
    found, small = None, points
    if not large.isEmpty():
        of = ["label", "dimensions"]
        told = F.broadcast(large) if large.count() <= TOLD else large
        small = points.join(told, of, "left_anti")
        found = across(points.join(told, of, "left_semi"), large.agg(F.max("rows")).first()[0], limit)
    inside = small.groupBy("label", "dimensions").applyInPandas(lambda pdf: within(pdf, limit), LINKS)
    links = cut(inside if found is None else inside.union(found))
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(links.where("b is not null").select("a", "b"))
    of_class = points.select("label", "dimensions", "k1", "k2", "id", "size").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").select("label", "dimensions", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    told = rows.drop("data").withColumn("dimensions", F.when(F.col("vec_id").isNotNull(), F.col("dimensions")))  # without an id, without links
    out = told.join(of_class, ["label", "dimensions", "k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
