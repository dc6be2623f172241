"""Operator 4: toxicity by a classifier chain. Linear models predict the categories one after the other; each takes the probabilities of the earlier categories as features, and is trained with out-of-fold predictions of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import by_row
from quarry.llm.words import LETTERS, word_hashes

#: Labelled rows that the chain is fitted on, at most about: those with the smallest hash of their id.
TRAIN_ROWS = 6000
#: Hash buckets, features kept for each category, and folds.
BITS, KEPT, FOLDS = 22, 1500, 3


def features(text: str) -> np.ndarray:
    """Distinct hash buckets of a whole text's words and of their first four and five bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    found = [word_hashes(raw, LETTERS, n) for n in (0, 4, 5)]
    return np.unique(np.concatenate([(h ^ np.uint64(k)) >> np.uint64(64 - BITS) for k, h in enumerate(found)])).astype(np.int64)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression over the features that tell the classes apart best; each feature is scaled by its log-count ratio. extra: dense columns, here earlier probabilities."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, extra: np.ndarray, rounds: int = 200):
        n, pos = len(rows), max(1.0, float(y.sum()))
        neg = max(1.0, n - pos)
        flat, of = (np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, at = np.unique(flat, return_inverse=True)
        with_, total = np.bincount(at, y[of], len(ids)), np.bincount(at, minlength=len(ids))
        ratio = np.log((with_ + 0.5) / (pos + 1)) - np.log((total - with_ + 0.5) / (neg + 1))
        expected = total * pos / max(n, 1)
        strength = np.abs(with_ - expected) / np.sqrt(expected * (1 - pos / max(n, 1)) + 1)
        best = np.argsort(-strength * (total >= 4), kind="stable")[:KEPT]
        best = np.sort(best[(total[best] >= 4) & (strength[best] >= 2.9)])
        self.ids, scale = ids[best], ratio[best]
        place = np.full(len(ids), -1)
        place[best] = np.arange(len(best))
        keep = place[at] >= 0
        r, c = of[keep], place[at[keep]]
        mean, sd = (extra.mean(0), extra.std(0) + 1e-6) if n else (np.zeros(extra.shape[1]), np.ones(extra.shape[1]))
        dense = (extra - mean) / sd
        w, v, b = np.zeros(len(best)), np.zeros(extra.shape[1]), float(np.log(pos / neg))
        state = [np.zeros(len(w) + len(v) + 1) for _ in range(2)]
        for k in range(1, rounds + 1):  # Adam, full batches
            z = np.bincount(r, (w * scale)[c], n) + dense @ v + b
            error = (sigmoid(z) - y) / max(n, 1)
            gradient = np.concatenate([np.bincount(c, error[r], len(w)) * scale + 1e-4 * w, dense.T @ error + 1e-4 * v, [error.sum()]])
            state[0] = 0.9 * state[0] + 0.1 * gradient
            state[1] = 0.99 * state[1] + 0.01 * gradient**2
            step = 0.1 * state[0] / (1 - 0.9**k) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-9)
            w, v, b = w - step[: len(w)], v - step[len(w) : -1], b - step[-1]
        self.weights, self.v, self.b = w * scale, v / sd, b - float((v * mean / sd).sum())

    def predict(self, row: np.ndarray, extra: np.ndarray) -> float:
        at = np.searchsorted(self.ids, row)
        at[at == len(self.ids)] = 0
        hit = self.ids[at] == row if len(self.ids) else np.zeros(len(row), bool)
        return float(sigmoid(self.weights[at[hit]].sum() + self.v @ extra + self.b))


class Chain:
    """One model for each category, in the order of their columns."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        n, self.models = len(rows), []
        fold, extra = np.arange(n) % FOLDS, np.zeros((n, 0))
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            self.models.append(Linear(rows, y, extra))
            if k + 1 == labels.shape[1]:
                break
            unseen = np.zeros(n)
            for f in range(FOLDS):  # what the next model sees of this one in training comes from models that have not seen the row
                part = Linear([rows[i] for i in np.flatnonzero(fold != f)], y[fold != f], extra[fold != f])
                for i in np.flatnonzero(fold == f):
                    unseen[i] = part.predict(rows[i], extra[i])
            extra = np.column_stack([extra, unseen])

    def predict(self, text: str | None) -> list[float]:
        """The probabilities, in order; of a null or empty text 0."""
        if not text:
            return [0.0] * len(self.models)
        row, found = features(text), []
        for model in self.models:
            found.append(model.predict(row, np.array(found)))
        return found


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Chain:
    """Fits on at most about train_rows labelled rows, picked by a hash of their id; categories: SQL conditions on the columns of labels, by name, in the chain's order. Rows with a null condition or text are left out; of repeated label rows a category's largest counts, of repeated documents the text that sorts first."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), *(F.expr(condition).cast("int").alias(f"y{k}") for k, condition in enumerate(categories.values()))).dropna().groupBy("id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))))
    n = labels.select(F.count("*")).first()[0]
    share = min(1.0, train_rows / max(n, 1))
    picked = marks.where((F.xxhash64("id") / F.lit(2.0**64) + 0.5) < share)
    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").where((F.xxhash64("id") / F.lit(2.0**64) + 0.5) < share).join(F.broadcast(picked), "id")  # the sample's bound holds for both sides

    # of rows that repeat an id one is learned from, so that the bound holds whatever repeats
    joined = joined.groupBy("id", *(f"y{k}" for k in range(len(categories)))).agg(F.min("text").alias("text"))

    def sample(key, text, *marks):
        return key, features(text).astype("<u4").tobytes(), list(marks)

    found = sorted((tuple(r) for r in joined.select("id", "text", *(f"y{k}" for k in range(len(categories)))).mapInArrow(by_row({"id": pa.int64(), "x": pa.binary(), "y": pa.list_(pa.int32())}, sample), "id long, x binary, y array<int>").collect()), key=lambda r: (r[0], bytes(r[1])))
    return Chain([np.frombuffer(r[1], "<u4").astype(np.int64) for r in found], np.array([r[2] for r in found]).reshape(-1, len(categories)))


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, one probability column p_<category> for each category, and the columns in keep, for every row of docs; whole texts are read.

    Null and empty texts get probability 0, as does every row if there is nothing to learn from. Repeated rows stay. Rows are independent: nothing is shuffled but labels, once.
    """
    chain = fit(docs, labels, categories, id_col, text_col, train_rows)
    model = docs.sparkSession.sparkContext.broadcast(chain)  # at most KEPT weights a category
    columns = [c for c in dict.fromkeys((id_col, *keep)) if c in docs.columns]

    def run(batches):
        for batch in batches:
            found = [model.value.predict(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([p[k] for p in found], pa.float64()) for k in range(len(categories)))], [*columns, *(f"p_{c}" for c in categories)])

    base = docs.select(*columns, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]), *(f"p_{c} double" for c in categories)])
    return base.mapInArrow(run, schema)


#: The categories of the labels table, in the chain's order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
LIMIT = 0.5


def toxic_columns():
    """Rejected rows have a toxicity probability above LIMIT."""
    return reduce(lambda a, b: a | b, [F.col("p_toxic") > LIMIT])
