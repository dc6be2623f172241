"""Operator 5: language identification by hierarchical discrimination: first the language family, then one-versus-one linear support vector machines, one for each pair of the family's languages, which vote."""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import by_row, cut

# Language codes by family, as ISO 639 names them. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
#: Hash buckets of character n-grams.
SIZE = 4096
#: Labelled rows per language that the classifier is fitted on, about: rows are picked by a hash of their id.
TRAIN_ROWS = 800
#: Up to so many languages are told to all tasks; with more, which only a dirty column has, counts are joined by an exchange.
LANGS = 10_000
SPACES = np.full(256, 32, np.uint8)
SPACES[65:91], SPACES[97:123] = np.arange(97, 123), np.arange(97, 123)
SPACES[128:] = np.arange(128, 256)
#: Bytes of a text whose n-grams are counted at a time.
PIECE = 1 << 20


def features(text: str) -> np.ndarray:
    """Square roots of the hashed counts of 1- to 3-byte n-grams of the lower-cased whole text, as a unit vector. Everything in ASCII but letters counts as a space."""
    data = SPACES[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    counts = np.zeros(SIZE, np.int64)
    for k in range(0, max(len(data) - 2, 1), PIECE):
        part = data[k : k + PIECE + 2]
        three = part[:-2] * 1_000_003 + part[1:-1] * 8_209 + part[2:] * 97
        two = part[:-1] * 40_503 + part[1:] * 131 + 7
        for grams in (three, two):
            counts += np.bincount((grams * np.uint32(2_654_435_761)) >> np.uint32(20), minlength=SIZE)
    out = np.sqrt(counts.astype(np.float32))
    return out / max(float(np.linalg.norm(out)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 15) -> np.ndarray:
    """A linear support vector machine (squared hinge) by dual coordinate descent; y is +1 or -1. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight, alpha, diagonal = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), 0.5 / cost
    norm, rng = (x.astype(np.float64) ** 2).sum(1) + diagonal, np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ weight) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                weight += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weight


class Model:
    """families: names, and a weight row for each that separates it from the others; languages: by family, names and a weight row for each pair of names, positive for the first of the pair."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        family = {lang: name for name, all_ in FAMILIES.items() for lang in all_}
        of = np.array([family.get(lang, lang) for lang in langs])
        langs = np.array(langs)
        self.families = sorted(set(of.tolist()))
        self.family_weights = np.array([svm(x, np.where(of == name, 1.0, -1.0)) for name in self.families]) if len(self.families) > 1 else np.zeros((1, x.shape[1] + 1))
        self.languages = {name: self.pairs(x[of == name], langs[of == name]) for name in self.families}

    @staticmethod
    def pairs(x: np.ndarray, y: np.ndarray) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
        names = sorted(set(y.tolist()))
        both = list(combinations(range(len(names)), 2))
        weights = [svm(x[of], np.where(y[of] == names[i], 1.0, -1.0)) for i, j in both for of in [(y == names[i]) | (y == names[j])]]
        return names, both, np.array(weights).reshape(len(both), x.shape[1] + 1)

    def family(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.families) == 1:
            return self.families[0], 1.0
        margin = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        chance = np.exp(3 * (margin - margin.max()))
        best = int(margin.argmax())
        return self.families[best], float(chance[best] / chance.sum())

    def language(self, x: np.ndarray, family: str) -> tuple[str, float]:
        """The language with most votes of its family's pairs, of equals the one with the larger sum of margins, then the first by name; and the mean chance that its own pairs give it."""
        names, both, weights = self.languages[family]
        if len(names) == 1:
            return names[0], 1.0
        margin = weights[:, :-1] @ x + weights[:, -1]
        votes, sums, chance = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for (i, j), m in zip(both, margin.tolist(), strict=True):
            votes[i if m >= 0 else j] += 1
            sums[i], sums[j] = sums[i] + m, sums[j] - m
            p = 1 / (1 + float(np.exp(-np.clip(3 * m, -50, 50))))
            chance[i], chance[j] = chance[i] + p, chance[j] + 1 - p
        best = max(range(len(names)), key=lambda k: (votes[k], sums[k], -k))
        return names[best], float(chance[best] / (len(names) - 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1; `und` and 0 without a letter."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = features(text)
        family, a = self.family(x)
        lang, b = self.language(x, family)
        return lang, a * b


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on a bounded sample: of each language about train_rows rows, those with the smallest hash of id and text. The sample's size does not grow with the input; languages are counted over all rows given, and the counts are joined."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    picked = rows.join(F.broadcast(counts) if counts.count() <= LANGS else counts, "lang").where((F.xxhash64("id", "text") / F.lit(2.0**64) + 0.5) * F.col("n") < train_rows)

    def sample(key, text, lang):
        return key, lang, features(text).astype(np.float16).tobytes()

    # a text's rows of one id are one in the order, so that reruns agree
    found = sorted(map(tuple, picked.select("id", "text", "lang").mapInArrow(by_row({"id": pa.int64(), "lang": pa.string(), "x": pa.binary()}, sample), "id long, lang string, x binary").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], bytes(r[2])))
    return Model(np.array([np.frombuffer(r[2], np.float16) for r in found]).astype(np.float32).reshape(-1, SIZE), [r[1] for r in found])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Predicts the language of every row's whole text: id, held_out, lang_pred, score.

    The rows whose crc32 of the id (as text) leaves 2 modulo 4 are held out; the others with a non-null language are what is learned from. Predictions use the text alone. Null texts and texts without a letter give `und` with score 0, as does every row if nothing can be learned. A null id is not held out. Repeated rows stay, other columns are not read. One pass counts languages, one takes the sample, one predicts; nothing is shuffled but the counts, unless there are too many languages to send their counts to all tasks. A letter is what Unicode calls one (category L). An empty table gives none.
    """
    out = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
    learned = fit(docs.where(~out), id_col, text_col, lang_col, train_rows)
    model = docs.sparkSession.sparkContext.broadcast(learned)  # some dozen weight vectors, whatever the input's size

    def row(key, held_out, text):
        return (key, held_out, *model.value.predict(text))

    columns = {id_col: pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}
    return docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), out.alias("held_out"), F.col(f"`{text_col}`").alias("text")).mapInArrow(by_row(columns, row), f"{id_col} long, held_out boolean, lang_pred string, score double")


def crc_mod(key: int) -> int:
    return zlib.crc32(str(key).encode()) % 4
