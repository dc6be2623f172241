"""Operator 9: exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

A word's tokens are the longest matches of an Aho-Corasick automaton, taken from left to right; a match is kept only if the pair with the token before it is compatible, that is, if merging the two tokens' text by rank leaves exactly these two. An incompatible match gives way to its next shorter prefix token, and a position that no token leaves is marked and never tried again, so the work is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import by_row

#: Marks a word's end inside this module; no byte maps to it.
END = "\0"
WORDS_KEPT = 150_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        inner = {(t[: -len(suffix)] + END if t.endswith(suffix) and len(t) > len(suffix) else t): i for t, i in model["vocab"].items()}
        self.inner = inner
        size = 1 + max([*inner.values(), *(t["id"] for t in spec["added_tokens"])])
        pieces = [b""] * size
        for token, i in model["vocab"].items():
            pieces[i] = token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(p) + 1 for p in pieces], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(p + b" " for p in pieces), np.uint8)

        self.length = {i: len(t) for t, i in inner.items()}
        self.pairs, self.split = {}, {i: (i, i) for i in inner.values()}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = left + right
            a, b = (inner[x[: -len(suffix)] + END if x.endswith(suffix) and len(x) > len(suffix) else x] for x in (left, right))
            c = model["vocab"][whole]
            self.pairs[a, b], self.split[c] = c, (a, b)
        self.shorter = {}
        for token, i in inner.items():
            self.shorter[i] = next((inner[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in inner), None)
        self.automaton = ahocorasick.Automaton()
        for token, i in inner.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.letters = byte_letters()
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.of_byte = {b: x for b, x in enumerate(self.letters)}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their text is merged by rank: no merge across their border, at any level, comes before those inside."""
        pairs, split, limit = self.pairs, self.split, 1 << 60
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            for step in ((0, 1) if left > right else (1, 0)):
                if step == 0:
                    limit, inside = left, split[left][1]
                    if inside != left:
                        left = inside
                        break
                else:
                    limit, inside = right + 1, split[right][0]
                    if inside != right:
                        right = inside
                        break
            else:
                return True

    def word(self, word: str) -> list[int]:
        """The tokens of one pre-token."""
        text = (word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.of_byte)) + END
        n, length, fit, matches = len(text), self.length, self.fit, self.automaton.iter_long

        def longest(at: int) -> int | None:
            end, (token, size) = next(matches(text, at), (-1, (0, 0)))
            return token if end - size + 1 == at else None

        out: list[int] = []
        open_, at, token, last = [True] * (n + 1), 0, longest(0), None
        while at < n:
            while token is not None:
                end = at + length[token]
                if open_[end]:
                    if last is None:
                        break
                    pair = last, token
                    fits = fit.get(pair)
                    if fits is None:
                        if len(fit) >= 4 * WORDS_KEPT:
                            fit.clear()
                        fits = fit[pair] = self.compatible(last, token)
                    if fits:
                        break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                last, at = token, end
                token = longest(end) if end < n else None
            else:
                if last is None:
                    raise ValueError(f"no tokens for {word!r}")
                open_[at] = False
                out.pop()
                at -= length[last]
                token, last = self.shorter[last], out[-1] if out else None
        return out

    def chunk(self, chunk: str) -> bytes:
        """The tokens of text without white space and special tokens, each as four bytes."""
        if not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        out, known = [], self.known_words
        for word in self.words.findall(chunk.replace("Σ", "σ").lower()):
            ids = known.get(word)
            if ids is None:
                ids = np.array(self.word(word), "<u4").tobytes()
                if len(known) >= WORDS_KEPT:
                    known.clear()
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The token ids of a whole text. Words met lately are kept, up to a fixed number of them."""
        out: list[bytes] = []
        known = self.known
        for k, part in enumerate(self.marks.split(text) if self.marks and any(m in text for m in self.special) else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            plain = part.isprintable() or not any(c in part for c in "\x1c\x1d\x1e\x1f")
            for chunk in part.split() if plain else filter(None, self.space.split(part)):
                ids = known.get(chunk)
                if ids is None:
                    ids = self.chunk(chunk)
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    if len(chunk) <= 64:
                        known[chunk] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' text, joined by a space, gathered from one table of bytes through the offset of each id."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        start, ends = self.offsets[ids], np.cumsum(self.offsets[ids + 1] - self.offsets[ids])
        step = np.ones(ends[-1], np.int64)
        step[0] = start[0]
        step[ends[:-1]] = start[1:] - (self.offsets[ids[:-1] + 1] - 1)
        return self.bytes[np.cumsum(step)][:-1].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, encoding="utf-8") as file:
        return Codec(json.load(file))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_tokens: bool = False) -> DataFrame:
    """Encodes and decodes each row's whole text; returns id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, tokens and decoded.

    path names a vocabulary file that every executor has, as an installed package's data. Null texts count as empty and give no tokens and an empty decoded text; repeated rows stay; a null id stays null; other columns are not read. Rows are independent, so nothing is shuffled.
    """
    columns = {id_col: pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if keep_tokens:
        columns |= {"tokens": pa.list_(pa.int64()), "decoded": pa.string()}

    def row(key, text):
        own = codec(path)
        ids = own.encode(text or "")
        decoded = own.decode(ids)
        out = (key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
        return (*out, ids.tolist(), decoded.decode()) if keep_tokens else out

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<long>, decoded string" * keep_tokens
    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias(text_col)).mapInArrow(by_row(columns, row), schema)
