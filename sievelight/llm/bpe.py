"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word is a row of symbols. The leaves of its tree hold ``rank * width +
place`` of every adjacent pair, so the root is the leftmost pair of the lowest
rank. A merge changes three leaves, and each change climbs ``log2(width)``
levels; a word is done when its root is empty. Words of one width share arrays,
so one step merges a pair in each of thousands of words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.packed import chunks
from sievelight.sources.jobs import ship_package

NONE = np.iinfo(np.int64).max
CACHE_WORDS = 300_000
TREE_CELLS = 1 << 20

# The vocabulary's splitting rule, and white space as Unicode defines it.
SPACES = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{SPACES}\\p{{L}}\\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file whose words end in a suffix."""

    def __init__(self, text: str) -> None:
        told = json.loads(text)
        model = told["model"]
        ids = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = dict(map(reversed, ids.items())) | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(self.tokens) + 1
        keys = np.array([ids[a] * self.base + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(order, 0)
        self.merged = np.append(np.array([ids[a + b] for a, b in pairs], np.int64), 0)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1 where it never merges."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            step = max(1, TREE_CELLS // width)
            for k in range(0, len(members), step):
                part = members[k: k + step]
                for i, ids in zip(part, self._encode([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _encode(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n, length = len(words), np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        alive = place < length[:, None]
        symbol = np.where(place == length[:, None] - 1, self.final[raw], self.inner[raw])
        after = np.where(place < length[:, None] - 1, place + 1, width) + np.zeros((n, 1), np.int64)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        ranks = self.rank(symbol[:, :-1], symbol[:, 1:])
        tree[:, width: 2 * width - 1] = np.where((ranks >= 0) & alive[:, 1:], ranks * width + place[:-1], NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level: 2 * level: 2], tree[:, level + 1: 2 * level: 2])
            level = half
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            symbol[rows, at] = self.merged[rank]
            alive[rows, gone] = False
            follow = after[rows, gone]
            after[rows, at] = follow
            r, f, a = rows[has := follow < width], follow[has := follow < width], at[has]
            before[r, f] = a
            self._set(tree, rows, gone, np.full(len(rows), NONE), width)
            self._set(tree, rows, at, self._leaf(symbol, rows, at, follow, width), width)
            prior = before[rows, at]
            has = prior >= 0
            r, p, a = rows[has], prior[has], at[has]
            self._set(tree, r, p, self._leaf(symbol, r, p, a, width), width)
            rows = rows[tree[rows, 1] != NONE]
        return np.split(symbol[alive], np.cumsum(alive.sum(1))[:-1])

    def _leaf(self, symbol, rows, left, right, width):
        rank = self.rank(symbol[rows, left], symbol[rows, np.minimum(right, width - 1)])
        return np.where((rank >= 0) & (right < width), rank * width + left, NONE)

    @staticmethod
    def _set(tree, rows, leaf, value, width):
        node = leaf + width
        tree[rows, node] = value
        for _ in range(width.bit_length() - 1):
            value = np.minimum(tree[rows, node], tree[rows, node ^ 1])
            node = node >> 1
            tree[rows, node] = value

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, and the special tokens between them with their ids."""
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part:
                yield part, self.special.get(part)

    def words_of(self, text: str) -> list[str | int]:
        """Words to merge and ids of special tokens, in order."""
        out: list[str | int] = []
        for part, special in self.pieces(text):
            if special is not None:
                out.append(special)
                continue
            # Lower-casing goes character by character: a final sigma has no form of its own.
            out += WORDS.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """A vocabulary with a bounded memory of encoded words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.vocabulary.words_of(t) for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [w for w in set().union(*split) if w not in known]
        plain = [w for w in new if isinstance(w, str)]
        encoded = self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in plain])
        known.update({w: ids.astype("<u4").tobytes() for w, ids in zip(plain, encoded, strict=True)})
        known.update({w: int(w).to_bytes(4, "little") for w in new if not isinstance(w, str)})
        return [b"".join(map(known.__getitem__, words)) for words in split]


_encoders: dict[int, Encoder] = {}


def _encoder(broadcast) -> Encoder:
    # One per worker process, so that later tasks find the words of earlier ones.
    if broadcast.value[0] not in _encoders:
        _encoders.clear()
        _encoders[broadcast.value[0]] = Encoder(Vocabulary(broadcast.value[1]))
    return _encoders[broadcast.value[0]]


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
           decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (little-endian unsigned 32-bit integers), and with ``decoded`` if asked for.

    ``vocabulary`` is the path of the file on the driver; its text (a fixed
    size) is broadcast. A null text counts as empty and has no ids. Null ids,
    repeated rows, ties and other columns change nothing: each row stands alone.
    """
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    shared = df.sparkSession.sparkContext.broadcast((hash(text), text))
    ship_package(df.sparkSession)
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in chunks(batches):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column("id"), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([encoder.vocabulary.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    out = rows.mapInArrow(run, f"id {id_type}, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_column)


def decode(df: DataFrame, vocabulary: str, ids_column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give null, an id outside the vocabulary is an error."""
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    shared = df.sparkSession.sparkContext.broadcast((hash(text), text))

    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def run(column):
        vocabulary = _encoder(shared).vocabulary
        return column.map(lambda x: None if x is None else vocabulary.decode(np.frombuffer(x, "<u4").tolist()))

    return df.withColumn(decoded, run(F.col(ids_column)))
