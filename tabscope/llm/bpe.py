"""Byte-level BPE, encoded by dynamic programming over prefixes, and decoded.

The greedy merging of BPE has a property that makes it a dynamic programme: of all tokens that end a prefix of a
word, exactly one can be the last token of that prefix's encoding, namely the one that merging would keep beside
the last token of what is before it. An automaton over the vocabulary finds all tokens ending at each byte; a
pair test, which undoes the merges of both neighbours in reverse order and looks for one that merging would have
preferred across their border, picks the right one; following the stored last tokens from the end gives the ids.

Words are found by the fixed pattern of byte-level BPE. Ids of words seen before are kept in each Python worker,
up to a bound.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import batch_of, map_batches, per_process, small_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: how byte-level BPE splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that ``regex`` and the tokenizers library put into the same classes; texts with others are split by the library.
_AGREED = regex.compile("[^\\x00-\\u0557\\u1000-\\u207f]")
_KEPT_WORDS, _KEPT_SIZE, _KEPT_PAIRS = 400_000, 48, 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens and merges of a ``tokenizer.json`` with byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.ids: dict[str, int] = model["vocab"]  # by letters
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in self.ids.items()}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        # rank of merging two neighbours, and for each merged token what it came from
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((left, right), rank)
            self.parts.setdefault(whole, (left, right, rank))
        self._fits: dict[tuple[int, int], bool] = {}
        self._sound: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(letters)})

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends with just these two side by side."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= _KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Going back in time: of the last token left of the border and the first one right of it, undo the younger.
        # Any pair that met at the border could have merged there; it did if its rank is below that of what came next.
        next_rank = len(self.rank) + 1
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < next_rank:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # At equal ranks merging goes from left to right, so the right one is the younger.
            if b is None or (a is not None and a[2] > b[2]):
                next_rank, left = a[2], a[1]
            else:
                # the border pair of equal rank stands further left, so it would have come first
                next_rank, right = b[2] + 1, b[0]

    def sound(self, token: int) -> bool:
        """Whether merging a token's own bytes gives that token."""
        known = self._sound.get(token)
        if known is None:
            parts = self.parts.get(token)
            if parts is None:
                known = len(self.bytes_of[token]) == 1
            else:
                left, right, rank = parts
                known = self.sound(left) and self.sound(right) and self._border_until(left, right, rank)
            self._sound[token] = known
        return known

    def _border_until(self, left: int, right: int, rank: int) -> bool:
        """Whether no merge across the border comes before the one of ``left`` and ``right`` themselves."""
        a, b = self.parts.get(left), self.parts.get(right)
        if (a is not None and a[2] > rank) or (b is not None and b[2] > rank):
            return False
        next_rank = rank
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < next_rank:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                next_rank, left = a[2], a[1]
            else:
                next_rank, right = b[2] + 1, b[0]

    def encode_word(self, letters: str) -> list[int]:
        """Ids of one word, given in letters for bytes."""
        whole = self.ids.get(letters)
        if whole is not None and self.sound(whole):
            return [whole]
        size = len(letters)
        last: list[int] = [-1] * (size + 1)  # the last token of each prefix
        length = [0] * (size + 1)
        for end, (token, width) in self.automaton.iter(letters):
            end += 1
            if last[end] >= 0:
                continue
            start = end - width
            if (start == 0 or (last[start] >= 0 and self.fits(last[start], token))) and self.sound(token):
                last[end], length[end] = token, width
        out, at = [], size
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks single bytes")
            out.append(last[at])
            at -= length[at]
        return out[::-1]


class Encoder(dict):
    """Ids of words as little-endian bytes, by the word; words not seen yet are encoded."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.vocabulary = Vocabulary(path)
        self._find = regex.compile(WORDS).findall
        self._library = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.special = special
        top = max(self.vocabulary.bytes_of) + 1
        tokens = [self.vocabulary.bytes_of.get(i, b"") for i in range(top)]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)

    def __missing__(self, word: str) -> bytes:
        letters = word.encode("utf-8").decode("latin-1").translate(self.vocabulary.table)
        ids = np.array(self.vocabulary.encode_word(letters), "<i4").tobytes()
        if len(self) >= _KEPT_WORDS:
            self.clear()
        if len(word) <= _KEPT_SIZE:
            self[word] = ids
        return ids

    def find(self, text: str) -> list[str]:
        """The words of ``text``; together they are all of it."""
        if text.isascii() or not _AGREED.search(text):
            return self._find(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        if self.split and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.split(text)):
                if i % 2:
                    out.append(np.array([self.vocabulary.special[part]], "<i4").tobytes())
                else:
                    out.extend(map(self.__getitem__, self.find(part)))
            return b"".join(out)
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)
        return self.joined[at], ends


def encoder(path: str) -> Encoder:
    return per_process(f"bpe-{path}", lambda: Encoder(path), large=True)


def _list_batch(key: pa.Array, pieces: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(p) // 4 for p in pieces)]).astype(np.int32)
    ids = pa.array(np.frombuffer(b"".join(pieces), "<i4"), pa.int32())
    return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["key", "ids"])


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` for every row: token ids of the whole text; NULL and empty texts have no ids.

    ``path`` names a ``tokenizer.json`` that every executor can open. Strings of its special tokens get their ids.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for batch in batches:
            for part in small_parts(batch, 1):
                yield _list_batch(part.column(0), [made.encode(t) if t else b"" for t in part.column(1).to_pylist()])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, work, f"key {kind}, ids array<int>", large=True).withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``(key, ids, text)``: the text that token ids stand for; bytes that are no UTF-8 become U+FFFD."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for batch in batches:
            for part in small_parts(batch, 1):
                lists = part.column(1)
                bounds = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)
                texts = []
                for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                    raw, _ = made.decode_bytes(values[start:end])
                    texts.append(raw.tobytes().decode("utf-8", "replace"))
                yield batch_of(key=part.column(0), ids=lists, text=pa.array(texts, pa.string()))

    wanted = rows.select(F.col(key).alias("key"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    kind = wanted.schema["key"].dataType.simpleString()
    return map_batches(wanted, work, f"key {kind}, ids array<int>, text string", large=True).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` from ids and the text decoded from them.

    Rows stand alone: NULL and empty texts have no tokens and the digests of an empty string, repeated rows and NULL ids
    give a row each, an empty table gives an empty one, further columns are not read.
    """
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
