"""Which tokens of one tokenizer stand for the same bytes as which tokens of another.

Both tokenizers cut the same bytes, a space and the text. Their tokens are intervals: sorted by start, with a running
maximum of the ends, they fall into groups wherever a token starts at (or after) the maximum of all before it, which is
where tokens of both end at the same byte. Inside a group every token overlaps a token of the other side; these overlaps
are expanded to pairs, and the pairs that end together are the links.

Neither tokenizer joins anything across the place between a character that is no white space and white space, so a text
is taken in segments cut there, and each Python worker keeps, up to a bound, what segments seen before gave.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.bpe import _AGREED as AGREED
from tabscope.llm.bpe import WORDS, byte_letters
from tabscope.llm.common import batch_of, map_batches, per_process, small_parts, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the white space of Unicode.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_JOINED = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_IS_SPACE = re.compile(f"[{_SPACE}]").match
_MARK = "▁"
_KEPT_SEGMENTS, _KEPT_SIZE = 200_000, 48
#: Segments that are taken apart in one go, and characters above which one is left to the tokenizers library alone.
_TOGETHER, _LONG = 20_000, 10_000


def coalesce(starts: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The group (0, 1, …) of every interval, and of the pairs of overlapping ones their two places.

    The ``first`` intervals at the front are of one side, the others of the other; each side lies end to end in order.
    Returns ``(groups, pairs)``, ``pairs`` with one row for the place on the first side and one for that on the second.
    """
    side = (np.arange(len(starts)) >= first).view(np.int8)
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(breaks) - 1
    # Overlaps: those of the other side that end after a token's start and start before its end.
    low = np.searchsorted(ends[first:], starts[:first], "right")
    high = np.searchsorted(starts[first:], ends[:first], "left")
    counts = high - low
    begin = np.cumsum(counts) - counts
    left = np.repeat(np.arange(first), counts)
    right = np.arange(len(left)) - np.repeat(begin, counts) + np.repeat(low, counts)
    return groups, np.stack([left, right])


class Aligner(dict):
    """By segment: counts of tokens and groups, the groups as text, the links as bytes; None if bytes are not kept."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        super().__init__()
        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(byte_letters())}
        entries = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
        self.library = tokenizers.Tokenizer.from_file(byte_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.byte_tokens = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.byte_tokens[i] = token
        # Where ids rank tokens as the merges do, tiktoken merges alike.
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        ranked = made == sorted(set(made)) and set(range(256)) == {entries[bytes([b])] for b in range(256)} and made[:1] == [256]
        entries = {t: i for t, i in entries.items() if i < 256 + len(made)}
        self.quick = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=entries, special_tokens={}) if ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.n_pieces = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(self.n_pieces)]
        # A segment is a run of white space and the run of other characters that follows; it goes on over white space that
        # some piece holds after another character.
        inner = {c for n in names for c in _JOINED.findall(n.replace(_MARK, " "))}
        more = f"(?:[{re.escape(''.join(sorted(inner)))}][{_SPACE}]*[^{_SPACE}]*)*" if inner else ""
        #: ``" " + text`` in segments that both tokenizers take apart on their own.
        self.segments = re.compile(f"[{_SPACE}]+[^{_SPACE}]*{more}").findall
        self.piece_tokens = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(_MARK, " ").encode() for i, n in enumerate(names)]
        self.byte_sizes = np.array([len(t) for t in self.byte_tokens], np.int64)
        self.piece_sizes = np.array([len(t) for t in self.piece_tokens], np.int64)
        self.kind = link_kind(len(self.byte_tokens), self.n_pieces)
        top = max(len(self.byte_tokens), self.n_pieces)
        self.digits = [np.array([f"{i}{end}".encode() for i in range(top)], object) for end in ",|;"]

    def _byte_ids(self, text: str) -> list[int]:
        if self.quick and len(text) <= _LONG and (text.isascii() or not AGREED.search(text)):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def missing(self, new: list[str]) -> dict[str, tuple | None]:
        """What all segments of ``new`` give."""
        out: dict[str, tuple | None] = {}
        plain, alone = [], []
        for s in new:
            easy = not _IS_SPACE(s[-1]) and len(s) <= _KEPT_SIZE and (s.isascii() or not AGREED.search(s))
            (plain if easy else alone).append(s)
        # Segments that end in other characters can follow each other without a change to any of them.
        for i in range(0, len(plain), _TOGETHER):
            some = plain[i : i + _TOGETHER]
            joined = " x" + "".join(some)
            a = np.array(self.quick.encode_ordinary(joined) if self.quick else self.library.encode(joined, add_special_tokens=False).ids, np.int64)
            out |= self._aligned(some, a, np.array(self.pieces.encode(joined[1:]), np.int64), joined.encode("utf-8"), 2)
        for s in alone:
            out |= self._alone(s)
        return out

    def _alone(self, s: str) -> dict[str, tuple | None]:
        joined = " x" + s
        a, b = np.array(self._byte_ids(joined), np.int64), np.array(self.pieces.encode(joined[1:]), np.int64)
        return self._aligned([s], a, b, joined.encode("utf-8"), 2)

    def _aligned(self, some: list[str], a: np.ndarray, b: np.ndarray, raw: bytes, skipped: int) -> dict[str, tuple | None]:
        """What each of ``some`` gives, from the tokens ``a`` and ``b`` of all of them joined, after ``skipped`` bytes of no segment."""
        kept = [b"".join(map(tokens.__getitem__, ids.tolist())) == raw for tokens, ids in ((self.byte_tokens, a), (self.piece_tokens, b))]
        if not all(kept):
            if len(some) == 1:
                return {some[0]: None}
            return {k: v for s in some for k, v in self._alone(s).items()}
        end_a, end_b = np.cumsum(self.byte_sizes[a]), np.cumsum(self.piece_sizes[b])
        ends = np.concatenate([end_a, end_b])
        starts = np.concatenate([[0], end_a[:-1], [0], end_b[:-1]])
        groups, (left, right) = coalesce(starts, ends, len(a))
        linked = end_a[left] == end_b[right]
        left, right = left[linked], right[linked]
        links = (a[left] * self.n_pieces + b[right]).astype(self.kind)
        # Groups as text: ids of the first side, then of the second, each with the sign that follows it.
        ga, gb = groups[: len(a)], groups[len(a) :]
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        comma, bar, stop = self.digits
        words = np.concatenate([comma[a], comma[b]])
        words[np.flatnonzero(last_a)] = bar[a[last_a]]
        words[np.flatnonzero(last_b) + len(a)] = stop[b[last_b]]
        words = words[np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")].tolist()
        to = np.cumsum([skipped, *(len(s.encode("utf-8")) for s in some)])
        to_a, to_b = (np.searchsorted(e, to, "right") for e in (end_a, end_b))
        to_l = np.searchsorted(left, to_a).tolist()
        to_g = np.append(ga, ga[-1] + 1)[to_a].tolist()
        to_a, to_b = to_a.tolist(), to_b.tolist()
        out: dict[str, tuple | None] = {}
        for i, s in enumerate(some):
            text = b"".join(words[to_a[i] + to_b[i] : to_a[i + 1] + to_b[i + 1]])
            link = links[to_l[i] : to_l[i + 1]].tobytes()
            out[s] = (to_a[i + 1] - to_a[i], to_b[i + 1] - to_b[i], to_g[i + 1] - to_g[i], text, link)
        return out

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """For each text its counts of tokens and groups, its groups as text, and its links as bytes."""
        parts = [self.segments(" " + t) if t and _MARK not in t else [] for t in texts]
        used = {s for p in parts for s in p}
        found = self.missing([s for s in used if s not in self])
        if len(self) + len(found) > _KEPT_SEGMENTS:
            found |= {s: self[s] for s in used if s in self}
            self.clear()
        self.update([(s, f) for s, f in found.items() if len(s) <= _KEPT_SIZE][:_KEPT_SEGMENTS])
        for p in parts:
            got = [self[s] if s in self else found[s] for s in p]
            if not got or None in got:
                yield 0, 0, 0, b"", b""
                continue
            n_a, n_b, n_groups, groups, links = zip(*got, strict=True)
            yield sum(n_a), sum(n_b), sum(n_groups), b"".join(groups)[:-1], b"".join(links)


def link_kind(n_bytes: int, n_pieces: int) -> type:
    """The integer that holds ``a * n_pieces + b`` for every pair of ids."""
    return np.int32 if n_bytes * n_pieces < 1 << 31 else np.int64


def aligner(byte_path: str, piece_path: str) -> Aligner:
    return per_process(f"align-{byte_path}-{piece_path}", lambda: Aligner(byte_path, piece_path), large=True)


def align(docs: DataFrame, byte_path: str, piece_path: str, *, groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups_sha256, links)``, one row for each row of ``docs`` (``doc_id``, ``text``).

    A are the tokens of the byte-level vocabulary in ``byte_path`` (a ``tokenizer.json``) of a space and the text, with
    strings of special tokens as plain text; B those of the sentencepiece model in ``piece_path``, which adds the space
    itself. ``groups_sha256`` is the digest of the groups as ``a1,a2|b1;a3|b2,b3``; with ``groups`` that text is a column
    too. ``links`` holds ``a * (number of pieces) + b`` for every pair of tokens that end at the same byte, in order.

    NULL and empty texts, and texts that the joined tokens of either side do not give back, have zeros, an empty text in
    place of the digest and no links. Rows stand alone: repeated rows and NULL or repeated ids give a row each, an empty
    table gives an empty one, and further columns of ``docs`` are not read.
    """
    made = aligner(byte_path, piece_path)
    kind = "int" if made.kind is np.int32 else "bigint"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(byte_path, piece_path)
        for batch in batches:
            for part in small_parts(batch, 1):
                rows = list(made.align(part.column(1).to_pylist()))
                n_a, n_b, n_groups, texts, links = zip(*rows, strict=True)
                values = np.frombuffer(b"".join(links), made.kind)
                ends = np.cumsum([0, *(len(x) // values.itemsize for x in links)]).astype(np.int32)
                shown = {"groups": pa.array([t.decode() for t in texts], pa.string())} if groups else {}
                yield batch_of(
                    key=part.column(0),
                    n_a=pa.array(n_a, pa.int64()),
                    n_b=pa.array(n_b, pa.int64()),
                    n_groups=pa.array(n_groups, pa.int64()),
                    groups_sha256=pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string()),
                    links=pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    **shown,
                )

    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<{kind}>"
    schema += ", groups string" if groups else ""
    return map_batches(rows, work, schema, large=True).withColumnRenamed("key", "doc_id")


def link_counts(aligned: DataFrame, n_pieces: int) -> DataFrame:
    """``(link, a_id, b_id, n, best)``: how many links of all documents hold a pair, and whether no other pair of its B id has more.

    Of two tokens that end together one ends with the other's bytes, so there are no more pairs than suffixes of
    vocabulary entries that are entries of the other vocabulary: some hundred thousand, whatever the corpus.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            lists = batch.column(0)
            bounds = lists.offsets.to_numpy()
            new, n = np.unique(lists.values.to_numpy()[bounds[0] : bounds[-1]], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            old = np.zeros(len(keys), np.int64)
            np.add.at(old, back, np.concatenate([counts, n]))
            counts = old
        for i in range(0, len(keys), 100_000):
            yield batch_of(link=pa.array(keys[i : i + 100_000]), n=pa.array(counts[i : i + 100_000]))

    parts = map_batches(aligned.select("links"), work, "link bigint, n bigint")
    pairs = parts.groupBy("link").agg(F.sum("n").alias("n"))
    b_id = F.pmod("link", F.lit(n_pieces)).cast("int")
    pairs = pairs.select("link", F.floor(F.col("link") / n_pieces).cast("int").alias("a_id"), b_id.alias("b_id"), "n")
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` (links whose pair is its B id's most frequent) and ``count_sum`` (over links).

    ``counts`` is what :func:`link_counts` found in ``aligned``; it goes to every task (its docstring bounds it).
    """
    table = counts.select("link", "n", "best").toPandas().sort_values("link")
    sent = aligned.sparkSession.sparkContext.broadcast(
        (table["link"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(np.int64))
    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            at = np.searchsorted(keys, lists.values.to_numpy()[bounds[0] : bounds[-1]])
            bounds -= bounds[0]
            sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (best, n)] if len(keys) else [np.zeros(1, np.int64)] * 2
            found = [pa.array(s[bounds[1:]] - s[bounds[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(bounds)), *found], names=names)

    rest = [c for c in aligned.columns if c != "links"]
    names = [*rest, "n_links", "n_best", "count_sum"]
    kinds = [f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in rest]
    return map_batches(aligned.select(*rest, "links"), work, ", ".join([*kinds, "n_links bigint", "n_best bigint", "count_sum bigint"]))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """:func:`align` with the counts of :func:`score_links`; texts are taken apart once, their links stored in between."""
    aligned = stored(align(docs, byte_path, piece_path), "links")
    n_pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    return score_links(aligned, link_counts(aligned, n_pieces))
