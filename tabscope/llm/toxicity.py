"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows typical of toxic text and one on windows typical of
ordinary text. A window is a word or its beginning (toxic words have many endings), written :data:`REPEATS` times, so
that knowing it already pays whatever its length. It speaks for toxicity if two lengths agree on it: the toxic
dictionary compresses it to no more bytes than its own windows, and to fewer than the ordinary dictionary does. A
text's distance is that of its most toxic window, found over the whole text.

Fitting uses at most ``max_rows`` labelled texts of each kind, the first by a hash of their id. Two thirds of them
choose the windows, the rest calibrate how many windows the toxic dictionary holds and the threshold on the
distance, where labelled texts left out of the sample count by weight. Windows are counted by the different neighbours
they stand between, so that copies of one text do not make its words typical. Words of one to three letters are no
windows: too few bytes for two lengths to tell anything but chance (on held-out rows 56 in place of 15 were wrongly rejected).
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import batch_of, map_batches, per_process, small_parts, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPEATS = 4
#: Letters of a word's beginnings that are windows, beside the whole word; shorter words are none.
BEGINNINGS = (4, 5, 6, 8)
_WORD = re.compile(r"[^\W_]+")
#: Sizes of the toxic dictionary, in windows, that calibration tries.
SIZES = (4, 8, 12, 16, 20, 24, 32, 48, 64, 96, 128)
#: How far, in standard deviations, a window's count in toxic text has to lie above the expected one.
TELLING = 4.0
ORDINARY_WINDOWS = 2000
#: The score at the threshold, and how steeply it rises there.
CUT, SLOPE = 0.3, 20.0
_KEPT_WINDOWS = 300_000


def _window(word: str) -> bytes:
    return ((word + " ") * REPEATS).encode("utf-8", "replace")


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _windows(word: str) -> set[str]:
    return {word, *(word[:n] for n in BEGINNINGS)} if len(word) >= BEGINNINGS[0] else set()


def _contexts(texts: Iterable[str]) -> Counter:
    """Between how many different pairs of neighbours the words of each window stand."""
    seen: set[tuple[str, str, str]] = set()
    for text in texts:
        words = ["", *_words(text), ""]
        seen.update(zip(words, words[1:], words[2:]))
    out: Counter = Counter()
    for word, n in Counter(word for _, word, _ in seen).items():
        for window in _windows(word):
            out[window] += n
    return out


def _dictionary(words: list[str], counts: Counter) -> bytes:
    """A zstandard dictionary for the windows of ``words``; those that training leaves out are put in front."""
    windows = sorted({_window(w) for w in words})
    samples = [_window(w) for w in words for _ in range(min(counts[w], 50))]
    samples.sort(key=lambda s: zlib.crc32(s))
    size = min(1 << 16, max(1024, 2 * sum(map(len, windows))))
    try:
        trained = zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        trained = b""
    # matches do not reach into the last bytes of a dictionary
    return b"".join(w for w in windows if w not in trained) + trained + b"\n" * 16


class ToxicityModel:
    """Both dictionaries and the calibrated threshold; without labels of both kinds all distances are 0."""

    def __init__(self, toxic: bytes = b"", ordinary: bytes = b"", own: list[str] | None = None) -> None:
        self.toxic, self.ordinary, self.threshold = toxic, ordinary, 1.0
        self._ready = None
        #: what a window that the toxic dictionary holds is compressed to, at most
        self.length = max((len(self._compressors()[0].compress(_window(w))) for w in own or ()), default=0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def _compressors(self) -> tuple:
        if self._ready is None:
            key = f"toxicity-{zlib.crc32(self.toxic)}-{zlib.crc32(self.ordinary)}-{len(self.toxic)}-{len(self.ordinary)}"
            self._ready = per_process(key, self._made, large=True)
        return self._ready

    def _made(self) -> tuple:
        made = [
            zstandard.ZstdCompressor(
                level=19,
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for d in (self.toxic, self.ordinary)
        ]
        return (*made, {})

    def distance(self, text: str | None) -> float:
        """Share of its bytes that the toxic dictionary saves on the most toxic window, beyond the ordinary one."""
        toxic, ordinary, kept = self._compressors()
        most = 0.0
        if not self.toxic:
            return most
        if len(kept) > _KEPT_WINDOWS:
            kept.clear()
        for word in _words(text):
            saved = kept.get(word)
            if saved is None:
                saved = 0.0
                for window in map(_window, _windows(word)):
                    size = len(toxic.compress(window))
                    if size <= self.length:
                        saved = max(saved, (len(ordinary.compress(window)) - size) * REPEATS / len(window))
                if len(word) < 64:
                    kept[word] = saved
            if saved > most:
                most = saved
        return most

    def score(self, distance: float) -> float:
        """0 to 1, :data:`CUT` at the threshold."""
        return 1 / (1 + math.exp(-SLOPE * (distance - self.threshold)) * (1 / CUT - 1))


def fit(sample: list[tuple[str, int]], ordinary_weight: float = 1.0) -> ToxicityModel:
    """A model from ``(text, toxic)`` pairs, the same for any order of them.

    An ordinary text of the sample stands for ``ordinary_weight`` times as many texts as a toxic one.
    """
    toxic = sorted({t for t, y in sample if y and t})
    ordinary = sorted({t for t, y in sample if not y and t} - set(toxic))
    if not toxic or not ordinary:
        return ToxicityModel()
    chosen = [[t for t in texts if zlib.crc32(t.encode("utf-8", "replace")) % 3] or texts for texts in (toxic, ordinary)]
    held = [(t, y) for texts, y in ((toxic, 1), (ordinary, 0)) for t in texts if not zlib.crc32(t.encode("utf-8", "replace")) % 3]
    words, counts = _typical(*chosen)
    tried: list[tuple[float, int, float]] = []
    usual = _dictionary(words[1], counts[1]) if words[1] else b""
    for size in SIZES:
        if tried and size > len(words[0]):
            break
        model = _model(words[0][:size], counts[0], usual)
        f1, threshold = _calibrated(model, held or [(t, 1) for t in toxic] + [(t, 0) for t in ordinary], ordinary_weight)
        tried.append((f1, size, threshold))
    good = [t for t in tried if t[0] >= max(tried)[0] - 0.002]
    _, size, threshold = good[len(good) // 2]  # the middle: neither too few windows to find all nor needless ones
    words, counts = _typical(toxic, ordinary)
    model = _model(words[0][:size], counts[0], _dictionary(words[1], counts[1]) if words[1] else b"")
    model.threshold = threshold
    return model


def _typical(toxic: list[str], ordinary: list[str]) -> tuple[tuple[list[str], list[str]], tuple[Counter, Counter]]:
    """Words more frequent in toxic text than chance allows, most telling first, and frequent words of ordinary text."""
    a, b = _contexts(toxic), _contexts(ordinary)
    share = sum(a.values()) / max(1, sum(b.values()))
    telling = {w: (n - (b[w] + 0.5) * share) / math.sqrt((b[w] + 0.5) * share) for w, n in a.items() if n >= 3}
    first = sorted((w for w, z in telling.items() if z >= TELLING), key=lambda w: (-telling[w], w))
    # a beginning that nearly always goes on the same way says no more than the longer window
    longer = {x for w in first for x in _windows(w) if x != w and a[w] >= 0.9 * a[x]}
    first = [w for w in first if w not in longer]
    second = sorted((w for w, n in b.items() if n >= 3 and n * share > a[w]), key=lambda w: (-b[w], w))
    return (first, second[:ORDINARY_WINDOWS]), (a, b)


def _model(windows: list[str], counts: Counter, ordinary: bytes) -> ToxicityModel:
    return ToxicityModel(_dictionary(windows, counts) if windows else b"", ordinary, windows)


def _calibrated(model: ToxicityModel, held: list[tuple[str, int]], ordinary_weight: float) -> tuple[float, float]:
    """Best F1 over ``held`` and the threshold that gives it, midway between the distances around it."""
    rows = sorted(((model.distance(t), y) for t, y in held), reverse=True)
    positives = sum(y for _, y in rows)
    best, right, wrong = (0.0, 1.0), 0, 0.0
    for i, (at, y) in enumerate(rows):
        right, wrong = right + y, wrong + (1 - y) * ordinary_weight
        below = rows[i + 1][0] if i + 1 < len(rows) else 0.0
        if below < at:
            best = max(best, (2 * right / (positives + right + wrong), (at + below) / 2))
    return best


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = 1000, max_chars: int = 20_000) -> ToxicityModel:
    """A model from at most ``max_rows`` labelled documents of each kind, of at most ``max_chars`` code points each.

    Both bounds hold for the sample alone; scoring sees all documents and whole texts. ``labels`` has
    ``(doc_id, toxic)``; rows with NULLs and ids with contradicting labels are left out.
    """
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most")
    )
    short = docs.filter(F.length("text") <= max_chars).select("doc_id").join(known, "doc_id")
    short = stored(short.select("doc_id", "toxic").distinct(), "labelled")
    sizes = {r["toxic"]: r["count"] for r in short.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    parts = [short.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for kind in (0, 1)]
    # At most 2 * max_rows ids: small enough to send to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("text", "toxic").collect()
    share = {kind: max(1.0, sizes.get(kind, 0) / max_rows) for kind in (0, 1)}
    return fit([(r["text"], r["toxic"]) for r in rows], share[0] / share[1])


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, distance, score, toxic)`` for every row; NULL and empty texts have distance 0.

    Rows stand alone: repeated rows score alike and stay, NULL ids stay, an empty table gives an empty one. ``doc_id`` is
    cast to bigint, further columns are not read.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.distance(t.as_py()) for t in batch.column(1)]
            scores = [model.score(d) for d in found]
            yield batch_of(
                doc_id=batch.column(0),
                distance=pa.array(found, pa.float64()),
                score=pa.array(scores, pa.float64()),
                toxic=pa.array([s >= CUT for s in scores], pa.bool_()),
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, "doc_id bigint, distance double, score double, toxic boolean", large=True)


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they were.

    A score equal to :data:`CUT` is rejected. Rows with NULL or empty texts stay, repeated rows go or stay together.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, batch.schema.get_field_index("text")):
                texts = part.column(part.schema.get_field_index("text"))
                yield part.filter(pa.array([model.score(model.distance(t.as_py())) < CUT for t in texts], pa.bool_()))

    return map_batches(docs, work, docs.schema, large=True)
