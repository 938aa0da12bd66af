"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    parent = {i: i for i, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            common = len(a & b)
            if common and 100 * common >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def repeats(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Maximal spans covered by a string of ``length`` bytes that starts more than once."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans: list[tuple[int, int]] = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        out.append(spans)
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, b""
    for a, b in spans:
        out, at = out + data[at:a], b
    return out + data[at:]


def edit_distance(pattern: str, text: str) -> int:
    """Smallest distance of ``pattern`` to any part of ``text``."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before)


def backoff_scores(rows: list[tuple[int, str | None]], rare: float, backoff: float) -> dict[int, tuple[int, float]]:
    known = {i: words(t) for i, t in rows}
    counts = Counter(w for ws in known.values() for w in ws)
    total = sum(counts.values())
    vocabulary = {w for w, n in counts.items() if not rare or (n > 1 and n >= rare * total)}
    lines = {i: [b"<s> "] + [w if w in vocabulary else b"<?> " for w in ws] for i, ws in known.items()}
    one = Counter(w for line in lines.values() if len(line) > 1 for w in line)
    two = Counter(g for line in lines.values() for g in zip(line, line[1:], strict=False))
    out = {}
    for i, line in lines.items():
        pairs, score = Counter(zip(line, line[1:], strict=False)), 0.0
        for (v, w), n in pairs.items():
            others = two[v, w] - n
            if others:
                score += n * math.log(others / one[v])
            else:
                score += n * math.log(backoff * one[w] / total)
        out[i] = (len(line) - 1, score)
    return out


def article(page: str) -> str:
    """The text between article tags, for pages that mark blocks with p, h1 and br only."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))
    return " ".join(html.unescape(inner).split())


_M = (1 << 64) - 1


def mixed(x: int) -> int:
    """Shifts and odd factors of the 64-bit mixer, in Python numbers."""
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & _M
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & _M
    return x ^ x >> 32


def word_hash(word: bytes, codes: list[int]) -> int:
    """A polynomial over random numbers for bytes."""
    total, power = 0, 1
    for b in word:
        total, power = total + codes[b] * power, power * 0x9E3779B97F4A7C15
    return mixed((total + len(word) * 0xD6E8FEB86659FD93) & _M)


def imatch(rows: list[tuple[int | None, str | None]], codes: list[int], low: float, high: float, shares: list[float]):
    """Fingerprints as lists of 16-bit numbers, for any text: lexicon by counting, one subset after the other."""
    found = Counter(w for _, t in rows for w in {word_hash(w, codes) for w in set(words(t))})
    lexicon = {w for w, n in found.items() if n > 1 and low * len(rows) <= n <= max(2.0, high * len(rows))}

    def of(text: str) -> list[int]:
        mine = sorted({word_hash(w, codes) for w in set(words(text))} & lexicon)
        out = []
        for j, share in enumerate(shares):
            draw = 0x9E3779B97F4A7C15 * (j // 4 * 4 + 1) & _M
            drawn = [mixed(w ^ draw) for w in mine]
            inside = [d for d in drawn if (d >> 16 * (j % 4) & 0xFFFF) < int(share * 65536)]
            total = mixed(sum(mixed((w + place) & _M) for place, w in enumerate(inside)) & _M)
            out.append(total % 65535 + 1 if inside else 0)
        return out

    return of
