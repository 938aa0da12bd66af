"""The main text of web pages.

Markup is read into blocks of text. Elements that never hold an article (menus, sidebars, footers, forms, scripts,
adverts, notices, reader comments ...) are left out by their names, classes and roles. Classes, roles and forms are hints only:
where they leave no article and hardly a word, the largest element they took away is read after all, hints inside it still
counting, and if that has no text either, the page is read without hints. What stands inside
``article`` is the marked article, or all of ``main`` where that holds most of its words outside articles. All blocks of a page go
into its token stream, and the streams of a host are searched for long strings that occur on different pages
(:mod:`tabscope.llm.suffix`). Blocks that such strings cover are boilerplate, and the unique ones are the main text. As
articles may well repeat each other, a covered block of a marked article is looked at once more: paragraphs, headings, list items
and cells stay, as articles share them; any other (``div``, bare text) goes if it stands at the same end of every article that
repeats it, next to several different blocks, as share lines and author boxes do. Pages with the
same stream count as one page, and articles without a block of their own are no evidence, so copies of a page do not speak against it.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import batch_of, drop_tables, list_array, map_batches, per_process, stored
from tabscope.llm.suffix import repeated_ranges, spans
from tabscope.llm.url_filter import url_host

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a repeated string, and of the pieces that it is found by.
LENGTH, GRAM = 12, 5
#: A block is boilerplate if repeated strings cover this share of its tokens.
COVERED = 0.5
#: A repeated block inside marked articles is boilerplate if it stands at the same end of all of them, next to at least so
#: many different blocks that do not repeat.
NEIGHBOURS = 4
#: Bytes of a token's hash; strings of ``LENGTH`` of them are compared.
_TOKEN = 4

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>|<[!?][^>]*>""", re.DOTALL
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z0-9]+")
_RAW = ("script", "style")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe menu nav noscript object option script select style svg"
    " template textarea title video".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = ("article", "main")
#: Blocks that carry the text of an article.
_PROSE = frozenset("blockquote caption dd dt figcaption legend li p pre summary td th".split()) | _HEADING
#: Elements that are left out by hints only, as those with marks in their attributes are.
_HINTED = frozenset({"form"})
#: Parts of class names and ids that mark what is no article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices notification alert newsletter subscribe subscription signup menu nav navbar navigation breadcrumb"
    " breadcrumbs sidebar footer masthead topbar toolbar share sharing social comment comments disqus reply replies respond"
    " related recommended popup modal overlay widget pagination pager login search hidden".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


def _marked(attributes: str, inside: bool) -> bool:
    """Whether an element's attributes hint that it holds no article text."""
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            parts = set(_PARTS.findall(value))
            if parts & _MARKS or (not inside and "header" in parts):
                return True
    return False


def _hidden(attributes: str) -> bool:
    """Whether an element is not shown."""
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


#: Where a block stands: in a marked article, in an element that holds none, or neither.
INSIDE, NEVER, OUTSIDE = "inside", "never", "outside"
#: Where else while a page is read: in ``main`` outside any article, or left out by a hint.
_MAIN, _HINT = "main", "hint"


def _words(found: list[tuple[str, str, bool]], *kinds: str) -> int:
    return sum(text.count(" ") + 1 for where, text, _ in found if where in kinds)


def blocks(page: str) -> list[tuple[str, str, bool]]:
    """``(where, text, prose)`` for each block of text, in page order; ``prose`` if it stands in a paragraph, heading or the like."""
    taken: list[tuple[int, int]] = []
    found = _read(page, taken=taken)
    if taken and not _words(found, INSIDE, _MAIN) and _words(found, OUTSIDE) < min(LENGTH, max(taken)[0]):
        found = _read(page, opened=max(taken)[1])
        if not _words(found, INSIDE, _MAIN, OUTSIDE):
            found = _read(page, hints=False)
    main = INSIDE if _words(found, _MAIN) > _words(found, INSIDE) else OUTSIDE
    names = {_MAIN: main, _HINT: NEVER}
    return [(names.get(where, where), text, prose) for where, text, prose in found]


def _read(page: str, hints: bool = True, opened: int = -1, taken: list[tuple[int, int]] | None = None) -> list[tuple[str, str, bool]]:
    """Blocks by markup; without ``hints`` only the names of elements leave something out.

    The element at ``opened`` is read in spite of its hints. ``taken`` collects words and place of those left out by hints.
    """
    out: list[tuple[str, str, bool]] = []
    pieces: list[str] = []
    left_out: list[str] = []
    inside = article = 0  # open article and main elements, articles among them
    header = 0  # open header elements inside them: of those only headings count
    heading = prose = False
    skipped, depth = "", 0  # the element that is left out just now, and how many of its name are open
    reason, since = NEVER, 0  # whether its name or a hint leaves it out, and where it begins
    at, end = 0, len(page)

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((INSIDE if article else _MAIN if inside else OUTSIDE, text, prose))
            pieces.clear()

    def leave_out(where: str) -> None:
        text = " ".join(html.unescape(" ".join(left_out)).split())
        if text:
            out.append((where, text, False))
            if where == _HINT and taken is not None:
                taken.append((text.count(" ") + 1, since))
        left_out.clear()

    while at < end:
        found = _MARKUP.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            text = page[at:stop]
            if not found and (cut := text.rfind("<")) >= 0 and re.match(r"</?[a-zA-Z!?]", text[cut:]):
                text = text[:cut]  # the page ends inside a tag
            if skipped or (header and not heading):
                left_out.append(text)
            else:
                pieces.append(text)
        if not found:
            break
        at = found.end()
        closing, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            continue
        name = name.lower()
        if skipped:
            if name == skipped:
                if closing:
                    depth -= 1
                elif name in ("p", "li"):
                    depth = 0  # the next one ends it
                elif not attributes.endswith("/"):
                    depth += 1
            elif (
                (name == "body" and skipped == "head")
                or (skipped == "p" and name in _BLOCK)
                or (not closing and name in _ARTICLE and not _hidden(attributes) and not (hints and _marked(attributes, True)))
            ):
                depth = 0
            if depth > 0:
                if name in _RAW and not closing:
                    at = _behind(page, name, at)
                continue
            skipped = ""
            leave_out(reason)
            if closing:
                continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in _BLOCK or name in _NEVER:
            close()
            prose = name in _PROSE and not closing
        if closing:
            if name in _ARTICLE:
                inside = max(0, inside - 1)
                if name == "article":
                    article = max(0, article - 1)
            elif name == "header":
                header = max(0, header - 1)
            elif name in _HEADING:
                heading = False
            continue
        if name in _RAW:
            at = _behind(page, name, at)
        elif name in _VOID or attributes.endswith("/"):
            continue
        elif (
            (name in _NEVER and name not in _HINTED)
            or (name == "header" and not inside)
            or (attributes and name not in ("html", "body", *_HEADING) and _hidden(attributes))
        ):
            close()
            skipped, depth, reason = name, 1, NEVER
        elif (
            hints
            and found.start() != opened
            and (name in _HINTED or (attributes and name not in ("html", "body", *_HEADING) and _marked(attributes, inside > 0)))
        ):
            close()
            skipped, depth, reason, since = name, 1, _HINT, found.start()
        elif name in _ARTICLE:
            inside += 1
            article += name == "article"
        elif name == "header":
            header += 1
        elif name in _HEADING:
            heading = True
    close()
    leave_out(reason if skipped else NEVER)
    return out


def _behind(page: str, name: str, at: int) -> int:
    """Behind the end tag of a raw-text element."""
    found = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
    return found.end() if found else len(page)


#: Tokens whose hashes a worker remembers.
_REMEMBERED = 1 << 17


class _Hashes(dict):
    """Hashes of tokens, each computed once until there are too many of them."""

    def __missing__(self, token: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[token] = out = xxhash.xxh64_digest(token.encode("utf-8", "replace"))[:_TOKEN]
        return out


def _tokens(texts: list[list[str]]) -> bytes:
    known = per_process("html-tokens", _Hashes)
    return b"".join([known[w] for t in texts for w in t])


def _parsed(page: str | None) -> tuple[list[tuple[bool, str, bool]], bool, bytes, int]:
    """Blocks, whether they could be main text and are prose; whether the page marks an article; its stream; a name for all that."""
    found = blocks(page) if page else []
    marked = any(where == INSIDE for where, _, _ in found)
    wanted = INSIDE if marked else OUTSIDE
    parts = [(where == wanted, text, prose) for where, text, prose in found]
    texts = [text.split() for _, text, _ in parts]
    stream = _tokens(texts)
    layout = repr([(here, len(words), prose) for (here, _, prose), words in zip(parts, texts, strict=True)]).encode()
    return parts, marked, stream, xxhash.xxh64_intdigest(stream + layout) - (1 << 63)


_LAYOUT = "array<struct<tokens: int, name: bigint, here: boolean, prose: boolean>>"


def _rows_of(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select("page_id", url.alias("url"), F.xxhash64(url_host(url)).alias("seed"), F.col("html").cast("string").alias("html"))


def read_pages(pages: DataFrame) -> DataFrame:
    """``(seed, page, marked, layout, stream)`` for every page: a name for its host and for its content, whether it marks an
    article, its blocks in order (tokens, a hash of the text, whether it could be main text and is prose), and a hash of each token of all blocks."""
    kinds = pa.list_(pa.struct([("tokens", pa.int32()), ("name", pa.int64()), ("here", pa.bool_()), ("prose", pa.bool_())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                names, marks, layouts, streams = [], [], [], []
                for page in part.column(1).to_pylist():
                    parts, marked, stream, name = _parsed(page)
                    names.append(name)
                    marks.append(marked)
                    layouts.append([(t.count(" ") + 1, xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63), h, p) for h, t, p in parts])
                    streams.append(stream)
                yield batch_of(
                    seed=part.column(0),
                    page=pa.array(names, pa.int64()),
                    marked=pa.array(marks, pa.bool_()),
                    layout=pa.array(layouts, kinds),
                    stream=list_array(np.frombuffer(b"".join(streams), np.int32), np.cumsum([0, *map(len, streams)]) // _TOKEN, pa.int32()),
                )

    rows = _rows_of(pages).select("seed", "html")
    return map_batches(rows, work, f"seed bigint, page bigint, marked boolean, layout {_LAYOUT}, stream array<int>")


def _covered(layout: list[dict], ranges: list[dict] | None) -> list[bool]:
    """Which blocks repeated strings cover."""
    ends = np.cumsum([b["tokens"] for b in layout])
    flags = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    for start, end in spans(ranges, len(flags) - 1):
        flags[start + 1 : end + 1] = 1
    total = np.cumsum(flags)
    return [bool(total[e] - total[e - b["tokens"]] >= COVERED * b["tokens"]) for b, e in zip(layout, ends.tolist(), strict=True)]


#: Where a covered block stands in a marked article.
_AMID, _FIRST, _LAST = 0, 1, 2
_FOUND = "seed bigint, page bigint, block int, name bigint, side int, beside bigint"


def _judged(pages: DataFrame) -> DataFrame:
    """One row for each covered block that could go: in a marked article, if it is no prose, with its ``side`` and the
    nearest block that is not covered, else without."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for seed, page, marked, layout, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flags = _covered(layout, ranges)
                here = [i for i, b in enumerate(layout) if b["here"]]
                free = [i for i in here if not flags[i]]
                for i in here:
                    if not flags[i]:
                        continue
                    side, beside = None, None
                    if marked and (not free or layout[i]["prose"]):
                        continue  # a page with nothing of its own is a copy, no evidence
                    if marked:
                        side = _FIRST if i < free[0] else _LAST if i > free[-1] else _AMID
                        beside = layout[free[0] if side == _FIRST else free[-1]]["name"]
                    out.append((seed, page, i, layout[i]["name"], side, beside))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return map_batches(pages.select("seed", "page", "marked", "layout", "ranges"), work, _FOUND)


def boilerplate(pages: DataFrame) -> DataFrame:
    """``(seed, page, blocks)``: numbers of the blocks that go, for each different page of a host that has any."""
    # Tokens follow a steep distribution: with a dictionary they take half the room of their hashes.
    read = stored(read_pages(pages), "pages", compression="zstd", **{"parquet.dictionary.page.size": str(4 << 20)})
    name = F.xxhash64("stream").alias("id")
    rows = read.filter(F.size("stream") >= LENGTH).select(name, F.xxhash64(F.lit("alt"), "stream").alias("alt"), "seed", F.col("stream").alias("data"))
    ranges = repeated_ranges(rows, LENGTH, GRAM, _TOKEN, distinct=True)
    ranges = ranges.groupBy("id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    each = read.select(name, "seed", "page", "marked", "layout").dropDuplicates(["seed", "page"])
    covered = stored(_judged(each.join(ranges, "id")), "covered")
    drop_tables(read)
    # The exact look at what repeats inside marked articles, which do share paragraphs.
    fixtures = covered.groupBy("seed", "name").agg(
        F.min("side").alias("low"), F.max("side").alias("high"), F.count_distinct("beside").alias("n")
    )
    fixtures = stored(fixtures.filter(f"low = high AND low <> {_AMID} AND n >= {NEIGHBOURS}").select("seed", "name"), "fixtures")
    gone = covered.filter("side is null").unionByName(covered.filter("side is not null").join(fixtures, ["seed", "name"], "left_semi"), True)
    return stored(gone.groupBy("seed", "page").agg(F.collect_set("block").alias("blocks")), "boilerplate")


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    Blocks are trimmed, have single spaces and are joined by one. NULL or empty pages have an empty text; repeated rows
    are pages of their own but count once when pages of a host are compared; a NULL url is a host of its own; an empty table
    gives an empty one. Pages are read twice, for their streams and for their texts, so no text is stored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                names, texts = [], []
                for page in part.column(3).to_pylist():
                    parts, _, _, name = _parsed(page)
                    names.append(name)
                    texts.append([t if here else None for here, t, _ in parts])
                yield batch_of(
                    page_id=part.column(0),
                    url=part.column(1),
                    seed=part.column(2),
                    page=pa.array(names, pa.int64()),
                    texts=pa.array(texts, pa.list_(pa.string())),
                )

    read = map_batches(_rows_of(pages), work, f"page_id {kind}, url string, seed bigint, page bigint, texts array<string>")
    both = read.join(boilerplate(pages), ["seed", "page"], "left")
    gone = F.coalesce("blocks", F.array().cast("array<int>"))
    kept = F.filter("texts", lambda text, i: ~F.array_contains(gone, i))  # joined without the blocks that are NULL
    return both.select("page_id", "url", F.array_join(kept, " ").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
