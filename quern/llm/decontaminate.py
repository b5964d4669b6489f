"""Benchmark decontamination by templates.

A text becomes a template: its words in lower case, but numbers, names and units
are replaced by typed placeholders.  A name is a word with one capital, its first
letter; where it opens a sentence, it is read both as a name and as a word; a unit is a word of `UNITS` after a
number.  Windows of ``window`` template tokens with at least ``literals``
words are hashed, and the documents' windows are joined with the benchmark's on the hash.
An item's windows with fewer words are hashed by their tokens as they are, without slots: they
lengthen runs, and where an item has no other windows, a share of them is a leak.

For a document and an item that meet, the slots are compared: each value of
the item has to stand for one value in the document, so "Ann has 3 pears, Ann eats 1" is found in
"Bob has 7 pears, Bob eats 2" but not in "Bob has 7 pears, Eve eats 2".  It holds the other way round too: a
name or unit of the document stands for one of the item's, so "Ann meets Bob" isn't found in "Zoe meets Zoe"; a number stands for
two at most, as numbers that are drawn anew coincide.  Windows
against the usual reading of a value don't count.  An item leaks into a document if the windows left
cover ``run`` tokens in a row, or ``share`` of the item's windows.  Where those of the whole document
don't, each occurrence is judged by its own usual readings, so variants of one question side by side are found.

The benchmark is a stated query set: it is cut into blocks of at most
``block_tokens`` tokens, so that what is broadcast is bounded, and each block
goes over all documents; nothing is shuffled.  `without_leaks` writes what is left every `CHAIN`
blocks, so that a task runs so many Python workers at most.  A block is sorted arrays of window hashes, 50 to 150
bytes a token, and the join a search in them.

Defined results
---------------
* null or empty texts: no windows, so no leaks;
* items shorter than the window: one window of their own length, which needs its words alone to be a third;
* items with too few words for any window: found by their tokens as they are, from ``literals`` tokens on;
* shorter ones with fewer than two words: never found;
* repeated documents or items: a row for each pair; null ids are kept;
* documents are compared whole; extra columns are kept by `without_leaks`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Words, numbers with their inner marks, single signs that are units, and what ends a sentence.
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d]\w*|[%$€£°]|[.!?\n]")
#: Units of measure and money.
UNITS = frozenset("% $ € £ ° mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hrs ms w kw v a hz mph kmh cents dollars euros pounds meters metres kilometers kilometres miles feet inches grams kilograms liters litres seconds minutes hours days weeks months years degrees percent".split())

_END, _WORD, _NUMBER, _TITLE, _UNIT = range(5)
#: Opening words are taken as names in turns of three: all 8 ways for windows with up to three of them.
TURN = 3
READINGS = range(1 << TURN)
#: The reading without any slots, for windows with too few words.
EXACT = 1 << TURN
#: Blocks that follow one another in a task before the documents left are written.
CHAIN = 8
_NUMBER_CODE, _NAME_CODE, _UNIT_CODE = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B))


@dataclass(frozen=True)
class Settings:
    window: int = 8
    literals: int = 4
    run: int = 13
    share: float = 0.6
    block_tokens: int = 500_000


class _Codes(dict):
    """Code of a token: a hash of its lower-case form with its kind in the lowest three bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        low = token.lower()
        if token in ".!?\n":
            kind = _END
        elif token[0].isdigit():
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        else:
            kind = _TITLE if token[0].isupper() and (token[1:].islower() or len(token) == 1) else _WORD
        h = int.from_bytes(blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[token] = code = (h & ~7) | kind
        return code


@dataclass
class Template:
    """Template tokens of several texts in a row."""

    codes: np.ndarray  # hash of the word or of the placeholder
    slot: np.ndarray  # whether it is a placeholder
    literal: np.ndarray  # hash of the token itself
    opens: np.ndarray  # whether it is a word with a capital that opens a sentence
    text: np.ndarray  # the text it belongs to

    def reading(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, slots and which opening words are names, in reading ``r`` of `READINGS`."""
        if r == EXACT:
            return self.literal, np.zeros(len(self.codes), bool), np.zeros(len(self.codes), bool)
        names = self.opens & (r >> (np.cumsum(self.opens) % TURN) & 1).astype(bool)
        return np.where(names, _NAME_CODE, self.codes), self.slot | names, names

    def windows(self, size: int, literals: int, r: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of that size in a reading, and which are inside one text, have enough words and are new in it."""
        n = len(self.codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        codes, slot, names = self.reading(r)
        h = np.full(n, size | (r == EXACT) << 32, np.uint64)
        for i in range(size):
            h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        words, named = np.cumsum(np.r_[0, ~slot]), np.cumsum(np.r_[0, names])
        inside = self.text[:n] == self.text[size - 1 :]
        if r == EXACT:
            return h, inside
        good = inside & (words[size:] - words[:-size] >= literals)
        return h, good & (named[size:] > named[:-size]) if r else good


def template(texts: list[str | None], codes: _Codes) -> Template:
    tokens: list[str] = []
    lengths = []
    for t in texts:
        before = len(tokens)
        tokens += TOKEN.findall(t or "")
        lengths.append(len(tokens) - before)
    c = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    text = np.repeat(np.arange(len(texts)), lengths)
    kind = (c & np.uint64(7)).astype(np.int8)
    new = np.r_[True, text[1:] != text[:-1]] if len(c) else np.zeros(0, bool)
    before = np.r_[_END, kind[:-1]] if len(c) else kind
    opens = (kind == _TITLE) & (new | (before == _END))
    name = (kind == _TITLE) & ~opens
    unit = (kind == _UNIT) & (before == _NUMBER) & ~new
    c = c | np.uint64(7)
    literal = c.copy()
    c[kind == _NUMBER], c[name], c[unit] = _NUMBER_CODE, _NAME_CODE, _UNIT_CODE
    stay = np.flatnonzero(kind != _END)
    return Template(c[stay], ((kind == _NUMBER) | name | unit)[stay], literal[stay], opens[stay], text[stay])


@dataclass
class Index:
    """The windows of one size, sorted by hash: hash, item, place in the item."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def of(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(number in ``h``, item, place) of the windows with the given hashes."""
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                yield int(i), int(self.item[j]), int(self.place[j])


@dataclass
class Items:
    """A block of the benchmark: the values of its tokens and its windows by hash."""

    ids: list[int | None]
    values: np.ndarray
    bounds: np.ndarray
    count: np.ndarray  # windows with enough words
    poor: np.ndarray  # windows with fewer
    by_size: dict[int, Index] = field(default_factory=dict)

    def of_which(self, item: int) -> int:
        """Windows of which a share has to be found: those with enough words, or the poor ones of an item without any."""
        return int(self.count[item] or self.poor[item])

    def length(self, item: int) -> int:
        return int(self.bounds[item + 1] - self.bounds[item])


def prepare(ids: list[int | None], texts: list[str | None], s: Settings) -> Items:
    t = template(texts, _Codes())
    n = len(ids)
    bounds = np.searchsorted(t.text, np.arange(n + 1))
    items = Items(ids, t.literal, bounds, np.zeros(n, np.int64), np.zeros(n, np.int64))
    size_of = np.minimum(np.diff(bounds), s.window)
    for size in np.unique(size_of[size_of > 0]).tolist():
        of_size = (size_of == size)[t.text[: max(0, len(t.codes) - size + 1)]]
        hashes, places, rich = [], [], None
        for r in READINGS:
            h, good = t.windows(size, _least(size, s), r)
            if r == 0:
                rich = good
                items.count += np.bincount(t.text[np.flatnonzero(good & of_size)], minlength=n)
            at = np.flatnonzero(good & of_size)
            hashes.append(h[at])
            places.append(at)
        if size >= s.literals:
            h, inside = t.windows(size, 0, EXACT)
            at = np.flatnonzero(inside & of_size & ~rich)
            items.poor += np.bincount(t.text[at], minlength=n)
            hashes.append(h[at])
            places.append(at)
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.lexsort((p, h))
        h, p = h[order], p[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])] if len(h) else np.zeros(0, bool)
        h, p = h[new], p[new]
        item = t.text[p]
        items.by_size[size] = Index(h, item.astype(np.int32), (p - bounds[item]).astype(np.int32))
    return items


def _least(size: int, s: Settings) -> int:
    return s.literals if size >= s.window else max(2, -(-size // 3))


def leaks(texts: list[str | None], items: Items, tables: dict, codes: _Codes, s: Settings) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, windows left, longest run in tokens, slots, slots with another value) of the leaks."""
    t = template(texts, codes)
    # The reading with the fewest names in which two windows meet.
    met: dict[tuple[int, int], dict[tuple[int, int, int], int]] = defaultdict(dict)
    for size, index in items.by_size.items():
        mask, table = tables[size]
        for r in (*sorted(READINGS, key=int.bit_count), EXACT):
            h, good = t.windows(size, _least(size, s), r)
            likely = np.flatnonzero(good & table[h & mask])
            for i, item, q in index.of(h[likely]):
                p = int(likely[i])
                met[int(t.text[p]), item].setdefault((p, q, size), r)
    slots = [t.reading(r)[1] for r in (*READINGS, EXACT)] if met else []
    out = []
    for (text, item), hits in met.items():
        best = _judged(hits, item, t, slots, items, s)
        if best is None and _may_leak(hits, item, items, s):
            best = max(filter(None, (_judged(part, item, t, slots, items, s) for part in _occurrences(hits, items.length(item)))), default=None)
        if best:
            out.append((text, item, *best))
    return out


def _may_leak(hits: dict[tuple[int, int, int], int], item: int, items: Items, s: Settings) -> bool:
    """Whether a part of the windows could be enough."""
    return len(hits) + s.window > s.run or len({q for _, q, _ in hits}) >= s.share * items.of_which(item)


def _occurrences(hits: dict[tuple[int, int, int], int], length: int) -> Iterator[dict[tuple[int, int, int], int]]:
    """The windows of each diagonal p - q alone, and with those less than half an item away, where values of more words shift the rest."""
    diagonals: dict[int, dict] = defaultdict(dict)
    for (p, q, size), r in hits.items():
        diagonals[p - q][p, q, size] = r
    order = sorted(diagonals)
    for d in order:
        yield diagonals[d]
        near = order[bisect_left(order, d - length // 2) : bisect_right(order, d + length // 2)]
        if len(near) > 1:
            yield {k: r for e in near for k, r in diagonals[e].items()}


def _judged(hits: dict[tuple[int, int, int], int], item: int, t: Template, slots: list[np.ndarray], items: Items, s: Settings) -> tuple[int, int, int, int] | None:
    """(windows left, longest run in tokens, slots, slots with another value) if that makes a leak."""
    first = int(items.bounds[item])
    asked = lambda q: int(items.values[first + q])
    here = lambda p: int(t.literal[p])
    readings: dict[int, Counter] = defaultdict(Counter)
    pairs = {(p + j, q + j) for (p, q, size), r in hits.items() for j in range(size) if slots[r][p + j]}
    for p, q in sorted(pairs):
        readings[asked(q)][here(p)] += 1
    usual = {v: c.most_common(1)[0][0] for v, c in readings.items()}
    wrong = {(p, q) for p, q in pairs if here(p) != usual[asked(q)]}
    back: dict[tuple[int, bool], Counter] = defaultdict(Counter)
    of = lambda p: (here(p), bool(t.codes[p] == _NUMBER_CODE))
    for p, q in sorted(pairs - wrong):
        back[of(p)][asked(q)] += 1
    stands_for = {v: {x for x, _ in c.most_common(2 if v[1] else 1)} for v, c in back.items()}
    wrong |= {(p, q) for p, q in pairs - wrong if asked(q) not in stands_for[of(p)]}
    left = sorted((p - q, q, size) for (p, q, size), r in hits.items() if not any(slots[r][p + j] and (p + j, q + j) in wrong for j in range(size)))
    longest = now = 0
    for i, (d, q, size) in enumerate(left):
        now = now + 1 if i and left[i - 1][:2] == (d, q - 1) else size
        longest = max(longest, now)
    exact = {q for (_, q, _), r in hits.items() if r == EXACT} if items.count[item] else set()
    windows = len({q for _, q, _ in left} - exact)
    if longest >= s.run or windows and windows >= s.share * items.of_which(item):
        return windows, longest, len(usual), sum(a != b for a, b in usual.items())
    return None


def _tables(items: Items) -> dict:
    """For each window size a table of 2^k marks, so that most windows are told apart without a search."""
    out = {}
    for size, index in items.by_size.items():
        bits = max(16, (16 * len(index.hashes)).bit_length())
        table = np.zeros(1 << bits, bool)
        mask = np.uint64((1 << bits) - 1)
        table[index.hashes & mask] = True
        out[size] = (mask, table)
    return out


def blocks(benchmark: DataFrame, s: Settings) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, in the order of its ids."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    size = 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r.text or "") // 2 + 1  # no text has more tokens
        if ids and size + n > s.block_tokens:
            yield prepare(ids, texts, s)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    if ids:
        yield prepare(ids, texts, s)


def _portions(batch: pa.RecordBatch, at: int, chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    low, texts, size = 0, [], 0
    for i, x in enumerate(batch.column(at)):
        texts.append(x.as_py())
        size += len(texts[-1] or "")
        if size >= chars:
            yield low, texts
            low, texts, size = i + 1, [], 0
    if texts:
        yield low, texts


LEAKS = "doc_id long, item_id long, windows int, run int, slots int, changed_slots int, cover double"


def find_leaks(documents: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each document and item that leaks into it."""
    spark = documents.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((k, pa.int32()) for k in ("windows", "run", "slots", "changed_slots")), ("cover", pa.float64())])
    out = None
    for items in blocks(benchmark, s):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, codes = shared.value, _Codes()
            tables = _tables(items)
            for batch in batches:
                for low, texts in _portions(batch, 1):
                    rows = leaks(texts, items, tables, codes, s)
                    if rows:
                        col = list(zip(*rows, strict=True))
                        ids = batch.column(0).take(pa.array([low + x for x in col[0]]))
                        cover = [w / items.of_which(i) for w, i in zip(col[2], col[1], strict=True)]
                        yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for i in col[1]], pa.int64()), *(pa.array(c, pa.int32()) for c in col[2:]), pa.array(cover, pa.float64())], schema=schema)

        found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], LEAKS) if out is None else out


def without_leaks(documents: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` that no item leaks into, as they are."""
    spark = documents.sparkSession
    at = documents.columns.index("text")
    out = documents
    left = None
    for n, items in enumerate(blocks(benchmark, s)):
        if n and n % CHAIN == 0:
            done, out = left, written(out, "without-leaks")
            left = out
            if done is not None:
                drop_written(done)
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, codes = shared.value, _Codes()
            tables = _tables(items)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for low, texts in _portions(batch, at):
                    for row in leaks(texts, items, tables, codes, s):
                        keep[low + row[0]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out
