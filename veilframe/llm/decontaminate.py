"""Benchmark decontamination by the q-gram lemma (operator 3).

Texts are compared as lower-case runs of letters and digits joined by single spaces. A copy of an
item of length m with at most e edits shares at least m + 1 - q(e + 1) of its q-grams with the item,
on diagonals (text offset less item offset) that span at most e. Each document's q-grams are looked
up in the items' index, hits are counted in bands of 2(e + 1) diagonals that overlap by half, and
bands that meet the lemma's bound are verified by alignment within the band.

q is 8, less for short items, so that the bound always holds for all of the edits allowed. Items too
short for any q-gram match word for word. Hits are counted a bounded number at a time.

The index holds benchmark items only. It is shipped in blocks of at most BLOCK_CHARS characters,
and each block meets all documents, so a large benchmark costs passes and no memory.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, kept

Q = 8
LEAST_Q = 2
HITS = 1_000_000  # of a document, counted at once
BLOCK_CHARS = 2_000_000
_TOKEN = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_BITS = 16


def normal(text: str | None) -> str:
    return " ".join(_TOKEN.findall(text.lower())) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, part, done, h = _P, 1, c.astype(np.uint64), 0, None
        while True:  # part: hashes of `size` codes; h: of the first `done` of each gram
            if q & size:
                h = part[:n] if h is None else h * power + part[done : done + n]
                done += size
            if 2 * size > q:
                break
            part, size, power = part[:-size] * power + part[size:], 2 * size, power * power
        return (h ^ (h >> np.uint64(29))) * _P


def budget(m: int, rate: float) -> int:
    """Edits allowed for an item of m characters."""
    return int(rate * m)


def gram_size(m: int, rate: float, q: int) -> int:
    """The largest q-gram that leaves the lemma a tenth of an item of m characters, two at least where there are so many; 0 under q characters."""
    return 0 if m < q else next((x for x in range(q, LEAST_Q - 1, -1) if m + 1 - x * (budget(m, rate) + 1) >= max(min(2, m - x + 1), m // 10)), 0)


def _edits(pattern: np.ndarray, text: np.ndarray, lo: int, width: int, most: int) -> tuple[int, int]:
    """(edits, end): the pattern against the best part of text that starts on diagonals lo .. lo + width - 1 and stays there. Over `most` edits count as most + 1."""
    # Around the text stands a code that no character has; matching it costs what leaving out the item's character does.
    before = max(0, -lo)
    around = np.full(before + len(text) + max(0, lo + len(pattern) + width - len(text)), 2**32 - 1, np.uint32)
    around[before : before + len(text)] = text
    at, row, new = np.arange(width), np.zeros(width, np.int64), np.empty(width, np.int64)
    for i, ch in enumerate(pattern):
        j = before + lo + i
        np.add(row, around[j : j + width] != ch, out=new)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new -= at  # an inserted text character moves one diagonal on
        np.minimum.accumulate(new, out=row)
        row += at
        if i % 8 == 7 and row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), min(max(0, len(pattern) + lo + best), len(text))


class _Grams:
    """q-grams of some items, all of one size: sorted keys, and for each its (item, offset) pairs."""

    def __init__(self, q: int, codes_of: list[np.ndarray], items: list[int], least: np.ndarray) -> None:
        self.q, self.fewest = q, int(least[items].min())
        g = [grams(codes_of[i], q) for i in items]
        h = np.concatenate([*g, np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.array(items, np.int64), [len(x) for x in g])[order]
        self.offset = np.concatenate([*(np.arange(len(x)) for x in g), np.empty(0, np.int64)])[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(_BITS, len(self.keys).bit_length() + 4))  # a small table stays in the processor's cache
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.keys >> self.shift] = True

    def bands(self, c: np.ndarray, edits: np.ndarray, least: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs of a document that meet the lemma's bound."""
        h = grams(c, self.q)
        pos = np.flatnonzero(self.maybe[h >> self.shift])
        if not len(pos):
            return []
        k = np.searchsorted(self.keys, h[pos])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[pos]
        pos, k = pos[hit], k[hit]
        n = self.count[k]
        if n.sum() < (fewest := self.fewest):
            return []
        keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
        steps = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + HITS, HITS))) if n.sum() > HITS else np.array([0, len(n)])
        for lo, hi in zip(steps, [*steps[1:], len(n)]):
            # every (text offset, item, item offset) hit of a run of text offsets
            row = np.repeat(np.arange(lo, hi), n[lo:hi])
            if not len(row):
                continue
            at = np.arange(len(row)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + self.first[k][row]
            item = self.item[at]
            if len(steps) == 1:  # all hits are here: items with fewer than they need have no band
                some = np.flatnonzero((np.bincount(item, minlength=len(least)) >= least)[item])
                if not len(some):
                    return []
                row, at, item = row[some], at[some], item[some]
            band = (pos[row] - self.offset[at]) // (edits[item] + 1)
            key, many = np.unique((item << 40) + (band + (1 << 38)), return_counts=True)
            keys, times = np.concatenate([keys, key]), np.concatenate([times, many])
        if 2 * times.max() < fewest and n.sum() <= HITS:
            return []
        # a band is a run of e + 1 diagonals and the next one
        keys, back = np.unique(np.concatenate([keys, keys - 1]), return_inverse=True)
        times = np.bincount(back, np.concatenate([times, times]), len(keys)).astype(np.int64)
        good = times >= least[(keys + 1) >> 40]
        return [(int((x + 1) >> 40), int(x & ((1 << 40) - 1)) - (1 << 38)) for x in keys[good]]


class Index:
    """The items by the size of their q-grams; those without any by their words."""

    def __init__(self, items: list[tuple[int, str]], rate: float, q: int) -> None:
        self.ids = [i for i, _ in items]
        self.codes = [codes(t) for _, t in items]
        self.edits = np.array([budget(len(c), rate) for c in self.codes], np.int64)
        sizes = [gram_size(len(c), rate, q) for c in self.codes]
        self.least = np.array([max(1, len(c) + 1 - g * (e + 1)) for c, e, g in zip(self.codes, self.edits, sizes)], np.int64)
        self.parts = [_Grams(g, self.codes, [i for i, x in enumerate(sizes) if x == g], self.least) for g in sorted(set(sizes) - {0})]
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, (g, c) in enumerate(zip(sizes, self.codes)):
            if not g:
                self.short.setdefault(len(c), {}).setdefault(c.tobytes(), []).append(i)

    def bands(self, c: np.ndarray) -> list[tuple[int, int]]:
        return [x for part in self.parts for x in part.bands(c, self.edits, self.least)]

    def _words(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Matches of the items without q-grams, whole words each."""
        found, ends = [], {}
        if self.short:
            apart = np.concatenate([[True], c == 32, [True]])  # before each code and after the last one
            for m, here in self.short.items():
                at = np.flatnonzero(apart[: max(0, len(c) - m + 1)] & apart[m + 1 :][: max(0, len(c) - m + 1)])
                for s in at.tolist():
                    for i in here.get(c[s : s + m].tobytes(), ()):
                        if ends.get(i, 0) <= s:
                            found.append((i, s, s + m, 0))
                            ends[i] = s + m
        return found

    def matches(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, edits) in normalised offsets, without overlaps for one item."""
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        bands, at = sorted(self.bands(c)), 0
        while at < len(bands):
            item, band = bands[at]
            # Two bands that overlap are aligned at once; copies of one item in them would overlap as well.
            wide = bands[at + 1 : at + 2] == [(item, band + 1)]
            at += 1 + wide
            p, e = self.codes[item], int(self.edits[item])
            lo, width = band * (e + 1) - e, (2 + wide) * (e + 1) + 2 * e
            edits, end = _edits(p, c, lo, width, e)
            if edits <= e:
                back, stop = _edits(p[::-1], c[:end][::-1], -e, 2 * e + 1, e)
                out.setdefault(item, []).append((edits, end - stop, end, item))
        found = []
        for item, hits in out.items():
            kept: list[tuple[int, int, int, int]] = []
            for edits, start, end, _ in sorted(hits):
                if all(end <= s or start >= t for _, s, t, _ in kept):
                    kept.append((edits, start, end, item))
            found += [(item, s, t, x) for x, s, t, _ in kept]
        return sorted(found + self._words(c))


def _spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised start, original start and original end of each token."""
    starts, begin, end, at = [], [], [], 0
    # Lower-casing can lengthen a text, so offsets are carried by tokens of the lower-cased text back by its characters.
    low, origin = [], []
    for i, ch in enumerate(text):
        x = ch.lower()
        low.append(x)
        origin += [i] * len(x)
    for m in _TOKEN.finditer("".join(low)):
        starts.append(at), begin.append(origin[m.start()]), end.append(origin[m.end() - 1] + 1)
        at += m.end() - m.start() + 1
    return np.array(starts), np.array(begin), np.array(end)


_INDEXES: dict[tuple, Index] = {}
kept(_INDEXES)


def _index(items: list[tuple[int, str]], name: str, rate: float, q: int) -> Index:
    """A block's index, made once in a worker; the last one stays."""
    key = (name, rate, q)
    if key not in _INDEXES:
        alone()
        _INDEXES[key] = Index(items, rate, q)
    return _INDEXES[key]


def _search(items: list[tuple[int, str]], rate: float, q: int):
    name = uuid.uuid4().hex

    def run(batches):
        index = _index(items, name, rate, q)
        for b in batches:
            docs, found, begin, end, edits = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                hits = index.matches(codes(normal(text)))
                if hits:
                    starts, first, last = _spans(text)
                    for item, s, e, x in hits:
                        docs.append(i), found.append(index.ids[item]), edits.append(x)
                        begin.append(int(first[np.searchsorted(starts, s, "right") - 1])), end.append(int(last[max(0, np.searchsorted(starts, e, "left") - 1)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(found, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int64())], names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def _filter(items: list[tuple[int, str]], rate: float, q: int, at: int):
    name = uuid.uuid4().hex

    def run(batches):
        index = _index(items, name, rate, q)
        for b in batches:
            yield b.filter(pa.array([not index.matches(codes(normal(t.as_py()))) for t in b.column(at)], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame):
    """The items as lists of (item_id, normalised text), BLOCK_CHARS or so at a time."""
    own = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(chars / BLOCK_CHARS) or 1
    for i in range(blocks):
        block = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        yield [(x, n) for x, t in block.collect() if (n := normal(t))]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, q: int = Q) -> DataFrame:
    """One row for each copy of a benchmark item in a document: doc_id, item_id, start, end, edits.

    A copy has at most rate * m edits of the item's m normalised characters; start and end are code
    points of the document, whole tokens. Only whole items count. Items of fewer than q normalised
    characters match word for word, null and wordless ones nothing, as do null and empty documents. Of
    copies of one item that overlap the one with fewest edits counts, then the first. Repeated rows and
    items each give rows of their own; empty tables an empty result. Rows with a null doc_id or
    item_id are searched like others.
    """
    out = None
    for items in _blocks(benchmark):
        made = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(_search(items, rate, q), "doc_id long, item_id long, start long, end long, edits long")
        out = made if out is None else out.unionByName(made)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, q: int = Q) -> DataFrame:
    """The rows of docs whose text holds no copy of a benchmark item, as leaks() finds them; all columns, null and empty texts and repeated rows stay."""
    at = docs.columns.index("text")
    for items in _blocks(benchmark):
        docs = docs.mapInArrow(_filter(items, rate, q, at), docs.schema)
    return docs
