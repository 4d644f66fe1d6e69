"""Language ID with hyperdimensional profiles (operator 8).

Each letter has a random vector of +1 and -1. An n-gram binds its letters' vectors, each rotated by
its place from the end, by multiplication; a text bundles its n-grams by addition. A language's
prototype is the bundle of its training texts, and a text goes to the prototype of largest cosine.
All sums are of integers, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, kept

SIZE = 1024
GRAM = 3
KNOWN = 16_000  # n-gram vectors kept in a worker, a byte a coordinate
LANGUAGES = 2000  # more distinct labels than that are refused
_RUNS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower case; runs of anything but letters are one space."""
    return _RUNS.sub(" ", text.lower()) if text else ""


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([8, code]).integers(0, 2, SIZE, dtype=np.int8) * np.int8(2) - np.int8(1)


def gram_vector(gram: tuple[int, ...]) -> np.ndarray:
    out = np.ones(SIZE, np.int8)
    for place, code in enumerate(reversed(gram)):
        out = out * np.roll(letter_vector(code), place)
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits a letter, and how often each comes."""
    c = np.frombuffer(f" {text} ".replace("  ", " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.zeros(n, np.uint64)
    for j in range(GRAM):
        key = (key << np.uint64(21)) | c[j : j + n]
    return np.unique(key, return_counts=True)


class Vectors:
    """Vectors of packed n-grams; those met first are kept."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.kept = np.empty((KNOWN, SIZE), np.int8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        get = self.at.get
        at = np.fromiter((get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        out = self.kept[at].astype(np.float32)
        for i in np.flatnonzero(at < 0).tolist():
            k = int(keys[i])
            out[i] = v = gram_vector(tuple((k >> (21 * p)) & (2**21 - 1) for p in reversed(range(GRAM))))
            if len(self.at) < KNOWN:
                self.kept[len(self.at)] = v
                self.at[k] = len(self.at)
        return out


_VECTORS: dict[int, Vectors] = {}
kept(_VECTORS)


def vectors() -> Vectors:
    if GRAM not in _VECTORS:
        alone(_VECTORS)
        _VECTORS[GRAM] = Vectors()
    return _VECTORS[GRAM]


def bundles(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of summed n-gram vectors for each text. Sums are exact while under 2^24, in blocks of counts else."""
    keys = np.unique(np.concatenate([k for k, _ in counts] + [np.empty(0, np.uint64)]))
    out = np.zeros((len(counts), SIZE))
    for at in range(0, len(keys), 4096):
        some = keys[at : at + 4096]
        m = np.zeros((len(counts), len(some)), np.float32)
        for i, (k, n) in enumerate(counts):
            lo, hi = np.searchsorted(k, [some[0], some[-1] + np.uint64(1)])
            m[i, np.searchsorted(some, k[lo:hi])] = n[lo:hi]
        exact = m.sum(axis=1).max(initial=0) < 2**24
        v = vectors().of(some)
        out += (m @ v) if exact else (m.astype(np.float64) @ v.astype(np.float64))
    return out


def _profiles(batches):
    """Of a partition: a row for each language, its summed n-gram vectors as integers."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for at in range(0, len(b), 256):
            part, by = b.slice(at, 256), {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                k, n = gram_counts(letters(text)) if any(map(str.isalpha, text)) else ([], [])
                if len(k):
                    by.setdefault(lang, []).append((k, n))
            for lang, found in by.items():
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)
                sums[lang] = sums.get(lang, 0) + bundles([(keys, n)])[0]
            if len(sums) > 64:
                yield _rows(sums)
                sums = {}
    if sums:
        yield _rows(sums)


def _rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([np.rint(v).astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from all rows of labelled (lang, text); a vector a language comes to the driver."""
    rows = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(_profiles, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = sums.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v"))
    found = sums.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} distinct languages")
    return {r.lang: np.array(r.v, np.float64) for r in sorted(found, key=lambda r: r.lang)}


def predict_texts(texts: list[str | None], names: list[str], unit: np.ndarray) -> list[tuple[str, float]]:
    """(language, score) of each text; ties go to the first name."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    clean = [letters(t) if t and any(map(str.isalpha, t)) else "" for t in texts]
    some = [i for i, t in enumerate(clean) if t]
    if not some or not names:
        return out
    v = bundles([gram_counts(clean[i]) for i in some])
    cosine = (v @ unit.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
    for i, row in zip(some, cosine):
        j = int(row.argmax())
        out[i] = names[j], float(min(1.0, max(0.0, row[j])))
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs (doc_id, text) to doc_id, lang_pred, score, a row for each row.

    A null text, or one without a letter, is `und` with score 0, as is every text where there are no
    prototypes. Only the text is looked at.
    """
    names, unit = _names(prototypes)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                found = predict_texts(part.column(1).to_pylist(), names, unit)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def _names(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = sorted(prototypes)
    return names, np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-9) for n in names]).reshape(len(names), SIZE)


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The rows of docs whose text identify() gives a language; `und` rows go. All columns stay."""
    names, unit = _names(prototypes)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array([x != "und" for x, _ in predict_texts(part.column(at).to_pylist(), names, unit)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_unheld(docs: DataFrame) -> dict[str, np.ndarray]:
    return learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def identify_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by prototypes of the rows that aren't held out."""
    made = identify(docs, learn_unheld(docs))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
