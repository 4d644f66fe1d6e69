"""Substring dedup by super-k-mer partitioning (operator 9).

A window is `width` consecutive words of one document. Its minimiser is the `m` consecutive words
in it whose hash is least, the leftmost on a tie, so equal windows have equal minimisers at equal
offsets. Consecutive windows that share a minimiser occurrence travel to the minimiser's bucket as
one packed string, their words joined by a space. Two windows of one packed string can't be equal
(their minimiser would be at two offsets), so equal windows are always in two packed strings.

Minimisers that occur once in the corpus are let go on hashes alone before any string is packed.
Equal packed strings are summed before they are dealt out; in a bucket with one string that occurs
twice or more every window repeats, and only buckets with several strings are taken apart into
windows: sorted within their task where they hold at most KINDS different strings of at most
BUCKET_BYTES in all, else dealt out as rows and counted by a sorted aggregate. Both compare whole
strings, and no bucket of unbounded size is gathered in one task.

Joins deal the rows of a heavy key (a minimiser, string or window with over 1/HEAVY of a table's
rows, so there are fewer than HEAVY) over SALTS parts; all rows of other keys meet as usual.

Each step is written to the shared folder. Its shuffle files go when it has ended, and a step's table
goes once the steps that read it have ended, so the disk holds two or three steps at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, dropped, kept, rolling, words, written

MINIMISER = 12
KINDS = 4096  # different packed strings of a bucket that one task takes apart
BUCKET_BYTES = 4_000_000  # and their bytes; with 24 windows each under 60 MB
HEAVY = 1024
HEAVY_ROWS = 4096  # a key with fewer rows is no burden to a task
SALTS = 512
_HASH = WordHash()
kept(_HASH)


def super_kmers(h: np.ndarray, width: int, m: int):
    """(minimiser, first window, number of windows) arrays for the word hashes of one document."""
    n = len(h) - width + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 2
    g = rolling(h, m)
    span, size, v, p = width - m + 1, 1, g, np.arange(len(g))
    while 2 * size <= span:
        right = v[size:] < v[:-size]
        v, p, size = np.where(right, v[size:], v[:-size]), np.where(right, p[size:], p[:-size]), 2 * size
    rest = span - size
    right = v[rest : rest + n] < v[:n]
    p = np.where(right, p[rest : rest + n], p[:n])
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return g[p[first]], first, np.diff(np.r_[first, n])


def _scan(width: int, m: int):
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                ids, hs, firsts, counts, rows = [], [], [], [], []
                part = b.slice(at, 512)
                for i, t in enumerate(part.column(2)):
                    h, first, count = super_kmers(_HASH.of(words(t.as_py())), width, m)
                    hs.append(h), firsts.append(first), counts.append(count), rows.append(np.full(len(h), i))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32))],
                    names=["h", "doc_id", "row_key", "at", "c"],
                )

    return run


def _pack(width: int):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                w = words(b.column(2)[i].as_py())
                found = b.column(3)[i].as_py()
                rows = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["h"] for x in found], pa.int64()), pa.array([b" ".join(w[x["at"] : x["at"] + x["c"] + width - 1]) for x in found], pa.binary()), b.column(0).take(rows), b.column(1).take(rows), pa.array([x["at"] for x in found], pa.int32()), pa.array([x["c"] for x in found], pa.int32())],
                    names=["h", "packed", "doc_id", "row_key", "at", "c"],
                )

    return run


def _sorted_counts(width: int):
    """Rows of h, packed, n, key, all of a bucket together, to h, key and the offsets of windows that start twice or more in the bucket."""

    def repeats(rows: list[tuple]):
        windows = []
        for i, (_, packed, n, _) in enumerate(rows):
            w = packed.split(b" ")
            windows += [(b" ".join(w[j : j + width]), n, i, j) for j in range(len(w) - width + 1)]
        windows.sort()
        offs: list[list[int]] = [[] for _ in rows]
        at = 0
        while at < len(windows):
            end, times = at, 0
            while end < len(windows) and windows[end][0] == windows[at][0]:
                times += windows[end][1]
                end += 1
            if times > 1:
                for _, _, i, j in windows[at:end]:
                    offs[i].append(j)
            at = end
        return [(h, key, o) for (h, _, _, key), o in zip(rows, offs) if o]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        h, key, offs = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(key, pa.binary()), pa.array(offs, pa.list_(pa.int32()))], names=["h", "key", "offs"])

    def run(batches):
        group: list[tuple] = []
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][0] != row[0]:
                    found += repeats(group)
                    group = []
                group.append(row)
            yield batch(found)
        if group:
            yield batch(repeats(group))

    return run


def _kept(width: int):
    """doc_id, text, window starts (or null) to the contract's columns, and the row's kept text."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                n, gone, sha = [], [], []
                for t, starts in zip(part.column(1), part.column(2)):
                    w = words(t.as_py())
                    n.append(len(w))
                    if found := starts.as_py():
                        cover = np.zeros(len(w) + 1, np.int64)
                        np.add.at(cover, found, 1)
                        np.add.at(cover, np.array(found) + width, -1)
                        keep = np.cumsum(cover[:-1]) == 0
                        gone.append(int(len(w) - keep.sum()))
                        w = [x for x, k in zip(w, keep) if k]
                    else:
                        gone.append(0)
                    sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("row_key"), "text")


def _heavy(n: str, rows: int) -> str:
    return f"{n} > {max(rows // HEAVY, HEAVY_ROWS)}"


def _dealt(big: DataFrame, small: DataFrame, on: list[str], heavy: DataFrame, by: list[str]) -> DataFrame:
    """big and small joined on their columns `on`, small with one row for each key. Rows of big with a key of heavy, fewer than HEAVY keys by _heavy(), go by a hash of `by` to SALTS parts, each with small's row."""
    keys = F.broadcast(heavy.select(*on, F.lit(True).alias("heavy")))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    big = big.join(keys, on, "left").withColumn("salt", salt).drop("heavy")
    small = small.join(keys, on, "left").withColumn("salt", F.explode(salts)).drop("heavy")
    return big.join(small, [*on, "salt"]).drop("salt")


def repeated_windows(docs: DataFrame, width: int = 50, m: int = MINIMISER) -> tuple[DataFrame, DataFrame]:
    """(starts, texts): for each row key that has any, the starts of its repeated windows; and those rows.

    starts: doc_id, row_key, starts (sorted array of word offsets); texts: doc_id, row_key, text of
    every row with a minimiser that the corpus has twice.
    """
    if width < m:
        m = width
    rows = _keyed(docs)
    scan = written(rows.mapInArrow(_scan(width, m), "h long, doc_id long, row_key long, at int, c int"), "minimisers", sweep=True)
    twice = written(scan.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "twice", sweep=True)
    pairs = _dealt(scan, twice.select("h"), ["h"], twice.where(_heavy("n", scan.count())), ["doc_id", "row_key", "at"])
    found = written(pairs.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("at", "c", "h")).alias("found")), "found", sweep=True)
    dropped(scan, twice)
    here = found.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "found")
    texts = written(rows.join(here, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key"))).select("doc_id", "row_key", "text", "found"), "candidates", sweep=True)
    dropped(found)
    packs = texts.mapInArrow(_pack(width), "h long, packed binary, doc_id long, row_key long, at int, c int")
    digest = F.unhex(F.sha2("packed", 256)).alias("key")
    strings = written(packs.groupBy("h", "packed").agg(F.count("*").alias("n"), F.min("c").alias("c")).select("h", "packed", "n", "c", digest, F.length("packed").alias("size")), "packed", sweep=True)
    of = strings.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes"))
    count, all_places = strings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds = _dealt(strings, of, ["h"], of.where(_heavy("kinds", count)), ["key"]).where("kinds > 1 OR n > 1")
    kinds = written(kinds.withColumn("packed", F.expr("IF(kinds > 1, packed, NULL)")), "several", sweep=True)
    often = written(strings.where(_heavy("n", all_places)).select("h", "key"), "often")
    dropped(strings)
    whole = kinds.where("kinds = 1").select("h", "key", F.expr("sequence(0, c - 1)").alias("offs"))
    small = F.expr(f"kinds <= {KINDS} AND bytes <= {BUCKET_BYTES}")
    few = kinds.where("kinds > 1").where(small).select("h", "packed", "n", "key").repartition("h").sortWithinPartitions("h")
    few = few.mapInArrow(_sorted_counts(width), "h long, key binary, offs array<int>")
    large = kinds.where("kinds > 1").where(~small)
    w = F.split(F.col("packed").cast("string"), " ", -1)
    windows = large.select("h", "key", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("c")), lambda i: F.array_join(F.slice(w, i, width), " "))).alias("off", "window"))
    sums = windows.groupBy("h", "window").agg(F.sum("n").alias("times"), F.count("*").alias("rows")).where("times > 1")
    sums = written(sums.select("h", "window", "rows"), "sums", sweep=True)
    total = large.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    parts = _dealt(windows, sums.drop("rows"), ["h", "window"], sums.where(_heavy("rows", total)), ["key", "off"]).groupBy("h", "key").agg(F.collect_set("off").alias("offs"))
    verdict = whole.unionByName(few).unionByName(parts)
    places = _dealt(packs.select("h", digest, "doc_id", "row_key", "at"), verdict, ["h", "key"], often, ["doc_id", "row_key", "at"])
    starts = places.select("doc_id", "row_key", F.explode(F.transform("offs", lambda x: x + F.col("at"))).alias("start"))
    starts = written(starts.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("start")).alias("starts")), "starts", sweep=True)
    dropped(kinds, often, sums)
    return starts, texts.select("doc_id", "row_key", "text")


def substring_dedup(docs: DataFrame, width: int = 50, m: int = MINIMISER) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    Each word covered by a window whose words also start anywhere else is removed; windows are
    judged on the input. Null or empty text: no words. Texts under `width` words lose nothing.
    Repeated rows repeat each other's windows. Rows are told apart by doc_id and text, so null and
    repeated doc_ids are taken each for itself. An empty table gives an empty result.
    """
    starts, texts = repeated_windows(docs, width, m)
    on = lambda x: F.col("doc_id").eqNullSafe(x["id"]) & (F.col("row_key") == x["key"])
    ends = starts.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    cut = texts.join(ends, on(ends)).select("doc_id", "text", "starts").mapInArrow(_kept(width), schema)
    bare = _keyed(docs).select("doc_id", "row_key", "text", F.lit(None).cast("array<int>").alias("starts"))
    whole = bare.select("doc_id", "text", "starts", "row_key").mapInArrow(_passing(width), f"{schema}, row_key long")
    keys = ends.select("id", "key")
    return cut.unionByName(whole.join(keys, on(keys), "left_anti").select(*cut.columns))


def _passing(width: int):
    """As _kept, with the row key as a last column."""
    inner = _kept(width)

    def run(batches):
        for b in batches:
            made = list(inner(iter([b])))
            if made:
                t = pa.Table.from_batches(made).append_column("row_key", b.column(3)).combine_chunks()
                yield from t.to_batches()

    return run
