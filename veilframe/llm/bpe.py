"""Byte-level BPE encoding and decoding with DuckDB, in each partition (operator 2).

Every match of the split pattern is encoded by itself. Encoding is a recursive query: rows of
(piece, position, token) join the merge table, and each round contracts in every piece its leftmost
pair of least rank. Pieces of over SHORT bytes, which would take a round over all their rows for each
contraction, contract in a round all pairs that one after the other would come out the same: those
that no pair of lower rank is near enough to reach. So they take about as many rounds as their
longest token has bytes, whatever their length, and rows are keyed by position, so rounds leave nothing
behind. Both forms give the same for any piece; the plainer one is three times as quick on words.
Decoding joins ids to their bytes and aggregates them in order.

Pieces are encoded once per Python worker while they stay in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .common import alone, kept

SHORT = 64  # bytes of pieces that contract one pair a round
BYTES = 200_000  # of pieces in a query; a longer piece stands alone
CACHED = 200_000
MEMORY = 256_000_000  # DuckDB's, bytes

#: The split pattern of the public vocabulary, and what its classes hold below U+0100.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\x09-\x0d\x20\x85\xa0"

_WORDS = """
WITH RECURSIVE s AS (
    SELECT w, p, np, t, nt, false AS done FROM tk
    UNION ALL
    SELECT * FROM (
        WITH best AS (
            SELECT w, min((m::BIGINT << 32) | p) AS k
            FROM s JOIN merges g ON g.k = ((t::BIGINT << 32) | nt::BIGINT)
            WHERE nt >= 0 AND NOT done GROUP BY w),
        pair AS (SELECT b.w, (b.k & 4294967295)::INT AS p, (b.k >> 32)::INT AS m, l.np AS q FROM best b JOIN s l ON l.p = (b.k & 4294967295)::INT),
        cut AS (SELECT a.w, a.p, a.m, a.q, r.np AS rnp, r.nt AS rnt FROM pair a JOIN s r ON r.p = a.q)
        SELECT s.w, s.p,
            CASE WHEN s.p = c.p THEN c.rnp ELSE s.np END AS np,
            CASE WHEN s.p = c.p THEN c.m ELSE s.t END AS t,
            CASE WHEN s.p = c.p THEN c.rnt WHEN s.np = c.p THEN c.m ELSE s.nt END AS nt,
            c.w IS NULL AS done
        FROM s LEFT JOIN cut c ON s.w = c.w
        WHERE NOT s.done AND (c.w IS NULL OR s.p <> c.q)
    )
)
SELECT w, list(t ORDER BY p) AS ids FROM s WHERE done GROUP BY w
"""

# A pair (a, b) at p of rank m can be reached from the left only by a token x with a merge (x, a) of rank m
# or less, which is at most `lx` bytes long, and from the right likewise, up to `rr` bytes on. No pair of
# lower rank there: nothing reaches it before its turn. Neighbouring pairs of one rank overlap, so every
# other one of such a run is contracted. A `wild` token has a merge of lower rank than its own; there
# pairs of the same rank to the left count too.
_LONG = """
WITH RECURSIVE s USING KEY (p) AS (
    SELECT p, w, t, false AS done FROM tk
    UNION ALL
    SELECT p, w, CASE WHEN eaten THEN -1 WHEN hit THEN m ELSE t END AS t, best IS NULL OR eaten AS done FROM (
        SELECT *, coalesce(lag(hit) OVER o, false) AS eaten FROM (
            SELECT *, m IS NOT NULL AND coalesce(max(CASE WHEN low < m OR wild AND before <= m THEN n END) OVER o, -1) < first AND (n - first) % 2 = 0 AS hit FROM (
                SELECT *, max(CASE WHEN m IS DISTINCT FROM left_m THEN n END) OVER o AS first FROM (
                    SELECT a.p, a.w, a.t, a.n, g.m, coalesce(g.wild, false) AS wild,
                        lag(g.m) OVER o AS left_m,
                        min(g.m) OVER (PARTITION BY w) AS best,
                        min(g.m) OVER (PARTITION BY w ORDER BY a.p RANGE BETWEEN coalesce(g.lx, 0) PRECEDING AND coalesce(g.rr, 0) FOLLOWING) AS low,
                        min(g.m) OVER (PARTITION BY w ORDER BY a.p RANGE BETWEEN greatest(coalesce(g.lx, 0), 1) PRECEDING AND 1 PRECEDING) AS before
                    FROM (SELECT p, w, t, lead(t) OVER o AS nt, row_number() OVER o AS n FROM s WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY p)) a
                    LEFT JOIN merges g ON g.k = ((a.t::BIGINT << 32) | a.nt::BIGINT)
                    WINDOW o AS (PARTITION BY w ORDER BY a.p))
                WINDOW o AS (PARTITION BY w ORDER BY p))
            WINDOW o AS (PARTITION BY w ORDER BY p))
        WINDOW o AS (PARTITION BY w ORDER BY p))
)
SELECT w, list(t ORDER BY p) AS ids FROM s WHERE t >= 0 GROUP BY w
"""

_DECODE = "SELECT d, list(b ORDER BY i) AS parts FROM ids JOIN vocab USING (id) GROUP BY d"


def splitter(pattern: str = SPLIT):
    """A function from a text to its pieces. Texts below U+0100 take an equal pattern of the quicker library."""
    full = regex.compile(pattern).findall
    if pattern != SPLIT:
        return full
    a, n, s = LETTERS, NUMBERS, SPACES
    quick = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+").findall
    wide = re.compile("[^\x00-\xff]").search
    return lambda text: full(text) if not text.isascii() and wide(text) else quick(text)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PieceCache:
    """Bytes of pieces, in two generations: what the older one holds and is asked for again moves to the newer."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int = CACHED) -> None:
        self.make, self.most, self.now, self.old = make, most, {}, {}

    def hold(self, need: set) -> None:
        """Have all these pieces in `now`."""
        new = need.difference(self.now)
        if len(self.now) + len(new) > self.most:
            self.now, self.old, new = {}, self.now, need
        missing = []
        for x in new:
            if (found := self.old.get(x)) is None:
                missing.append(x)
            else:
                self.now[x] = found
        self.now.update(zip(missing, self.make(missing)))

    def join(self, lists: list[list[str]]) -> list[bytes]:
        """The bytes of each list's pieces, joined."""
        self.hold(set().union(*lists))
        get = self.now.__getitem__
        return [b"".join(map(get, x)) for x in lists]


def _reach(token: np.ndarray, others: np.ndarray, made: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each merge: the most bytes (size) that a merge of its rank or less has beside the merge's token where `others` is that token."""
    order = np.lexsort((made, others))
    group = np.cumsum(np.concatenate([[0], np.diff(others[order]) != 0])) << 32
    most = np.maximum.accumulate(group + size[order]) - group
    at = np.searchsorted(others[order] << 32 | made[order], token << 32 | made, side="right") - 1
    return np.where((at >= 0) & (others[order][at] == token), most[at], 0).astype(np.int32)


class Codec:
    """A vocabulary of ranks in DuckDB."""

    def __init__(self, ranks: bytes, pattern: str = SPLIT) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.split = splitter(pattern)
        left, right, made, at = [], [], [], []
        for whole, rank in self.ranks.items():
            for i in range(1, len(whole)):
                a, b = self.ranks.get(whole[:i]), self.ranks.get(whole[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank), at.append((i, len(whole) - i))
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        size = np.array(at, np.int64).reshape(-1, 2)
        wild = np.union1d(left[made < left], right[made < right])
        lx, ry = _reach(left, right, made, size[:, 0]), _reach(right, left, made, size[:, 1])
        self.single = np.full(256, -1, np.int32)
        for whole, rank in self.ranks.items():
            if len(whole) == 1:
                self.single[whole[0]] = rank
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": ""})  # no spill to a local folder
        self._table("merges", {"k": (left << 32) | right, "m": made.astype(np.int32), "lx": lx, "rr": np.where(ry > 0, size.sum(axis=1) + ry - 1, 0), "wild": np.isin(made, wild)})
        self._table("vocab", {"id": np.array(list(self.ranks.values()), np.int32), "b": pa.array(list(self.ranks), pa.binary())})
        self.cache = PieceCache(lambda new: self.pieces([x.encode("utf-8") for x in new]))

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _query(self, name: str, columns: dict, sql: str, n: int) -> pa.Table:
        """The result over n given rows. A text or piece of uncommon length gets more memory, and only while it is at work."""
        self.con.register(name, pa.table(columns))
        if n > BYTES:
            self.con.execute(f"SET memory_limit = '{max(MEMORY, 1600 * n)}B'")
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        if n > BYTES:
            self.con.execute(f"SET memory_limit = '{MEMORY}B'")
        return out

    def pieces(self, found: list[bytes]) -> list[bytes]:
        """The ids of each nonempty piece, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(found)
        for sql, some in ((_WORDS, [i for i, x in enumerate(found) if len(x) <= SHORT]), (_LONG, [i for i, x in enumerate(found) if len(x) > SHORT])):
            ends = np.cumsum([len(found[i]) for i in some])
            at = 0
            while at < len(some):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BYTES, "right")))
                self._contract(some[at:to], found, sql, out)
                at = to
        return out

    def _contract(self, some: list[int], found: list[bytes], sql: str, out: list[bytes]) -> None:
        sizes = np.array([len(found[i]) for i in some])
        n = int(sizes.sum())
        t = self.single[np.frombuffer(b"".join(found[i] for i in some), np.uint8)]
        if (t < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        at = np.arange(n, dtype=np.int32)
        rest = np.append(t[1:], np.int32(-1))
        rest[np.cumsum(sizes) - 1] = -1
        rows = {"w": np.repeat(np.arange(len(some), dtype=np.int32), sizes), "p": at, "np": at + np.int32(1), "t": t, "nt": rest}
        made = self._query("tk", rows, sql, n)
        for batch in made.to_batches():
            lists = batch.column("ids")
            raw = lists.values.to_numpy().astype("<u4").tobytes()
            at = (lists.offsets.to_numpy() * 4).tolist()
            for w, i, j in zip(batch.column("w").to_pylist(), at, at[1:]):
                out[some[w]] = raw[i:j]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        lists = [self.split(t) if t else [] for t in texts]
        return self.cache.join(lists)

    def decode(self, docs: list[bytes]) -> list[bytes]:
        """The bytes of each document's ids, joined in order."""
        flat = np.frombuffer(b"".join(docs), "<u4").astype(np.int32)
        sizes = np.array([len(x) // 4 for x in docs])
        out = [b""] * len(docs)
        if not len(flat):
            return out
        made = self._query("ids", {"d": np.repeat(np.arange(len(docs), dtype=np.int32), sizes), "i": np.arange(len(flat), dtype=np.int32), "id": flat}, _DECODE, len(flat))
        for batch in made.to_batches():
            lists = batch.column("parts").cast(pa.list_(pa.binary()))
            first, parts = lists.offsets.to_numpy(), lists.values
            at = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset :]
            data = parts.buffers()[2]
            for d, i, j in zip(batch.column("d").to_pylist(), first[:-1], first[1:]):
                if j - i != sizes[d]:
                    raise ValueError("an id is not in the vocabulary")
                out[d] = data[int(at[i]) : int(at[j])].to_pybytes()
        if len(made) != int((sizes > 0).sum()):
            raise ValueError("an id is not in the vocabulary")
        return out


_CODECS: dict[tuple[bytes, str], Codec] = {}
kept(_CODECS)


def codec(ranks: bytes, pattern: str = SPLIT) -> Codec:
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODECS:
        alone(_CODECS)
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _slices(batch: pa.RecordBatch, chars: int = 1_000_000):
    """Runs of rows with about so many bytes of text; a longer text stands alone."""
    sizes = [x.as_py() or 0 for x in pa.compute.binary_length(batch.column(1))]
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(batch):
        yield batch.slice(at)


def encode(docs: DataFrame, ranks: bytes, pattern: str = SPLIT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids (binary, little-endian unsigned 32-bit).

    Special tokens' strings are ordinary text. A null or empty text has no ids. Rows are taken each
    for itself, so repeated and null doc_ids stay as they are.
    """

    def run(batches):
        c = codec(ranks, pattern)
        for b in batches:
            for part in _slices(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.encode(part.column(1).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, decoded (binary). Null ids decode to nothing; an unknown id raises."""

    def run(batches):
        c = codec(ranks)
        for b in batches:
            for part in _slices(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.decode([x or b"" for x in part.column(1).to_pylist()]), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str = SPLIT, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids; the ids are decoded as read.

    A null or empty text has no ids and the digests of nothing. Rows are taken each for itself, so
    repeated and null doc_ids stay as they are; an empty table gives an empty result.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def run(batches):
        c = codec(ranks, pattern)
        for b in batches:
            for part in _slices(b):
                ids = c.encode(part.column(1).to_pylist())
                back = c.decode(ids)
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array([hashlib.sha256(y).hexdigest() for y in x]) for x in (ids, back))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * keep_ids], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
