"""Token-id files with a minimal perfect hash index (operator 7).

A dataset is a folder on a file system that all executors share:

- ``shard-00000.ids``: raw ids, 2 bytes little-endian each (4 if the vocabulary is larger), of the
  documents in ascending doc_id order, each followed by the end id. Shard order is doc_id order.
- ``index-00000.mph``: for a bucket of document keys, a minimal perfect hash from key to slot, and
  for each slot a 32-bit fingerprint of the key, the shard, the offset in it and the number of ids.
- ``shards.json``: id width, number of ids of each shard, number of index buckets.

A lookup hashes the key to a bucket, walks the bucket's levels of bits to a slot, compares the
stored fingerprint and reads one range of one shard. Files are written under a name of their own
and renamed, so a task that is run again leaves the same files.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PieceCache, _slices
from .common import alone, kept, mix, new_folder, written

GAMMA = 2  # bits a key of a level
BUCKET = 50_000  # keys of an index file, about
_MAGIC = b"VFMPH1\0\0"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"
    return pafs.FileSystem.from_uri(folder)


@contextlib.contextmanager
def _file(folder: str, name: str):
    """A file of the folder, written under a name of this attempt and renamed at the end; what an earlier attempt left under the name goes."""
    fs, root = _open(folder)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(own) as f:
            yield f
        if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{root}/{name}")
        fs.move(own, f"{root}/{name}")
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(own)
        raise


def _put(folder: str, name: str, chunks) -> None:
    with _file(folder, name) as f:
        for x in chunks:
            f.write(x)


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """64 bits of a document key: its id and, for rows that share one, which of them it is."""
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0xD1342543DE82EF95 % 2**64)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits; a key's slot is the rank of its bit at the first level where it stood alone."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - 1 + b for x, b in zip(levels, before)]

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """h: distinct 64-bit hashes."""
        levels = []
        while len(h):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(8, GAMMA * len(h))
            at = _place(h, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            h = h[~alone[at]]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level has its bit. A strange key may get a slot: compare fingerprints."""
        out, rest = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _place(h[rest], level, len(bits))
            hit = bits[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def index_bytes(doc_id, copy, shard, offset, n) -> bytes:
    h = key_hash(doc_id, copy)
    ph = PerfectHash.build(h)
    entries = np.zeros(len(h), _ENTRY)
    at = ph.slots(h)
    for name, values in (("print", fingerprint(h)), ("shard", shard), ("offset", offset), ("n", n)):
        entries[name][at] = values
    head = struct.pack(f"<8sQQ{len(ph.levels)}Q", _MAGIC, len(h), len(ph.levels), *map(len, ph.levels))
    return b"".join([head, *(np.packbits(x, bitorder="little").tobytes() for x in ph.levels), entries.tobytes()])


def read_index(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    magic, n, k = struct.unpack_from("<8sQQ", raw)
    if magic != _MAGIC:
        raise ValueError("not an index file")
    sizes, at, levels = struct.unpack_from(f"<{k}Q", raw, 24), 24 + 8 * k, []
    for s in sizes:
        levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (s + 7) // 8, at), count=s, bitorder="little").astype(bool))
        at += (s + 7) // 8
    return PerfectHash(levels), np.frombuffer(raw, _ENTRY, n, at)


_ENCODERS: dict[tuple[str, int], Encoder] = {}
kept(_ENCODERS)


def pieces_alone(model: dict) -> bool:
    """Whether a tokenizers model is known to encode each match of bpe.SPLIT by itself, whatever stands around it."""
    before, bpe = model.get("pre_tokenizer") or {}, model.get("model") or {}
    plain = not any(bpe.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
    whole = any(model.get(x) for x in ("normalizer", "truncation", "padding"))
    return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and bpe.get("type") == "BPE" and plain and not whole


#: Classes of a character in bpe.SPLIT: BLANK is U+0020, EDGE stands outside a text.
OTHER, LETTER, NUMBER, SPACE, BLANK, EDGE = range(6)


def classes(split: Callable[[str], list[tuple[str, tuple[int, int]]]]) -> np.ndarray:
    """The class of each code point, as a pre-tokenizer of SPLIT sees it: its Unicode may be another than a Python library's."""
    points = "".join(map(chr, [*range(0x20), *range(0x21, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]))  # no Unicode has letters, numbers or spaces elsewhere
    out = np.full(0x110000, OTHER, np.uint8)
    out[0x20] = BLANK
    for _, (i, j) in split(points):
        kind = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")) if len(split(x + points[i])) == 1), SPACE)
        out[np.frombuffer(points[i:j].encode("utf-32-le"), "<u4")] = kind
    return out


def cuts(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The matches of SPLIT in nonempty texts by column: the byte each begins at (and the end of all), how many each text has, and the texts' bytes joined.

    A match begins where the class changes, except after a blank, which belongs to what follows; at
    the last white space before something else; and around the contractions, which count where their
    apostrophe begins a match.
    """
    joined = "".join(texts)
    raw = joined.encode("utf-8")
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    first = np.cumsum([0, *map(len, texts)])
    kind = kinds[points]
    left, right = np.empty_like(kind), np.empty_like(kind)
    left[1:], right[:-1] = kind[:-1], kind[1:]
    left[first[:-1]] = right[first[1:] - 1] = EDGE
    blank = kind >= SPACE
    start = np.where(blank, (left < SPACE) | (left == EDGE) | (right < SPACE), (left != kind) & (left != BLANK))
    at = np.flatnonzero((points == ord("'")) & start & (right == LETTER))
    if len(at):
        more = np.append(points, np.zeros(2, points.dtype))
        one, two = more[at + 1], more[at + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
        long &= right[at + 1] == LETTER
        start[at[short | long] + 1] = False
        ends = np.concatenate([at[short] + 2, at[long] + 3])
        start[ends[ends < len(start)]] = True
    begin = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(begin, first))
    if len(raw) > len(joined):
        begin = np.flatnonzero(np.frombuffer(raw, np.int8) >= -64)[begin]  # other bytes go on with a character
    return np.append(begin, len(raw)), counts, raw


def _alphabet() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u4")
    out[shown] = shown
    out[out == 0] = 256 + np.arange(256 - len(shown))
    return out


def _column(offsets: np.ndarray, raw: bytes) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


class Encoder:
    """The tokenizers library, as encode(text, add_special_tokens=False) would give.

    A byte-level vocabulary encodes each match of its pattern by itself, so a text's ids are its
    pieces' ids joined, and the library's model tokenizes each distinct piece once while it stays
    cached. Pieces are told apart, looked up and joined by column. Texts with the string of an added
    token, and all texts of other models, go through the library whole.
    """

    def __init__(self, model: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        known = json.loads(model)
        self.tokenizer = Tokenizer.from_str(model)
        self.added = [x["content"] for x in known.get("added_tokens") or [] if x["content"]]
        self.kind, self.alone, self.alphabet = {2: "H", 4: "I"}[width], pieces_alone(known), _alphabet()
        self.model = self.tokenizer.model
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without offsets, where there is such a call
        self.kinds = classes(self.tokenizer.pre_tokenizer.pre_tokenize_str) if self.alone else None
        self.cache = PieceCache(self.pieces)

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.batch([text], add_special_tokens=False)[0].ids)

    def pieces(self, new: list[bytes]) -> list[bytes]:
        """The ids of each piece, straight from the library's model: an Encoding for each costs three times as much."""
        shown = self.alphabet[np.frombuffer(b"".join(new), np.uint8)].tobytes().decode("utf-32-le")
        ends = np.cumsum([0, *map(len, new)]).tolist()
        return [self._bytes([x.id for x in self.model.tokenize(shown[i:j])]) for i, j in itertools.pairwise(ends)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, some = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if t and (not self.alone or any(x in t for x in self.added)):
                out[i] = self.whole(t)
            elif t:
                some.append(i)
        if not some:
            return out
        at, counts, raw = cuts([texts[i] for i in some], self.kinds)
        found = _column(at, raw).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.cache.hold(set(distinct))
        made = list(map(self.cache.now.__getitem__, distinct))
        ids = _column(np.cumsum([0, *map(len, made)]), b"".join(made)).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.cumsum([0, *counts])].tolist()
        data = memoryview(ids.buffers()[2])
        for i, j, k in zip(some, ends, ends[1:]):
            out[i] = data[j:k].tobytes()
        return out


def _encoder(model: str, width: int) -> Encoder:
    key = (hashlib.sha256(model.encode()).hexdigest(), width)
    if key not in _ENCODERS:
        alone()
        _ENCODERS[key] = Encoder(model, width)
    return _ENCODERS[key]


def _writer(folder: str, model: str, end_id: int, width: int):
    def run(batches):
        encoder, shard = _encoder(model, width), TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        at, last, copy = 0, object(), 0
        with _file(folder, f"shard-{shard:05d}.ids") as f:
            for b in itertools.chain([first], batches):
                for part in _slices(b, 2_000_000):
                    ns, copies, offsets = [], [], []
                    for doc_id, x in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                        copy = copy + 1 if doc_id == last else 0
                        last = doc_id
                        n = len(x) // width + 1
                        ns.append(n), copies.append(copy), offsets.append(at)
                        at += n
                        f.write(x)
                        f.write(end)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(copies, pa.int64()), pa.array([shard] * len(ns), pa.int64()), pa.array(offsets, pa.int64()), pa.array(ns, pa.int64())], names=["doc_id", "copy", "shard", "offset", "n"])

    return run


def _bucket(h, buckets: int):
    return (mix(h + np.uint64(0xABC98388FB8FAC03)) % np.uint64(buckets)).astype(np.int64)


def _keys(doc_id: pa.Array, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Null ids are keys too: 0 with copies counted from 2^40."""
    null = doc_id.is_null().to_numpy(zero_copy_only=False)
    return doc_id.fill_null(0).to_numpy(), copy + null * (1 << 40)


def _bucketed(buckets: int):
    def run(batches):
        for b in batches:
            ids, copy = _keys(b.column(0), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(key_hash(ids, copy), buckets)), pa.array(ids), pa.array(copy), *b.columns[2:]], names=["bucket", "id", "copy", "shard", "offset", "n"])

    return run


def _index(folder: str):
    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        _put(folder, f"index-{bucket:05d}.mph", [index_bytes(*(t[c].to_numpy() for c in ("id", "copy", "shard", "offset", "n")))])
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "n": pa.array([len(t)], pa.int64())})

    return run


def _numbered(made: DataFrame, ends: list) -> DataFrame:
    """Count the copies of a doc_id on from one shard to the next. ends: of each shard, in order, its first and its last row."""
    before, more = None, []
    for r in ends:
        if before is not None and r.first.doc_id == before[0]:
            more.append((r.shard, before[1] + 1))
        carried = before[1] + 1 if before is not None and r.last.doc_id == r.first.doc_id == before[0] else 0
        before = r.last.doc_id, r.last["copy"] + carried
    if not more:
        return made
    firsts = {r.shard: r.first.doc_id for r in ends}
    base = made.sparkSession.createDataFrame([(s, firsts[s], n) for s, n in more], "shard long, first long, base long")
    out = made.join(F.broadcast(base), "shard", "left")  # at most a row a shard
    return out.select("doc_id", (F.col("copy") + F.when(F.col("base").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first")), F.col("base")).otherwise(0)).alias("copy"), "shard", "offset", "n")


@dataclass
class TokenFiles:
    """A written dataset: its folder and the keys (doc_id, copy) it holds."""

    folder: str
    keys: DataFrame


def write_tokens(docs: DataFrame, model: str, end_id: int = 0, folder: str | None = None, shards: int | None = None, shard_chars: int = 64_000_000) -> TokenFiles:
    """Encode docs (doc_id, text) with a tokenizers model (JSON) and write shards, index and shards.json.

    Null and empty texts have the end id alone. Rows that share a doc_id, or have none, keep their
    own keys (doc_id, copy); null ids come first. An empty table gives a dataset without shards.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    shards = shards or max(1, spark.sparkContext.defaultParallelism, -(-(total.chars or 0) // shard_chars))
    width = 2 if max((*json.loads(model)["model"]["vocab"].values(), end_id)) < 1 << 16 else 4
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))  # rows of one doc_id can fill several shards
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    schema = "doc_id long, copy long, shard long, offset long, n long"
    made = written(dealt.mapInArrow(_writer(folder, model, end_id, width), schema), "token-rows")
    ends = made.groupBy("shard").agg(F.sum("n").alias("n"), F.min_by(F.struct("doc_id"), "offset").alias("first"), F.max_by(F.struct("doc_id", "copy"), "offset").alias("last")).collect()  # a row a shard
    made = _numbered(made, sorted(ends, key=lambda r: r.shard))
    buckets = max(1, -(-total.n // BUCKET))
    keyed = made.mapInArrow(_bucketed(buckets), "bucket long, id long, copy long, shard long, offset long, n long")
    indexed = keyed.groupBy("bucket").applyInArrow(_index(folder), "bucket long, n long").agg(F.sum("n")).first()[0] or 0
    if indexed != total.n:
        raise RuntimeError(f"{indexed} of {total.n} documents are in the index")
    sizes = {r.shard: r.n for r in ends}
    last = max(sizes, default=-1)
    _put(folder, "shards.json", [json.dumps({"width": width, "buckets": buckets, "shards": [sizes.get(i, 0) for i in range(last + 1)]}).encode()])
    return TokenFiles(folder, made.select("doc_id", "copy"))


def layout(folder: str) -> dict:
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/shards.json") as f:
        return json.loads(f.read())


class Reader:
    """Constant-time access by key."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = _open(folder)
        self.layout = layout(folder)
        self.starts = np.cumsum([0, *self.layout["shards"]])
        self.kept: tuple[int, tuple[PerfectHash, np.ndarray]] | None = None
        self.file: tuple[int, object] | None = None

    def find(self, h: np.ndarray, bucket: int) -> np.ndarray:
        """Index entries of the hashes, all of one bucket; raises KeyError for one it doesn't hold."""
        if self.kept is None or self.kept[0] != bucket:
            with self.fs.open_input_stream(f"{self.root}/index-{bucket:05d}.mph") as f:
                self.kept = bucket, read_index(f.read())
        ph, entries = self.kept[1]
        slots = ph.slots(h)
        if (slots < 0).any() or (entries["print"][slots] != fingerprint(h)).any():
            raise KeyError("a key is not in the index")
        return entries[slots]

    def ids(self, shard: int, offset: int, n: int) -> np.ndarray:
        if self.file is None or self.file[0] != shard:
            self.file = shard, self.fs.open_input_file(f"{self.root}/shard-{shard:05d}.ids")
        width = self.layout["width"]
        raw = self.file[1].read_at(n * width, offset * width)
        return np.frombuffer(raw, f"<u{width}")

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray:
        """The ids of one document, its end id included."""
        ids, copies = _keys(pa.array([doc_id], pa.int64()), np.array([copy]))
        h = key_hash(ids, copies)
        e = self.find(h, int(_bucket(h, self.layout["buckets"])[0]))[0]
        return self.ids(int(e["shard"]), int(e["offset"]), int(e["n"]))


def _lookup(folder: str, buckets: int):
    def run(batches):
        reader = None
        for b in batches:
            if not len(b):
                continue
            reader = reader or Reader(folder)
            ids, copy = _keys(b.column(0), b.column(1).to_numpy())
            h = key_hash(ids, copy)
            own = _bucket(h, buckets)
            found = np.zeros(len(h), _ENTRY)
            for x in np.unique(own):
                found[own == x] = reader.find(h[own == x], int(x))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[c].astype(np.int64)) for c in ("shard", "offset", "n"))], names=["doc_id", "shard", "offset", "n"])

    return run


def _read(folder: str):
    def run(batches):
        reader = None
        for b in batches:
            if not len(b):
                continue
            reader = reader or Reader(folder)
            shard, offset, n = (b.column(i).to_numpy() for i in (1, 2, 3))
            crc = [zlib.crc32(reader.ids(int(s), int(o), int(k)).astype("<u4").tobytes()) for s, o, k in zip(shard, offset, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(reader.starts[shard] + offset), b.column(3), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(files: TokenFiles) -> DataFrame:
    """Per document, from the files by way of the index: doc_id, start (ids before it), n_tokens (end id included), ids_crc32 (of the ids as 32-bit)."""
    spark = files.keys.sparkSession
    at = layout(files.folder)
    parts = max(spark.sparkContext.defaultParallelism, len(at["shards"]))
    bucket = files.keys.mapInArrow(_by_bucket(at["buckets"]), "doc_id long, copy long, bucket long")
    places = bucket.repartition(max(at["buckets"], 1), "bucket").sortWithinPartitions("bucket").select("doc_id", "copy").mapInArrow(_lookup(files.folder, at["buckets"]), "doc_id long, shard long, offset long, n long")
    dealt = places.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(_read(files.folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _by_bucket(buckets: int):
    def run(batches):
        for b in batches:
            ids, copy = _keys(b.column(0), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_bucket(key_hash(ids, copy), buckets))], names=["doc_id", "copy", "bucket"])

    return run
