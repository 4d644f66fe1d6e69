"""MinHash near-dedup: chosen-path set similarity join (operator 4).

Every document is the set of its k-word shingles. Documents with equal sets are one class. Class
representatives descend independent random trees: a node picks one coordinate of the minwise
signature, and with probability 1/threshold - 1 a second, and deals its documents out by the
minwise token there. Nodes with few documents are compared exhaustively; large ones go on branching.

Documents of a node are compared by parity sketches: bit h(x) mod m of a set is the parity of its
shingles there, so the bits in which two sketches differ are never more than the shingles in which
the two sets differ. A pair with more differing bits than a link may have is certainly none, and none
of the links is lost here. m is at least four times the set, so what passes has a similarity of about
0.77 or more. Candidates are confirmed on the full shingle sets, never on sketches.

A node that stays large holds documents much alike. There each document is tried against about 64
sampled ones. Where the links so far leave a node in several components, the documents outside its
largest one meet all of the node in blocks of about 64. Branching on would lose pairs with depth, so
the documents of nodes with too many outside are dealt out by their rarest shingles instead: two sets
at the threshold always share one of those (prefix filter), and only documents that share one meet, in
blocks again. That is exact; it costs rows by block where thousands of unlinked documents have a rare
shingle in common.

Confirmation goes in three rounds: the best candidate of each document, the best one of any two
components that the links so far leave, and then all candidates that can still join two. A set travels
once for each of its document's pairs, to the other one.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, alone, components, kept, mix, rolling, words, written

WIDTH = 64  # coordinates of the signature that trees branch on
TREES = 12
LEAF = 16  # documents of a node compared exhaustively
LEVELS = 3  # before large nodes are tried by sampled documents
BLOCK = 64  # sampled documents, or those outside the largest component, that a row meets at once
CHUNK = 256  # documents of a large node that go to a Python worker as one, about
STAR = 256  # sets that meet one document's set in one place
STRAYS = 1024  # outside the largest component; documents of a node with more are dealt out by rare shingles
STRONG = 0.9  # share of the differences a link may have below which a candidate is taken for certain when one is chosen
LIGHT, HEAVY = 32768, 2048  # class representatives for each task that writes a table of numbers, and one of sketches, sets or pairs
_A = (np.random.default_rng(4).integers(1, 2**63, WIDTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.default_rng(5).integers(0, 2**63, WIDTH, dtype=np.uint64)
_HASH = WordHash()
kept(_HASH)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; under k words the whole sequence is one shingle; no words: empty."""
    h = _HASH.of(words(text, lower=True))
    if 0 < len(h) < k:
        return rolling(h, len(h))
    return np.unique(rolling(h, k))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of the set under each of WIDTH functions."""
    low = np.full(WIDTH, 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            low = np.minimum(low, ((_A[:, None] * s[i : i + 2048] + _B[:, None]) >> np.uint64(32)).min(axis=1))
    return low.astype(np.uint32)


def parity(s: np.ndarray) -> bytes:
    """The parity sketch of a set: a power of two of bits, four for each shingle or more and 512 at least."""
    m = max(512, 1 << (4 * len(s) - 1).bit_length())
    bits = np.bincount((mix(s + np.uint64(78)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of an Arrow column, by length."""

    def __init__(self, column: pa.Array):
        self.size = pc.binary_length(column).to_numpy(zero_copy_only=False)
        self.at, self.rows = np.zeros(len(column), np.int64), {}
        for size in np.unique(self.size):
            there = np.flatnonzero(self.size == size)
            self.at[there] = np.arange(len(there))
            self.rows[size] = np.frombuffer(b"".join(column.take(pa.array(there)).to_pylist()), np.uint64).reshape(len(there), -1)

    def take(self, i: np.ndarray, size: int) -> np.ndarray:
        """Sketches of one length, folded to a shorter one: parities of halves add up."""
        x = self.rows[self.size[i[0]]][self.at[i]]
        while x.shape[1] * 8 > size:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x


def differing(a: Sketches, i: np.ndarray, b: Sketches, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair (i of a, j of b): differing bits and bits compared."""
    out, short = np.zeros(len(i), np.int64), np.minimum(a.size[i], b.size[j]) if len(i) else np.zeros(0, np.int64)
    kinds = a.size[i].astype(np.int64) << 32 | b.size[j].astype(np.int64) if len(i) else short
    for kind in np.unique(kinds):
        there = np.flatnonzero(kinds == kind)
        size = int(short[there[0]])
        step = max(1, (1 << 23) // size)
        for at in range(0, len(there), step):
            t = there[at : at + step]
            out[t] = np.bitwise_count(a.take(i[t], size) ^ b.take(j[t], size)).sum(axis=1)
    return out, short.astype(np.int64) * 8


def alike(a: Sketches, na: np.ndarray, i: np.ndarray, b: Sketches, nb: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that can be links, and their ranks: 0 where surely one, else the more the less likely."""
    some = np.flatnonzero(100 * np.minimum(na[i], nb[j]) >= percent * np.maximum(na[i], nb[j]))
    bits, m = differing(a, i[some], b, j[some])
    both = (na[i[some]] + nb[j[some]]) * (100 - percent)
    ok = np.flatnonzero(bits * (100 + percent) <= both)
    some, bits, m, both = some[ok], bits[ok], m[ok], both[ok]
    with np.errstate(divide="ignore"):
        share = -0.5 * m * np.log(np.maximum(1 - 2 * bits / m, 1e-9)) * (100 + percent) / np.maximum(both, 1)
    return some, np.where(share <= STRONG, 0, np.minimum(1000 * share, 1e6)).astype(np.int64)


def _features(k: int):
    def run(batches):
        alone(_HASH)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(b), 512):
                n, keys, sigs, sketches = [], [], [], []
                for t in texts.slice(at, 512):
                    s = shingle_set(t.as_py(), k)
                    n.append(len(s))
                    if not len(s):
                        keys.append(None), sigs.append(None), sketches.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        keys.append(np.array([mix(s).sum(), mix(s + np.uint64(77)).sum()], np.uint64).tobytes())
                    m = minwise(s)
                    sigs.append(m.tobytes())
                    sketches.append(parity(s))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 512), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n", "key", "sig", "sketch"],
                )

    return run


def _children(nodes: np.ndarray, sigs: np.ndarray, second: float):
    """Row numbers and child nodes: each node picks its coordinates itself, alike for all its documents."""
    with np.errstate(over="ignore"):
        one = mix(nodes + np.uint64(11)) % np.uint64(WIDTH)
        two = (one + np.uint64(1) + mix(nodes + np.uint64(12)) % np.uint64(WIDTH - 1)) % np.uint64(WIDTH)
        both = np.flatnonzero(mix(nodes + np.uint64(13)) < np.uint64(int(second * 2**64)))
        rows = np.concatenate([np.arange(len(nodes)), both])
        at = np.concatenate([one, two[both]])
        value = sigs[rows, at.astype(np.int64)].astype(np.uint64)
        return rows, mix(mix(nodes[rows] ^ mix(at + np.uint64(101))) + value)


def _roots(trees: int, second: float):
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                n = len(part)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(n, WIDTH)
                nodes = mix(np.repeat(np.arange(1, trees + 1, dtype=np.uint64), n))
                rows, child = _children(nodes, np.tile(sigs, (trees, 1)), second)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column(0).take(pa.array(rows % n))], names=["node", "rep"])

    return run


def _branch(second: float):
    def run(batches):
        for b in batches:
            if len(b):
                sigs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(len(b), WIDTH)
                rows, child = _children(b.column(0).to_numpy().view(np.uint64), sigs, second)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1).take(pa.array(rows))], names=["node", "rep"])

    return run


def _documents(lists: pa.Array):
    """Reps, sizes, components and sketches of the documents in an Arrow column of arrays, and where each array starts."""
    flat = lists.flatten()
    reps, n, comp = (flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
    return reps, n, comp, Sketches(flat.field(3)), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])


def _best(rank: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The place of one pair for each value of the keys: of the least rank, then the first."""
    order = np.lexsort((rank, *keys))
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])]) if len(order) else np.zeros(0, bool)
    return order[new]


def _pairs(u, v, rank):
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(rank, pa.int64())], names=["u", "v", "rank"])


FIRST, ONE, ALL = range(3)  # of each document its best pair; of two components their best pair in a place; all pairs of two components


def _compare(percent: int, mode: int):
    """Nodes (array of rep, n, comp, sketch) to candidate pairs, as the mode says."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 128):
                reps, n, comp, sketches, starts = _documents(b.column(0).slice(at, 128))
                i, j = [], []
                sizes = np.diff(starts)
                for size in np.unique(sizes):
                    x, y = np.triu_indices(size, 1)
                    there = starts[:-1][sizes == size]
                    i.append((there[:, None] + x).ravel()), j.append((there[:, None] + y).ravel())
                i, j = np.concatenate(i), np.concatenate(j)
                i, j = np.where(reps[i] > reps[j], i, j), np.where(reps[i] > reps[j], j, i)
                some = np.flatnonzero((reps[i] != reps[j]) & ((mode == FIRST) | (comp[i] != comp[j])))
                i, j = i[some], j[some]
                ok, rank = alike(sketches, n, i, sketches, n, j, percent)
                yield _chosen(mode, reps[i[ok]], reps[j[ok]], comp[i[ok]], comp[j[ok]], rank)

    return run


def _chosen(mode: int, u, v, cu, cv, rank) -> pa.RecordBatch:
    if mode != ALL:
        order = np.lexsort((v, u))
        u, v, cu, cv, rank = (x[order] for x in (u, v, cu, cv, rank))
        there = _best(rank, u) if mode == FIRST else _best(rank, np.maximum(cu, cv), np.minimum(cu, cv))
        u, v, rank = u[there], v[there], rank[there]
    return _pairs(u, v, rank)


def _meet(percent: int, mode: int):
    """Two arrays of rep, n, comp, sketch to candidate pairs of one of each, as the mode says."""

    def run(batches):
        for b in batches:
            for at in range(len(b)):
                reps, n, comp, sketches, _ = _documents(b.column(0).slice(at, 1))
                others, size, theirs, more, _ = _documents(b.column(1).slice(at, 1))
                i, j = np.repeat(np.arange(len(reps)), len(others)), np.tile(np.arange(len(others)), len(reps))
                some = np.flatnonzero((reps[i] != others[j]) & ((mode == FIRST) | (comp[i] != theirs[j])))
                i, j = i[some], j[some]
                ok, rank = alike(sketches, n, i, more, size, j, percent)
                u, v, cu, cv = reps[i[ok]], others[j[ok]], comp[i[ok]], theirs[j[ok]]
                if mode != FIRST:
                    u, v = np.maximum(u, v), np.minimum(u, v)
                yield _chosen(mode, u, v, cu, cv, rank)

    return run


def _sets(k: int):
    """Rows of rep, center, salt and text to the same with the set for the text."""

    def run(batches):
        text, found = None, shingle_set(None, k).tobytes()
        for b in batches:
            for at in range(0, len(b), 256):
                part, out = b.slice(at, 256), []
                for t in part.column(3):
                    if t.as_py() != text:
                        text = t.as_py()
                        found = shingle_set(text, k).tobytes()
                    out.append(found)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.binary())], names=["rep", "center", "salt", "shingles"])

    return run


def _shingles(k: int):
    """Rows of rep, part and text to a row for each shingle, with the size of its set."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                sets = [shingle_set(t.as_py(), k) for t in part.column(2)]
                n = np.array([len(s) for s in sets], np.int64)
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "part", "n", "node"])

    return run


def _links(percent: int):
    """Rows of rep, center, salt, shingles in order, a center's own first, to the links (u, v) of its other documents with it."""

    def run(batches):
        now, own = None, []
        for b in batches:
            us, vs = [], []
            for rep, center, salt, raw in zip(*(b.column(c) for c in range(4))):
                rep, here, s = rep.as_py(), (center.as_py(), salt.as_py()), np.frombuffer(raw.as_py(), np.uint64)
                if here != now:
                    now, own = here, []
                if rep == here[0]:
                    if not any(np.array_equal(s, t) for t in own):
                        own.append(s)
                    continue
                for t in own:
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        us.append(rep), vs.append(here[0])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _sized(front: DataFrame, tasks: int) -> DataFrame:
    """(node, rep, c): rows of nodes with company."""
    size = front.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
    return written(front.join(size, "node"), "sized", tasks=tasks)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the least doc_id reachable over links, kept is doc_id = component_id. Null or
    wordless texts have no shingles and no links. Rows with one doc_id are one document (each row
    is returned); a null doc_id takes part in nothing: component_id null, kept true. An empty table
    gives an empty result. A link is lost only where no tree brings the two documents together in its
    first levels: at exactly the threshold about one in ten thousand, whatever the size of the nodes.
    """
    second = 100 / percent - 1
    feats = written(docs.select("doc_id", "text").mapInArrow(_features(k), "doc_id long, n long, key binary, sig binary, sketch binary"), "features")
    known = feats.where("n > 0 AND doc_id IS NOT NULL")
    # Equal keys have equal sets, so any row's signature will do.
    reps = written(known.groupBy("key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sig", "sketch"))), "reps")
    # As many tasks write a table as its documents ask for, at least some for each core.
    count, cores = reps.count(), docs.sparkSession.sparkContext.defaultParallelism
    light, heavy = max(2 * cores, math.ceil(count / LIGHT)), max(4 * cores, math.ceil(count / HEAVY))
    member = known.select("doc_id", "key").distinct().join(reps.select("key", "rep"), "key").select("doc_id", "rep")
    sketches = reps.select("rep", "n", "sketch")
    pairs, entry = "u long, v long, rank long", F.struct("rep", "n", "comp", "sketch")

    def branched(level: DataFrame) -> DataFrame:
        rows = level.select("node", "rep").join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig")
        return _sized(written(rows.mapInArrow(_branch(second), "node long, rep long"), "front", tasks=heavy), light)

    def with_comp(nodes: DataFrame, comp: DataFrame | None) -> DataFrame:
        """Node rows with their component, before any link the document itself."""
        return nodes.withColumn("comp", F.col("rep")) if comp is None else nodes.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def grouped(nodes: DataFrame, comp: DataFrame | None) -> DataFrame:
        """Small nodes of two components or more as arrays of at most LEAF documents."""
        rows = with_comp(nodes, comp)
        if comp is not None:
            rows = written(rows, "small", tasks=light)
            rows = rows.join(rows.groupBy("node").agg((F.min("comp") < F.max("comp")).alias("open")).where("open").select("node"), "node")
        return rows.join(sketches, "rep").groupBy("node").agg(F.collect_list(entry).alias("docs")).select("docs")

    def met(rows: DataFrame, mode: int) -> DataFrame:
        """Rows of nodes (node, rep, comp, c, n_some, meets, some) that meet others against the `some` rows of the same node, in each of its blocks, which hold about BLOCK of these n_some.

        The c rows of a node are dealt to chunks of about CHUNK; each of its blocks goes to each chunk, so no key holds a whole node.
        """
        chunks = F.ceil(F.col("c") / CHUNK).cast("int")
        docs_of = rows.where("meets").select("node", "rep", "comp", F.pmod(F.xxhash64("rep", F.lit(3)), chunks).cast("int").alias("chunk")).join(sketches, "rep").groupBy("node", "chunk").agg(F.collect_list(entry).alias("docs"))
        lists = rows.where("some").select("node", "rep", "comp", chunks.alias("chunks"), F.pmod(F.xxhash64("rep", F.lit(2)), F.greatest(F.ceil(F.col("n_some") / BLOCK), F.lit(1))).alias("block")).join(sketches, "rep").groupBy("node", "block").agg(F.first("chunks").alias("chunks"), F.collect_list(entry).alias("others"))
        lists = lists.select("node", "others", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        return docs_of.join(lists, ["node", "chunk"]).select("docs", "others").mapInArrow(_meet(percent, mode), pairs)

    def confirmed(found: DataFrame, name: str) -> DataFrame:
        """Pairs (u, v) that are links on the full sets. Each set of a u goes to its v, whose own set goes there once for STAR others."""
        salts = found.groupBy(F.col("v").alias("center")).agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
        legs = found.select(F.col("u").alias("rep"), F.col("v").alias("center")).join(salts, "center").select("rep", "center", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"))
        own = salts.select(F.col("center").alias("rep"), "center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        texts = docs.select(F.col("doc_id").alias("rep"), "text").join(written(legs.unionByName(own), f"{name}-legs", tasks=light), "rep").select("rep", "center", "salt", "text")
        sets = texts.mapInArrow(_sets(k), "rep long, center long, salt int, shingles binary")
        there = sets.repartition("center", "salt").sortWithinPartitions("center", "salt", F.col("rep") != F.col("center"))
        return written(there.mapInArrow(_links(percent), "u long, v long"), f"{name}-links", records=256, tasks=heavy).distinct()

    def apart(found: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs of two components, with these as cu and cv."""
        for end in ("u", "v"):
            found = found.join(comp.select(F.col("rep").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        return found.where("cu <> cv")

    def joined(links: DataFrame, comp: DataFrame, name: str) -> DataFrame:
        """The components with further links: those of the graph of components, carried over to the documents."""
        links = written(apart(links, comp).select(F.col("cu").alias("u"), F.col("cv").alias("v")), f"{name}-apart", tasks=light)
        if links.isEmpty():
            return comp
        to = components(links, name, light).withColumnRenamed("node", "comp")
        rows = comp.unionByName(links.select(F.explode(F.array("u", "v")).alias("rep")).distinct().withColumn("comp", F.col("rep"))).distinct()
        return written(rows.join(to, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp")), f"{name}-comp", tasks=light)

    def rare(rest: DataFrame, comp: DataFrame) -> DataFrame:
        """Rows that meet by rare shingles, as met() takes them.

        In an order of all shingles, rarest first, the larger set of a pair at the threshold shares one of its first `probe` with the first `held` of the smaller one.
        Shingles of one document come first and are only counted.
        """
        texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("part"), "text").join(rest.select("rep").distinct(), "rep", "left_semi")
        tokens = written(texts.mapInArrow(_shingles(k), "rep long, part long, n long, node long"), "shingles", tasks=heavy)
        often = tokens.groupBy("node").agg(F.count("*").alias("f")).where("f > 1")
        sets = tokens.join(often, "node").groupBy("rep", "part", "n").agg(F.sort_array(F.collect_set(F.struct("f", "node"))).alias("s"))
        first = sets.selectExpr("rep", "s", "n - size(s) AS own", f"n - ({percent} * n + 99) div 100 + 1 AS probe", f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1 AS held")
        first = first.selectExpr("rep", "held - own AS held", "posexplode(slice(s, 1, int(greatest(probe - own, 0)))) AS (at, x)").groupBy("rep", F.col("x.node").alias("node")).agg(F.bool_or(F.col("at") < F.col("held")).alias("held"))
        some = first.groupBy("node").agg(F.count("*").alias("c"), F.bool_or("held").alias("any")).where("c > 1 AND any").select("node")
        rows = written(with_comp(first.join(some, "node"), comp), "rare", tasks=heavy)
        most = F.struct("k", "comp")
        kinds = rows.groupBy("node", "comp").agg(F.count("*").alias("k"), F.count_if("held").alias("h")).groupBy("node").agg(F.max_by("comp", most).alias("most"), F.max_by("h", most).alias("inside"), (F.sum("h") - F.max_by("h", most)).alias("outside"), F.count("*").alias("comps"), F.sum("k").alias("c")).where("comps > 1")
        rows = written(rows.join(kinds, "node"), "rare-open", tasks=heavy)
        no, of = F.lit(False), ("rep", "comp", "c")
        outside = rows.select(F.xxhash64("node", F.lit(1)).alias("node"), *of, F.col("outside").alias("n_some"), (~no).alias("meets"), F.expr("held AND comp <> most").alias("some"))
        return outside.unionByName(rows.select(F.xxhash64("node", F.lit(2)).alias("node"), *of, F.col("inside").alias("n_some"), F.expr("comp <> most").alias("meets"), F.expr("held AND comp = most").alias("some")))

    def alike_pairs(comp: DataFrame, mode: int) -> DataFrame:
        """Candidates of two components in all nodes, by the components so far."""
        rows = written(with_comp(large, comp), "large", tasks=light)
        kinds = rows.groupBy("node", "comp").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), (F.sum("k") - F.max("k")).alias("strays")).where("strays > 0")
        rows = written(rows.join(kinds, "node"), "open", tasks=light)
        rest = rows.where(F.col("strays") > STRAYS)
        rows = rows.where(F.col("strays") <= STRAYS).select("node", "rep", "comp", "c", F.col("strays").alias("n_some"), F.lit(True).alias("meets"), F.expr("comp <> most").alias("some"))
        if not rest.isEmpty():
            rows = rows.unionByName(rare(rest, comp))
        return grouped(small, comp).mapInArrow(_compare(percent, mode), pairs).unionByName(met(rows, mode))

    level, small = _sized(reps.select("rep", "sig").mapInArrow(_roots(trees, second), "node long, rep long"), light), []
    for _ in range(LEVELS - 1):
        small.append(level.where(F.col("c") <= LEAF))
        level = branched(level.where(F.col("c") > LEAF))
    small = reduce(DataFrame.unionByName, [*small, level.where(F.col("c") <= LEAF)]).select("node", "rep")
    large = level.where(F.col("c") > LEAF)

    sampled = F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("c") / BLOCK)) == 0
    tried = met(with_comp(large, None).select("*", F.lit(0).alias("n_some"), F.lit(True).alias("meets"), sampled.alias("some")), FIRST)
    found = grouped(small, None).mapInArrow(_compare(percent, FIRST), pairs).unionByName(tried)
    links = confirmed(written(found, "first", records=64, tasks=heavy).groupBy("u").agg(F.min_by("v", F.struct("rank", "v")).alias("v")), "first")
    comp = written(components(links, "stars", light).select(F.col("node").alias("rep"), F.col("component").alias("comp")), "comp", tasks=light)
    some = apart(written(alike_pairs(comp, ONE), "some", records=64, tasks=heavy).distinct(), comp)
    some = written(some.groupBy("cu", "cv").agg(F.min_by(F.struct("u", "v"), F.struct("rank", "u", "v")).alias("p")).select("p.u", "p.v"), "second", tasks=light)
    if not some.isEmpty():
        comp = joined(confirmed(some, "second"), comp, "second")
        last = written(written(alike_pairs(comp, ALL), "rest", records=64, tasks=heavy).select("u", "v").distinct().join(some, ["u", "v"], "left_anti"), "last", tasks=heavy)
        if not last.isEmpty():
            comp = joined(confirmed(last, "last"), comp, "last")
    # A document with several rows of different text belongs to several classes: its rows join them.
    final = member.join(comp, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    final = final.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = feats.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
