"""Operator 3, n-gram Jaccard join by signature trees.

Two documents link when their sets of word shingles have a Jaccard similarity of num / den or more. The join is exact:

1. Classes. Documents with equal sets are one class, whose least doc_id stands for it.
2. Groups. Sets that link differ in at most k shingles, k from their sizes. Shingles are dealt to k + 1 + t parts by hash, so
   linking sets agree on t + 1 parts. Each set sends a key for each part, for its own size band and the one below. How many
   documents have a key is the same for all that have it; so each set can do without its empty parts and its most common keys, t
   in all: of the parts that two linking sets agree on, one is rarer than what either leaves out. What documents share in passing, like a
   frequent passage, so leaves no trace, while copies keep their rarest keys. Tasks combine very common keys before the shuffle. All sets with a key gather around the least of them, their hub: any two that can link are in one hub's group.
3. Trees. Each group's sets hang in a binary signature tree, ordered by size: a node has the OR of its sets' token bitmaps,
   their size range and the most tokens that share bits. Two nodes are walked together and dropped when their largest
   possible overlap is too small for their sizes, or when all their sets are known to be connected. Leaves compare sets.
   Groups over BLOCK sets are dealt to blocks that hold the hub as well; sets that then are outside their group's main
   component are walked against all blocks. No task gets an unbounded group.
4. Components of the found links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Sets, and shingles of all of them together, in a block of a large group.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
#: Keys a task gathers before it combines and sends them.
GATHERED = 400_000
LEAF, SALTS = 4, 64
#: Levels of how many documents have a key: 1 for two or three, 2 for four to seven and so on; the last has no upper end. A task
#: combines the keys that are of the last level in it alone.
LEVELS = 6
COMMON = 1 << LEVELS
#: Ids of grouped sets up to which they are broadcast to where the texts are; beyond it texts move to the ids.
BROADCAST_IDS = 1_000_000
U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * B
    x = (x ^ (x >> U(27))) * C
    return x ^ (x >> U(31))


class Words(dict):
    """64-bit hashes of words; forgets all when it has many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text: words are lower-cased in A-Z and parted by ASCII white space."""

    def __init__(self, width: int):
        self.width, self.words = width, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, U)
        w = np.fromiter(map(self.words.__getitem__, words), U, len(words))
        if len(w) < self.width:
            h = np.full(1, len(w), U)
            for x in w:
                h = mix(h * A + x)
            return h
        n, h = len(w) - self.width + 1, np.zeros(1, U)
        for k in range(self.width):
            h = (h + w[k : k + n]) * A
            h = h ^ (h >> U(32))
        return np.unique(mix(h))


class Bands:
    """Size bands in which linking sets are in one or adjacent ones, with the differences k and spare parts t of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.floor = num, den, [1]

    def of(self, n: int) -> int:
        while self.floor[-1] <= n:
            self.floor.append(self.floor[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.floor, n, "right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        k = (self.floor[band + 1] - 1) * (self.den - self.num) // self.num
        return k, 1 + k * 3 // 20

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Keys of the parts in the own band and the one below, a key's last bit telling bands apart; and for either value of that
        bit, how many parts besides its empty ones the set can do without."""
        out, spare, own = [], [0, 0], self.of(len(s))
        x = mix(s ^ A)
        for band in (own, own - 1):
            if band < 0:
                continue
            k, t = self.parts(band)
            if not k:
                continue  # only equal sets link here, and they are one class
            m = k + 1 + t
            part = ((x >> U(32)) * U(m)) >> U(32)
            order = np.argsort(part, kind="stable")
            sums = np.concatenate([np.zeros(1, U), np.cumsum(x[order], dtype=U)])
            n = np.bincount(part.astype(np.int64), minlength=m)
            ends = np.cumsum(n)
            total = sums[ends] - sums[ends - n]
            names = mix(total ^ mix(np.arange(m, dtype=U) * A + np.full(1, band, U) * B))
            names = (names & ~U(1)) | U(band & 1)
            spare[band & 1] = t - int((n == 0).sum())
            out.append(names if spare[band & 1] < 0 else names[n > 0])
        return np.concatenate(out) if out else np.zeros(0, U), spare


def set_hash(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)


SENT = "kind int, bucket int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary"
GOT = "kind int, c0 long, c1 long, c2 long, c3 long, c4 long, c5 long"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds, buckets, cols = zip(*rows, strict=True)
    blobs = [[c[k].tobytes() if k < len(c) else None for c in cols] for k in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["kind", "bucket", *(f"c{k}" for k in range(6))])


def _unpacked(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(cols[0]), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind), pa.int32()), *(pa.array(cols[k].astype(np.int64)) if k < len(cols) else none for k in range(6))], ["kind", *(f"c{k}" for k in range(6))])


def runs(keys: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries in order of key and doc; where keys begin; and for each entry its key's least doc and documents in all."""
    order = np.lexsort((docs, keys))
    keys, docs, counts = keys[order], docs[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(counts, at) if len(at) else counts
    which = np.cumsum(new) - 1
    return keys, docs, counts, new, docs[at][which], total[which]


def summed(*cols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of cols, with the sums of n."""
    order = np.lexsort(cols[::-1])
    cols, n = [c[order] for c in cols], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return *(c[at] for c in cols), np.add.reduceat(n, at) if len(at) else n


def keyed(docs: DataFrame, width: int, num: int, den: int, bits: int) -> DataFrame:
    """Packed rows, by kind: 0 (key, doc, documents that it stands for); 1 (least doc, doc, band bit, common keys) of keys that the
    task combined as it has COMMON documents with them; 2 (doc, shingles, set hash twice, spare parts twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        shingle, bands = Shingler(width), Bands(num, den)
        keys, ids, about, seen, gathered = [], [], [], set(), 0

        def sent():
            rows = []
            d = np.concatenate([*ids, np.zeros(0, np.int64)])
            k, d, c, new, hub, total = runs(np.concatenate([*keys, np.zeros(0, U)]), d, np.ones(len(d), np.int64))
            hot = total >= COMMON
            spread = (int(k[0] >> U(40)) if len(k) else len(about)) % (1 << bits)
            if hot.any():
                rows.append((1, spread, summed(hub[hot], d[hot], (k[hot] & U(1)).astype(np.int64), n=np.where(new[hot], 0, 1))))
                c = np.where(hot, total, 1)
                keep = new | ~hot
                k, d, c = k[keep], d[keep], c[keep]
            bucket = (k >> U(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), bucket[1:] != bucket[:-1]]))
            for lo, hi in zip(at, [*at[1:], len(k)] if len(k) else [], strict=True):
                rows.append((0, int(bucket[lo]), (k[lo:hi], d[lo:hi], c[lo:hi])))
            if about:
                rows.append((2, spread, tuple(np.array(x, np.int64) for x in zip(*about, strict=True))))
            for x in (keys, ids, about, seen):
                x.clear()
            return [_packed(rows[i : i + 2000]) for i in range(0, len(rows), 2000)]

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle(text)
                h, k, spare = set_hash(s), None, [0, 0]
                if len(s):
                    k, spare = bands.keys(s)
                about.append((doc, len(s), *h, *spare))
                if k is not None and h not in seen:
                    seen.add(h)
                    keys.append(k)
                    ids.append(np.full(len(k), doc, np.int64))
                    gathered += len(k)
                if gathered > GATHERED or len(about) > 200_000:
                    yield from sent()
                    gathered = 0
        if about:
            yield from sent()

    return docs.mapInArrow(run, SENT)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket, unpacked. Kind 0 now is (hub, doc, band bit, level of the keys, number of keys) of keys with
    several documents; the hub itself is among them."""
    common.lean()
    for t in common.grouped_stream(batches, ["bucket"]):
        parts = [[np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for kind, _, *cols in zip(*(c.to_pylist() for c in t.columns), strict=True):
            own = [np.frombuffer(c, np.int64) for c in cols if c is not None]
            if kind == 0:
                for x, c in zip(parts, (own[0].view(U), *own[1:]), strict=True):
                    x.append(c)
            else:
                yield _unpacked(kind, *own)
        k, d, _, _, hub, total = runs(*(np.concatenate(x) for x in parts))
        several = total > 1
        if several.any():
            k, d, hub, total = k[several], d[several], hub[several], total[several]
            yield _unpacked(0, *summed(hub, d, (k & U(1)).astype(np.int64), np.minimum(LEVELS, np.frexp(total)[1] - 1).astype(np.int64), n=np.ones(len(d), np.int64)))


def _bits(s: np.ndarray, log: int) -> np.ndarray:
    out = np.zeros(1 << log, bool)
    out[(s >> U(64 - log)).astype(np.int64)] = True
    return out


class Tree:
    """Sets in order of size under a binary tree; nodes are (lo, hi, OR of bitmaps, least size, largest size, most shared bits)."""

    def __init__(self, n: list[int], bits: list[np.ndarray], sets: list[np.ndarray] | None = None):
        least = min((len(b) for b in bits), default=64)
        rows = [b if len(b) == least else b.reshape(least, -1).any(1) for b in bits]  # the bitmap of shorter leading bits
        maps = np.packbits(np.array(rows, bool).reshape(len(n), least), axis=1).view(U)
        size = np.array(n, np.int64)
        order = np.lexsort((*maps.T[:3], size))
        self.order, self.n, self.maps = order, size[order], maps[order]
        self.sets = [sets[i] for i in order] if sets is not None else None
        self.shared = self.n - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.root = self._node(0, len(n)) if len(n) else None

    def _node(self, lo: int, hi: int) -> tuple:
        own = (lo, hi, np.bitwise_or.reduce(self.maps[lo:hi]), int(self.n[lo]), int(self.n[hi - 1]), int(self.shared[lo:hi].max()))
        mid = (lo + hi) // 2
        return (*own, *((self._node(lo, mid), self._node(mid, hi)) if hi - lo > LEAF else (None, None)))


    def one(self, i: int) -> tuple:
        """A set as a node."""
        return i, i + 1, self.maps[i], int(self.n[i]), int(self.n[i]), int(self.shared[i])


class Links:
    """Walks trees in pairs and unites what links; found: the pairs that joined two components."""

    def __init__(self, ids: list[int], num: int, den: int):
        self.up, self.num, self.den, self.found, self.compared = {i: i for i in ids}, num, den, [], 0

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)

    def one(self, ids: list[int]) -> int | None:
        """The component that all of ids are in, if it is one."""
        top = self.top(ids[0])
        return top if all(self.top(i) == top for i in ids[1:]) else None

    def can(self, x: tuple, y: tuple) -> bool:
        if self.den * x[4] < self.num * y[3] or self.den * y[4] < self.num * x[3]:
            return False
        most = min(x[4], y[4], int(np.bitwise_count(x[2] & y[2]).sum()) + min(x[5], y[5]))
        return (self.num + self.den) * most >= self.num * (x[3] + y[3])

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        self.compared += 1
        if len(a) > len(b):
            a, b = b, a
        if self.den * len(a) < self.num * len(b):
            return False
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def walk(self, s: Tree, ids: list[int], t: Tree | None = None, others: list[int] | None = None) -> None:
        """ids, others: in the order of their tree's sets. Without t, s against itself."""
        if s.root is None or t is not None and t.root is None:
            return
        stack = [(s.root, (t or s).root)]
        t2, others = t or s, ids if t is None else others
        while stack:
            x, y = stack.pop()
            same = t is None and x is y
            c = self.one(ids[x[0] : x[1]])
            if c is not None and (same or c == self.one(others[y[0] : y[1]])):
                continue
            if not same and not self.can(x, y):
                continue
            if x[6] is None and y[6] is None:
                for i in range(x[0], x[1]):
                    for j in range(max(y[0], i + 1) if t is None else y[0], y[1]):
                        if self.top(ids[i]) != self.top(others[j]) and self.linked(s.sets[i], t2.sets[j]):
                            self.found.append((ids[i], others[j]))
                            self.unite(ids[i], others[j])
            elif same:
                stack += [(x[6], x[7]), (x[7], x[7]), (x[6], x[6])]  # the halves first
            elif y[6] is None or x[6] is not None and x[1] - x[0] >= y[1] - y[0]:
                stack += [(x[6], y), (x[7], y)]
            else:
                stack += [(x, y[6]), (x, y[7])]


def _log(sets: list[np.ndarray]) -> int:
    return min(15, max(6, int(2 * max((len(s) for s in sets), default=1) - 1).bit_length()))


def walked(num: int, den: int):
    """For mapInArrow over (hub, block, other, side, doc, label, set) sorted by the first three. side 1 rows are walked
    against side 0 rows; a block without side 1 rows against itself. label: the component found so far, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean()
        for t in common.grouped_stream(batches, ["hub", "block", "other"]):
            sides: tuple[dict, dict] = ({}, {})
            labels: dict[int, list[int]] = {}
            for side, doc, label, s in zip(*(t.column(c).to_pylist() for c in ("side", "doc", "label", "set")), strict=True):
                sides[side][doc] = np.frombuffer(s, U)
                if label is not None:
                    labels.setdefault(label, []).append(doc)
            log = _log([*sides[0].values(), *sides[1].values()])
            trees = [Tree([len(s) for s in x.values()], [_bits(s, log) for s in x.values()], list(x.values())) for x in sides]
            names = [[list(x)[i] for i in tree.order] for x, tree in zip(sides, trees, strict=True)]
            links = Links([*sides[0], *sides[1]], num, den)
            for own in labels.values():
                for doc in own[1:]:
                    links.unite(own[0], doc)
            links.walk(trees[0], names[0], *((trees[1], names[1]) if sides[1] else ()))
            if links.found:
                a, b = zip(*links.found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def jaccard_join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, a row per input row; component_id is the least doc_id reachable by links.

    Null, empty and blank texts have the empty set and link with nothing. A text of fewer words than width has one shingle. Rows
    with a null doc_id get a null component_id. Rows that repeat a doc_id are one document: what any of them links with, all do;
    where there are such rows, all rows get numbers of their own, in the order of doc_id, and those of one doc_id are linked.
    Other columns are ignored; an empty table gives an empty result. Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    common.ship(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known, without = given.where("doc_id is not null"), given.where("doc_id is null")

    def sized(batches):
        shingle = Shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(shingle(t)) for t in b.column(1).to_pylist()], pa.int64()), pa.nulls(b.num_rows, pa.int64())], ["doc_id", "n_shingles", "component_id"])

    with common.batch_rows(spark, 1000):
        if known.groupBy("doc_id").count().where("count > 1").isEmpty():
            out = _joined(known, width, num, den)
        else:
            path = common.shared_dir(spark)
            rows = known.repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id").withColumn("row", F.monotonically_increasing_id())
            rows = common.stored(rows, f"{path}/rows")
            first = common.stored(rows.groupBy("doc_id").agg(F.min("row").alias("b")), f"{path}/first")
            same = rows.select("doc_id", F.col("row").alias("a")).join(first, "doc_id").where("a <> b").select("a", "b")
            out = _joined(rows.select(F.col("row").alias("doc_id"), "text"), width, num, den, same)
            own, root = rows.select(F.col("row").alias("own"), F.col("doc_id").alias("id")), rows.select(F.col("row").alias("root"), F.col("doc_id").alias("root_id"))
            out = out.join(own, F.col("doc_id") == F.col("own")).join(root, F.col("component_id") == F.col("root"))
            out = out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("root_id").alias("component_id"))
        return out.unionByName(without.mapInArrow(sized, "doc_id long, n_shingles long, component_id long"))


def _joined(known: DataFrame, width: int, num: int, den: int, same: DataFrame | None = None) -> DataFrame:
    """jaccard_join of rows with distinct doc_ids that aren't null; same: links (a, b) that hold whatever the texts."""
    spark = known.sparkSession
    ws, n_parts = common.shared_dir(spark), common.shuffle_partitions(spark)
    bits = max(6, min(20, (16 * n_parts - 1).bit_length()))
    packed = keyed(known, width, num, den, bits).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    packed.mapInArrow(met, GOT).write.partitionBy("kind").parquet(f"{ws}/met")
    got = spark.read.schema(GOT).parquet(f"{ws}/met")
    across = got.where("kind = 0").select(F.col("c0").alias("hub"), F.col("c1").alias("doc"), F.col("c2").alias("bit"), F.col("c3").alias("level"), F.col("c4").alias("n"))
    within = got.where("kind = 1").select(F.col("c0").alias("hub"), F.col("c1").alias("doc"), F.col("c2").alias("bit"), F.col("c3").alias("n"))
    about = got.where("kind = 2").select(F.col("c0").alias("doc_id"), F.col("c1").alias("n"), F.col("c2").alias("h1"), F.col("c3").alias("h2"), F.col("c4").alias("spare0"), F.col("c5").alias("spare1"))

    # Classes of equal sets; rep: the class's least doc_id.
    full = about.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = full.groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("rep"))
    whole = parts.groupBy("h1", "h2").agg(F.min("rep").alias("rep"))
    reps = full.join(parts.select("h1", "h2", "salt").join(whole, ["h1", "h2"]), ["h1", "h2", "salt"])
    reps = common.stored(reps.select("doc_id", "n", "h1", "rep").union(about.where("n = 0").select("doc_id", "n", "h1", F.col("doc_id").alias("rep"))), f"{ws}/reps")
    to = lambda c: reps.select(F.col("doc_id").alias(c), F.col("rep").alias(f"{c}_rep"))
    # Tables that are joined on a hub are stored first, so that Spark can split a hub's rows over tasks (skewed joins of AQE).

    # Groups around hubs, of classes. A document leaves the groups of its most common keys, as many as it can spare.
    own = across.select("doc", "bit", "level", "n").union(within.select("doc", "bit", F.lit(LEVELS).cast("long"), "n"))
    own = own.groupBy("doc", "bit").agg(*[F.sum(F.when(F.col("level") >= k, F.col("n")).otherwise(0)).alias(f"from{k}") for k in range(1, LEVELS + 1)])
    spare = about.where("n > 0").select("doc_id", "spare0", "spare1")
    own = own.join(spare, own["doc"] == spare["doc_id"]).withColumn("spare", F.expr("if(bit = 0, spare0, spare1)"))
    below = F.lit(LEVELS + 1)
    for k in range(LEVELS, 0, -1):
        below = F.when(F.col(f"from{k}") <= F.col("spare"), k).otherwise(below)
    keeps = common.stored(own.select("doc", "bit", below.alias("below")).where("below > 1"), f"{ws}/keeps")
    up = across.where(f"level = {LEVELS} and hub <> doc").select(F.col("hub").alias("above"), F.col("doc").alias("hub"), "bit").distinct()
    up = common.stored(up, f"{ws}/up")
    local = within.join(keeps.where(f"below > {LEVELS}"), ["doc", "bit"]).select("hub", "doc", "bit")
    near = across.join(keeps, ["doc", "bit"]).where("level < below").select("hub", "doc")
    near = near.union(local.select("hub", "doc")).union(local.join(up, ["hub", "bit"]).select("above", "doc")).distinct()
    near = near.join(to("hub"), "hub").join(to("doc"), "doc").select(F.col("hub_rep").alias("hub"), F.col("doc_rep").alias("doc")).distinct()
    near = common.stored(near, f"{ws}/near")
    # A group whose members all are in the group of its hub's least hub adds nothing.
    above = common.stored(near.where("hub < doc").groupBy("doc").agg(F.min("hub").alias("up")).withColumnRenamed("doc", "hub"), f"{ws}/above")
    inside = near.join(above, "hub").join(near.withColumnRenamed("hub", "up"), ["up", "doc"], "left_semi").groupBy("hub").count()
    members_in_all = near.groupBy("hub").agg(F.count("*").alias("members"))
    needless = common.stored(inside.join(members_in_all, "hub").where("count = members").select("hub"), f"{ws}/needless")
    near = common.stored(near.join(needless, "hub", "left_anti"), f"{ws}/own")
    facts = reps.where("doc_id = rep").select(F.col("rep").alias("doc"), "n", "h1").distinct()
    members = near.join(facts, "doc")
    members = common.stored(members.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")), f"{ws}/grouped")
    shares = members.groupBy("hub", "salt").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = shares.groupBy("hub").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).where("c > 1")
    sizes = sizes.select("hub", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(shares.select("hub", "salt").join(sizes, "hub"), ["hub", "salt"]).drop("salt")
    members = common.stored(members, f"{ws}/members")

    for name in ("met", "keeps", "near", "up", "above", "needless", "own", "grouped"):
        common.dropped(spark, f"{ws}/{name}")

    def tokenised(batches):
        common.lean()
        shingle = Shingler(width)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_hash(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "h1", "set"])

    wanted = common.stored(members.select(F.col("doc").alias("doc_id")).distinct(), f"{ws}/wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("merge")
    sets = common.stored(known.join(wanted, "doc_id", "left_semi").mapInArrow(tokenised, "doc long, h1 long, set binary"), f"{ws}/sets")

    def walk(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.join(sets, ["doc", "h1"]).select("hub", "block", "other", "side", "doc", "label", "set")
        rows = rows.repartition(n_parts, "hub", "block", "other").sortWithinPartitions("hub", "block", "other")
        return common.stored(rows.mapInArrow(walked(num, den), "a long, b long"), f"{ws}/{name}")

    own_block = F.when(F.col("hub") == F.col("doc"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")))
    dealt = members.select("hub", "doc", "h1", F.explode(own_block).alias("block"), F.lit(0).alias("other"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("label"))
    links = walk(dealt, "links")
    if same is not None:
        links = links.union(same.join(to("a"), "a").join(to("b"), "b").select("a_rep", "b_rep"))
    large = members.where("blocks > 1")
    if not large.isEmpty():  # sets outside the main component of a group of several blocks
        roots = common.connected(links, f"{ws}/first")
        placed = large.join(roots.withColumnRenamed("id", "doc"), "doc", "left").select("hub", "doc", "h1", "n", "blocks", F.coalesce("root", "doc").alias("label"))
        placed = common.stored(placed, f"{ws}/placed")
        main = stored_few(placed.groupBy("hub", "label").count().groupBy("hub").agg(F.max_by("label", "count").alias("main")), f"{ws}/main")
        rest = placed.join(main, "hub").where("label <> main").drop("main")
        much = rest.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("others"))
        much = stored_few(much, f"{ws}/much")
        block, other = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("others")).cast("int")
        all_ = placed.join(much, "hub").select("hub", "doc", "h1", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), F.lit(0).alias("side"), "label")
        few = rest.join(much, "hub").select("hub", "doc", "h1", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), other.alias("other"), F.lit(1).alias("side"), "label")
        links = links.union(walk(all_.unionByName(few), "more"))
    roots = common.connected(links, f"{ws}/last")
    for name in ("members", "wanted", "sets", "links", "first", "placed", "main", "much", "more"):
        common.dropped(spark, f"{ws}/{name}")
    return reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def stored_few(table: DataFrame, path: str) -> DataFrame:
    """A table of large groups, one row for each: stored, and broadcast if it has no more than BROADCAST_IDS rows."""
    table = common.stored(table, path)
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table.hint("merge")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs' rows, all columns, with one document of each component: the one with the least doc_id."""
    gone = jaccard_join(docs, width, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = common.stored(gone, f"{common.shared_dir(docs.sparkSession)}/gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as sh
  from w),
u as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (
  select a.doc_id as x, b.doc_id as y from u a join u b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select x, y from p union select y, x from p),
r(id, z) as (select doc_id, doc_id from documents union select r.id, e.y from r join e on r.z = e.x)
select s.doc_id, len(sh) as n_shingles, c.component_id from s join (select id, min(z) as component_id from r group by id) c on s.doc_id = c.id
"""
