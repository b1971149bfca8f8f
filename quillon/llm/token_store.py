"""Operator 5, token ids in a content-addressed store.

Documents become streams of token ids, a rolling hash over the ids cuts the streams into chunks, and each distinct chunk
is stored once under its digest. A document's recipe lists its chunk digests; a Merkle root over them verifies that what
is read back is what was written. Store layout, all Parquet in a folder of shared storage:

  chunks/   digest, n, payload    one row per distinct chunk. Payload: a width byte (2 or 4), then ids little-endian in that width.
  recipes/  part, local_start, doc_id, n_tokens, digests, root    sorted by doc_id; a document starts at local_start plus
            the tokens of all parts before its own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import common

#: Ids of the rolling hash's window, and one cut in about MEAN ids, with chunks of LEAST to MOST ids: well under the usual document, so that
#: passages that documents share are stored once too.
WINDOW, MEAN, LEAST, MOST = 4, 256, 64, 2048
#: Digests a task remembers so as to send a chunk once; more are sent again, and dropped by the store.
REMEMBERED = 1 << 20
MIXED = "kind int, slot long, doc_id long, n long, digests array<binary>, root binary, digest binary, payload binary"
MIXED_ARROW = pa.schema([("kind", pa.int32()), ("slot", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digests", pa.list_(pa.binary())), ("root", pa.binary()), ("digest", pa.binary()), ("payload", pa.binary())])
MULT = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The byte alphabet of byte-level BPE beyond ASCII: bytes without a visible Latin-1 character are numbered from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTES = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1], and so on."""
    ends = np.cumsum(n, dtype=n.dtype)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0, dtype=n.dtype)


class Encoder:
    """Ids of texts, as the tokenizers library gives them with add_special_tokens=False.

    A byte-level BPE cuts a text before each single blank and at each single line end that stand between other characters,
    and never merges across a cut. So texts are split there, the library encodes each distinct unit once, many in one call with a special
    token between them, and from then on it is looked up, all units of many texts at once. Texts with other runs of white space or
    with a special token, and tokenizers of another kind, go to the library whole.
    """

    UNITS, CALL, SLICE = 700_000, 64, 16 << 20

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, self.special = spec.get("pre_tokenizer") or {}, [t["content"] for t in spec.get("added_tokens", [])]
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        plain = [t for t in spec.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark = plain[0] if byte_level and plain and spec["model"]["type"] == "BPE" else None
        self.unsafe = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        #: Units learned; ids of all of them one after another; each unit's start and number of ids (-1: unsafe); whether it was met again.
        self.units, self.store = pa.array([], pa.string()), array("I")
        self.at, self.n, self.again = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.signs = {c: self._library(c) for c in ".,"}

    def _forget(self) -> None:
        """Keeps the units that were met again since the last time, if they are few enough."""
        kept = np.flatnonzero(self.again)
        if len(kept) > self.UNITS // 2:
            kept = kept[:0]
        start, self.n = self.at[kept], self.n[kept]
        width = np.maximum(self.n, 0)
        self.units = self.units.take(pa.array(kept))
        self.store = array("I", np.array(self.store, "<u4")[spread(start, width)].tobytes())
        self.at = (np.cumsum(width) - width).astype(np.int32)
        self.again = np.zeros(len(kept), bool)

    def _word(self, unit: str, blank: str) -> list[int] | None:
        """Ids of one word, or a word and one sign, which are tokens of their own: the library's model takes it as it is, in its byte alphabet."""
        sign = None
        if not unit.isalpha():
            sign = self.signs.get(unit[-1:])
            unit = unit[:-1]
            if sign is None or not unit.isalpha():
                return None
        ids = [t.id for t in self.tokenizer.model.tokenize(blank + (unit if unit.isascii() else unit.encode().decode("latin-1").translate(BYTES)))]
        return ids + sign if sign else ids

    def _learn(self, units: list[str]) -> None:
        """Ids of new units. One that white space at an edge makes depend on its neighbours, or that holds a special token, is unsafe."""
        store, word, at, n, texts, places = self.store, self._word, [], [], [], []
        for u in units:
            at.append(len(store))
            ids = word(u, "\u0120")
            if ids is not None:
                store.fromlist(ids)
                n.append(len(ids))
                continue
            core = u[1:] if u[:1] == "\n" else u
            if core and not core[0].isspace() and not core[-1].isspace() and not self.unsafe.search(u):
                texts.append(u if u[0] == "\n" else " " + u)
                places.append(len(n))
            n.append(-1)
        for lo in range(0, len(texts), self.CALL):
            ids = np.array(self._library(self.mark["content"].join(texts[lo : lo + self.CALL])), "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark["id"]), len(ids))
            starts = np.append(0, ends[:-1] + 1)
            base = len(store)
            store.frombytes(ids.tobytes())
            for k, x, y in zip(places[lo : lo + self.CALL], starts.tolist(), ends.tolist(), strict=True):
                at[k], n[k] = base + x, y - x
        self.at, self.n = np.concatenate([self.at, np.array(at, np.int32)]), np.concatenate([self.n, np.array(n, np.int32)])
        self.again = np.concatenate([self.again, np.zeros(len(units), bool)])

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column without nulls. Units are told apart by Arrow, SLICE bytes at a time; each distinct one is looked up."""
        size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + self.SLICE, "right")))
            yield from self._slice(texts.slice(lo, hi - lo))
            lo = hi

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if self.mark is None:
            yield from (np.array(self._library(t), "<u4") for t in texts.to_pylist())
            return
        if len(self.units) > self.UNITS:
            self._forget()
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        idx, bounds = coded.indices.to_numpy(), np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
        if self.units.type != coded.dictionary.type:
            self.units = self.units.cast(coded.dictionary.type)
        places = pc.index_in(coded.dictionary, value_set=self.units)
        fresh = coded.dictionary.filter(pc.is_null(places))
        places = places.fill_null(-1).to_numpy().astype(np.int64)
        self.again[places[places >= 0]] = True
        places[places < 0] = len(self.units) + np.arange(len(fresh))
        self._learn(fresh.to_pylist())
        self.units = pa.concat_arrays([self.units, fresh])
        width, start, flat = self.n[places], self.at[places], np.array(self.store)
        unsafe = (width < 0)[idx]
        width = np.maximum(width, 0)
        firsts = bounds[:-1]
        unsafe[firsts] = False  # the first unit has no blank before it and is encoded by itself
        broken = np.add.reduceat(unsafe, firsts, dtype=np.int64) > 0
        for t in self.special:
            broken |= np.asarray(pc.match_substring(texts, t), bool)
        heads = parts.flatten().take(pa.array(firsts)).to_pylist()
        for lo in range(0, len(texts), 1000):
            own = slice(bounds[lo], bounds[min(lo + 1000, len(texts))])
            units = idx[own]
            n = width[units]
            n[firsts[lo : lo + 1000] - bounds[lo]] = 0
            ids = flat[spread(start[units], n)]
            cut = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[bounds[lo : lo + 1001] - bounds[lo]].tolist()
            for k in range(lo, min(lo + 1000, len(texts))):
                head = heads[k]
                if broken[k] or not head or head[-1].isspace():
                    yield np.array(self._library(texts[k].as_py()), "<u4")
                else:
                    first = self._word(head, "")
                    yield np.concatenate([np.array(self._library(head) if first is None else first, "<u4"), ids[cut[k - lo] : cut[k - lo + 1]]])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The process's encoder of a vocabulary: what it has learned serves all tasks of a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def marked(ids: np.ndarray) -> list[int]:
    """Where chunks may end: after an id at which a rolling hash of the last WINDOW ids says so."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * MULT
    roll = x.copy()
    for k in range(1, min(WINDOW, len(x))):
        roll[k:] += x[: len(x) - k] << np.uint64(7 * k)
    roll = (roll ^ (roll >> np.uint64(29))) * MULT
    return (np.flatnonzero((roll >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1).tolist()


def cuts(ids: np.ndarray, marks: list[int] | None = None, at: int = 0, end: int | None = None) -> list[int]:
    """Chunk ends of ids[at:end]: at the first mark after LEAST ids, after MOST ids at the latest. marks: of all of ids.

    LEAST is more than WINDOW, so that no mark that counts depends on ids before `at`.
    """
    out, end = [], len(ids) if end is None else end
    marks = marked(ids) if marks is None else marks
    k = bisect_left(marks, at + LEAST)
    while end - at > LEAST:
        k = bisect_left(marks, at + LEAST, k)
        at = min(marks[k] if k < len(marks) else end, at + MOST, end)
        if at >= end:
            break
        out.append(at)
    return [*out, end]


def packed(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def merkle(digests: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def crc_shift(crc: np.ndarray | int, n: int) -> int:
    """A CRC-32 register run over n zero bytes: multiplication by x^(8n) modulo the polynomial."""
    power, base, k = 0x80000000, 0x00800000, n  # 1 and x^8, bit-reversed
    while k:
        if k & 1:
            power = gf_mul(power, base)
        base, k = gf_mul(base, base), k >> 1
    return gf_mul(crc, power)


def gf_mul(a: int, b: int) -> int:
    out, bit = 0, 0x80000000
    while bit:
        if b & bit:
            out ^= a
        a = (a >> 1) ^ 0xEDB88320 if a & 1 else a >> 1
        bit >>= 1
    return out


def gf_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """gf_mul of each pair of two uint32 columns."""
    out, a = np.zeros(len(a), np.uint32), a.astype(np.uint32)
    for k in range(31, -1, -1):
        out ^= a * (b >> np.uint32(k) & np.uint32(1))
        a = (a >> np.uint32(1)) ^ (a & np.uint32(1)) * np.uint32(0xEDB88320)
    return out


class Joined:
    """Checksums of what is put together from parts. x^(32 n) modulo the polynomial is for many n at once a product of two powers out
    of tables of STEP, which grow as needed."""

    STEP = 4096

    def __init__(self):
        self.low = self._powers(crc_shift(0x80000000, 4), self.STEP)
        self.base, self.high = crc_shift(0x80000000, 4 * self.STEP), np.zeros(0, np.uint32)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.array([0x80000000], np.uint32)
        while len(out) < n:  # doubled: the powers so far times the next one
            more = gf_mul(int(out[-1]), base)
            out = np.concatenate([out, gf_products(out, np.full(len(out), more, np.uint32))])
        return out[:n]

    def _shift(self, n: np.ndarray) -> np.ndarray:
        hi, lo = n // self.STEP, n % self.STEP
        if len(hi) and hi.max() >= len(self.high):
            self.high = self._powers(self.base, 2 * int(hi.max()) + 2)
        return gf_products(self.low[lo], self.high[hi]) if len(hi) and hi.any() else self.low[lo]

    def __call__(self, a: int, b: int, n: int) -> int:
        """crc32 of two parts, from theirs and the second one's bytes."""
        return crc_shift(a, n) ^ b

    def many(self, crc: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """crc32 of each group of parts, from the parts' checksums and numbers of 32-bit ids; first: where groups begin."""
        total = np.cumsum(n)
        ends = total[np.append(first[1:], len(n)) - 1]
        after = np.repeat(ends, np.diff(np.append(first, len(n)))) - total
        return np.bitwise_xor.reduceat(gf_products(crc.astype(np.uint32), self._shift(after)), first)


_joined: list[Joined] = []


def of_kind(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(columns["slot"])
    every = {"kind": pa.array(np.full(n, kind, np.int32))} | columns
    return pa.RecordBatch.from_arrays([every[f.name] if f.name in every else pa.nulls(n, f.type) for f in MIXED_ARROW], schema=MIXED_ARROW)


def encoded(docs: DataFrame, vocabulary: str, end_id: int, slots: int) -> DataFrame:
    """Rows of two kinds: documents' recipes (0), and chunks (1), each at least once for each task that met it."""

    def make():
        encoder, sent = encoder_of(vocabulary), set()
        end = np.array([end_id], "<u4")

        def cut(docs: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([x for own in ids for x in (own, end)])
            ends = np.cumsum([len(own) + 1 for own in ids]).tolist()
            marks, narrow = marked(flat), flat.max() < 65536
            raw = flat.astype("<u2").tobytes() if narrow else b""
            names, firsts, roots, fresh, loads, sizes = [], [0], [], [], [], []
            at = 0
            for stop in ends:
                first = len(names)
                for hi in cuts(flat, marks, at, stop):
                    load = b"\x02" + raw[2 * at : 2 * hi] if narrow else packed(flat[at:hi])
                    name = hashlib.sha256(load).digest()
                    names.append(name)
                    if name not in sent:
                        if len(sent) < REMEMBERED:
                            sent.add(name)
                        fresh.append(name)
                        loads.append(load)
                        sizes.append(hi - at)
                    at = hi
                firsts.append(len(names))
                roots.append(merkle(names[first:]))
            where = [zlib.crc32(str(doc).encode()) % slots for doc in docs]
            recipe = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(names, pa.binary()))
            yield of_kind(0, slot=pa.array(where, pa.int64()), doc_id=pa.array(docs, pa.int64()), n=pa.array(np.diff([0, *ends])), digests=recipe, root=pa.array(roots, pa.binary()))
            if fresh:
                slot = np.frombuffer(b"".join(fresh), "<u4")[::8].astype(np.int64) % slots
                yield of_kind(1, slot=pa.array(slot), n=pa.array(sizes, pa.int64()), digest=pa.array(fresh, pa.binary()), payload=pa.array(loads, pa.binary()))

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            docs, ids, weight = [], [], 0
            for doc, own in zip(b.column(0).to_pylist(), encoder.many(pc.fill_null(b.column(1), "")), strict=True):
                docs.append(doc)
                ids.append(own)
                weight += len(own)
                if weight > 1 << 20:
                    yield from cut(docs, ids)
                    docs, ids, weight = [], [], 0
            if docs:
                yield from cut(docs, ids)

        return work

    return common.per_document(docs, make, MIXED, ["doc_id", "text"])


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest, recipes, which have none, first: the first of each digest, once equal digests' payloads have been compared."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b if last is None else last, b] if last is not None else [b]).combine_chunks()
        digest, load = rows["digest"].combine_chunks(), rows["payload"].combine_chunks()
        n = rows.num_rows
        again = pc.fill_null(pc.equal(digest.slice(1), digest.slice(0, n - 1)), False)
        if pc.any(pc.and_(again, pc.invert(pc.fill_null(pc.equal(load.slice(1), load.slice(0, n - 1)), False)))).as_py():
            raise ValueError("two chunks have the same SHA-256 digest")
        new = pa.concat_arrays([pa.array([last is None]), pc.invert(again)])
        last = b.slice(b.num_rows - 1, 1)
        yield from rows.filter(new).to_batches()


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each document's start within its sorted part."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = np.asarray(b.column(1))
        starts = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(starts, pa.int64()), *b.columns], ["part", "local_start", *b.schema.names])


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0) -> None:
    """Encode every whole text, append end_id, and write the store. Null text counts as empty; null doc_ids come first; rows
    that repeat a doc_id are documents of their own. Other columns are ignored. An empty table makes an empty store."""
    spark = docs.sparkSession
    common.ship(spark)
    slots = common.shuffle_partitions(spark)
    rows = encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary or default_vocabulary(), end_id, 1 << 30)
    rows = rows.repartition(slots, "slot").sortWithinPartitions("digest").mapInArrow(once, MIXED)
    rows.select("kind", "doc_id", "n", "digests", "root", "digest", "payload").write.partitionBy("kind").option("parquet.enable.dictionary", "false").parquet(f"{path}/staged")
    staged = spark.read.schema("doc_id long, n long, digests array<binary>, root binary").parquet(f"{path}/staged/kind=0") if _there(spark, f"{path}/staged/kind=0") else spark.createDataFrame([], "doc_id long, n long, digests array<binary>, root binary")
    ordered = staged.withColumnRenamed("n", "n_tokens").repartitionByRange(slots, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(placed, "part int, local_start long, doc_id long, n_tokens long, digests array<binary>, root binary").write.parquet(f"{path}/recipes")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk files read back: the digest again from the payload, the number of ids, and the checksum of the ids as u32."""
    for b in batches:
        digest, n, crc = [], [], []
        for load in b.column(0).to_pylist():
            ids = unpacked(load)
            digest.append(hashlib.sha256(load).digest())
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "c_n", "c_crc"])


REBUILT = "part int, local_start long, doc_id long, n_tokens long, ids_crc32 long"


def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document, chunks in order: joined checksum and length, with length and Merkle root held against the recipe."""
    held: list[pa.RecordBatch] = []  # of the last document, which the next batch may go on with

    def closed(t: pa.Table) -> pa.RecordBatch:
        part, start, doc_id, n_tokens, n, crc = (np.asarray(t[c].combine_chunks().fill_null(-1)) for c in ("part", "local_start", "doc_id", "n_tokens", "c_n", "c_crc"))
        if (n < 0).any():
            raise ValueError(f"a chunk of document {doc_id[n < 0][0]} is missing from the store")
        first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (start[1:] != start[:-1])))
        size, names, roots = np.add.reduceat(n, first), t["digest"].to_pylist(), t["root"].take(pa.array(first)).to_pylist()
        for k, (lo, hi) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(n)], strict=True)):
            if size[k] != n_tokens[lo] or merkle(names[lo:hi]) != roots[k]:
                raise ValueError(f"document {doc_id[lo]} can't be rebuilt from the store")
        if not _joined:
            _joined.append(Joined())
        crcs = _joined[0].many(crc, n, first).astype(np.int64)
        of = t.take(pa.array(first)).combine_chunks()
        cols = [of[c].combine_chunks() for c in ("part", "local_start", "doc_id", "n_tokens")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(crcs)], [c.split()[0] for c in REBUILT.split(", ")])

    for b in batches:
        if not b.num_rows:
            continue
        part, start = np.asarray(b.column(0)), np.asarray(b.column(1))
        new = np.flatnonzero((part != part[-1]) | (start != start[-1]))
        cut = int(new[-1]) + 1 if len(new) else 0  # rows of documents that end here
        last = held[-1].slice(held[-1].num_rows - 1) if held else None
        if held and (last.column(0)[0].as_py(), last.column(1)[0].as_py()) != (part[-1], start[-1]) and not cut:
            yield closed(pa.Table.from_batches(held))
            held = []
        if cut:
            yield closed(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
    if held:
        yield closed(pa.Table.from_batches(held))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; raises where a digest, length or root differs.

    Chunk payloads are read and checked where they lie; only digests, lengths and checksums are shuffled.
    """
    common.ship(spark)
    recipes = spark.read.schema("part int, local_start long, doc_id long, n_tokens long, digests array<binary>, root binary").parquet(f"{path}/recipes")
    at = f"{path}/staged/kind=1"
    chunks = spark.read.schema("payload binary").parquet(at) if _there(spark, at) else spark.createDataFrame([], "payload binary")
    chunks = chunks.mapInArrow(checked, "digest binary, c_n long, c_crc long")
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    offsets = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("offset"))  # a row for each part
    refs = recipes.select("part", "local_start", "doc_id", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    found = refs.join(chunks, "digest", "left").select("part", "local_start", "doc_id", "n_tokens", "root", "pos", "digest", "c_n", "c_crc")
    whole = found.repartition(common.shuffle_partitions(spark), "part", "local_start").sortWithinPartitions("local_start", "part", "pos")
    whole = whole.mapInArrow(rebuilt, REBUILT)
    return whole.join(F.broadcast(offsets), "part").select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def documents_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids array<int>: the documents' ids themselves, put together from the store's chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = spark.read.parquet(f"{path}/staged/kind=1").select("digest", "payload")

    def unpack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([unpacked(x).tolist() for x in b.column(4).to_pylist()], pa.list_(pa.int64()))], [*b.schema.names[:-1], "ids"])

    rows = recipes.select("part", "local_start", "doc_id", F.posexplode("digests").alias("pos", "digest")).join(chunks, "digest").select("part", "local_start", "doc_id", "pos", "payload")
    rows = rows.mapInArrow(unpack, "part int, local_start long, doc_id long, pos int, ids array<long>")
    return rows.groupBy("part", "local_start", "doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda x: x.ids)).alias("ids")).select("doc_id", "ids")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark)
    write_store(common.table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
