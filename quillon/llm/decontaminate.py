"""Operator 2, benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping windows of WINDOW characters (short items are one window). A window of n characters
that stands in a text with at most e = n // RATE edits shares n - q + 1 - q * e of its q-grams with it, all within 2e + 1
adjacent diagonals. So q-gram hits are counted in overlapping diagonal bands; bands that reach the bound are aligned, and
a window that aligns within e edits is a leak of its item.

Texts are worked on in segments that their own q-grams cut, so that a passage that is repeated, in one text or in many, is worked
on once; hits are counted for each window before they are gathered, and gathered HITS at a time. Windows that are equal are one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Q-gram length, that of windows whose bound isn't positive with it, characters of a window, and characters of a window for each edit.
Q, SHORT_Q, WINDOW, RATE = 12, 8, 120, 20
#: Bytes of benchmark text whose index goes to tasks at once; a larger benchmark is run in several such blocks.
BLOCK_BYTES = 8_000_000
#: Least and most bytes of a segment; bytes before and after it that its bands and alignments look at.
LEAST, MOST, BEFORE, AFTER = 1024, 4096, 64, WINDOW + 96
#: Hits gathered at once, alignments made at once, segments whose results are remembered.
HITS, PAIRS, REMEMBERED = 2_000_000, 1024, 50_000
FILTER_BITS = 22
FOUND = "doc_id long, item_id long, n_windows long, edits long, start long, end long"
A = np.uint64(0x9E3779B97F4A7C15)
NEVER, COST = np.int32(1 << 29), np.int32(1 << 12)  # a cell is its edits times COST, less the start: of equal edits the latest start


def normalised(text: str | None) -> bytes:
    """Lower-cased, with a blank for each run of white space: UTF-8, over which q-grams, windows and edits are counted."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram at each byte."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = lambda k: np.ndarray((n,), "<u8", data, k, (1,))  # noqa: E731  eight bytes from k on, at each byte
    h = at(0) * A
    h = (h ^ (h >> np.uint64(32)) ^ at(q - 8)) * A
    return h ^ (h >> np.uint64(29))


def aligned(patterns: np.ndarray, texts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits (most + 1 for more than `most`), start and end of whole patterns against parts of texts, many pairs at once.

    patterns: pairs x n; texts: pairs x m bytes as int16, of which the first ends[k] are the text and the rest -1. Free start and end in
    the text; cells are kept by diagonal, from -most to m - n + most. Pairs are dropped once no cell is within most.
    """
    pairs, n = patterns.shape
    m = texts.shape[1]
    width = m - n + 2 * most + 1
    wide = np.full((n + width + 1, pairs), -1, np.int16)  # pairs side by side, so that each step runs along them
    wide[most : most + m] = texts.T
    patterns = np.ascontiguousarray(patterns.T)
    first = (np.arange(width, dtype=np.int32) - most)[:, None]  # where a cell of row 0 stands in the text
    cells = np.tile(np.where(first >= 0, COST - 1 - first, NEVER).astype(np.int32), (1, pairs))
    cost, start, end = np.full(pairs, most + 1), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    live = np.arange(pairs)
    limit = (most + 1) * COST
    for i in range(n):
        below = cells[1:] + COST
        cells = cells + (wide[i : i + width] != patterns[i]) * COST
        np.minimum(cells[:-1], below, out=cells[:-1])
        k = 1
        while k <= most:  # characters of the text put in, as many as edits allow
            np.minimum(cells[k:], cells[:-k] + k * COST, out=cells[k:])
            k *= 2
        if i % 8 == 7:
            on = (cells < limit).any(0)
            if not on.any():
                return cost, start, end
            if 4 * on.sum() < 3 * len(on):
                cells, wide, patterns, live = cells[:, on], wide[:, on], patterns[:, on], live[on]
    place = n + first
    cells = np.where((place >= 0) & (place <= ends[live]), cells, NEVER)
    at = cells.argmin(0)
    best = cells[at, np.arange(len(at))]
    good = best < limit
    cost[live[good]] = best[good] // COST
    start[live[good]] = COST - 1 - best[good] % COST
    end[live[good]] = place[at[good], 0]
    return cost, start, end


class Index:
    """Distinct windows of benchmark items, the items that have them, and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[int, str]]):
        number: dict[bytes, int] = {}
        self.items: list[list[int]] = []
        self.short: list[tuple[int, bytes]] = []
        for item, text in items:
            data = normalised(text)
            if 0 < len(data) < Q:
                self.short.append((item, data))
            if len(data) < Q:
                continue
            for at in sorted({*range(0, max(1, len(data) - WINDOW + 1), WINDOW // 2), max(0, len(data) - WINDOW)}):
                k = number.setdefault(data[at : at + WINDOW], len(number))
                if k == len(self.items):
                    self.items.append([])
                self.items[k].append(item)
        self.windows = list(number)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.codes = np.zeros((len(self.windows), WINDOW), np.int16)
        for k, w in enumerate(self.windows):
            self.codes[k, : len(w)] = np.frombuffer(w, np.uint8)
        self.most = self.size // RATE
        q = np.where(self.size - Q + 1 - Q * self.most > 0, Q, SHORT_Q)
        self.bound = self.size - q + 1 - q * self.most
        self.tables = [(n, *self._table(n, np.flatnonzero(q == n)), int(self.bound[q == n].min())) for n in (Q, SHORT_Q) if (q == n).any()]
        self.known: dict[bytes, list[tuple[int, int, int, int, int]]] = {}

    def _table(self, q: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows' q-grams in order, the window and the place in it of each, and a filter of the hashes."""
        hashes = [grams(self.windows[k], q) for k in windows]
        sizes = [len(h) for h in hashes]
        hash_ = np.concatenate(hashes)
        window = np.repeat(windows.astype(np.int32), sizes)
        place = np.concatenate([np.arange(n, dtype=np.int16) for n in sizes])
        order = np.argsort(hash_, kind="stable")
        held = np.zeros(1 << FILTER_BITS, bool)
        held[self._bit(hash_)] = True
        return hash_[order], window[order], place[order], held

    def _bit(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def found(self, data: bytes) -> dict[int, list[int]]:
        """Of a normalised text: item -> [places where one of its windows stands, least edits of one, start of the first, end of the last]."""
        seen: dict[int, list[int]] = {}  # the same by window
        for table in self.tables:
            q, hash_, held, least = table[0], table[1], table[4], table[5]
            h = grams(data, q)
            at = np.flatnonzero(held[self._bit(h)])
            if len(at) == 0:
                continue
            lo = np.searchsorted(hash_, h[at], "left")
            n = np.searchsorted(hash_, h[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if n.sum() < least:
                continue
            sums = np.concatenate([[0], np.cumsum(n)])
            for a, b in segments(h, len(data)):
                x0, x1 = max(0, a - BEFORE), b + AFTER
                i, j = np.searchsorted(at, [x0, x1 - q + 1])
                if sums[j] - sums[i] < least:
                    continue
                own = data[x0:x1]
                key = xxhash.xxh3_128_digest(own, b - a << 8 | a - x0) + bytes([q])
                hits = self.known.get(key)
                if hits is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    hits = self.known[key] = self._segment(table, own, a - x0, b - x0, at[i:j] - x0, lo[i:j], n[i:j])
                for v, count, cost, start, end in hits:
                    x = seen.setdefault(v, [0, cost, x0 + start, x0 + end])
                    seen[v] = [x[0] + count, min(x[1], cost), min(x[2], x0 + start), max(x[3], x0 + end)]
        out: dict[int, list[int]] = {}
        for item, t in self.short:  # too short for a q-gram, and for an edit: found as it stands, as words
            at = (b" " + data + b" ").find(b" " + t + b" ")
            if at >= 0:
                seen_ = out.setdefault(item, [0, 0, at, at + len(t)])
                out[item] = [seen_[0] + 1, 0, min(seen_[2], at), max(seen_[3], at + len(t))]
        for v, (count, cost, start, end) in seen.items():
            for item in self.items[v]:
                x = out.setdefault(item, [0, cost, start, end])
                out[item] = [x[0] + count, min(x[1], cost), min(x[2], start), max(x[3], end)]
        return out

    def _segment(self, table, data: bytes, a: int, b: int, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(window, places, least edits, first start, last end) of windows that start in data[a:b]; at, lo, n: the hits' places and postings."""
        window, place = table[2], table[3]
        posted = np.zeros(len(self.windows), np.int64)
        runs = np.flatnonzero(np.diff(np.cumsum(n) // HITS, prepend=-1))  # hits are counted HITS at a time
        parts = [slice(x, y) for x, y in zip(runs, [*runs[1:], len(n)], strict=True)]
        for p in parts:
            posted += np.bincount(window[spread(lo[p], n[p])], minlength=len(posted))
        left = np.flatnonzero(posted >= self.bound)
        if not len(left):
            return []
        groups = np.cumsum(posted[left]) // HITS
        bands = []
        for g in np.unique(groups):
            own = left[groups == g]
            on = np.zeros(len(posted), bool)
            on[own] = True
            places, windows, inner = [], [], []
            for p in parts:
                k = spread(lo[p], n[p])
                keep = on[window[k]]
                k = k[keep]
                places.append(np.repeat(at[p], n[p])[keep])
                windows.append(window[k].astype(np.int64))
                inner.append(place[k].astype(np.int64))
            bands.append(self._bands(np.concatenate(places), np.concatenate(windows), np.concatenate(inner), a, b))
        v, base = (np.concatenate(x) for x in zip(*bands, strict=True))
        return self._placed(data, a, b, v, base)

    def _bands(self, at, window, place, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal) of the bands that hold enough distinct q-grams of a window. Each diagonal is in two bands, of 4e + 2
        diagonals every 2e + 1, so that 2e + 1 adjacent ones are in one band; the first band starts one step before the segment."""
        step = 2 * self.most[window] + 1
        band = (at - place - a + step) // step
        n_bands = b - a + 3
        window, band, place = np.concatenate([window, window]), np.concatenate([band, band - 1]), np.concatenate([place, place])
        keep = (band >= 0) & (band < n_bands)
        key = np.sort((window[keep] * n_bands + band[keep]) * WINDOW + place[keep])
        key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])] // WINDOW
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        count, key = np.diff(np.append(first, len(key))), key[first]
        v = key // n_bands
        v, key = v[count >= self.bound[v]], key[count >= self.bound[v]]
        return v, a + (key % n_bands - 1) * (2 * self.most[v] + 1)

    def _placed(self, data: bytes, a: int, b: int, v: np.ndarray, base: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Bands aligned: what _segment gives. Of overlapping places of one window the first counts."""
        text = np.frombuffer(data, np.uint8).astype(np.int16)
        e, size = self.most[v], self.size[v]
        lo = np.maximum(0, base - e)
        hi = np.minimum(len(data), base + 5 * e + 2 + size)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        todo = np.ones(len(v), bool)
        for k in np.flatnonzero(hi - lo >= size):
            x = data.find(self.windows[v[k]], lo[k], hi[k])
            if x >= 0:  # as it stands
                todo[k] = False
                hits.setdefault(int(v[k]), []).append((x, 0, x + int(size[k])))
        todo = np.flatnonzero(todo & (e > 0))
        for own in np.unique(size[todo]):
            same = todo[size[todo] == own]
            most = int(own) // RATE
            m = int(own) + 6 * most + 2
            for part in (same[x : x + PAIRS] for x in range(0, len(same), PAIRS)):
                ends = hi[part] - lo[part]
                cols = lo[part][:, None] + np.arange(m)
                texts = np.where(cols < hi[part][:, None], text[np.minimum(cols, len(text) - 1)], np.int16(-1))
                cost, start, end = aligned(self.codes[v[part], : int(own)], texts, ends, most)
                for k in np.flatnonzero(cost <= most):
                    hits.setdefault(int(v[part[k]]), []).append((int(lo[part[k]] + start[k]), int(cost[k]), int(lo[part[k]] + end[k])))
        out = []
        for w, found in hits.items():
            found = sorted(x for x in found if a <= x[0] < b)
            if found:
                count, last = 0, -1
                for x, _, y in found:
                    if x >= last:
                        count, last = count + 1, y
                out.append((w, count, min(x[1] for x in found), found[0][0], max(x[2] for x in found)))
        return out


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def segments(h: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Segments of a text of n bytes whose q-grams are h: each is cut at the least hash of LEAST to MOST bytes after its start, so that
    what repeats is soon cut alike."""
    a = 0
    while n - a > MOST:
        b = a + LEAST + int(h[a + LEAST : a + MOST].argmin())
        yield a, b
        a = b
    yield a, n


_index: list[tuple[str, Index]] = []


def index_of(name: str, shared: Broadcast) -> Index:
    """The worker's index of a broadcast block of the benchmark, kept for its next tasks."""
    if not _index or _index[0][0] != name:
        _index[:] = [(name, Index(shared.value))]
    return _index[0][1]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, edits, start, end: a row per document row and benchmark item found in it.

    n_windows counts places where windows of the item stand. start and end are bytes of the normalised text (lower case, runs of white space as one blank). Null and empty texts and items
    give no rows; items of fewer than Q characters must stand unchanged, as whole words. Documents that repeat give repeated
    rows; items that repeat an item_id are pooled under it. Other columns are ignored. Tasks get the index of one block of the
    benchmark of at most BLOCK_BYTES (an item that alone is longer is a block); larger benchmarks are run block by block.
    """
    spark = docs.sparkSession
    common.ship(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        found = common.per_document(picked, lambda shared=shared, name=name: finder(index_of(name, shared)), FOUND, ["doc_id", "text"])
        out = found if out is None else out.union(found)
    return out


def finder(index: Index):
    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows += [(doc, item, *x) for item, x in index.found(normalised(text)).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return work


def blocks(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of at most BLOCK_BYTES, or of one item; one empty block for an empty benchmark."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    block, size, any_ = [], 0, False
    for r in items.orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode("utf-8", "replace"))
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size, any_ = size + n, True
    if block or not any_:
        yield block


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs' rows, all columns, in whose text no benchmark item is found."""
    spark = docs.sparkSession
    common.ship(spark)
    for block in blocks(benchmark):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(shared=shared, name=name):
            index = index_of(name, shared)
            return lambda text: not index.found(normalised(text))

        docs = common.rows_where(docs, make, ["text"])
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
