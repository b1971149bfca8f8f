"""Operator 9, SentencePiece encoding with offsets and decoding.

Ids come from the library itself. The offsets come from an own normaliser: at each byte the longest key of the model's
compiled character map (a double-array trie) is replaced and every normalised byte remembers the original byte it came
from, so that each piece projects to a span of the original UTF-8 bytes. The model that the query uses has an empty map; all that
it changes are blanks, whose one rule is compiled into a map here, so that its texts go through the same trie.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common

SPACE = "▁".encode()
DECODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def compiled(rules: dict[bytes, bytes]) -> bytes:
    """A character map of few rules, in the form that models have. A unit of the trie has its label in bits 0 to 7, whether a key ends
    there in bit 8, and from bit 10 the offset that with a child's label gives the child's place; label 0 leads to the key's value."""
    pool, at = b"", {}
    for key, value in rules.items():
        at[key] = len(pool)
        pool += value + b"\0"
    units, used, todo = {0: 0}, {0}, [(0, b"")]
    while todo:
        place, prefix = todo.pop()
        labels = sorted({k[len(prefix)] for k in rules if len(k) > len(prefix) and k.startswith(prefix)} | ({0} if prefix in rules else set()))
        offset = next(o for o in range(256, 1 << 21) if all(place ^ o ^ c not in used for c in labels))
        units[place] = units.get(place, 0) | offset << 10 | (0x100 if prefix in rules else 0)
        used |= {place ^ offset ^ c for c in labels}
        for c in labels:
            units[place ^ offset ^ c] = c if c else 0x80000000 | at[prefix]
            if c:
                todo.append((place ^ offset ^ c, prefix + bytes([c])))
    trie = np.zeros((max(units) | 255) + 1, "<u4")
    trie[list(units)] = list(units.values())
    return len(trie.tobytes()).to_bytes(4, "little") + trie.tobytes() + pool


class CharMap:
    """Longest-prefix replacement by a compiled character map: a little-endian u32 trie size, the trie, then the NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.pool = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.pool = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]
        u, byte = self.units, np.arange(256)
        node = self._children(u[:1]) ^ byte if len(u) else byte
        #: Bytes that a key can begin with, so that other places don't step at all.
        self.first = (node < len(u)) & (u[np.where(node < len(u), node, 0)] & 0x800000FF == byte) if len(u) else np.zeros(256, bool)

    @staticmethod
    def _children(unit: np.ndarray) -> np.ndarray:
        """Units' offsets to their children."""
        return ((unit >> 10) << ((unit & 0x200) >> 6)).astype(np.int64)

    def matches(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and values of the keys that are replaced in a text, from left to right, the longest at each place. All places
        step down the trie together."""
        u = self.units
        none = np.zeros(0, np.int64)
        if not len(u) or not len(raw):
            return none, none, none
        start = np.flatnonzero(self.first[raw])
        node = self._children(u[:1]) ^ raw[start]
        size, value = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        depth = 0
        while len(start):
            label = raw[start + depth]
            inside = node < len(u)
            unit = u[np.where(inside, node, 0)]
            on = inside & (unit & 0x800000FF == label)
            start, unit, node, depth = start[on], unit[on], node[on], depth + 1
            node = node ^ self._children(unit)
            leaf = (unit >> 8 & 1).astype(bool)
            size[start[leaf]], value[start[leaf]] = depth, u[node[leaf]] & 0x7FFFFFFF
            on = start + depth < len(raw)
            start, node = start[on], node[on]
            node = node ^ raw[start + depth]
        start = np.flatnonzero(size)
        over = np.flatnonzero(start[:-1] + size[start[:-1]] > start[1:])
        if len(over):  # a key within or across another: the first one counts
            keep, end = np.ones(len(start), bool), 0
            for k, a in enumerate(start.tolist()):
                keep[k] = a >= end
                end = a + int(size[a]) if keep[k] else end
            start = start[keep]
        return start, size[start], value[start]

    def replacement(self, value: int) -> bytes:
        return self.pool[value : self.pool.index(b"\0", value)]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at a byte."""
        u, found = self.units, None
        if not len(u):
            return None
        child = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)  # noqa: E731  a unit's offset to its children
        unit = int(u[0])
        node = child(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = int(u[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= child(unit)
            if unit >> 8 & 1:
                value = int(u[node]) & 0x7FFFFFFF
                found = (i + 1 - at, self.replacement(value))
        return found


class Codec:
    """One SentencePiece model: encode, decode, and pieces with original byte spans."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        self.spec = spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.blanks = CharMap(compiled({b" ": SPACE if spec.escape_whitespaces else b" "}))
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        #: Normalised bytes of each id's piece; -1 for the unknown piece, whose length depends on the text.
        self.width = np.array([{2: -1, 6: 1}.get(p.type, len(p.piece.encode())) for p in proto.pieces], np.int64)

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte it stands at."""
        spec = self.spec
        if not data:
            return b"", np.zeros(1, np.int64)
        if not spec.remove_extra_whitespaces:
            return self._kept(data)
        out, src = bytearray(), []
        at, end, blank = 0, len(data), spec.remove_extra_whitespaces
        while at < end:
            hit = self.map.longest(data, at)
            if hit is None:
                n = 1
                while at + n < end and data[at + n] & 0xC0 == 0x80:
                    n += 1
                piece = data[at : at + n]
            else:
                n, piece = hit
            for j in range(len(piece)):
                c = piece[j : j + 1]
                if c == b" ":
                    if blank and spec.remove_extra_whitespaces:
                        continue
                    blank = True
                    mark = SPACE if spec.escape_whitespaces else b" "
                    out += mark
                    src += [at] * len(mark)
                else:
                    blank = False
                    out += c
                    src.append(min(at + j, at + n - 1) if piece == data[at : at + n] else at)
            at += n
        mark = SPACE if spec.escape_whitespaces else b" "
        while spec.remove_extra_whitespaces and out.endswith(mark):
            del out[-len(mark) :], src[-len(mark) :]
        if spec.add_dummy_prefix and out:
            if self.suffix:
                out, src = out + mark, src + [end] * len(mark)
            else:
                out, src = mark + bytes(out), [src[0]] * len(mark) + src
        return bytes(out), np.array([*src, end], np.int64)

    def _kept(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same for a model that keeps white space: the map's replacements, then the blanks', on all places at once."""
        raw, src = np.frombuffer(data, np.uint8), np.arange(len(data), dtype=np.int64)
        for m in (self.map, self.blanks):
            raw, src = replaced(m, raw, src)
        mark = SPACE if self.spec.escape_whitespaces else b" "
        end = np.array([len(data)], np.int64)
        if self.spec.add_dummy_prefix:
            own = np.zeros(len(mark), np.int64)
            return (raw.tobytes() + mark, np.concatenate([src, own + len(data), end])) if self.suffix else (mark + raw.tobytes(), np.concatenate([own, src, end]))
        return raw.tobytes(), np.concatenate([src, end])

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the ids' pieces as original UTF-8 byte spans; the pieces partition the normalised text. Where they don't, as
        of a model with rules that are not known here, the library's own spans are taken."""
        norm, src = self.normalise(text.encode("utf-8", "replace"))
        own = self.width[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
        at = done = 0
        for k in np.flatnonzero(own < 0).tolist():  # unknown: a run of characters that no piece has
            at += int(own[done:k].sum())
            end, first = at, True
            while end < len(norm):
                n = end + 1
                while n < len(norm) and norm[n] & 0xC0 == 0x80:
                    n += 1
                if not first and self.sp.piece_to_id(norm[end:n].decode("utf-8", "replace")) != ids[k]:
                    break
                end, first = n, False
            own[k], at, done = end - at, end, k + 1
        ends = np.cumsum(own)
        if len(ends) and ends[-1] != len(norm):
            return self._library(text)
        return src[ends - own], src[ends]

    def spans(self, texts: list[str], ids: list[list[int]]) -> list[np.ndarray]:
        """offsets() of many texts, as a column of (start, end) pairs for each. Texts are normalised together, parted by a byte that UTF-8
        doesn't have; those with unknown pieces, and all of a model that drops white space, are taken one by one."""
        if self.spec.remove_extra_whitespaces or self.suffix or not texts:
            return [np.stack(self.offsets(t, i), 1) for t, i in zip(texts, ids, strict=True)]
        data = [t.encode("utf-8", "replace") for t in texts]
        size = np.array([len(d) + 1 for d in data], np.int64)
        raw, src = np.frombuffer(b"\xff".join([*data, b""]), np.uint8), np.arange(size.sum(), dtype=np.int64)
        for m in (self.map, self.blanks):
            raw, src = replaced(m, raw, src)
        stops = np.flatnonzero(raw == 0xFF)
        base = np.append(0, stops[:-1] + 1)
        mark = (len(SPACE) if self.spec.escape_whitespaces else 1) if self.spec.add_dummy_prefix else 0
        n = np.array([len(i) for i in ids], np.int64)
        width = self.width[np.fromiter(chain.from_iterable(ids), np.int64, n.sum())]
        sums, cut = np.append(0, np.cumsum(width)), np.append(0, np.cumsum(n))
        unknown = np.append(0, np.cumsum(width < 0))
        odd = (n > 0) & ((sums[cut[1:]] - sums[cut[:-1]] != stops - base + mark) | (unknown[cut[1:]] > unknown[cut[:-1]]))
        ends = sums[1:] - np.repeat(sums[cut[:-1]], n)
        shift, own = np.repeat(base - mark, n), np.repeat(np.cumsum(size) - size, n)
        at = lambda p: np.where(p < mark, 0, src[np.clip(shift + p, 0, len(src) - 1)] - own)
        pairs = np.stack([at(ends - width), at(ends)], 1)
        return [np.stack(self.offsets(texts[k], ids[k]), 1) if odd[k] else pairs[cut[k] : cut[k + 1]] for k in range(len(texts))]

    def _library(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.sp.encode(text, return_type="proto").pieces
        return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)


def replaced(m: CharMap, raw: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes after a map's replacements, and of each the original byte: of a replacement the one where its key starts."""
    start, size, value = m.matches(raw)
    if not len(start):
        return raw, src
    width = np.ones(len(raw), np.int64)
    inside = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    width[inside] = 0
    values, which = np.unique(value, return_inverse=True)
    texts = [np.frombuffer(m.replacement(int(v)), np.uint8) for v in values]
    width[start] = np.array([len(t) for t in texts], np.int64)[which]
    ends = np.cumsum(width)
    out = np.repeat(raw, width)
    for k, t in enumerate(texts):
        at = ends[start[which == k]] - len(t)
        for j, c in enumerate(t):
            out[at + j] = c
    return out, np.repeat(src, width)


def digests(path: str, with_ids: bool = False):
    """A worker for per_document: ids and decoded text of every document, as digests."""

    def make():
        codec = Codec(path)

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, b.num_rows, 64):
                yield some(b.slice(at, 64))

        def some(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [codec.sp.encode(t) for t in texts]
            ids_sha = [hashlib.sha256(str(i)[1:-1].replace(" ", "").encode()).hexdigest() for i in ids]
            text_sha = [hashlib.sha256(codec.sp.decode(i).encode()).hexdigest() for i in ids]
            spans = [zlib.crc32(np.ascontiguousarray(x, "<i8")) for x in codec.spans(texts, ids)]
            cols = [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(spans, pa.int64())]
            more = [pa.array([np.array(i, np.int32) for i in ids], pa.list_(pa.int32()))] if with_ids else []
            return pa.RecordBatch.from_arrays(cols + more, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", *["ids"] * with_ids])

        return work

    return make


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, pieces array<string>, starts and ends array<int> (byte spans of the original UTF-8), decoded.

    One row per input row. Null and empty texts have no pieces and decode to "". Texts of any length are encoded whole.
    Repeated rows give repeated rows; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    path = model or default_model()

    def make():
        codec = Codec(path)

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(b.num_rows):  # a batch for each document: rows are far larger than their texts
                text = b.column(1)[at].as_py() or ""
                ids = codec.sp.encode(text)
                starts, ends = codec.offsets(text, ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([codec.sp.id_to_piece(ids)], pa.list_(pa.string())), pa.array([starts], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int32())), pa.array([codec.sp.decode(ids)])],
                    ["doc_id", "ids", "pieces", "starts", "ends", "decoded"],
                )

        return work

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return common.per_document(picked, make, "doc_id long, ids array<int>, pieces array<string>, starts array<int>, ends array<int>, decoded string", ["doc_id", "text"])


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (of all (start, end) byte spans as little-endian 64-bit integers), one row per input row; null text counts as empty."""
    common.ship(docs.sparkSession)
    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return common.per_document(picked, digests(model or default_model()), DECODED, ["doc_id", "text"])


def tokenised(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, ids_sha256, decoded_sha256, spans_crc32: the digests' rows with the ids themselves."""
    common.ship(docs.sparkSession)
    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return common.per_document(picked, digests(model or default_model(), with_ids=True), DECODED + ", ids array<int>", ["doc_id", "text"])


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(common.table(spark, sf_dir, "documents"))
