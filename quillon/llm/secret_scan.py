"""Operator 6, secret scans with a linear-chain conditional random field.

Tokens are tagged as begin (B) or inside (I) of a secret or outside (O) from the shapes of the token and its neighbours and
features of the file. Weights are trained here by maximum likelihood on generated lines and on prose lines of a bounded
sample of the corpus. Tags are decoded by Viterbi; a token whose margin for O exceeds all that transitions can give is O in
any best path, so only the stretches between such tokens are decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

# The base patterns; matches whose checked part is shorter than the last number are dropped.
BASE = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-]+))", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
]
KINDS = {"assign": 0, "access": 1, "hex": 2, "crf": 3}
KEYWORDS = {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials", "access_key", "secret_key", "access_token", "private_key", "authorization"}
PREFIXES = ("AKIA", "ghp_", "gho_", "sk-", "xox", "eyJ", "glpat-", "AIza")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|\S")
#: Neighbours that a token's score looks at, a found secret's least length.
OFFSETS, LEAST = (-3, -2, -1, 0, 1), 8
#: Bounds of what is trained on: sampled documents, distinct lines of them, words and characters of a line, tokens of a sequence.
SAMPLE_DOCS, SAMPLE_LINES, LINE_WORDS, LINE_CHARS, MOST_TOKENS = 200, 600, 20, 400, 48
O, B, I = 0, 1, 2


def features(token: str) -> tuple[str, ...]:
    n = len(token)
    size = n if n < 4 else 4 if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 24 else 24 if n < 40 else 40
    if n == 1:
        return ("c" + token if token.isascii() and not token.isalnum() else "digit1" if token.isdigit() else "letter1",)
    if not token.isascii():
        return ("other",)
    low = token.lower()
    if low in KEYWORDS or low.rpartition("_")[2] in KEYWORDS:
        return ("keyword",)
    if token.isalpha():
        return (f"lower{size}" if token.islower() else f"title{size}" if token[1:].islower() else f"upper{size}" if token.isupper() else f"mixed{size}", f"alpha{size}")
    if token.isdigit():
        return ("digits", f"digits{size}")
    alnum = any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
    out = ["alnum" if alnum else "signs", f"{'alnum' if alnum else 'signs'}{size}"]
    if alnum and set(low) <= set("0123456789abcdef"):
        out.append(f"hex{size}")
    if token.startswith(PREFIXES):
        out.append("prefix")
    if n >= 12:
        out.append(f"varied{len(set(token)) * 4 // n}")
    if alnum and low != token and token.upper() != token:
        out.append("bothcases")
    if "-" in token or "/" in token:
        out.append("parted")
    return tuple(out)


def file_feature(text: str) -> int:
    """0 prose, 1 some assignments, 2 mostly assignments."""
    signs = text.count("=") + text.count(":")
    return 0 if not signs else 1 if signs * 200 < len(text) else 2


class Field:
    """weights[offset][feature] and file[feature] are scores of O, B, I; trans[from, to]."""

    def __init__(self, weights: dict[tuple[int, str], np.ndarray], file: np.ndarray, trans: np.ndarray):
        self.weights, self.file, self.trans = weights, file, trans
        self.types: dict[tuple[str, ...], int] = {}
        self.tokens: dict[str, int] = {}
        self.table = np.zeros((256, len(OFFSETS), 3))
        gains = [trans[a, y] + trans[y, c] - trans[a, O] - trans[O, c] for a in range(3) for y in (B, I) for c in range(3)]
        gains += [trans[y, c] - trans[O, c] for y in (B, I) for c in range(3)] + [trans[a, y] - trans[a, O] for y in (B, I) for a in range(3)]
        self.gain = max([*gains, 0.0]) + 1e-9

    def type_of(self, token: str) -> int:
        f = features(token)
        k = self.types.get(f)
        if k is None:
            k = self.types[f] = len(self.types)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for o, off in enumerate(OFFSETS):
                self.table[k, o] = sum((self.weights.get((off, x), 0.0) for x in f), np.zeros(3))
        if len(self.tokens) >= 500_000:
            self.tokens.clear()
        self.tokens[token] = k
        return k

    def scores(self, tokens: list[str], file: int) -> np.ndarray:
        get, own = self.tokens.get, self.type_of
        idx = np.fromiter((k if (k := get(t)) is not None else own(t) for t in tokens), np.int32, len(tokens))
        s = np.zeros((len(tokens), 3)) + self.file[file]
        for o, off in enumerate(OFFSETS):
            part = self.table[idx, o]
            if off < 0:
                s[-off:] += part[:off]
            elif off > 0:
                s[:-off] += part[off:]
            else:
                s += part
        return s

    def tags(self, s: np.ndarray) -> dict[int, int]:
        """Tokens that the best path doesn't tag O."""
        sure = s[:, O] - s[:, 1:].max(1) > self.gain
        open_ = np.flatnonzero(~sure)
        out: dict[int, int] = {}
        if not len(open_):
            return out
        breaks = np.flatnonzero(np.diff(open_) > 1)
        for lo, hi in zip([0, *breaks + 1], [*breaks, len(open_) - 1], strict=True):
            a, b = int(open_[lo]), int(open_[hi]) + 1
            v = s[a] + (self.trans[O] if a else 0)
            back = []
            for t in range(a + 1, b):
                m = v[:, None] + self.trans
                back.append(m.argmax(0))
                v = m.max(0) + s[t]
            if b < len(s):
                v = v + self.trans[:, O]
            y = int(v.argmax())
            for t in range(b - 1, a - 1, -1):
                if y != O:
                    out[t] = y
                if t > a:
                    y = int(back[t - a - 1][y])
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character spans of the decoded secrets: B and the Is after it; an I without a B begins one."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        tagged = self.tags(self.scores(tokens, file_feature(text)))
        if not tagged:
            return []
        out: list[list[int]] = []
        for k, m in enumerate(TOKEN.finditer(text)):
            y = tagged.get(k, O)
            if y == I and tagged.get(k - 1, O) != O:
                out[-1][1] = m.end()
            elif y != O:
                out.append([m.start(), m.end()])
        return [(a, b) for a, b in out if b - a >= LEAST]


def generated(rng: np.random.Generator, lines: list[str], n: int = 1200) -> list[tuple[list[str], list[int], int]]:
    """Labelled lines: (tokens, tags, file feature), half of them with a secret."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    abc = {"hex": "0123456789abcdef", "b62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "up": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    run = lambda kind, lo, hi: "".join(pick(abc[kind]) for _ in range(int(rng.integers(lo, hi))))
    words = [w for line in lines for w in line.split()] or ["the", "of", "a", "note", "on", "value"]
    prose = lambda lo, hi: " ".join(pick(words) for _ in range(int(rng.integers(lo, hi))))
    out = []
    for k in range(n):
        before, after = prose(0, 7), prose(0, 5)
        if k % 2:
            kind = int(rng.integers(7))
            secret = [run("hex", 24, 64), run("b62", 16, 48), "AKIA" + run("up", 16, 17), run("b64", 20, 44), "ghp_" + run("b62", 30, 40), run("b62", 10, 20), "sk-" + run("b62", 20, 48)][kind]
            word = pick(sorted(KEYWORDS))
            lead = pick([f'{word} = "', f"{word}: ", f"{word}=", f"{word} is ", f"{word.upper()}=", "Authorization: Bearer ", f'"{word}": "'] + ([""] if kind in (0, 2, 4, 6) else []))
            mid, file = lead + secret, int(rng.integers(3))
        else:
            secret = None
            n16 = "".join(str(int(x)) for x in rng.integers(0, 10, 16))
            mid = pick([prose(3, 9), prose(3, 9), n16, f"+1 ({n16[:3]}) 555-{n16[3:7]}", f"{n16[:2]}.{n16[2:4]}.{n16[4:6]}.{n16[6:7]}", f"{pick(words)}{n16[:2]}@mail{n16[3]}.example.com", f"http://{pick(words)}.example.org/{pick(words)}/{n16[:4]}", "the secret of the token", "password: " + pick(words), f"{n16[:4]}-{n16[4:6]}-{n16[6:8]}", " | ".join(pick(words) for _ in range(4)), "".join(pick("#$%&*!") for _ in range(3)), pick(words).upper() + "!!", f"{pick(words)}-{pick(words)}", f"version {n16[0]}.{n16[1]}", f"id {n16[:8]}"])
            file = int(rng.integers(2))
        text = f"{before} {mid} {after}"
        at = text.index(secret) if secret else -1
        tokens, tags = [], []
        for m in TOKEN.finditer(text):
            tokens.append(m.group())
            inside = secret and at <= m.start() < at + len(secret)
            tags.append((B if m.start() == at else I) if inside else O)
        out.append((tokens, tags, file))
    return out + [(TOKEN.findall(line), [O] * len(TOKEN.findall(line)), 0) for line in lines]


def fit(lines: list[str], epochs: int = 12, batch: int = 64, seed: int = 11) -> Field:
    """Maximum likelihood by AdaGrad with a small L2 penalty; forward-backward runs over padded batches."""
    rng = np.random.default_rng(seed)
    data = [d for d in generated(rng, lines) if 0 < len(d[0]) <= MOST_TOKENS]
    names: dict[tuple[int, str], int] = {}
    rows = []
    for tokens, tags, file in data:
        fs = [features(t) for t in tokens]
        rows.append(([[names.setdefault((off, x), len(names)) for off in OFFSETS if 0 <= t + off < len(fs) for x in fs[t + off]] for t in range(len(fs))], tags, file))
    w, g2 = np.zeros((len(names) + 3, 3)), np.full((len(names) + 3, 3), 1e-8)
    trans, tg = np.zeros((3, 3)), np.full((3, 3), 1e-8)
    lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
    flat = []
    for fs, tags, file in rows:
        t_of = np.repeat(np.arange(len(fs)), [len(f) + 1 for f in fs])
        cols = np.array([c for f in fs for c in (*f, len(names) + file)])
        flat.append((t_of, cols, np.array(tags)))
    for _ in range(epochs):
        order = rng.permutation(len(flat))
        for lo in range(0, len(order), batch):
            own = [flat[k] for k in order[lo : lo + batch]]
            n = np.array([len(x[2]) for x in own])
            t_max, m = int(n.max()), len(own)
            at = np.concatenate([x[0] + k * t_max for k, x in enumerate(own)])
            cols = np.concatenate([x[1] for x in own])
            e = np.zeros((m * t_max, 3))
            np.add.at(e, at, w[cols])
            e = e.reshape(m, t_max, 3)
            mask = np.arange(t_max) < n[:, None]
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, t_max):
                step = lse(fwd[:, t - 1, :, None] + trans, 1) + e[:, t]
                fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
            for t in range(t_max - 2, -1, -1):
                step = lse(trans + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
            z = lse(fwd[:, -1], 1)
            p = np.where(mask[..., None], np.exp(fwd + bwd - z[:, None, None]), 0)
            gt = np.zeros((3, 3))
            for t in range(1, t_max):
                q = np.exp(fwd[:, t - 1, :, None] + trans + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
                gt += (q * mask[:, t, None, None]).sum(0)
            for k, x in enumerate(own):
                p[k, np.arange(n[k]), x[2]] -= 1
                np.add.at(gt, (x[2][:-1], x[2][1:]), -1.0)
            g = np.zeros_like(w)
            np.add.at(g, cols, p.reshape(-1, 3)[at])
            g = g / m + 1e-4 * w
            gt = gt / m + 1e-4 * trans
            g2 += g * g
            tg += gt * gt
            w -= 0.3 * g / np.sqrt(g2)
            trans -= 0.3 * gt / np.sqrt(tg)
    return Field({k: w[v] for k, v in names.items()}, w[len(names) :], trans)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    signs = ":" in text or "=" in text
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not signs or kind == "access" and "AKIA" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS[s[0]], s[2])))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field trained on generated lines and on prose lines of at most sample_docs documents, drawn by a hash of doc_id.

    Prose lines have no digit, colon, equals or at sign. Of all that the sampled documents have, SAMPLE_LINES distinct ones are
    drawn by a hash of the line and cut to LINE_WORDS words and LINE_CHARS characters; no more than these reach the driver.
    """
    ids = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("doc_id", F.lit("secrets")).alias("u")).orderBy("u", "doc_id").limit(sample_docs)
    ids = [r["doc_id"] for r in ids.collect() if r["doc_id"] is not None]  # the ids first: a sorted limit of texts would send many to the driver
    if not ids:
        return fit([])
    lines = docs.where(F.col("doc_id").isin(ids)).select(F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike("[0-9=:@]"))
    lines = lines.select(F.substring(F.array_join(F.slice(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), 1, LINE_WORDS), " "), 1, LINE_CHARS).alias("line"))
    drawn = lines.where("line <> ''").distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES)
    return fit([r["line"] for r in drawn.collect()])


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, a row per input row.

    spans: kind:start:end in code points, end exclusive, by start, then kind (assign, access, hex, crf), comma-joined. The
    field's spans that overlap a base span are left out; base spans always stay. Null counts as empty; without spans the string is
    empty. Texts of any length are read whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast((field.weights, field.file, field.trans))  # a few hundred features

    def make():
        own = Field(*shared.value)

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                found = common.apart([("crf", a, e) for a, e in own.spans(text or "")], base)
                count = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
                rows.append((doc, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + found)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in SCANNED.split(", ")])

        return work

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return common.per_document(picked, make, SCANNED, ["doc_id", "text"])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return secret_scan(docs, train(docs))
