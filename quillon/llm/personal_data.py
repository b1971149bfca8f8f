"""Operator 7, personal data with a character-level bidirectional LSTM and CRF transitions, in numpy.

The network is trained here from labelled spans in generated text. Texts are read in overlapping windows; each window is
decoded by Viterbi, and every character takes its tag from the window in which it stands most centrally, over the whole text.
A span must hold a digit or an at sign, as all four kinds do, so windows without either can't hold one and aren't decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGIT = re.compile(r"[0-9]")
#: Characters of a window and from one to the next; hidden units of each direction; windows decoded at once.
WINDOW, STRIDE, HIDDEN, TOGETHER = 64, 32, 16, 512
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SIGNS = "@.-+()_%:/,\"'=|#"
SYMBOLS = 8 + len(SIGNS)
CODES = np.full(128, 7, np.uint8)  # 0 padding, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 letter beyond ASCII, 7 other
for _c in range(128):
    _s = chr(_c)
    CODES[_c] = 1 if "a" <= _s <= "z" else 2 if "A" <= _s <= "Z" else 3 if "0" <= _s <= "9" else 5 if _s in "\r\n" else 4 if _s in " \t\x0b\x0c" else 8 + SIGNS.index(_s) if _s in SIGNS else 7


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind: str, text: str) -> bool:
    """Whether a span can be of a kind: what the base asks of its matches; for the network's, the same but for how it is written."""
    digits = "".join(DIGIT.findall(text))
    if kind == "email":
        return "@" in text
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split(".")) if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text) else False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in BASE["email"].finditer(text)]
    if DIGIT.search(text):
        for kind in KINDS[1:]:
            if kind != "phone" or "+" in text:
                out += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text) if holds(kind, m.group())]
    return out


def symbols(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = CODES[np.minimum(x, 127)]
    wide = np.flatnonzero(x > 127)
    if len(wide):
        out[wide] = [6 if text[k].isalpha() else 4 if text[k].isspace() else 7 for k in wide]
    return out


class Network:
    """p: wf, wb (SYMBOLS x 4H), uf, ub (H x 4H), out (2H+1 x TAGS), trans (TAGS x TAGS); gates in the order i, f, o, g."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        h = HIDDEN
        p = {"wf": rng.normal(0, 0.3, (SYMBOLS, 4 * h)), "wb": rng.normal(0, 0.3, (SYMBOLS, 4 * h)), "uf": rng.normal(0, 0.2, (h, 4 * h)), "ub": rng.normal(0, 0.2, (h, 4 * h)), "out": rng.normal(0, 0.2, (2 * h + 1, TAGS)), "trans": np.zeros((TAGS, TAGS))}
        for w in ("wf", "wb"):
            p[w][:, h : 2 * h] += 1  # remember at first
        return cls(p)

    def _run(self, x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """x: T x batch; the hidden states T x batch x H."""
        n, h = HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32)
        c, out = np.zeros_like(h), np.empty((*x.shape, HIDDEN), np.float32)
        for t in range(len(x)):
            a = w[x[t]] + h @ u
            s = 1 / (1 + np.exp(-a[:, : 3 * n]))
            g, c0, h0 = np.tanh(a[:, 3 * n :]), c, h
            c = s[:, n : 2 * n] * c + s[:, :n] * g
            tc = np.tanh(c)
            h = s[:, 2 * n :] * tc
            out[t] = h
            if keep is not None:
                keep.append((s, g, c0, tc, h0))
        return out

    def scores(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x: batch x T symbols. Tag scores T x batch x TAGS, and the layer below them."""
        xt = x.T
        f = self._run(xt, self.p["wf"], self.p["uf"], keep and keep[0])
        b = self._run(xt[::-1], self.p["wb"], self.p["ub"], keep and keep[1])[::-1]
        hid = np.concatenate([f, b, np.ones((*xt.shape, 1), np.float32)], 2)
        return hid @ self.p["out"], hid

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi over each window: batch x T tags."""
        e, _ = self.scores(x)
        v, back, trans = e[0], [], self.p["trans"]
        for t in range(1, len(e)):
            m = v[:, :, None] + trans
            k = m.argmax(1)
            back.append(k)
            v = np.take_along_axis(m, k[:, None, :], 1)[:, 0] + e[t]
        y = np.empty((len(x), len(e)), np.int8)
        y[:, -1] = v.argmax(1)
        rows = np.arange(len(x))
        for t in range(len(e) - 2, -1, -1):
            y[:, t] = back[t][rows, y[:, t + 1]]
        return y

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (batch x T) and its gradients."""
        kf, kb = [], []
        xt, m = x.T, len(x)
        f = self._run(xt, self.p["wf"], self.p["uf"], kf)
        b = self._run(xt[::-1], self.p["wb"], self.p["ub"], kb)[::-1]
        hid = np.concatenate([f, b, np.ones((*xt.shape, 1), np.float32)], 2)
        e, trans, t_max = hid @ self.p["out"], self.p["trans"], len(xt)
        lse = lambda a, axis: a.max(axis) + np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis))
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[0] = e[0]
        for t in range(1, t_max):
            fwd[t] = lse(fwd[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(t_max - 2, -1, -1):
            bwd[t] = lse(trans + (e[t + 1] + bwd[t + 1])[:, None, :], 2)
        z = lse(fwd[-1], 1)
        de = np.exp(fwd + bwd - z[None, :, None])
        yt, rows = y.T.astype(np.int64), np.arange(m)
        dtrans, gold = np.zeros_like(trans), e[0][rows, yt[0]].copy()
        for t in range(1, t_max):
            dtrans += np.exp(fwd[t - 1][:, :, None] + trans + (e[t] + bwd[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dtrans, (yt[t - 1], yt[t]), -1)
            gold += e[t][rows, yt[t]] + trans[yt[t - 1], yt[t]]
        for t in range(t_max):
            de[t][rows, yt[t]] -= 1
        de /= m
        dhid = de @ self.p["out"].T
        g = {"out": np.tensordot(hid, de, ((0, 1), (0, 1))), "trans": dtrans / m}
        for w, u, saved, dh_all, xs in (("wf", "uf", kf, dhid[:, :, :HIDDEN], xt), ("wb", "ub", kb, dhid[::-1, :, HIDDEN : 2 * HIDDEN], xt[::-1])):
            dw, du, n = np.zeros_like(self.p[w]), np.zeros_like(self.p[u]), HIDDEN
            dh, dc = np.zeros((m, n), np.float32), np.zeros((m, n), np.float32)
            for t in range(t_max - 1, -1, -1):
                s, gg, c0, tc, h0 = saved[t]
                dh = dh + dh_all[t]
                i, fo, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
                dc = dc + dh * o * (1 - tc * tc)
                da = np.concatenate([dc * gg * i * (1 - i), dc * c0 * fo * (1 - fo), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                np.add.at(dw, xs[t], da)
                du += h0.T @ da
                dh, dc = da @ self.p[u].T, dc * fo
            g[w], g[u] = dw, du
        return float((z - gold).mean()), g


def generated(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags: words with and without personal data, and with numbers that are none."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    word = lambda: "".join(pick(letters) for _ in range(int(rng.integers(1, 9))))

    def card():
        body = num(int(rng.integers(12, 16)))
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return body if rng.random() < 0.6 else pick(" -").join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b}{c}"])

    make = {
        "email": lambda: pick([f"{word()}@{word()}.com", f"{word()}.{word()}@{word()}.{word()}.org", f"{num(2)}@{word()}{num(1)}.example.com", f"{word()}_{num(3)}@{word()}-{word()}.net", f"{word()}+{word()}@{word()}.de"]).replace("é", "e").replace("ü", "u").replace("ñ", "n"),
        "ip": lambda: ".".join(str(int(d)) for d in rng.integers(1, 256, 4)),
        "card": card,
        "phone": phone,
    }
    none = [lambda: num(4), lambda: num(int(rng.integers(1, 9))), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(8, 40)))), lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(2)}:{num(2)}", lambda: f"@{word()}", lambda: f'token = "{num(3)}{word()}{num(3)}"', lambda: f"{num(1)},{num(3)},{num(3)}", lambda: num(22)]
    xs, ys = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int8)
    for k in range(n):
        text, tags = "", []
        while len(text) < 2 * WINDOW:
            r = rng.random()
            kind = pick(KINDS) if r < 0.16 else None
            part = make[kind]() if kind else pick(none)() if r < 0.3 else word() if rng.random() < 0.85 else word().capitalize()
            tags += [0] * len(part) if not kind else [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(part) - 1)
            gap = pick([" "] * 8 + [", ", ".\n", " | ", ". "])
            text += part + gap
            tags += [0] * len(gap)
        at = int(rng.integers(0, len(text) - WINDOW + 1))
        xs[k], ys[k] = symbols(text[at : at + WINDOW]), tags[at : at + WINDOW]
    return xs, ys


_trained: dict[tuple, Network] = {}


def train(steps: int = 260, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Network:
    """A network trained by Adam on generated windows; the same for the same arguments, and kept for the process."""
    if (key := (steps, batch, rate, seed)) in _trained:
        return _trained[key]
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    xs, ys = generated(rng, 3000)
    for step in range(1, steps + 1):
        own = rng.integers(0, len(xs), batch)
        _, g = net.gradients(xs[own], ys[own])
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        lr = rate * min(1.0, 2.2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    _trained[key] = net
    return net


def windows(x: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text that hold a digit or an at sign; windows start every STRIDE characters."""
    hit = np.flatnonzero((x == 3) | (x == 8)) // STRIDE
    starts = np.unique(np.concatenate([hit, hit - 1]))
    return starts[starts >= 0] * STRIDE


def reconciled(n: int, starts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Tags of a text of n characters: each from the window in which the character is most central."""
    out, best = np.zeros(n, np.int8), np.full(n, -1, np.int16)
    depth = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)).astype(np.int16)
    depth_first = np.where(np.arange(WINDOW) < WINDOW // 2, WINDOW, depth).astype(np.int16)  # nothing stands before a text's start
    for a, t in zip(starts, tags, strict=True):
        e = min(n, a + WINDOW)
        d = (depth_first if a == 0 else depth)[: e - a]
        take = d > best[a:e]
        out[a:e][take] = t[: e - a][take]
        best[a:e][take] = d[take]
    return out


def spans_of(tags: np.ndarray, text: str) -> list[tuple[str, int, int]]:
    """Runs of one kind's tags, without blanks and punctuation at their ends, that can be of the kind."""
    out, n, k = [], len(tags), 0
    on = np.flatnonzero(tags)
    while k < len(on):
        a = int(on[k])
        kind, e = (tags[a] - 1) // 2, a + 1
        while e < n and tags[e] == 2 * kind + 2:
            e += 1
        while k < len(on) and on[k] < e:
            k += 1
        own = text[a:e]
        a, e = a + len(own) - len(own.lstrip(" \n.,|:;")), e - len(own) + len(own.rstrip(" \n.,|:;"))
        if e > a and holds(KINDS[kind], text[a:e]):
            out.append((KINDS[kind], a, e))
    return out


ORDER = {k: i for i, k in enumerate([*KINDS, *(f"net-{k}" for k in KINDS)])}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{e}" for k, a, e in sorted(spans, key=lambda s: (ORDER[s[0]], s[1], s[2])))


SCANNED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, a row per input row.

    spans: kind:start:end in code points, end exclusive, by kind (email, ip, card, phone, then net- and each), then start. The
    network's spans that overlap a base span are left out; base spans always stay. Null counts as empty; without spans the
    string is empty. Texts of any length are read whole, in windows. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(network.p)  # a few thousand weights

    def make():
        net = Network(shared.value)

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found: dict[int, list] = {}
            queue: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush():
                grid = np.concatenate([np.stack([np.pad(x[a : a + WINDOW], (0, max(0, a + WINDOW - len(x)))) for a in starts]) for _, x, starts in queue])
                tags = np.concatenate([net.decode(grid[k : k + TOGETHER]) for k in range(0, len(grid), TOGETHER)])
                at = 0
                for k, x, starts in queue:
                    own = tags[at : at + len(starts)]
                    at += len(starts)
                    if own.any():
                        found[k] = spans_of(reconciled(len(x), starts, own), texts[k])
                queue.clear()

            waiting = 0
            for k, text in enumerate(texts):
                if "@" in text or DIGIT.search(text):
                    x = symbols(text)
                    queue.append((k, x, windows(x)))
                    waiting += len(queue[-1][2])
                    if waiting >= 8 * TOGETHER:
                        flush()
                        waiting = 0
            if queue:
                flush()
            rows = []
            for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), texts, strict=True)):
                base = base_spans(text)
                more = common.apart([(f"net-{kind}", a, e) for kind, a, e in found.get(k, ())], base)
                rows.append((doc, *(sum(s[0] == kind for s in base) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in SCANNED.split(", ")])

        return work

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return common.per_document(picked, make, SCANNED, ["doc_id", "text"])


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"), train())
