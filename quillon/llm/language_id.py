"""Operator 10, language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Training uses a bounded sample of labelled documents (PER_LANG for each language; a documented parameter), of which the driver
gets n-gram counts and no texts, and follow-the-regularised-leader with an elastic net; a temperature is then fitted on sampled
documents that training did not see. Document frequencies come from all documents of the training fold. The weights that
aren't zero go to tasks; if they are over BROADCAST bytes, training is repeated with a doubled l1. Prediction reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Hashed n-grams of 1 to ORDERS characters in DIM columns; at most PER_LANG sampled documents of each language.
DIM, ORDERS, PER_LANG = 1 << 16, 3, 500
#: Characters that are run through numpy at once; longer texts go in pieces that overlap by an n-gram.
STEP = 1 << 20
#: More distinct labels than this are not languages: such a table is refused.
MOST_LANGS = 1000
#: Bytes of weights that are broadcast, and the elastic net's penalties.
BROADCAST, L1, L2 = 64_000_000, 1e-3, 1e-6
ALNUM = re.compile(r"[^\W\d_]")
MULTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def lettered(text: str) -> bool:
    """Whether a text has a letter, that is, a character of a Unicode category L*; numerals, fractions and superscripts are none."""
    return any(m.group().isalpha() for m in ALNUM.finditer(text))


def codes(text: str) -> np.ndarray:
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """Columns of the n-grams of each order that start in x."""
    h = np.zeros(len(x), np.uint64)
    for k in range(ORDERS):
        h = h[: len(x) - k] if len(x) > k else h[:0]
        h = (h + x[k:] + np.uint64(1)) * MULTS[k]
        yield ((h ^ (h >> np.uint64(31))) >> np.uint64(20)).astype(np.int64) & (DIM - 1)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a whole text and how often each occurs."""
    total = np.zeros(0, np.int64)
    x = codes(text)
    for at in range(0, len(x), STEP):
        total = np.concatenate([total, *grams(x[at : at + STEP + ORDERS - 1])])
    cols, n = np.unique(total, return_counts=True)
    return cols.astype(np.int32), n.astype(np.int32)


class Model:
    """Sparse weights, with the inverse document frequencies multiplied in: of column c the languages lang[at[c]:at[c + 1]] and their
    weights; bias; temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        """weights: DIM x languages, as training has them."""
        self.langs, self.bias, self.temperature = langs, bias, temperature
        cols, lang = np.nonzero(weights)
        self.lang, self.value = lang.astype(np.int16), weights[cols, lang].astype(np.float32)
        self.at = np.searchsorted(cols, np.arange(DIM + 1)).astype(np.int64)

    def size(self) -> int:
        return self.lang.nbytes + self.value.nbytes + self.at.nbytes

    def logits(self, text: str) -> np.ndarray:
        x, total, n = codes(text), np.zeros(len(self.langs)), 0
        for at in range(0, len(x), STEP):
            part = x[at : at + STEP + ORDERS - 1]
            for cols in grams(part):
                start = self.at[cols]
                size = self.at[cols + 1] - start
                ends = np.cumsum(size)
                k = np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
                total += np.bincount(self.lang[k], weights=self.value[k], minlength=len(total))
                n += len(cols)
        return (total / max(n, 1) + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not lettered(text):
            return "und", 0.0
        z = self.logits(text)
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each column occurs, and their number: partial sums of DIM rows a task."""

    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                seen, x = np.zeros(DIM, bool), codes(text)
                for at in range(0, len(x), STEP):
                    for cols in grams(x[at : at + STEP + ORDERS - 1]):
                        seen[cols] = True
                df += seen
                n += 1
        cols = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*cols, -1], pa.int32()), pa.array([*df[cols], n], pa.int64())], ["col", "n"])

    rows = docs.select("text").mapInArrow(run, "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).toArrow()  # DIM + 1 rows at most
    col, n = np.asarray(rows["col"]), np.asarray(rows["n"])
    df = np.zeros(DIM, np.int64)
    df[col[col >= 0]] = n[col >= 0]
    return df, int(n[col < 0].sum())


def fit(sample: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray, n_docs: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal on the sample's (columns, counts, lang); every fifth row is kept back to fit the temperature."""
    langs = sorted({x[2] for x in sample})
    if not langs:
        return Model([], np.zeros((DIM, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    number = {x: k for k, x in enumerate(langs)}
    rows = [(cols, (n / max(1, n.sum()) * idf[cols]).astype(np.float32), number[lang]) for cols, n, lang in sample]
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    held, train = order[::5], np.array([k for i, k in enumerate(order) if i % 5]) if len(rows) > 5 else order
    width = DIM + 1  # the last row is the bias, which has no penalty
    z, n = np.zeros((width, len(langs))), np.zeros((width, len(langs)))
    penalty = np.full((width, 1), l1)
    penalty[DIM] = 0

    def weight(cols):
        zc, nc, own = z[cols], n[cols], penalty[cols]
        return np.where(np.abs(zc) <= own, 0, -(zc - np.sign(zc) * own) / ((beta + np.sqrt(nc)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(train):
            cols, v, y = rows[k]
            cols, v = np.append(cols, DIM), np.append(v, 1.0).astype(np.float64)
            w = weight(cols)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            step = (np.sqrt(n[cols] + g * g) - np.sqrt(n[cols])) / alpha
            z[cols] += g - step * w
            n[cols] += g * g
    w = weight(np.arange(width))
    model = Model(langs, w[:DIM] * idf[:, None], w[DIM], 1.0)
    if model.size() - model.at.nbytes > BROADCAST:
        return fit(sample, df, n_docs, epochs, alpha, beta, 2 * l1, l2)
    kept = held if len(rows) > 5 else order
    scores = np.array([rows[k][1] @ w[rows[k][0]] + w[DIM] for k in kept])
    truth = np.array([rows[k][2] for k in kept])

    doubt = 1 / (len(truth) + 2)  # as one more row of a wrong language: held-back rows without an error would make it endlessly sure

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        s = np.log(np.exp(s).sum(1))[:, None] - s
        return float(((1 - doubt) * s[np.arange(len(truth)), truth] + doubt * s.mean(1)).mean())

    model.temperature = min(np.geomspace(1e-3, 20, 201), key=loss) if len(truth) else 1.0
    return model


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lang) as (doc_id, lang, columns, counts): at most DIM of them for a text of any length."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            found = [counts(t) for t in part.column(1).to_pylist()]
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], ["doc_id", "lang", "cols", "n"])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of docs' (doc_id, text, lang), from rows with text, lang and a fold other than 2. The sample of each language
    is drawn by a hash of doc_id; at most 2 * per_lang rows of each reach the driver."""
    common.ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where((fold(F.col("doc_id")) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    langs = rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} distinct values of lang")
    if not langs:
        return fit([], np.zeros(DIM), 0)
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    drawn = rows.withColumn("u", u).where(F.col("u") < F.element_at(share, F.col("lang")))
    drawn = drawn.select("doc_id", "text", "lang").mapInArrow(counted, "doc_id long, lang string, cols array<int>, n array<int>")
    got = drawn.withColumn("u", u).orderBy("u", "doc_id", "lang", "cols").limit(2 * per_lang * len(langs)).select("doc_id", "lang", "cols", "n").toArrow()
    got = got.take(pa.array(np.argsort(np.asarray(got["doc_id"]), kind="stable")))
    lists = [got[c].combine_chunks() for c in ("cols", "n")]
    cols, times, at = np.asarray(lists[0].flatten()), np.asarray(lists[1].flatten()), np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists[0]))))
    sample = [(cols[lo:hi], times[lo:hi], lang) for lo, hi, lang in zip(at[:-1], at[1:], got["lang"].to_pylist(), strict=True)]
    df, n = document_frequencies(rows)
    return fit(sample, df, n)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row per input row. `und` with score 0 where text is null or has no letter.
    held_out is false for a null doc_id. Only the text is looked at; other columns are ignored; an empty table stays empty."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BROADCAST bytes at most

    def make():
        own = shared.value

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            said = [own.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return work

    key = docs[id_col].cast("long")
    picked = docs.select(key.alias("doc_id"), F.coalesce(fold(key) == 2, F.lit(False)).alias("held_out"), docs[text_col].alias("text"))
    return common.per_document(picked, make, "doc_id long, held_out boolean, lang_pred string, score double", ["doc_id", "held_out", "text"])


def accepted(docs: DataFrame, model: Model, least_score: float = 0.0) -> DataFrame:
    """docs' rows, all columns, whose text has a language, that is, isn't `und`, and a calibrated score of least_score or more."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def holds(text):
            lang, score = own.predict(text)
            return lang != "und" and score >= least_score

        return holds

    return common.rows_where(docs, make, ["text"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
