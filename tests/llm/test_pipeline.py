"""The corpus pipeline against a brute-force version, and on odd tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillon.llm import decontaminate
from tests.llm.test_operators import brute_dedup, brute_join


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "benchmark_leaks", "token_ids"]
    names = set(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    en, de = "the of and to in is that for with as".split(), "der die und in den von zu das mit sich".split()
    word = lambda v: rng.choice(v) if rng.random() < 0.4 else "".join(rng.choice(["th", "er", "on", "an"] if v is en else ["ch", "ei", "sch", "ung"]) for _ in range(rng.randrange(1, 4)))
    make = lambda v, n: " ".join(word(v) for _ in range(n))
    bench = [(k, make(en, 30)) for k in range(5)]
    rows = []
    for k in range(150):
        v = en if k % 3 else de
        t = make(v, rng.randrange(30, 90))
        if k % 10 == 4 and rows:
            t = rows[rng.randrange(len(rows))][1] or t
        elif k % 10 == 5 and rows:
            w = (rows[rng.randrange(len(rows))][1] or t).split()
            w[rng.randrange(len(w))] = "changed"
            t = "  ".join(w)
        elif k % 10 == 6:
            t = t + " " + bench[k % 5][1] + " end"
        rows.append((k, t, "en" if v is en else "de", "s", len(t)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "12 34 !", "en", "s", 7), (1003, rows[0][1], None, None, None)]
    sf = f"{tmp_path}/sf"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("kept", F.lit("own")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    exact = brute_dedup(docs.items())
    docs = {i: t for i, t in docs.items() if exact[i][2]}
    near = brute_join(docs.items(), 5, 80, 100)
    docs = {i: t for i, t in docs.items() if near[i][1] == i}
    index = [decontaminate.normalised(t).decode() for _, t in bench]
    docs = {i: t for i, t in docs.items() if not any(b in decontaminate.normalised(t).decode() for b in index)}
    import sentencepiece

    from quillon.llm import piece_codec

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(docs) and len(docs) < 150
    for i, t in docs.items():
        assert got[i]["ids"] == sp.encode(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, sf, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, hub int, rep string"
    none = spark.createDataFrame([], schema)
    assert stage(spark, none, sf).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "x"), (1, "", "en", "s", 0, 1, "x"), (2, "the thing and the other of it " * 3, "en", "s", 9, None, None), (None, "the thing", "en", None, None, None, None)], schema)
    out = stage(spark, odd, sf)
    rows = out.collect()
    if name != "token_ids":
        assert out.columns == odd.columns
    assert any(r["doc_id"] == 2 for r in rows)
