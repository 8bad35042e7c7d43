"""Exact search against brute force, the queries' columns, and the pipeline."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from graphfold.llm import queries, search

SMALL = "/root/testdata/sf0.001"


def by_hand(rows, is_query, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = [math.floor(256 * float(np.float32(x))) for x in v]
            vectors[i] = min(vectors.get(i, own), own)
    out = []
    for q in filter(is_query, vectors):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    rng = random.Random(1)
    rows += [(1000 + i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(64)]) for i in range(60)]  # many ties
    rows += [(2000, None), (2050, [0.1, None]), (2100, [float("nan")] * 64), (2150, [float("inf")] * 64), (2200, [1.5] * 10), (2250, []), (None, [0.2] * 64), (1000, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    vectors = search.whole_vectors(frame, "vec_id", "embedding")
    for options in ({}, {"pivots": 3, "block_rows": 50, "sample_rows": 40}, {"pivots": 2, "block_rows": 7, "sample_rows": 3}):
        assert found(search.top_k(vectors, F.col("vec_id") % 50 == 0, **options)) == by_hand(rows, lambda i: i % 50 == 0, 5)
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert search.top_k(search.whole_vectors(one, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).count() == 0
    assert search.top_k(search.whole_vectors(one.limit(0), "vec_id", "embedding"), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_stay_exact():
    a = np.array([[2**30, 3]], np.int64)
    assert search.products(a, a)[0, 0] == 2**60 + 9


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == names, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    ran = pipeline.run(spark, SMALL).collect()
    assert sorted({r.doc_id for r in ran}) == sorted({r.doc_id for r in packed})
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_pipeline_on_an_odd_table(spark):
    """Clashing column names, nulls in all columns, repeated rows, ties and a very long text go through every stage."""
    import corpus_pipeline as pipeline

    clashing = ["kept", "key", "rep", "bands", "base", "found", "gf_row", "gf_i", "lang_pred", "score", "words", "sig", "n_words", "symbols", "start", "ids"]
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = random.Random(3)
    long_text = " ".join(rng.choice(["the", "and", "of", "thing", "other"]) + str(rng.randrange(10**5)) for _ in range(60_000))
    first = base.where("lang = 'en'").orderBy("doc_id").limit(40).collect()
    rows = [tuple(r) for r in base.collect()] + [(None, None, None, None, None), (None, first[0].text, None, None, 3), tuple(first[1]), (10**6, long_text, "en", "s", len(long_text)), (10**6 + 1, long_text, "en", "s", len(long_text)), (10**6 + 2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, base.schema).withColumns({c: F.lit(c) for c in clashing})
    names = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL).cache()
        assert after.columns == names, name
        assert after.where(" or ".join(f"{c} <> '{c}'" for c in clashing)).count() == 0
        if name != "secret scan":
            assert after.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0, name
        docs = after
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert (10**6 in ids) + (10**6 + 1 in ids) <= 1 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == set(ids)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))
