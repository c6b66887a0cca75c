"""What queries over many documents must not do: make tokens twice, hold a batch's results at once, list all pairs, encode documents for terms."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.functions import text as txt
from tesserae.operators import chunk, embed, retrieve, vector_store


def test_tokens_equal_those_of_built_in_functions(spark):
    rng = random.Random(3)
    pool = "abcXYZ 019-'_.@/+`\n\tßŒœſªµ½ﬁ’–…é東京한국नमसмирשל​９A"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(50))) for _ in range(2000)] + [None, "", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = txt.tokenize(txt.normalize(F.col("text")))
    want = {r["doc_id"]: (r["a"], r["c"]) for r in rows.select("doc_id", plain.alias("a"), txt.content(plain).alias("c")).collect()}
    got = rows.select("doc_id", txt.tokens(F.col("text")).alias("a"), txt.content_tokens(F.col("text")).alias("c"), txt.count_tokens(F.col("text")).alias("n")).collect()
    assert {r["doc_id"]: (r["a"], r["c"]) for r in got} == want and all(r["n"] == len(r["a"]) for r in got)
    assert {r["doc_id"]: r["tokens"] for r in txt.token_rows(rows, "doc_id").collect()} == {k: c for k, (_, c) in want.items()}


def test_tokens_of_documents_are_made_once(spark):
    from conftest import SF
    from tesserae.plans import registry

    plan = registry.tokenized(spark, SF).select("doc_id", F.explode("tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_workers_hand_on_slices():
    texts = pa.array(["a" * 400_000, None, "b" * 700_000, "c" * 3_000_000, "d", ""])
    assert list(txt.slices(texts)) == [(0, 2), (2, 1), (3, 1), (4, 2)] and list(txt.slices(pa.array([], pa.string()))) == []
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), texts], names=["doc_id", "text"])
    assert [b.num_rows for b in chunk._sliced([batch])] == [2, 1, 1, 2]


def test_highlighting_takes_only_words_that_begin_alike(spark):
    made = next(txt._alike(iter([(pa.array(["Walking walks, walnut; token tok x to"]), pa.array([["walk", "to"]]))])))
    assert [w["word"] for w in made[0].as_py()] == ["walking", "walks", "walnut", "to"]
    row = spark.createDataFrame([("Walking walks, walnut; token tok x to",)], "t string").select(txt.highlight_spans(F.col("t"), F.array(F.lit("walk"), F.lit("to"))).alias("s")).first()
    assert [tuple(x) for x in row["s"]] == [(0, 13), (35, 37)]


def test_searches_of_a_store_keep_the_best_of_each_partition(spark, tmp_path):
    rng = np.random.default_rng(1)
    own = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(300, 8)))] + [(k, [1.0] * 8) for k in range(300, 320)]
    rows = spark.createDataFrame(own, "chunk_id long, vector array<double>").coalesce(2)
    asked = rows.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    vector_store.create(rows, f"{tmp_path}/store", 4)
    search = vector_store.VectorSearch(spark, f"{tmp_path}/store", asked, k=3, probes=4)
    made = search.scores(search.near)
    assert made.groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] <= 3
    matrix = np.array([v for _, v in own])
    for q in range(0, 320, 20):
        score = (matrix * matrix[q]).sum(axis=1)
        want = np.lexsort((np.arange(320), -score))[:3].tolist()
        assert [r["chunk_id"] for r in search.hits.filter(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_terms_are_compared_without_vectors_of_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ["red", "green", "blue", f"w{k % 3}"]) for k in range(12)], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("red",)], "term string")
    want = sorted(map(tuple, embed.fit_ppmi(docs, 16).neighbours(words, 2).collect()))
    monkeypatch.setattr(embed, "_raw", lambda *_: 1 / 0)
    assert sorted(map(tuple, embed.fit_ppmi(docs, 16, direction=False).neighbours(words, 2).collect())) == want


def test_words_within_two_edits_of_long_ones(spark):
    words = ["y" * 300, "x" + "y" * 300, "y" * 150 + "c" + "y" * 149, "x" + "y" * 100 + "c" + "y" * 198, "ab", "b", "a"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {(r["term"], r["other"]): r["d"] for r in retrieve.within_edits(spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(w,) for w in words], "other string")).collect()}
    assert got == {(a, b): d for a in words for b in words if (d := edits(a, b)) <= 2}


def test_reranking_and_answers_read_the_documents_tokens_once(spark, monkeypatch):
    from conftest import SF
    from tesserae.plans import registry

    made = []
    monkeypatch.setattr(registry, "tokenized", lambda s, d, f=registry.tokenized: made.append(1) or f(s, d))
    registry.rerank(spark, SF)
    registry.extractive_answers(spark, SF)
    assert len(made) == 2
