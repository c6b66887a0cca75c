"""Documents in blocks: terms are looked up once for each block, and neither vectors nor rows of a document and term are shuffled."""

import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from tesserae.operators import blocks, chunk, embed, pairs, stats
from tesserae.plans import registry
from tesserae.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    own = [(k, [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.randrange(0, 40))]) for k in range(60)]
    return spark.createDataFrame([*own, (3, ["w1", "w2", "lonely"]), (None, ["w1"]), (100, None)], "doc_id long, tokens array<string>").coalesce(2)


@pytest.fixture(scope="module")
def model(docs):
    return embed.fit_ppmi(docs, 16)


def test_blocks_keep_all_tokens_and_count_terms(docs, monkeypatch):
    for name, most in (("TOKENS", 100), ("TERMS", 30), ("SLICE", 25), ("ROW", 7)):
        monkeypatch.setattr(blocks, name, most)
    own = blocks.blocks(docs)
    words = {(r["block"], r["code"]): r for r in blocks.dictionaries(own).collect()}
    told = sorted((str(r["doc_id"]), [words[r["block"], c]["term"] for c in r["codes"]]) for r in own.filter("codes is not null").collect())
    rows = [(r["doc_id"], r["tokens"] or []) for r in docs.collect()]
    assert told == sorted((str(d), ts) for d, ts in rows) and len({b for b, _ in words}) > 5
    tf, df = Counter(t for _, ts in rows for t in ts), Counter(t for _, ts in rows for t in set(ts))
    assert sum((Counter({r["term"]: r["tf"]}) for r in words.values()), Counter()) == tf
    assert sum((Counter({r["term"]: r["df"]}) for r in words.values()), Counter()) == df
    assert blocks.repeated(own) and not blocks.repeated(blocks.blocks(docs.filter("doc_id <> 3")))


def test_encoding_looks_a_term_up_once_for_each_block(docs, model, monkeypatch):
    vectors = {r["term"]: np.array(r["vector"]) for r in model.vectors.collect()}
    idf = {r["term"]: r["idf"] for r in model.terms.collect()}
    bags = {}
    for r in docs.collect():
        bags.setdefault(r["doc_id"], []).extend(r["tokens"] or [])
    met, seen = blocks.met, []
    monkeypatch.setattr(blocks, "met", lambda of, known, *a: seen.append((blocks.dictionaries(of).count(), known)) or met(of, known, *a))
    for most in (blocks.TOKENS, 60):
        monkeypatch.setattr(blocks, "TOKENS", most)
        monkeypatch.setattr(blocks, "SLICE", 25)
        got = {r["doc_id"]: np.array(r["vector"]) for r in replace(model, common=None, fitted=None).encode(docs).collect()}
        assert set(got) == set(bags)
        for d, ts in bags.items():
            v = sum((idf[t] * vectors[t] for t in ts if t in vectors), np.zeros(16))
            assert np.allclose(got[d], v / max(np.linalg.norm(v), 1e-12), atol=1e-9)
    n = sum(len(set(ts)) for ts in bags.values())
    assert seen[0][0] < n / 4 and seen[0][1].count() == seen[0][1].select("term").distinct().count()


def test_drift_by_a_model_equals_that_by_vectors_of_all_units(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(" ".join(f"w{int(r.paretovariate(0.7)) % 40}" for _ in range(r.randrange(1, 12))).capitalize() + "." for _ in range(r.randrange(0, 25))) for _ in range(25)]
    rows = spark.createDataFrame([*enumerate(texts), (90, None), (91, "..."), (92, "w1 " * 300)], "doc_id long, text string")
    model = embed.fit_ppmi(registry.txt.token_rows(rows, "doc_id"), 16)
    told = lambda df: sorted(map(tuple, df.select("doc_id", "ordinal", "text", "token_count").collect()))
    want = told(chunk.drift(rows, model.encode, 0.8, 12, 40))
    monkeypatch.setattr(chunk, "with_nearness", lambda *_: 1 / 0)
    assert told(chunk.drift(rows, model, 0.8, 12, 40)) == want and len(want) > 40


def test_terms_are_counted_without_a_row_for_each_document_and_term(spark, docs, monkeypatch):
    one = docs.filter("doc_id <> 3")
    want = sorted(map(tuple, stats.term_stats(one).collect()))
    assert sorted(map(tuple, stats.block_stats(docs, blocks.blocks(docs)).collect())) == sorted(map(tuple, stats.term_stats(docs).collect()))
    monkeypatch.setattr(stats, "term_stats", lambda *_: 1 / 0)
    assert sorted(map(tuple, stats.block_stats(one, blocks.blocks(one)).collect())) == want
    registry.char_encode(spark, SF)
    registry._pairs(spark, SF)


def test_numbers_as_bytes():
    r = np.random.default_rng(1)
    for _ in range(50):
        sizes = r.integers(0, 6, r.integers(0, 9))
        v = np.concatenate([np.sort(r.integers(0, 1 << int(r.integers(1, 62)), n)) for n in sizes] + [np.zeros(0, np.int64)]).astype(np.int64)
        own = pairs.to_bytes(pairs.gaps(v, sizes), sizes)
        for lo in (0, len(sizes) // 2):
            found, n = pairs.from_bytes(own.slice(lo))
            assert (n == sizes[lo:]).all() and (pairs.from_gaps(found, n) == v[sizes[:lo].sum() :]).all()


def test_pairs_of_three_million_terms_go_as_arrays_in_few_bytes(spark):
    r = np.random.default_rng(2)
    n, ids = 3_000_000, spark.createDataFrame([([int(x) for x in r.integers(0, 3_000_000, 3000)],) for _ in range(10)], "ids array<int>").coalesce(1)
    names = spark.range(3).selectExpr("cast(id as int) id", "string(id) term")
    own = pairs.Pairs(names, n, ids, 5, 60, spark.range(1).selectExpr("cast(id as int) id", "1L units"))
    assert own.strongest(4) is not None
    rows = own.rows()
    shipped = rows._jdf.queryExecution().analyzed().toString()
    assert "pairs" in shipped and "array<int>" not in shipped
    got = {(x["a"], x["b"]): x["weight"] for x in rows.collect()}
    want = Counter()
    for (ts,) in ids.collect():
        for i, a in enumerate(ts):
            for d in range(1, 6):
                if i + d < len(ts) and ts[i + d] != a:
                    want[a, ts[i + d]] += 60 // d
                    want[ts[i + d], a] += 60 // d
    assert got == {k: u / 60 for k, u in want.items()}


def test_vectors_of_terms_are_not_stored(docs, monkeypatch):
    monkeypatch.setattr(tables, "_written", [])
    model = embed.fit_ppmi(docs, 16, direction=False)
    assert model.vectors.count() > 10 and not [p for p in tables._written if "tesserae-vectors-" in p]
