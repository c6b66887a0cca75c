"""The stored index, chunkers of SQL and streams that grow or watch, against plain Python and batch twins."""

import math
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as txt
from tesserae.operators import chunk, chunk_sql, embed, index, retrieve
from tesserae.streaming import indexing, streaks


def bm25(chunks: dict, query: list, k: int) -> list[tuple]:
    n, avg = len(chunks), sum(map(len, chunks.values())) / len(chunks)
    df = Counter(t for ts in chunks.values() for t in set(ts))
    out = []
    for c, ts in chunks.items():
        tf = Counter(ts)
        score = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.4 / (tf[t] + 1.4 * (0.28 + 0.72 * len(ts) / avg)) for t in set(query) if tf[t])
        if any(tf[t] for t in query):
            out.append((-round(score, 6), c))
    return [(c, -s) for s, c in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    chunks = {f"c{i}": rng.choices(words, weights, k=rng.randrange(0, 60)) for i in range(400)}
    chunks["same1"] = chunks["same2"] = ["w58", "w59", "w58"]
    queries = {i: rng.choices(words, k=rng.randrange(1, 6)) for i in range(25)} | {90: ["absent"], 91: [], 92: ["w58", "w59"]}
    return chunks, queries


def written(spark, chunks: dict, path: str, segment: int = 0, block: int = 8) -> None:
    index.write_segment(spark.createDataFrame(list(chunks.items()), "chunk_id string, tokens array<string>").repartition(3), path, segment, block)


def found(spark, path: str, queries: dict, **sizes) -> index.Search:
    return index.Search(index.Index.read(spark, path), spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>"), **sizes)


def test_pruned_search_equals_a_search_of_everything(spark, tmp_path, corpus):
    chunks, queries = corpus
    written(spark, chunks, f"{tmp_path}/i")
    search = found(spark, f"{tmp_path}/i", queries, k=4, first=3)
    got = {}
    for r in sorted(search.hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for q, terms in queries.items():
        assert [(c, pytest.approx(s, abs=2e-6)) for c, s in bm25(chunks, terms, 4)] == got.get(q, [])
    read, bounds = search.first.unionByName(search.rest), search.bounds
    assert read.distinct().count() == read.count() and read.count() < bounds.count()
    # of every block that was not read the bound is below the k-th score
    kth = {q: rows[-1][1] for q, rows in got.items() if len(rows) == 4}
    skipped = bounds.join(read, ["query_id", "block"], "left_anti").collect()
    assert skipped and all(r["bound"] < kth[r["query_id"]] for r in skipped)


def test_smallest_windows(spark, tmp_path, corpus):
    chunks, queries = corpus
    written(spark, chunks, f"{tmp_path}/i")
    search = found(spark, f"{tmp_path}/i", queries, k=4, first=3)
    hits = {(r["query_id"], r["chunk_id"]) for r in search.hits.collect()}
    got = {(r["query_id"], r["chunk_id"]): (r["n_terms"], r["width"], r["start"], r["stop"]) for r in search.proximity().collect()}
    assert set(got) == hits
    for (q, c), window in got.items():
        places = [[i for i, t in enumerate(chunks[c]) if t == term] for term in set(queries[q]) if term in chunks[c]]
        stop, start = min(((max(p) - min(p), max(p)), min(p)) for p in product(*places))
        assert window == (len(places), stop[0] + 1, start, stop[1])
    ranked = search.reranked().collect()
    assert {(r["query_id"], r["chunk_id"]) for r in ranked} == hits and all(0 < r["rerank"] <= 1 for r in ranked)


def test_an_empty_corpus_and_chunks_without_tokens(spark, tmp_path):
    index.write_segment(spark.createDataFrame([("a", []), ("b", None)], "chunk_id string, tokens array<string>"), f"{tmp_path}/i")
    assert index.Index.read(spark, f"{tmp_path}/i").n_docs == 2
    assert found(spark, f"{tmp_path}/i", {1: ["x"]}).hits.count() == 0


def test_a_segment_is_seen_once_it_is_whole(spark, tmp_path, corpus):
    import shutil

    chunks, queries = corpus
    path = f"{tmp_path}/i"
    written(spark, chunks, path)
    written(spark, {"new": ["w1", "w2"]}, path, 1)
    assert index.Index.read(spark, path).n_docs == len(chunks) + 1
    shutil.rmtree(f"{path}/corpus/segment=1")  # as if the writer had failed before its last step
    again = index.Index.read(spark, path)
    assert again.n_docs == len(chunks) and "new" not in {r["chunk_id"] for r in found(spark, path, {1: ["w1", "w2"]}, k=400).hits.collect()}


def test_a_stream_of_three_batches_one_of_them_replayed(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["river", "stone", "harbour", "ship", "bread", "salt", "house"]) + str(rng.randrange(3)) for _ in range(rng.randrange(2, 30)))) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(docs[k::3], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = indexing.index_stream(stream, f"{tmp_path}/i", f"{tmp_path}/c", availableNow=True)
    query.awaitTermination(120)
    assert query.exception() is None
    batches = sorted(r["segment"] for r in spark.read.parquet(f"{tmp_path}/i/corpus").select("segment").distinct().collect())
    assert batches == [0, 1, 2]
    # a batch that comes again
    part = index.Index.read(spark, f"{tmp_path}/i").postings.filter("segment = 1").select(F.inline("occurrences")).select(F.col("chunk_id").alias("doc_id")).distinct()
    again = spark.createDataFrame(docs, "doc_id long, text string").join(part, "doc_id")
    assert again.count() == 30
    indexing.add_batch(again, 1, f"{tmp_path}/i")
    whole = spark.createDataFrame(docs, "doc_id long, text string").select(F.col("doc_id").alias("chunk_id"), txt.content_tokens(F.col("text")).alias("tokens"))
    index.write_segment(whole, f"{tmp_path}/batch")
    asked = spark.createDataFrame([(1, ["river1", "salt0"]), (2, ["bread2"]), (3, ["ship0", "ship1", "house2"])], "query_id long, tokens array<string>")
    one, other = (index.Index.read(spark, f"{tmp_path}/{p}") for p in ("i", "batch"))
    assert (one.n_docs, one.avg_len) == (other.n_docs, other.avg_len) and sorted(map(tuple, one.terms.collect())) == sorted(map(tuple, other.terms.collect()))
    rows = [sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in index.Search(i, asked).hits.collect()) for i in (one, other)]
    assert rows[0] == rows[1] == sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in retrieve.top_k(retrieve.bm25(whole, asked).withColumn("score", F.round("score", 6))).collect())


def test_bm25_with_more_terms_than_literals(spark, corpus, monkeypatch):
    chunks, queries = corpus
    own = spark.createDataFrame(list(chunks.items()), "chunk_id string, tokens array<string>"), spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    rows = lambda: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9), r["matched_terms"]) for r in retrieve.bm25(*own).collect())
    listed = rows()
    monkeypatch.setattr(retrieve, "MOST_LITERALS", 3)
    assert rows() == listed and listed


# --- chunkers --------------------------------------------------------------------------------------------------------

PASSAGES = [
    (1, "River stones are round. They roll in the water. Bread needs salt, flour and time; bread also needs an oven. Ovens are hot. " * 6),
    (2, "!!! ?? ;; One two three. " + "Ships sail. " * 40),
    (3, ""), (4, None), (5, "word " * 400), (6, "5"), (7, "?! ... ;"),
]


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(PASSAGES, "doc_id long, text string")


def test_drift_chunks_equal_brute_force(spark, passages):
    encode = lambda rows: embed.encode_chars(rows)
    got = {}
    for r in chunk.drift(passages, encode, 0.8, 12, 40).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for doc, text in PASSAGES:
        text = text or ""
        pieces = []
        for lo, hi in txt.sentence_spans(text, min_chars=1):
            n = txt.token_count(text[lo:hi])
            pieces += [(p, txt.token_count(p)) for p in chunk._evenly(text[lo:hi], 40)] if n > 40 else [(text[lo:hi], n)]
        buffers = [" ".join(p for p, _ in pieces[max(0, i - 1) : i + 2]) for i in range(len(pieces))]
        vectors = {}
        if pieces:
            rows = spark.createDataFrame(list(enumerate(buffers)), "doc_id long, text string").select("doc_id", txt.content_tokens(F.col("text")).alias("tokens"))
            vectors = {r["doc_id"]: r["vector"] for r in encode(rows).collect()}
        chunks, own, n = [], [], 0
        for i, (piece, k) in enumerate(pieces):
            a, b = vectors[i], vectors[i - 1] if i else None
            size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if b else 0
            near = sum(x * y for x, y in zip(a, b)) / size if size else 0.0
            if k and n and (n + k > 40 or (n >= 12 and near < 0.8)):
                chunks.append(" ".join(own))
                own, n = [], 0
            own.append(piece)
            n += k
        chunks += [" ".join(own)] if own else []
        assert got.get(doc, []) == chunks
        assert "".join("".join(chunks).split()) == "".join(text.split())  # nothing is lost
        assert all(txt.token_count(c) <= 40 for c in chunks)


def test_semantic_chunks_keep_all_text(passages):
    got = {}
    for r in chunk.semantic(passages).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    # a last sentence of one character is none, by the rule of the sentences
    assert got[2][0].startswith("!!! ??") and got[7] == ["?! ..."]


def test_chunkers_of_sql_give_the_rows_of_the_operators(spark, passages):
    chunk_sql.register(spark)
    passages.createOrReplaceTempView("passages")
    made = lambda rows: sorted(map(tuple, rows.collect()))
    columns = ("doc_id", "ordinal", "text", "token_count")
    sentences = "SELECT doc_id, p.* FROM passages, LATERAL chunk_sentences(text) p"
    for side in (1, 2, 3):
        rows = spark.sql(f"WITH s AS ({sentences}) SELECT * FROM chunk_rows(TABLE(s) PARTITION BY doc_id ORDER BY ordinal, strategy => 'sentence_window', side => {side})")
        assert rows.columns == [*columns, "window_before", "window_after"] and dict(rows.dtypes)["doc_id"] == "bigint"
        assert made(rows) == made(chunk.sentence_window(passages, side).select(*columns, "window_before", "window_after"))
    parts = "SELECT doc_id, p.* FROM passages, LATERAL chunk_parts(text, 60) p"
    rows = spark.sql(f"WITH s AS ({parts}) SELECT * FROM chunk_rows(TABLE(s) PARTITION BY doc_id ORDER BY ordinal, strategy => 'recursive', most => 60, least => 10, overlap => 5)")
    assert rows.columns == list(columns) and made(rows) == made(chunk.recursive(passages, 60, 10, 5).select(*columns))
    chunk.with_nearness(chunk.units(passages, 40), embed.encode_chars).createOrReplaceTempView("unit_rows")
    rows = spark.sql("SELECT * FROM chunk_rows(TABLE(unit_rows) PARTITION BY doc_id ORDER BY ordinal, strategy => 'drift', most => 40, least => 12, break_below => 0.8D)")
    assert made(rows) == made(chunk.drift(passages, embed.encode_chars, 0.8, 12, 40).select(*columns))


@pytest.mark.parametrize("call,message", [("strategy => 'other'", "strategy is one of"), ("strategy => 'drift'", "lacks near"), ("strategy => 'recursive', side => 2", "takes most, least, overlap")])
def test_table_functions_refuse_what_they_do_not_know(spark, passages, call, message):
    chunk_sql.register(spark)
    passages.createOrReplaceTempView("passages")
    with pytest.raises(Exception, match=message):
        spark.sql(f"WITH s AS (SELECT doc_id, p.* FROM passages, LATERAL chunk_sentences(text) p) SELECT * FROM chunk_rows(TABLE(s) PARTITION BY doc_id ORDER BY ordinal, {call})")


# --- streaks ---------------------------------------------------------------------------------------------------------


def intervals(spans: list[tuple], most: int, cooldown: int, end: int) -> list[tuple]:
    """spans (name, ms, error) in order; intervals that have ended by end."""
    out = []
    for name in sorted({s[0] for s in spans}):
        state, errors, since = "closed", 0, 0
        for _, ms, error in [s for s in spans if s[0] == name] + [(name, end, None)]:
            if state == "open" and ms >= since + cooldown:
                out.append((name, "open", since, since + cooldown))
                state, since = "half_open", since + cooldown
            if error is None:
                break
            if state == "half_open":
                out.append((name, "half_open", since, ms))
                state, errors, since = ("open" if error else "closed"), 0, ms
            elif state == "closed":
                errors = errors + 1 if error else 0
                if errors >= most:
                    state, errors, since = "open", 0, ms
    return sorted(out)


def test_streaks_and_their_timers(spark, tmp_path):
    for k, v in streaks.SETTINGS.items():
        spark.conf.set(k, v)
    rng = random.Random(5)
    base = 1_700_000_000_000
    spans = sorted({(name, base + 1000 * t): rng.random() < (0.7 if t % 100 < 40 else 0.2) for name in ("embed", "rerank") for t in rng.sample(range(400), 150)}.items(), key=lambda x: x[0][1])
    spans = [(name, ms, error) for (name, ms), error in spans]
    # a stage whose last spans are errors: only a timer ends its interval
    spans += [("quiet", base + 1000 * t, True) for t in (1, 2, 3)]
    spans.sort(key=lambda s: s[1])
    edges = [base + 1000 * t for t in (0, 100, 200, 300, 500)]
    batches = [[s for s in spans if a <= s[1] < b] for a, b in zip(edges, edges[1:])] + [[("other", base + 1_000_000, False)], [("other", base + 1_000_001, False)]]
    schema = "name string, span_id string, status string, ts timestamp"
    for k, own in enumerate(batches):
        rows = spark.createDataFrame([(n, f"{i:05d}", "timeout" if e else "ok", ms) for i, (n, ms, e) in enumerate(own)], "name string, span_id string, status string, ms long")
        rows.select("name", "span_id", "status", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k + 1 < len(batches):
            import time

            time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaks.streaks(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = intervals(spans, 3, 30_000, base + 900_000)
    assert got == want and ("quiet", "open", base + 3000, base + 33_000) in got and {s for _, s, _, _ in got} == {"open", "half_open"}


# --- stored vectors --------------------------------------------------------------------------------------------------


def test_a_vector_store_is_read_by_clusters_and_grows(spark, tmp_path):
    import numpy as np

    from tesserae.operators import vector_store

    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8)) * 4
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    rows = unit(centers[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.2)
    frame = spark.createDataFrame(list(enumerate(rows)), "chunk_id long, vector array<double>").repartition(4)
    path = f"{tmp_path}/v"
    vector_store.create(frame.filter("chunk_id < 600"), path, clusters=12)
    vector_store.append(frame.filter("chunk_id >= 600"), path, 1)
    asked = frame.filter("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    search = vector_store.VectorSearch(spark, path, asked, k=4, probes=1)
    pick = lambda hits: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in hits.collect())
    assert pick(search.hits) == pick(retrieve.brute_force(frame, asked, 4))
    files = spark.read.parquet(f"{path}/vectors").select("segment", "cluster", F.input_file_name().alias("file")).distinct()
    read = files.join(search.near.select("cluster").distinct(), "cluster", "left_semi")
    assert 0 < read.count() < files.count() and search.rest.count() < search.probes.count() - search.near.count()
    plan = search.candidates(search.near)._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in plan
    # what has no radii yet is not there
    import shutil

    shutil.rmtree(f"{path}/radii/segment=1")
    assert pick(vector_store.VectorSearch(spark, path, asked, k=4, probes=12).hits) == pick(retrieve.brute_force(frame.filter("chunk_id < 600"), asked, 4))


@pytest.mark.parametrize("made", [1, 40, 1 << 18])
def test_postings_of_blocks_that_batches_cut(monkeypatch, made):
    import pyarrow as pa

    monkeypatch.setattr(index, "MADE", made)
    rng = random.Random(6)
    chunks = [(k // 3, f"c{k:03}", [rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 5, 40]))]) for k in range(100)]
    block, ids, tokens = zip(*chunks)
    whole = pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(ids), pa.array(list(map(len, tokens)), pa.int32()), pa.array(tokens, pa.list_(pa.string()))], names=["block", "chunk_id", "dl", "tokens"])
    want = {}
    for b, c, ts in chunks:
        for t in set(ts):
            want.setdefault((t, b), []).append(((c, len(ts), ts.count(t)), [k for k, x in enumerate(ts) if x == t]))
    for cuts in ([0, 100], [0, 1, 2, 50, 51, 100], [0, 10, 10, 30, 100], list(range(101))):
        got = [r for x in index._postings(whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])) for r in x.to_pylist()]
        assert len(got) == len(want)
        for r in got:
            rows = want[r["term"], r["block"]]
            assert [tuple(h.values()) for h in r["held"]] == [h for h, _ in rows] and r["places"] == [p for _, p in rows]
            assert (r["chunks"], r["most"], r["shortest"]) == (len(rows), max(h[2] for h, _ in rows), min(h[1] for h, _ in rows))


def test_scores_read_numbers_only(spark, tmp_path, corpus):
    chunks, queries = corpus
    written(spark, chunks, f"{tmp_path}/i")
    search = found(spark, f"{tmp_path}/i", queries, k=4, first=3)
    read = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "places" not in read(search.scores(search.first)) and "occurrences" not in read(search.scores(search.first))
    # the places of hits are looked up once, by both parts of the rerank
    assert "held" in read(search.occurrences(search.hits)) and "held" not in read(search.reranked())


def test_a_segment_is_written_without_shuffles_in_rows_of_several_terms(spark, tmp_path, corpus, monkeypatch):
    chunks, queries = corpus
    names, real = [], index.stored
    monkeypatch.setattr(index, "stored", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(index, "MADE", 300)
    monkeypatch.setattr(index, "PACKED", 5)
    written(spark, chunks, f"{tmp_path}/i")
    assert names == ["indexed"]  # no table of lengths, which block numbers had to wait for
    search = found(spark, f"{tmp_path}/i", queries, k=4, first=3)
    got = {}
    for r in sorted(search.hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    assert all([(c, pytest.approx(s, abs=2e-6)) for c, s in bm25(chunks, terms, 4)] == got.get(q, []) for q, terms in queries.items())
    rows = spark.read.parquet(f"{tmp_path}/i/postings").select("held", "n").collect()
    assert len(rows) > 64 and all(sum(r["n"]) == len(r["held"]) for r in rows)
    # all terms are read where those asked are not few
    monkeypatch.setattr(index.Search, "_few", lambda self: False)
    key = lambda r: (r["query_id"], r["rank"], r["chunk_id"], r["score"])
    assert sorted(map(key, found(spark, f"{tmp_path}/i", queries, k=4, first=3).hits.collect())) == sorted(map(key, search.hits.collect()))
