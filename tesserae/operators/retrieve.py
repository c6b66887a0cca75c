"""Retrieval over batches of queries: postings, BM25, dense scores, fusion, diversification.

Queries are (query_id, term, qtf) or (query_id, vector); results are rows
(query_id, chunk_id, ...).  Where a body is not given by parameters it is this
library's own definition, said in the docstring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.similarity import dot
from tesserae.functions.text import char_ngrams, normalize, stem
from tesserae.operators import stats
from tesserae.sources.tables import stored

# Retrieval parameters.
K1, B = 1.4, 0.72
RRF_K = 60
CANDIDATES, TOP_K, PER_DOC = 120, 5, 2
BLEND = {"lexical": 0.42, "dense": 0.38, "rerank": 0.20}
MMR_LAMBDA = 0.72
MIN_SCORE = 0.055
IVF_CLUSTERS, IVF_ITERATIONS, IVF_PROBES, IVF_LEAST = 48, 12, 8, 1200


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl) of chunks (chunk_id, tokens)."""
    return chunks.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def distinct_requests(requests: DataFrame) -> DataFrame:
    """(query_id, text, n_asked): requests (query_id, text) that are equal once normalized are one, with the smallest id and its text."""
    keyed = requests.select("query_id", "text", F.coalesce(normalize(F.col("text")), F.lit("")).alias("_key"))
    return keyed.groupBy("_key").agg(F.min(F.struct("query_id", "text")).alias("x"), F.count("*").alias("n_asked")).select("x.*", "n_asked")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, tokens)."""
    return queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_weight(tf: Column, dl: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    """What a term that a chunk of dl terms has tf times adds to its score, before idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_len))


#: Query terms up to so many are filtered within the tokens' arrays; with more, all tokens are joined with them.
MOST_LITERALS = 10_000


def wanted_tokens(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, dl, tokens) of all chunks, tokens being only those among terms (term); dl counts all."""
    own = terms.select("term").distinct()
    some = [r["term"] for r in own.limit(MOST_LITERALS + 1).collect()]
    if len(some) <= MOST_LITERALS:
        listed = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in some) or "null"
        return chunks.select("chunk_id", F.size("tokens").alias("dl"), F.expr(f"filter(tokens, t -> t in ({listed}))").alias("tokens"))
    each = chunks.select("chunk_id", F.explode("tokens").alias("term")).join(own, "term", "left_semi")
    kept = each.groupBy("chunk_id").agg(F.collect_list("term").alias("kept"))
    return chunks.select("chunk_id", F.size("tokens").alias("dl")).join(kept, "chunk_id", "left").select("chunk_id", "dl", F.coalesce("kept", F.expr("cast(array() as array<string>)")).alias("tokens"))


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, terms: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, matched, matched_terms) for chunks (chunk_id, tokens) and queries (query_id, tokens); terms=False leaves the last out.

    Chunks are read once: what is stored of them is their length and those of
    their tokens that a query has.  Document frequencies are those of all
    chunks.  A term counts once, however often a query repeats it.  Chunks with dl
    are taken as what wanted_tokens has made.
    """
    wanted = stored(query_terms(queries), "asked")
    slim = chunks if "dl" in chunks.columns else stored(wanted_tokens(chunks, wanted), "wanted-tokens")
    corpus = slim.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total")).select("n_docs", (F.col("total") / F.col("n_docs")).alias("avg_len"))
    posts = stored(slim.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf")), "postings")
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    rows = posts.join(df, "term").crossJoin(F.broadcast(corpus)).join(wanted, "term")
    weight = stats.idf(F.col("df"), F.col("n_docs")) * term_weight(F.col("tf"), F.col("dl"), F.col("avg_len"), k1, b)
    listed = [F.sort_array(F.collect_set("term")).alias("matched_terms")] if terms else []
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score"), F.count("*").cast("int").alias("matched"), *listed)


def ranked(hits: DataFrame, by: str = "score", name: str = "rank") -> DataFrame:
    """hits with their place in their query, equal scores by chunk_id."""
    return hits.withColumn(name, F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), "chunk_id")))


def top_k(hits: DataFrame, k: int = TOP_K, by: str = "score") -> DataFrame:
    return ranked(hits, by).filter(F.col("rank") <= k)


def dense_scores(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """candidates (query_id, chunk_id) with dense, the dot product of the stored unit vectors (chunk_id, vector) and (query_id, query_vector)."""
    return candidates.join(vectors, "chunk_id").join(queries, "query_id").withColumn("dense", dot(F.col("vector"), F.col("query_vector"))).drop("vector", "query_vector")


#: Query vectors that a task holds at a time, and vectors that meet them when there are more queries.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 4096


class _Nearest:
    """The k best (query, chunk, score) of each of n queries so far, equal scores by chunk."""

    #: Candidates that are held before they are cut to the best.
    HELD = 1 << 18

    def __init__(self, n: int, k: int) -> None:
        self.k, self.kth = k, np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def least(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """What a chunk must score to be among the best of these queries, as far as scores (query x chunk) and those before tell."""
        kth = self.kth[queries]
        if scores.shape[1] >= self.k and np.isneginf(kth).any():
            kth = np.maximum(kth, np.partition(scores, -self.k, axis=1)[:, -self.k])
        return kth

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, chunk, score))
        self.size += len(query)
        if self.size >= self.HELD or np.isneginf(self.kth).any():
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        query, chunk, score = map(np.concatenate, zip(*self.held))
        order = np.lexsort((chunk, -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        last = place == self.k - 1
        self.kth[query[last]] = score[last]
        kept = place < self.k
        self.held, self.size = [(query[kept], chunk[kept], score[kept])], 0
        return self.held[0]

    def rows(self, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        if (own := self.cut()) is not None:
            query, chunk, score = own
            for lo in range(0, len(query), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pd.DataFrame({"query_id": ids[query[part]], "chunk_id": chunk[part], "score": score[part]})


def _meet(best: _Nearest, matrix: np.ndarray, chunk: np.ndarray, vectors: np.ndarray) -> None:
    every = np.arange(len(matrix))
    for lo in range(0, len(chunk), VECTOR_BLOCK):
        scores = matrix @ vectors[lo : lo + VECTOR_BLOCK].T
        q, c = np.nonzero(scores >= best.least(every, scores)[:, None])
        best.add(q, chunk[lo + c], scores[q, c])


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest of all vectors for each query.

    Queries, a stated set, meet all rows in blocks: each block keeps the best k
    of each query by a matrix product, and a window merges them.  Up to
    QUERY_BLOCK queries go with the task; more are blocks of a table that meets
    the blocks of vectors, so that neither the driver nor a task holds them all.
    """
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    if queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        own = queries.select("query_id", "query_vector").toPandas()
        ids = own["query_id"].to_numpy()
        matrix = np.array(own["query_vector"].tolist(), np.float64).reshape(len(own), -1)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Nearest(len(ids), k)
            for batch in batches:
                if len(batch) and len(ids):
                    _meet(best, matrix, batch["chunk_id"].to_numpy(), np.array(batch["vector"].tolist(), np.float64))
            yield from best.rows(ids)

        return top_k(vectors.select("chunk_id", "vector").mapInPandas(nearest, schema), k)

    def blocks(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
        n = F.pmod(F.xxhash64(key), F.lit(rows.count() // size + 1))
        return rows.groupBy(n.alias("_n")).agg(F.collect_list(key).alias(key), F.collect_list(value).alias(value)).drop("_n")

    pairs = blocks(queries, "query_id", "query_vector", QUERY_BLOCK).crossJoin(blocks(vectors, "chunk_id", "vector", VECTOR_BLOCK))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                best = _Nearest(len(r.query_id), k)
                _meet(best, np.stack(r.query_vector).astype(np.float64), np.array(r.chunk_id), np.stack(r.vector).astype(np.float64))
                yield from best.rows(np.array(r.query_id))

    return top_k(pairs.mapInPandas(meet, schema), k)


def rrf(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, fusion): the sum over rankings (query_id, chunk_id, rank) of 1 / (k + rank)."""
    rows = [r.select("query_id", "chunk_id", "rank") for r in rankings]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fusion"))


def fused(hits: DataFrame, by: tuple[str, ...], candidates: int = CANDIDATES, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, fusion): rrf of several orders of the same hits, each cut to its candidates; the hits are read once."""
    rows = hits
    for c in by:
        rows = ranked(rows, c, f"_rank_{c}")
    rows = rows.filter(reduce(lambda a, b: a | b, [F.col(f"_rank_{c}") <= candidates for c in by]))
    parts = [F.when(F.col(f"_rank_{c}") <= candidates, 1.0 / (k + F.col(f"_rank_{c}"))).otherwise(0.0) for c in by]
    return rows.select("query_id", "chunk_id", reduce(lambda a, b: a + b, parts).alias("fusion"))


def scaled(hits: DataFrame, column: str) -> DataFrame:
    """column scaled to 0..1 within each query; equal values become 1.  Own definition."""
    own = W.partitionBy("query_id")
    lo, hi = F.min(column).over(own), F.max(column).over(own)
    return hits.withColumn(column, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(F.when(F.col(column).isNotNull(), 1.0)))


def blend(hits: DataFrame, weights: dict[str, float] = BLEND) -> DataFrame:
    """hits with score, the weighted sum of the scaled columns, absent ones counting 0."""
    out = hits
    for c in weights:
        out = scaled(out, c)
    return out.withColumn("score", sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)))


def per_doc_cap(hits: DataFrame, most: int = PER_DOC, by: str = "score") -> DataFrame:
    """At most so many hits of a document (doc_id) for each query."""
    place = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc(by), "chunk_id"))
    return hits.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def above_floor(hits: DataFrame, floor: float = MIN_SCORE, by: str = "score") -> DataFrame:
    return hits.filter(F.col(by) >= floor)


def rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, corpus_terms: DataFrame, top: int = 40) -> DataFrame:
    """The top hits with rerank: the share of the query's idf that the chunk's tokens cover.  Own definition."""
    best = top_k(hits, top)
    terms = query_terms(queries).join(corpus_terms.select("term", "idf"), "term", "left").na.fill({"idf": 0.0})
    total = terms.groupBy("query_id").agg(F.sum("idf").alias("total"))
    rows = best.join(chunks.select("chunk_id", "tokens"), "chunk_id").join(terms, "query_id")
    covered = rows.groupBy("query_id", "chunk_id").agg(F.sum(F.when(F.array_contains("tokens", F.col("term")), F.col("idf")).otherwise(0.0)).alias("covered"))
    return best.join(covered, ["query_id", "chunk_id"], "left").join(total, "query_id", "left").withColumn("rerank", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0)).drop("covered", "total")


def mmr(candidates: DataFrame, vectors: DataFrame, k: int = TOP_K, weight: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, chunk_id, score, rank): greedily the candidate of most weight * score - (1 - weight) * similarity to what is chosen.

    candidates have (query_id, chunk_id, score), a bounded number for each
    query (top_k); vectors (chunk_id, vector).  Ties by chunk_id.
    """
    rows = candidates.select("query_id", "chunk_id", "score").join(vectors.select("chunk_id", "vector"), "chunk_id")
    kinds = dict(rows.dtypes)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["chunk_id"]).reset_index(drop=True)
        v = np.array(group["vector"].tolist(), np.float64)
        gain, most, left, out = group["score"].to_numpy(float), np.zeros(len(group)), list(range(len(group))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (weight * gain[i] - (1 - weight) * most[i], -i))
            out.append(best)
            left.remove(best)
            most = np.maximum(most, v @ v[best]) if len(out) > 1 else v @ v[best]
        chosen = group.loc[out, ["query_id", "chunk_id", "score"]]
        return chosen.assign(rank=range(1, len(out) + 1))

    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")


def expand_terms(queries: DataFrame, terms: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, term, expansion): corpus terms with the stem of a query term, the most frequent first.  Own definition."""
    own = query_terms(queries).withColumn("stem", stem(F.col("term")))
    other = own.join(terms.select("stem", F.col("term").alias("expansion"), "df"), "stem").filter("expansion <> term")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("df"), "expansion", "term"))
    return other.withColumn("_n", place).filter(F.col("_n") <= most).select("query_id", "term", "expansion")


def expand_with_neighbours(queries: DataFrame, terms: DataFrame, neighbours: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, term, expansion): forms with the stem of a query term first, by df, then its nearest terms (term, other, score) by score; most for a query.  Own definition."""
    forms = expand_terms(queries, terms, most).join(terms.select(F.col("term").alias("expansion"), "df"), "expansion").select("query_id", "term", "expansion", F.lit(0).alias("kind"), F.col("df").cast("double").alias("weight"))
    near = query_terms(queries).join(neighbours, "term").select("query_id", "term", F.col("other").alias("expansion"), F.lit(1).alias("kind"), F.col("score").alias("weight"))
    once = forms.unionByName(near).withColumn("_k", F.row_number().over(W.partitionBy("query_id", "expansion").orderBy("kind", F.desc("weight"), "term"))).filter("_k = 1")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("kind", F.desc("weight"), "expansion", "term"))
    return once.withColumn("_n", place).filter(F.col("_n") <= most).select("query_id", "term", "expansion")


#: Characters from which deletions are taken; edits beyond them change a word's beginning by as many deletions at most.
DELETED_FROM = 12


def deletions(most: int = 2, size: int = DELETED_FROM) -> Callable[[str], Column]:
    """A function that makes array<string>: the first size characters of a term with up to most of them deleted, each string once."""

    @F.pandas_udf("array<string>")
    def of(terms: pd.Series) -> pd.Series:
        def one(term: str) -> list[str]:
            level = {term[:size]}
            out = set(level)
            for _ in range(most):
                level = {s[:i] + s[i + 1 :] for s in level for i in range(len(s))}
                out |= level
            return list(out)

        return terms.map(one)

    return of


def within_edits(asked: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(term, other, d): all pairs of asked (term) and known (other) at an edit distance d of most at most.

    What two such words keep of their beginnings after most deletions each has a string
    in common, so both are indexed by their deletions; short words, too, meet.  The
    length is part of the key, which splits strings that many words share.  An index
    entry is a string and a word, so memory follows neither a word's length nor the number of
    its neighbours; pairs are measured once they are distinct.
    """
    own = deletions(most)
    left = asked.select("term").distinct().select("term", F.explode(own("term")).alias("deleted"))
    left = left.select("term", "deleted", F.explode(F.sequence(F.length("term") - most, F.length("term") + most)).alias("size"))
    right = known.select("other", F.length("other").alias("size"), F.explode(own("other")).alias("deleted"))
    # equal hashes of unequal keys only add a pair that is measured
    keyed = lambda rows, c: rows.select(F.xxhash64("deleted", "size").alias("key"), c)
    pairs = keyed(left, "term").join(keyed(right, "other"), "key").select("term", "other").distinct()
    return pairs.withColumn("d", F.levenshtein("term", "other", most)).filter("d >= 0")


def repair_terms(queries: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, term, repair): for query terms outside the corpus the nearest corpus term within most edits; ties by df, then term.  Own definition."""
    own = query_terms(queries).join(terms.select("term"), "term", "left_anti").select("query_id", "term")
    near = within_edits(own, terms.select(F.col("term").alias("other")), most).join(terms.select(F.col("term").alias("other"), "df"), "other")
    best = near.groupBy("term").agg(F.min_by("other", F.struct("d", -F.col("df"), "other")).alias("repair"))
    return own.join(best, "term").select("query_id", "term", "repair")


def parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits whose chunk has a parent, with the parent in its place; a parent that is hit more than once has its best score."""
    own = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id").withColumn("chunk_id", F.coalesce("parent_id", "chunk_id"))
    return own.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def ivf_index(vectors: DataFrame, clusters: int = IVF_CLUSTERS, iterations: int = IVF_ITERATIONS, seed: int = 20260813, sample: int = 200_000):
    """(vectors with cluster, centroids): k-means fitted on at most sample vectors, all of which are then assigned.

    The sample is a documented bound; every vector is indexed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector("vector"))
    n = rows.count()
    fit = rows if n <= sample else rows.sample(fraction=sample / n, seed=seed)
    model = KMeans(k=clusters, maxIter=iterations, seed=seed, featuresCol="features", predictionCol="cluster").fit(fit)
    return model.transform(rows).drop("features"), np.array(model.clusterCenters())


def ivf_radii(indexed: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The largest distance of a vector from its cluster's centre, for each cluster; 0 for an empty one."""

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = np.linalg.norm(np.array(batch["vector"].tolist(), np.float64) - centers[batch["cluster"].to_numpy()], axis=1)
                yield pd.DataFrame({"cluster": batch["cluster"], "radius": own}).groupby("cluster", as_index=False).max()

    out = np.zeros(len(centers))
    for r in indexed.select("cluster", "vector").mapInPandas(farthest, "cluster int, radius double").groupBy("cluster").agg(F.max("radius").alias("radius")).collect():
        out[r["cluster"]] = r["radius"]
    return out


def in_clusters(indexed: DataFrame, ids: np.ndarray, kind: str, matrix: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """(query_id, chunk_id, score): of each partition the k best of each query among the clusters that its row of wanted (query x cluster) has."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Nearest(len(ids), k)
        for batch in batches:
            if not len(batch):
                continue
            chunk, cluster, vectors = batch["chunk_id"].to_numpy(), batch["cluster"].to_numpy(), np.array(batch["vector"].tolist(), np.float64)
            for own in np.unique(cluster):
                at, queries = np.flatnonzero(cluster == own), np.flatnonzero(wanted[:, own])
                for lo in range(0, len(at) if len(queries) else 0, VECTOR_BLOCK):
                    part = at[lo : lo + VECTOR_BLOCK]
                    # products tell which pairs can matter; what counts is summed row by row, so that equal vectors have equal scores wherever they stand
                    near = matrix[queries] @ vectors[part].T
                    q, c = np.nonzero(near >= best.least(queries, near)[:, None] - 1e-9)
                    best.add(queries[q], chunk[part[c]], (vectors[part[c]] * matrix[queries[q]]).sum(axis=1))
        yield from best.rows(ids)

    return indexed.select("chunk_id", "vector", "cluster").mapInPandas(nearest, f"query_id {kind}, chunk_id {dict(indexed.dtypes)['chunk_id']}, score double")


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, probes: int = IVF_PROBES, clusters: int = IVF_CLUSTERS, least: int = IVF_LEAST) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest of all vectors for each query; fewer than least vectors are searched one by one.

    The probes nearest clusters give each query a k-th score.  No vector of a
    cluster scores more than its centre does, plus the cluster's radius times
    the query's length; clusters that can reach the k-th score by that are
    searched too, so nothing is lost.  Queries are taken QUERY_BLOCK at a time.
    """
    if vectors.limit(least).count() < least:
        return brute_force(vectors, queries, k)
    indexed, centers = ivf_index(vectors, clusters)
    radii = ivf_radii(indexed, centers)
    n = queries.count() // QUERY_BLOCK + 1
    blocks = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]
    return reduce(DataFrame.unionByName, (_probed(indexed, centers, radii, b, k, probes) for b in blocks))


def _probed(indexed: DataFrame, centers: np.ndarray, radii: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    own = queries.select("query_id", "query_vector").toPandas()
    ids, kind = own["query_id"].to_numpy(), dict(queries.dtypes)["query_id"]
    matrix = np.array(own["query_vector"].tolist(), np.float64).reshape(len(own), centers.shape[1])
    at_center = matrix @ centers.T
    near = np.zeros(at_center.shape, bool)
    np.put_along_axis(near, np.argsort(-at_center, axis=1, kind="stable")[:, :probes], True, axis=1)
    first = top_k(in_clusters(indexed, ids, kind, matrix, near, k), k)
    kth = {r["query_id"]: r["score"] for r in first.filter(F.col("rank") == k).select("query_id", "score").collect()}
    least = np.array([kth.get(x, -np.inf) for x in ids.tolist()])
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    most = at_center + size * radii + 1e-9 * (1 + size)  # more than rounding adds
    return top_k(in_clusters(indexed, ids, kind, matrix, near | ~(most < least[:, None]), k), k)
