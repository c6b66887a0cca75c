"""A stored vector index: clusters as partitions that searches prune, appended to without fitting anew.

Under its folder a store has centers, vectors/segment=s/cluster=c and radii/segment=s.
A search gives each query its nearest clusters and reads the partitions of these
only; the k-th score that they give, with each cluster's radius, tells which other
clusters can still matter, and these are read too.  So results are those of a search of everything.
A segment becomes visible with its radii, which are written last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.retrieve import IVF_CLUSTERS, IVF_PROBES, QUERY_BLOCK, TOP_K, in_clusters, ivf_index, top_k
from tesserae.sources.corpus import write_vector_store
from tesserae.sources.tables import stored


def _centers(spark: SparkSession, path: str) -> np.ndarray:
    """The centers, as many as clusters, by number."""
    rows = spark.read.parquet(f"{path}/centers").orderBy("cluster").collect()
    return np.array([r["center"] for r in rows], np.float64)


def _write(indexed: DataFrame, path: str, segment: int, centers: np.ndarray) -> None:
    write_vector_store(indexed.select("chunk_id", "vector", "cluster"), f"{path}/vectors/segment={segment}")

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = np.linalg.norm(np.array(batch["vector"].tolist(), np.float64) - centers[batch["cluster"].to_numpy()], axis=1)
                yield pd.DataFrame({"cluster": batch["cluster"], "radius": own}).groupby("cluster", as_index=False).max()

    spark = indexed.sparkSession
    written = spark.read.parquet(f"{path}/vectors/segment={segment}").select("cluster", "vector")
    radii = written.mapInPandas(distances, "cluster int, radius double").groupBy("cluster").agg(F.max("radius").alias("radius"))
    radii.write.mode("overwrite").parquet(f"{path}/radii/segment={segment}")


def create(vectors: DataFrame, path: str, clusters: int = IVF_CLUSTERS) -> None:
    """A store of vectors (chunk_id, vector), whose centers are fitted on a bounded sample of them."""
    indexed, centers = ivf_index(vectors, clusters)
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(centers)]
    vectors.sparkSession.createDataFrame(rows, "cluster int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    _write(indexed, path, 0, centers)


def append(vectors: DataFrame, path: str, segment: int) -> None:
    """More vectors, as a segment of its own, each in the cluster of the nearest center that the store has."""
    centers = _centers(vectors.sparkSession, path)
    kind = dict(vectors.dtypes)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = np.array(batch["vector"].tolist(), np.float64)
                near = (centers**2).sum(axis=1) - 2 * own @ centers.T
                yield batch.assign(cluster=near.argmin(axis=1).astype(np.int32))

    _write(vectors.select("chunk_id", "vector").mapInPandas(assigned, f"chunk_id {kind['chunk_id']}, vector {kind['vector']}, cluster int"), path, segment, centers)


class VectorSearch:
    """The k nearest vectors of a store for each query (query_id, query_vector).

    probes (query_id, query_vector, cluster, place, bound) has the clusters of each query by
    falling score of their centers, and what a vector of the cluster can score at most.
    """

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, probes: int = IVF_PROBES) -> None:
        centers, kind = _centers(spark, path), dict(queries.dtypes)["query_id"]
        self.k, self.shape = k, centers.shape
        radii = spark.read.parquet(f"{path}/radii")
        done = [r["segment"] for r in radii.select("segment").distinct().collect()]
        radius = np.full(len(centers), -np.inf)  # a cluster without vectors can score nothing
        for r in radii.groupBy("cluster").agg(F.max("radius").alias("radius")).collect():
            radius[r["cluster"]] = r["radius"]

        def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                own = np.array(batch["query_vector"].tolist(), np.float64)
                at = own @ centers.T
                size = np.linalg.norm(own, axis=1, keepdims=True)
                bound = np.where(np.isfinite(radius), at + size * np.where(np.isfinite(radius), radius, 0) + 1e-9 * (1 + size), -np.inf)
                place = np.argsort(np.argsort(-at, axis=1, kind="stable"), axis=1, kind="stable")
                q, c = np.nonzero(np.isfinite(bound))
                yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[q], "query_vector": list(own[q]), "cluster": c.astype(np.int32), "place": place[q, c].astype(np.int32), "bound": bound[q, c]})

        schema = f"query_id {kind}, query_vector array<double>, cluster int, place int, bound double"
        self.vectors = spark.read.parquet(f"{path}/vectors").filter(F.col("segment").isin(done))
        self.probes = stored(queries.select("query_id", "query_vector").mapInPandas(ranked, schema), "probes")
        self.near = self.probes.filter(F.col("place") < probes)
        first = stored(top_k(self.scores(self.near), k).drop("rank"), "first-hits")
        kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        rest = self.probes.filter(F.col("place") >= probes).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        self.rest = stored(rest.select(*self.probes.columns), "other-probes")
        self.hits = top_k(first.unionByName(self.scores(self.rest)), k)

    def candidates(self, probes: DataFrame) -> DataFrame:
        """The vectors in the clusters of probes; partitions of other clusters are pruned when the join's small side is there."""
        wanted = probes.filter("cluster >= 0").select("cluster").distinct()  # as many as clusters at most
        return self.vectors.join(F.broadcast(wanted), "cluster", "left_semi")

    def scores(self, probes: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score): of each partition of the clusters the k best of each query that probes them; queries go with the tasks, QUERY_BLOCK at a time."""
        kind = dict(probes.dtypes)["query_id"]
        own = probes.groupBy("query_id").agg(F.first("query_vector").alias("query_vector"), F.collect_set("cluster").alias("clusters"))
        n = own.count() // QUERY_BLOCK + 1
        return reduce(DataFrame.unionByName, (self._block(own.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b), kind) for b in range(n)))

    def _block(self, queries: DataFrame, kind: str) -> DataFrame:
        own = queries.toPandas()
        matrix = np.array(own["query_vector"].tolist(), np.float64).reshape(len(own), self.shape[1])
        wanted = np.zeros((len(own), self.shape[0]), bool)
        for k, c in enumerate(own["clusters"]):
            wanted[k, np.asarray(c, int)] = True
        own_clusters = self.vectors.filter(F.col("cluster").isin([int(c) for c in np.flatnonzero(wanted.any(axis=0))]))
        return in_clusters(own_clusters, own["query_id"].to_numpy(), kind, matrix, wanted, self.k)
