"""Embeddings learned from a corpus: PPMI with random indexing, character n-grams, and both together.

A fitted model is a set of tables.  Signatures are made once for each distinct
term by an Arrow-batched function (Spark's BIGINT arithmetic raises on overflow)
and joined; sums are grouped by (key, index) and then turned into arrays.
Vectors are doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.similarity import l2_normalize
from tesserae.functions.text import stem
from tesserae.operators import blocks, stats
from tesserae.operators.pairs import from_bytes, from_gaps
from tesserae.sources.tables import stored

# Parameters of the embedders, and constants of the hash and the generator behind signatures.
DIM, SEED, NONZEROS = 256, 20260813, 8
CHAR_SEED = 0x5EED
BLEND = (0.7, 0.3)
COMMON_LEAST, COMMON_ROUNDS = 8, 8
FNV_PRIME = 0x100000001B3
LCG_FACTOR, LCG_STEP = 6364136223846793005, 1442695040888963407
MASK = (1 << 64) - 1


def signature(term: str, dim: int = DIM, seed: int = SEED) -> list[tuple[int, float]]:
    """NONZEROS distinct (index, sign) of a term, from a multiplicative hash that drives a linear generator."""
    if dim < NONZEROS:
        raise ValueError(f"dim is at least {NONZEROS}")
    state = seed & MASK
    for ch in term:
        state = ((state ^ ord(ch)) * FNV_PRIME) & MASK
    found: dict[int, float] = {}
    while len(found) < NONZEROS:
        state = (state * LCG_FACTOR + LCG_STEP) & MASK
        found.setdefault((state >> 17) % dim, 1.0 if (state >> 61) & 1 else -1.0)
    return list(found.items())


def signatures(terms: DataFrame, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(term, idx, sign) of each distinct term."""

    @F.pandas_udf("array<struct<idx:int,sign:double>>")
    def of(xs: pd.Series) -> pd.Series:
        return xs.map(lambda t: signature(t, dim, seed))

    return terms.select("term").distinct().select("term", F.explode(of("term")).alias("s")).select("term", "s.idx", "s.sign")


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length; rows of (almost) no length are left as they are."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size > 1e-12, size, 1.0)


def _encoded(own: DataFrame, known: DataFrame, rows_of: Callable[[pa.Table, int], Callable[[np.ndarray], np.ndarray]], dim: int, terms: bool = False) -> DataFrame:
    """(doc_id, vector) of blocks at unit length: for each document the sum, over its tokens with repeats, of the row that rows_of makes of known for a block's term."""
    kind, again = own.schema["doc_id"].dataType.simpleString(), blocks.repeated(own)

    def sums(docs: pa.Table, rows: pa.Table) -> pa.Table:
        codes, sizes = blocks.flat(docs, "codes")
        out = blocks.part_sums(rows_of(rows, int(codes.max(initial=-1)) + 1), codes, sizes, dim)
        return pa.table({"doc_id": docs.column("doc_id"), "vector": _lists(out if again else _unit(out))})

    def total(table: pa.Table) -> pa.Table:
        v = table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0, keepdims=True)
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "vector": _lists(_unit(v))})

    schema = f"doc_id {kind}, vector array<double>"
    made = blocks.met(own, known, sums, schema, terms)
    return made.groupBy("doc_id").applyInArrow(total, schema) if again else made


@dataclass
class Contexts:
    """What term vectors are made of: packed (term, id, ctxs, units), and by number the signatures and, in weight, the marginals of all terms."""

    packed: DataFrame
    signs: np.ndarray
    weight: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    dim: int

    @property
    def rows(self) -> Callable[[pa.Table | pa.RecordBatch], np.ndarray]:
        """What makes the vectors at unit length of some rows (id, ctxs, units)."""
        signs, weight, dim = self.signs, self.weight, self.dim

        def made(table: pa.Table | pa.RecordBatch) -> np.ndarray:
            ids = table.column("id").to_numpy()
            (ctxs, sizes), (units, _) = (from_bytes(_whole(table.column(c))) for c in ("ctxs", "units"))
            ctxs, row = from_gaps(ctxs, sizes), np.repeat(np.arange(len(sizes)), sizes)
            w, at = weight(ids[row], ctxs, units), signs[ctxs].astype(np.int64)
            cell = row[:, None] * dim + np.where(at >= 0, at, -1 - at)
            return _unit(np.bincount(cell.ravel(), weights=(w[:, None] * np.where(at >= 0, 1.0, -1.0)).ravel(), minlength=len(sizes) * dim).reshape(-1, dim))

        return made

    def vectors(self, packed: DataFrame) -> DataFrame:
        """(term, vector) of rows of packed."""
        rows = self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    batch = whole.slice(lo, 1024)
                    yield pa.RecordBatch.from_arrays([batch.column("term"), _lists(rows(batch))], names=["term", "vector"])

        return packed.select("term", "id", "ctxs", "units").mapInArrow(run, "term string, vector array<double>")


@dataclass
class PpmiModel:
    """terms (term, stem, df, idf), vectors (term, vector), max_idf and the common direction, if any.

    Where contexts are known, vectors are made of them whenever they are read,
    since a vector is several times as large as its term's contexts.
    """

    terms: DataFrame
    vectors: DataFrame
    max_idf: float
    common: list[float] | None
    dim: int = DIM
    #: The documents that the model was fitted on and their sums, which that took.
    fitted: tuple[DataFrame, DataFrame] | None = None
    contexts: Contexts | None = None
    #: Their blocks.
    own: DataFrame | None = None

    def encode(self, docs: DataFrame) -> DataFrame:
        """(doc_id, vector) of docs (doc_id, tokens) with the common direction taken out; documents without known terms have zero vectors."""
        raw, schema, finished = self.fitted[1] if self.fitted is not None and self.fitted[0] is docs else _raw(docs, self), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vector array<double>", self._finished
        if self.common is None:
            return raw

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    batch = whole.slice(lo, 1024)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(finished(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)))], names=["doc_id", "vector"])

        return raw.select("doc_id", "vector").mapInArrow(run, schema)

    @property
    def _finished(self) -> Callable[[np.ndarray], np.ndarray]:
        """Sums at unit length without the common direction."""
        common = None if self.common is None else np.array(self.common)
        return lambda v: _unit(v) if common is None else _unit((u := _unit(v)) - (u @ common)[:, None] * common)

    def parts(self, docs: DataFrame, made: Callable[[dict, np.ndarray], list[tuple]], schema: str) -> DataFrame:
        """What made returns for each document, (values of the row, vectors of its parts, sums of their tokens before any length is taken): docs (tokens, sizes, others), sizes being those of consecutive parts."""
        rows_of, dim, names = self._rows_of(), self.dim, [c for c in docs.columns if c not in ("tokens", "sizes")]
        kinds = _arrow(docs.sparkSession, schema)

        def run(table: pa.Table, rows: pa.Table) -> pa.Table:
            codes, sizes = blocks.flat(table, "codes")
            row, out, at = rows_of(rows, int(codes.max(initial=-1)) + 1), [], 0
            for k, n in enumerate(sizes):
                values = {c: table.column(c)[k].as_py() for c in names}
                out += made(values, blocks.part_sums(row, codes[at : at + n], np.array(table.column("sizes")[k].as_py() or [0], np.int64), dim))
                at += n
            return pa.Table.from_arrays([pa.array(list(x), kind.type) for x, kind in zip(zip(*out), kinds)], schema=kinds) if out else kinds.empty_table()

        own = blocks.blocks(docs)
        return blocks.met(own, _known(own, self), run, schema)

    def _rows_of(self) -> Callable[[pa.Table, int], Callable[[np.ndarray], np.ndarray]]:
        """What makes the rows of a block's terms, idf times vector, of the rows of _known; terms without a vector have zeros."""
        of, dim = self.contexts and self.contexts.rows, self.dim

        def made(rows: pa.Table, n: int) -> Callable[[np.ndarray], np.ndarray]:
            matrix, code = np.zeros((n, dim)), rows.column("code").to_numpy()
            for lo in range(0, rows.num_rows, 1024):
                own = rows.slice(lo, 1024)
                vectors = of(own) if of else own.column("vector").combine_chunks().flatten().to_numpy().reshape(own.num_rows, dim)
                matrix[code[lo : lo + 1024]] = vectors * own.column("idf").to_numpy()[:, None]
            return lambda codes: matrix[codes]

        return made

    def _some(self, terms: DataFrame) -> DataFrame:
        """The vectors (term, vector) of those of terms (term) that have one."""
        return self.vectors.join(terms, "term", "left_semi") if self.contexts is None else self.contexts.vectors(self.contexts.packed.join(terms, "term", "left_semi"))

    def neighbours(self, words: DataFrame, k: int = 8) -> DataFrame:
        """(term, other, score): the k terms nearest to each of words (term), which fall back to their stem's vector."""
        own = words.select("term", stem(F.col("term")).alias("s")).distinct()
        # a set of terms and their stems, stored, as it is read by each of the joins
        some = stored(self._some(own.select(F.explode(F.array("term", "s")).alias("term")).distinct()), "some-vectors")
        exact = own.join(some, "term").select("term", "vector")
        by_stem = own.join(some.select("term"), "term", "left_anti").join(some.withColumnRenamed("term", "s"), "s").select("term", "vector")
        from tesserae.operators.retrieve import brute_force

        hits = brute_force(self.vectors.select(F.col("term").alias("chunk_id"), "vector"), exact.unionByName(by_stem).select(F.col("term").alias("query_id"), F.col("vector").alias("query_vector")), k + 1)
        hits = hits.filter("query_id <> chunk_id").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("n") <= k)
        return hits.select(F.col("query_id").alias("term"), F.col("chunk_id").alias("other"), "score")

    def save(self, path: str) -> None:
        """Parquet tables under path, with a version."""
        self.terms.write.parquet(f"{path}/terms")
        self.vectors.write.parquet(f"{path}/vectors")
        spark = self.terms.sparkSession
        spark.createDataFrame([(3, self.max_idf, self.common, self.dim)], "version int, max_idf double, common array<double>, dim int").write.parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PpmiModel:
        row = spark.read.parquet(f"{path}/model").first()
        if row is None or row["version"] != 3:
            raise ValueError(f"{path} holds no model of version 3")
        return PpmiModel(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/vectors"), row["max_idf"], row["common"], row["dim"])


def _raw(docs: DataFrame, model: PpmiModel) -> DataFrame:
    """(doc_id, vector) of documents or their blocks: the sum over tokens, with repeats, of idf * vector at unit length; an unknown term takes the vector of the most frequent one with its stem."""
    own = blocks.blocks(docs)
    return _encoded(own, _known(own, model), model._rows_of(), model.dim)


def _known(own: DataFrame, model: PpmiModel) -> DataFrame:
    """(term, idf, contexts or vector) of the terms of blocks that have a vector, or the vector of the most frequent one with their stem."""
    words = blocks.dictionaries(own).select("term").distinct().join(model.terms.select("term", "stem", "df", "idf"), "term", "left")
    vectors = model.vectors if model.contexts is None else model.contexts.packed
    known = vectors.select("term").join(model.terms.select("term", "stem", "df"), "term")
    of_stem = known.withColumn("_n", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("df"), "term"))).filter("_n = 1").select(F.col("stem").alias("s"), F.col("term").alias("stand_in"))
    mapped = words.withColumn("s", F.coalesce("stem", stem(F.col("term")))).join(known.select(F.col("term"), F.lit(True).alias("known")), "term", "left").join(of_stem, "s", "left")
    mapped = mapped.select("term", F.when(F.col("known"), F.col("term")).otherwise(F.col("stand_in")).alias("use"), F.coalesce("idf", F.lit(model.max_idf)).alias("idf")).filter("use is not null")
    return mapped.join(vectors.withColumnRenamed("term", "use"), "use").drop("use")


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    """A schema as Arrow has it."""
    return spark.createDataFrame([], schema).toArrow().schema


def fit_ppmi(docs: DataFrame, dim: int = DIM, seed: int = SEED, min_df: int = 2, window: int = 5, max_contexts: int = 64, direction: bool = True) -> PpmiModel:
    """A model of docs (doc_id, tokens).  Without co-occurrences it has no vectors.

    The common direction takes the vectors of all documents; terms need none, so
    that a model that only tells neighbours is fitted with direction=False.

    Tables that are read more than once are stored in the shared folder.
    """
    given, docs = docs, stored(docs.select("doc_id", "tokens"), "tokens")
    corpus, own = stats.corpus_stats(docs), blocks.blocks(docs)
    terms = stored(stats.with_idf(stats.block_stats(docs, own), corpus), "terms")
    contexts, vectors = _contexts(stats.pairs(docs, stats.vocabulary(terms, min_df), window), max_contexts, dim, seed)
    n = corpus.first()["n_docs"]
    model = PpmiModel(terms, vectors, float(np.log((n - 0.5) / 1.5 + 1.0)) if n else 1.0, None, dim, contexts=contexts)
    if not direction:
        return model
    raw = stored(_raw(own, model), "raw-vectors")
    model.common, model.fitted, model.own = common_direction(raw, dim), (given, raw), own
    return model


def _contexts(own: stats.Pairs, max_contexts: int, dim: int, seed: int) -> tuple[Contexts | None, DataFrame]:
    """The contexts of pairs, if their terms are few enough to go with tasks as arrays, and the vectors (term, vector)."""
    packed = own.strongest(max_contexts, packed=True)
    if packed is None:
        return None, stored(_term_vectors(stored(stats.strongest_contexts(own, max_contexts), "contexts"), dim, seed), "vectors")
    packed = stored(own.named(packed, "term", "id").select("term", "id", "ctxs", "units"), "contexts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [i if s > 0 else -1 - i for t in batch.column("term").to_pylist() for i, s in signature(t, dim, seed)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(np.array(made, np.int16).reshape(batch.num_rows, NONZEROS))], names=["id", "at"])

    table = own.names.mapInArrow(run, "id int, at array<short>").toArrow()
    signs = np.zeros((max(own.n, 1), NONZEROS), np.int16)
    if table.num_rows:
        signs[table.column("id").to_numpy()] = blocks.flat(table, "at")[0].reshape(-1, NONZEROS)
    contexts = Contexts(packed, signs, own.pmi(), dim)
    return contexts, contexts.vectors(packed)


def _term_vectors(contexts: DataFrame, dim: int, seed: int) -> DataFrame:
    """(term, vector) at unit length: the sum of w times the signature of each context (term, ctx, w); a row for each context goes to its term, not one for each sign."""
    own = contexts.select(F.col("ctx").alias("term")).distinct()

    @F.pandas_udf("array<int>")
    def signs(xs: pd.Series) -> pd.Series:
        return xs.map(lambda t: [i if s > 0 else -1 - i for i, s in signature(t, dim, seed)])

    known = own.select(F.col("term").alias("ctx"), signs("term").alias("at"))
    packed = contexts.join(known, "ctx").groupBy("term").agg(F.flatten(F.collect_list("at")).alias("at"), F.collect_list("w").alias("w"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                at = batch.column("at").flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), batch.column("at").value_lengths().to_numpy())
                w = np.repeat(batch.column("w").flatten().to_numpy(), NONZEROS) * np.where(at >= 0, 1.0, -1.0)
                out = np.bincount(row * dim + np.where(at >= 0, at, -1 - at), weights=w, minlength=batch.num_rows * dim).reshape(-1, dim)
                size = np.linalg.norm(out, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column("term"), _lists(out / np.where(size > 1e-12, size, 1.0))], names=["term", "vector"])

    return packed.mapInArrow(spread, "term string, vector array<double>")


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, dim = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(matrix.reshape(-1)))


def common_direction(vectors: DataFrame, dim: int = DIM) -> list[float] | None:
    """First principal direction of all vectors (doc_id, vector) that are not (almost) zero, by power iteration; null of fewer than COMMON_LEAST.

    Each partition sums the products of its vectors' elements, dim rows of dim
    sums; these are added by row, and the iteration runs on that one matrix,
    whose size does not depend on the number of documents.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((dim, dim)), 0
        for batch in batches:
            own = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, dim)
            own = own[np.linalg.norm(own, axis=1) > 1e-12]
            sums += own.T @ own
            n += len(own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(sums), pa.list_(pa.float64())), pa.array(np.full(dim, n), pa.int64())], names=["i", "sums", "n"])

    def added(table: pa.Table) -> pa.Table:
        total = table.column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64())), "n": pa.array([sum(table.column("n").to_pylist())])})

    schema = "i int, sums array<double>, n long"
    rows = vectors.select("vector").mapInArrow(products, schema).groupBy("i").applyInArrow(added, schema).collect()
    if not rows or rows[0]["n"] < COMMON_LEAST:
        return None
    matrix = np.array([r["sums"] for r in sorted(rows, key=lambda r: r["i"])])
    v = np.full(dim, 1.0 / np.sqrt(dim))
    for _ in range(COMMON_ROUNDS):
        nxt = matrix @ v
        size = np.linalg.norm(nxt)
        if size <= 1e-12:
            return None
        v = nxt / size
    return [float(x) for x in v]


class _GramSums:
    """The sums of the signatures of terms' 3- to 5-grams, whole numbers, of up to most terms at a time, MOST unless given."""

    MOST = 65_536

    def __init__(self, dim: int, seed: int, most: int | None = None) -> None:
        self.dim, self.seed, self.most = dim, seed, most or self.MOST
        self.place: dict[str, int] = {}
        self.sums, self.sizes = np.zeros((self.most, dim), np.float32), np.zeros(self.most)

    def rows(self, terms: list[str]) -> np.ndarray:
        """The rows of at most so many terms."""
        new = [t for t in dict.fromkeys(terms) if t not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place, new = {}, list(dict.fromkeys(terms))
        for lo in range(0, len(new), 512):
            part, at = new[lo : lo + 512], len(self.place)
            self.sums[at : at + len(part)], self.sizes[at : at + len(part)] = self._made(part)
            self.place.update(zip(part, range(at, at + len(part))))
        return np.fromiter((self.place[t] for t in terms), np.int64, len(terms))

    def _made(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(f"^{t}$" for t in terms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter((len(t) + 2 for t in terms), np.int64, len(terms))
        owner, left = np.repeat(np.arange(len(terms)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        sums, sizes = np.zeros(len(terms) * self.dim), np.zeros(len(terms))
        for n in (3, 4, 5):
            starts = np.flatnonzero(left >= n)
            sizes += np.bincount(owner[starts], minlength=len(terms))
            for lo in range(0, len(starts), 1 << 16):
                at = starts[lo : lo + (1 << 16)]
                state = np.full(len(at), self.seed & MASK, np.uint64)
                for j in range(n):
                    state = (state ^ codes[at + j]) * np.uint64(FNV_PRIME)
                found, have, row = np.full((len(at), NONZEROS), -1), np.zeros(len(at), np.int64), np.arange(len(at))
                while len(row):
                    state = state * np.uint64(LCG_FACTOR) + np.uint64(LCG_STEP)
                    idx = ((state >> np.uint64(17)) % np.uint64(self.dim)).astype(np.int64)
                    fresh = np.flatnonzero(~(found[row] == idx[:, None]).any(axis=1))
                    found[row[fresh], have[row[fresh]]] = idx[fresh]
                    have[row[fresh]] += 1
                    sign = np.where((state[fresh] >> np.uint64(61)) & np.uint64(1), 1.0, -1.0)
                    sums += np.bincount(owner[at[row[fresh]]] * self.dim + idx[fresh], weights=sign, minlength=len(sums))
                    open_ = have[row] < NONZEROS
                    row, state = row[open_], state[open_]
        return sums.reshape(-1, self.dim), sizes


def encode_chars(docs: DataFrame, terms: DataFrame | None = None, max_idf: float = 1.0, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(doc_id, vector) of documents or their blocks from the 3- to 5-grams of tokens, each token weighted by idf / sqrt(number of its grams); idf is 1 without terms.

    A document without tokens has a zero vector.
    """
    own, seed = blocks.blocks(docs), seed ^ CHAR_SEED
    known = blocks.dictionaries(own).select("term").distinct()
    known = known.withColumn("idf", F.lit(1.0)) if terms is None else known.join(terms.select("term", "idf"), "term", "left").select("term", F.coalesce("idf", F.lit(max_idf)).alias("idf"))

    def rows_of(rows: pa.Table, n: int) -> Callable[[np.ndarray], np.ndarray]:
        names, code = rows.column("term").to_pylist(), rows.column("code").to_numpy()
        grams, at, weight = _GramSums(dim, seed, len(names)), np.zeros(n, np.int64), np.zeros(n)
        at[code] = grams.rows(names)
        weight[code] = rows.column("idf").to_numpy() / np.sqrt(np.maximum(grams.sizes[at[code]], 1))
        return lambda codes: grams.sums[at[codes]] * weight[codes][:, None]

    return _encoded(own, known, rows_of, dim, True)


def encode_composite(model: PpmiModel, docs: DataFrame) -> DataFrame:
    """(doc_id, vector): 0.7 of the PPMI and 0.3 of the character vector at unit length; a missing one counts as zero."""
    own = model.own if model.fitted is not None and model.fitted[0] is docs else blocks.blocks(docs.select("doc_id", "tokens"))
    a, b = model.encode(docs if own is model.own else own).withColumnRenamed("vector", "p"), encode_chars(own, model.terms, model.max_idf, model.dim).withColumnRenamed("vector", "c")
    both = b.join(a, "doc_id", "full")
    none = F.array_repeat(F.lit(0.0), model.dim)
    return both.select("doc_id", l2_normalize(F.zip_with(F.coalesce("p", none), F.coalesce("c", none), lambda x, y: x * BLEND[0] + y * BLEND[1])).alias("vector"))


@dataclass
class CharModel:
    """What the character embedder knows of a corpus: terms (term, idf) and the idf of others."""

    terms: DataFrame
    max_idf: float
    dim: int = DIM
    seed: int = SEED

    def encode(self, docs: DataFrame) -> DataFrame:
        return encode_chars(docs, self.terms, self.max_idf, self.dim, self.seed)

    def save(self, path: str) -> None:
        self.terms.select("term", "idf").write.parquet(f"{path}/terms")
        _save_row(self.terms.sparkSession, path, "char", self.max_idf, self.dim, self.seed)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CharModel:
        row = _load_row(spark, path, "char")
        return CharModel(spark.read.parquet(f"{path}/terms"), row["max_idf"], row["dim"], row["seed"])


@dataclass
class CompositeModel:
    """A PPMI model whose terms also serve the character embedder."""

    ppmi: PpmiModel

    def encode(self, docs: DataFrame) -> DataFrame:
        return encode_composite(self.ppmi, docs)

    def neighbours(self, words: DataFrame, k: int = 8) -> DataFrame:
        return self.ppmi.neighbours(words, k)

    def save(self, path: str) -> None:
        self.ppmi.save(f"{path}/ppmi")
        _save_row(self.ppmi.terms.sparkSession, path, "composite", self.ppmi.max_idf, self.ppmi.dim, SEED)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CompositeModel:
        _load_row(spark, path, "composite")
        return CompositeModel(PpmiModel.load(spark, f"{path}/ppmi"))


def _save_row(spark: SparkSession, path: str, kind: str, max_idf: float, dim: int, seed: int) -> None:
    """Written last: a folder without it holds no whole model."""
    spark.createDataFrame([(kind, max_idf, dim, seed)], "kind string, max_idf double, dim int, seed long").write.parquet(f"{path}/embedder")


def _load_row(spark: SparkSession, path: str, kind: str) -> Row:
    row = spark.read.parquet(f"{path}/embedder").first()
    if row is None or row["kind"] != kind:
        raise ValueError(f"{path} holds no {kind} model")
    return row


def fit_chars(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> CharModel:
    """A character model of docs (doc_id, tokens)."""
    corpus = stats.corpus_stats(docs)
    n = corpus.first()["n_docs"]
    return CharModel(stats.with_idf(stats.block_stats(docs, blocks.blocks(docs.select("doc_id", "tokens"))), corpus), float(np.log((n - 0.5) / 1.5 + 1.0)) if n else 1.0, dim, seed)


def embedder(kind: str, docs: DataFrame, dim: int = DIM, seed: int = SEED) -> Callable[[DataFrame], DataFrame]:
    """An encoder of documents (doc_id, tokens) fitted on docs: ppmi, char or composite."""
    if kind == "char":
        return fit_chars(docs, dim, seed).encode
    if kind not in ("ppmi", "composite"):
        raise ValueError(f"unknown embedder {kind}")
    model = fit_ppmi(docs, dim, seed)
    return model.encode if kind == "ppmi" else CompositeModel(model).encode
