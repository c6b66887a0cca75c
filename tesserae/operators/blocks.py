"""Documents in blocks whose terms are numbered within the block, so that what is known of a term travels once for each block and not for each document.

A block is a run of documents of one task, closed at some million tokens or
some hundred thousand distinct terms, whichever comes first; a document is
never cut.  Its tokens are numbers in the block's own dictionary.  What a job
looks up by term (idf, contexts, a vector) is joined to the dictionaries and
meets the block's documents in one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import stored

#: A block is closed once it has so many tokens or distinct terms; documents are taken in by slices of SLICE tokens.
TOKENS, TERMS, SLICE = 2_000_000, 100_000, 1 << 16
#: Terms in one row of a dictionary.
ROW = 1 << 13


def blocks(docs: DataFrame) -> DataFrame:
    """docs (tokens, others) as a stored table with two kinds of rows: a document's (block, others, codes), and parts of a block's dictionary (block, base, terms, dfs, tfs), terms[k] having the number base + k.  Blocks are returned as they are."""
    if "codes" in docs.columns:
        return docs
    others = [c for c in docs.columns if c != "tokens"]
    kinds = [f.dataType.simpleString() for f in docs.select(*others).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, k = TaskContext.get().partitionId() << 32, 0
        held: dict[str, int] = {}
        dfs, tfs, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def table(rows: int, of: dict[str, pa.Array], like: pa.RecordBatch) -> pa.RecordBatch:
            kinds = {"codes": pa.list_(pa.int32()), "base": pa.int32(), "terms": pa.list_(pa.string()), "dfs": pa.list_(pa.int64()), "tfs": pa.list_(pa.int64())} | {c: like.schema.field(c).type for c in others}
            names = ["block", *others, "codes", "base", "terms", "dfs", "tfs"]
            made = {"block": pa.array(np.full(rows, number | k))} | of
            return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(rows, kinds[c]) for c in names], names=names)

        def dictionary(like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            terms = list(held)
            for lo in range(0, len(terms), ROW):
                one = {"base": pa.array([lo], pa.int32()), "terms": pa.array([terms[lo : lo + ROW]], pa.list_(pa.string()))}
                yield table(1, one | {c: pa.array([x[lo : min(lo + ROW, len(terms))]], pa.list_(pa.int64())) for c, x in (("dfs", dfs), ("tfs", tfs))}, like)

        like = None
        for batch in batches:
            ends = np.cumsum(batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo, like = 0, batch
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(int(np.searchsorted(ends, before + SLICE, "right")), lo + 1)
                own = batch.slice(lo, hi - lo)
                lo = hi
                sizes = own.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = own.column("tokens").flatten().dictionary_encode()
                names = found.dictionary.to_pylist()
                place = np.fromiter((held.setdefault(t, len(held)) for t in names), np.int64, len(names))
                codes = place[found.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
                if len(held) > len(tfs):
                    room = np.zeros(max(len(held), 2 * len(tfs)) - len(tfs), np.int64)
                    dfs, tfs = np.concatenate([dfs, room]), np.concatenate([tfs, room])
                row = np.repeat(np.arange(len(sizes)), sizes)
                once = np.unique(row * len(held) + codes) % len(held) if len(codes) else codes
                tfs[: len(held)] += np.bincount(codes, minlength=len(held))
                dfs[: len(held)] += np.bincount(once, minlength=len(held))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield table(own.num_rows, {c: own.column(c) for c in others} | {"codes": pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32()))}, like)
                size += len(codes)
                if size >= TOKENS or len(held) >= TERMS:
                    yield from dictionary(like)
                    held, dfs, tfs, size, k = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, k + 1
        if held:
            yield from dictionary(like)

    schema = ", ".join(["block long", *(f"`{c}` {kind}" for c, kind in zip(others, kinds)), "codes array<int>", "base int", "terms array<string>", "dfs array<long>", "tfs array<long>"])
    return stored(docs.select(*others, "tokens").mapInArrow(run, schema), "blocks")


def dictionaries(of: DataFrame) -> DataFrame:
    """(block, code, term, df, tf) of blocks: each term once for each block, with its documents and places there."""
    rows = of.filter("terms is not null").select("block", "base", F.posexplode(F.arrays_zip("terms", "dfs", "tfs")).alias("k", "x"))
    return rows.select("block", (F.col("base") + F.col("k")).alias("code"), F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"), F.col("x.tfs").alias("tf"))


def repeated(of: DataFrame) -> bool:
    """Whether blocks have a doc_id in several rows."""
    return not of.filter("codes is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def met(of: DataFrame, known: DataFrame, made: Callable[[pa.Table, pa.Table], pa.Table], schema: str, terms: bool = False) -> DataFrame:
    """What made returns for each block's documents and the rows of known (term, others) for its terms, with their code and, if wanted, the terms."""
    docs = of.filter("codes is not null").drop("base", "terms", "dfs", "tfs")
    rows = dictionaries(of).select(F.col("block").alias("of_block"), "code", "term").join(known, "term")
    rows = rows if terms else rows.drop("term")
    return docs.groupBy("block").cogroup(rows.groupBy("of_block")).applyInArrow(lambda docs, rows: made(docs, rows) if docs.num_rows else made(docs, rows.slice(0, 0)), schema)


def flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists, and the lists' sizes."""
    own = table.column(column).combine_chunks()
    return own.flatten().to_numpy(zero_copy_only=False), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def part_sums(rows: Callable[[np.ndarray], np.ndarray], codes: np.ndarray, sizes: np.ndarray, dim: int) -> np.ndarray:
    """For consecutive parts of codes the sums of their rows, made for a thousand codes at a time."""
    out, owner = np.zeros((len(sizes), dim)), np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(codes), 1024):
        own = owner[lo : lo + 1024]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(rows(codes[lo : lo + 1024]), first)
    return out
