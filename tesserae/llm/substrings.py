"""Substring deduplication with difference-cover anchors.

Words are removed where a window of WINDOW words also starts anywhere else.  A
difference cover is a set of residues modulo PERIOD such that every difference
of two places is one of its differences: any two equal windows then share an
offset below PERIOD at which both places are cover positions.  So only the runs
of WINDOW - PERIOD + 1 words at cover positions (a quarter of all) are hashed
and counted over all texts; windows around an anchor that occurs again are then
extended to their whole length, hashed with 96 bits and counted in turn.

Texts are dealt into blocks of about BLOCK_BYTES.  Hashes are merged within a
batch and a block before they are shuffled, so that a passage that stands in a
third of all texts is one row per block; texts travel once compressed, and again
only where a window needs its count.

Nulls and odd cases: a null or empty text has no words and keeps the empty text.
Each row is a text of its own: of a row that is repeated, with the same id or
not, both are copies.  Null ids stay null.  Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.storage import documents
from tesserae.llm.wordhash import Words, parts, released

WINDOW = 35
#: A difference cover modulo 21; all of 0..20 are differences of two of its residues.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
BLOCK_BYTES = 2_000_000

_IN_COVER = np.zeros(PERIOD, dtype=bool)
_IN_COVER[list(COVER)] = True

#: Rows that are dealt out by block: marks (hashes that occur again) come first, then texts or finished documents.
DEALT = "block long, kind int, h long, check int, doc_id long, n_words long, n_removed long, kept_sha256 string, texts binary"
MARK, TEXTS, DONE, COUNTED = 0, 1, 2, 3


def _places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word its place in its text, and how many words there are from it on."""
    place = np.arange(len(words.hash)) - words.first[words.row]
    return place, words.count[words.row] - place


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that have a window."""
    run = window - PERIOD + 1
    place, left = _places(words)
    at = np.flatnonzero(_IN_COVER[place % PERIOD] & (left >= run) & (words.count[words.row] >= window))
    return at, words.runs(at, run)


def _counted(block: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct (block, keys) and how often each occurs."""
    order = np.lexsort((*keys[::-1], block))
    sorted_ = [block[order], *(k[order] for k in keys)]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for s in sorted_:
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return sorted_[0][at], [s[at] for s in sorted_[1:]], np.diff(np.append(at, len(order)))


def _emit_anchors(window: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in parts(batch, "text"):
                words = Words(part.column("text").fill_null(""))
                at, h = _anchors(words, window)
                found.append((part.column("block").to_numpy()[words.row[at]], h))
            if not found:
                continue
            blocks, (h,), n = _counted(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(blocks), pa.array(n.astype(np.int64))], names=["h", "block", "n"])

    return run


def _packed(ids: pa.Array, texts: pa.Array) -> bytes:
    """Ids and texts as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(packed) as stream:
        return stream.read_next_batch()


def _rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of DEALT rows with nulls in the columns that are not given."""
    kinds = {"block": pa.int64(), "kind": pa.int32(), "h": pa.int64(), "check": pa.int32(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "texts": pa.binary()}
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t) if c not in columns else None) for c, t in kinds.items()], names=list(kinds))


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's texts by block, compressed."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=block[order][:1] - 1)) if len(block) else []
        for k, lo in enumerate(cuts):
            own = pa.array(order[lo : cuts[k + 1] if k + 1 < len(cuts) else len(order)])
            texts = batch.column("text").take(own).fill_null("")
            yield _rows(TEXTS, 1, block=pa.array([int(block[order[lo]])]), texts=pa.array([_packed(batch.column("doc_id").take(own), texts)], pa.binary()))


def _is_in(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array of."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _by_block(batches: Iterator[pa.RecordBatch], each: Callable) -> Iterator[pa.RecordBatch]:
    """Calls each(block, marks, row batch) for rows sorted by block and kind, with the block's own marks gathered before."""
    current, own, marks = None, [], None
    for batch in batches:
        block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(block, prepend=block[:1]) != 0) | (np.diff(kind, prepend=kind[:1]) != 0))
        for lo, hi in zip([0, *edges], [*edges, len(block)]):
            if lo == hi:
                continue
            if block[lo] != current:
                current, own, marks = block[lo], [], None
            part = batch.slice(lo, hi - lo)
            if kind[lo] == MARK:
                own.append(part.column("h").to_numpy().view(np.uint64))
                continue
            if marks is None:
                marks = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
            yield from each(int(current), marks, part)


def _kept(text: str, keep: np.ndarray | None) -> str:
    """SHA-256 of a text's kept words, joined by one space."""
    words = text.encode().split()
    return hashlib.sha256(b" ".join(words if keep is None else compress(words, keep.tolist()))).hexdigest()


def _candidates(words: Words, dup_anchors: np.ndarray, window: int) -> np.ndarray:
    """Places of windows that contain, below the period, an anchor that occurs again."""
    at, h = _anchors(words, window)
    dup = np.zeros(len(words.hash) + PERIOD + 1, np.int64)
    dup[at[_is_in(h, dup_anchors)] + 1] = 1
    sums = np.cumsum(dup)
    _, left = _places(words)
    return np.flatnonzero((sums[PERIOD : PERIOD + len(left)] > sums[: len(left)]) & (left >= window))


def _window_hashes(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return words.runs(at, window), words.runs(at, window, seed=1).astype(np.uint32).view(np.int32)


def _extend(window: int) -> Callable:
    """Texts without a candidate are done; of the others the texts and the candidate windows are passed on."""

    def each(block: int, marks: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for packed in part.column("texts"):
            docs = _unpacked(packed.as_py())
            words = Words(docs.column("text"))
            at = _candidates(words, marks, window)
            waits = np.zeros(docs.num_rows, dtype=bool)
            waits[words.row[at]] = True
            done = np.flatnonzero(~waits)
            if len(done):
                texts = docs.column("text").take(pa.array(done)).to_pylist()
                yield _rows(
                    DONE,
                    len(done),
                    block=pa.array(np.full(len(done), block)),
                    doc_id=docs.column("doc_id").take(pa.array(done)),
                    n_words=pa.array(words.count[done].astype(np.int64)),
                    n_removed=pa.array(np.zeros(len(done), np.int64)),
                    kept_sha256=pa.array([_kept(t, None) for t in texts]),
                )
            if len(at):
                own = pa.array(np.flatnonzero(waits))
                yield _rows(TEXTS, 1, block=pa.array([block]), texts=pa.array([_packed(docs.column("doc_id").take(own), docs.column("text").take(own))], pa.binary()))
                h, check = _window_hashes(words, at, window)
                _, (h, check), n = _counted(np.zeros(len(h), np.int64), h, check)
                yield _rows(COUNTED, len(h), block=pa.array(np.full(len(h), block)), h=pa.array(h.view(np.int64)), check=pa.array(check), n_words=pa.array(n.astype(np.int64)))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_block(batches, each)

    return run


def _remove(window: int) -> Callable:
    """Finished documents pass; in the others the words of repeated windows are removed."""

    def each(block: int, marks: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if part.column("kind")[0].as_py() == DONE:
            yield part.select(["doc_id", "n_words", "n_removed", "kept_sha256"])
            return
        for packed in part.column("texts"):
            docs = _unpacked(packed.as_py())
            words = Words(docs.column("text"))
            _, left = _places(words)
            at = np.flatnonzero(left >= window)
            # counted by 96 bits; within one block 64 tell its windows apart
            twice = at[_is_in(words.runs(at, window), marks)]
            edge = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.bincount(words.row[gone], minlength=docs.num_rows).astype(np.int64)
            shas = [_kept(t, ~gone[f : f + c] if r else None) for t, f, c, r in zip(docs.column("text").to_pylist(), words.first, words.count, removed)]
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(removed), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_block(batches, each)

    return run


def _marks(hashes: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Of (keys, block, n) rows those whose keys occur more than once in all, as MARK rows."""
    again = hashes.withColumn("_all", F.sum(n).over(W.partitionBy(*keys))).filter("_all > 1")
    return again.select(
        "block", F.lit(MARK).alias("kind"), "h", F.lit(None).cast("int").alias("check"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("texts", "binary"))),
    )


def deduplicated(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs (doc_id, text)."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    anchors = dealt.select("block", "text").mapInArrow(_emit_anchors(window), "h long, block long, n long")
    texts = dealt.mapInArrow(_pack_texts, DEALT)
    together = _marks(anchors, ["h"], "n").unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    extended = together.mapInArrow(_extend(window), DEALT)
    windows = extended.filter(F.col("kind") == COUNTED).select("h", "check", "block", F.col("n_words").alias("n"))
    rest = extended.filter(F.col("kind") != COUNTED)
    together = _marks(windows, ["h", "check"], "n").unionByName(rest).repartition("block").sortWithinPartitions("block", "kind")
    return together.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i+1:i+{WINDOW}], ' ') AS g FROM (SELECT rid, ws, unnest(range(0, len(ws) - {WINDOW} + 1)) AS i FROM src WHERE len(ws) >= {WINDOW})),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM dup) GROUP BY rid),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT rid, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM src) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT rid AS r2, unnest(ps) AS p2 FROM gone) y WHERE y.r2 = x.rid AND y.p2 = x.p) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM src LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""
