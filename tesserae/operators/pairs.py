"""Co-occurrence by numbered terms: pairs are sorted and summed as arrays before and after one shuffle.

Terms are numbered in their order.  A weight 1 / distance is a whole number of
1 / unit, so sums are exact in any order.  What a task ships is one row for each
bucket of first terms, with the pairs of some million places as the gaps between
them, in as few bytes as each takes; the merging task holds the distinct pairs of
its buckets.  Up to MOST_TERMS terms, numbers and sums go with the tasks as
arrays; with more, tokens meet the numbers in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import stored

#: Terms of which a task holds arrays of at most 16 bytes each, 128 MB.
MOST_TERMS = 8_000_000
#: Pairs that a task sorts at a time, each once for both directions, and pairs of a merging task before they are summed.
RUN, MERGED = 3 << 20, 1 << 22


def numbered_terms(vocab: DataFrame) -> DataFrame:
    """(id, term): the terms of vocab (term), numbered from 0 without gaps in their order."""
    placed = stored(vocab.select("term").distinct().orderBy("term").select("term", F.monotonically_increasing_id().alias("place")), "places")
    part = F.shiftright("place", 33)
    before, n = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first")).collect(), key=lambda r: r["part"]):
        before[r["part"]], n = n - r["first"], n + r["n"]
    shift = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), part) if before else F.lit(0)
    return stored(placed.select((F.col("place") + shift).cast("int").alias("id"), "term"), "numbers")


def whole(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tokens) with the rows of one id as one row, their tokens in the order of their places."""
    more = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "split-documents")
    if more.isEmpty():
        return docs.select("doc_id", "tokens")
    alike = docs["doc_id"].eqNullSafe(more["doc_id"])
    parts = docs.join(more, alike, "left_semi").select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    merged = parts.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("tokens"))
    return docs.join(more, alike, "left_anti").select("doc_id", "tokens").unionByName(merged)


def _as_numbers(docs: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """(ids): the numbers of each document's tokens, others left out."""
    if n <= MOST_TERMS:
        table = names.select(F.xxhash64("term").alias("h"), "id").toArrow()
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        hashes, ids = table.column("h").to_numpy()[order], table.column("id").to_numpy()[order].astype(np.int32)
        if n < 2 or (np.diff(hashes) != 0).all():

            def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own = batch.column("hs")
                    flat, sizes = own.flatten().to_numpy(zero_copy_only=False), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(hashes, flat), max(n - 1, 0))
                    known = hashes[at] == flat if n else np.zeros(len(flat), bool)
                    ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)])]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[at[known]] if n else [], pa.int32()))], names=["ids"])

            # tokens are told apart by 64 bits, as in op2 and op7; vocabularies with equal hashes are joined
            return docs.select(F.transform("tokens", lambda t: F.xxhash64(t)).alias("hs")).mapInArrow(looked_up, "ids array<int>")
    each = docs.select(F.monotonically_increasing_id().alias("row"), "tokens").select("row", F.posexplode("tokens").alias("pos", "term")).join(names, "term")
    return each.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def _neighbours(batches: Iterator[pa.RecordBatch], window: int, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(distance, a, b) of the unequal terms up to window places apart, of step places at a time."""
    for batch in batches:
        own = batch.column("ids")
        flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for lo in range(0, len(flat), step):
            for d in range(1, window + 1):
                hi = min(lo + step, len(flat) - d)
                if hi > lo:
                    a, b = flat[lo:hi], flat[lo + d : hi + d]
                    kept = (row[lo:hi] == row[lo + d : hi + d]) & (a != b)
                    yield d, a[kept], b[kept]


def summed(keys: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(units[order], first) if len(first) else units[:0]


def to_bytes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of whole numbers from 0, of the given sizes, as binary values: seven bits to a byte, the highest bit set where another follows."""
    n = np.ones(len(values), np.int64)
    for j in range(1, 9):
        n += values >= 1 << 7 * j
    starts = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(starts[-1], np.uint8)
    at, left = np.arange(len(values)), values
    for j in range(n.max(initial=0)):
        out[starts[at] + j] = (left & 127) | np.where(n[at] > j + 1, 128, 0)
        more = n[at] > j + 1
        at, left = at[more], left[more] >> 7
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(starts[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)), pa.py_buffer(out)])


def from_bytes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of such lists, and the lists' sizes."""
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    own = np.frombuffer(lists.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(lists) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    last = own < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    values, at, j = np.zeros(len(ends), np.int64), np.arange(len(ends)), 0
    while len(at):
        values[at] |= (own[starts[at] + j] & 127).astype(np.int64) << 7 * j
        at, j = at[starts[at] + j < ends[at]], j + 1
    return values, np.diff(np.concatenate([[0], np.cumsum(last)])[offsets - offsets[0]])


def gaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first value of each list that rises, and the differences of the others."""
    out = np.diff(values, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = values[first]
    return out


def from_gaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(values)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes)


@dataclass
class Pairs:
    """names (id, term), n of them; ids (ids) of documents; marginals (id, units); unit, of which a weight is a whole number of parts."""

    names: DataFrame
    n: int
    ids: DataFrame
    window: int
    unit: int
    marginals: DataFrame

    def merged(self, made: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What made yields for (a, b, units), the distinct pairs of a part of the first terms, both directions of each, sorted."""
        n, window, unit = max(self.n, 1), self.window, self.unit
        places = self.ids.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first()["n"]
        parts = places * 2 * window // MERGED + 1
        buckets, scale, step = 8 * parts, window + 1, max(RUN // window, 1)
        per = n // buckets + 1
        worth = np.array([0] + [unit // d for d in range(1, scale)], np.int64)

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                packed = np.concatenate(held)
                held.clear()
                packed.sort()
                keys = packed // scale
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                units, keys = np.add.reduceat(worth[packed % scale], first), keys[first]
                del packed, first
                a, b = np.concatenate([keys // n, keys % n]), np.concatenate([keys % n, keys // n])
                # sorted by bucket, and by first and second term within it; the first term's number is told by the bucket and a quotient
                keys, units = (a % buckets * per + a // buckets) * n + b, np.concatenate([units, units])
                del a, b
                order = np.argsort(keys, kind="stable")
                keys, units = keys[order], units[order]
                del order
                edges = np.searchsorted(keys, np.arange(buckets + 1) * (per * n))
                lo = 0
                while lo < buckets:  # some buckets at a time, as the bytes of each number take several arrays
                    hi = max(int(np.searchsorted(edges, edges[lo] + (1 << 19), "right")) - 1, lo + 1)
                    own, sizes = slice(edges[lo], edges[hi]), np.diff(edges[lo : hi + 1])
                    bucket = np.arange(lo, hi)[sizes > 0]
                    sizes = sizes[sizes > 0]
                    lists = [to_bytes(gaps(keys[own] - np.repeat(bucket, sizes) * (per * n), sizes), sizes), to_bytes(units[own], sizes)]
                    if len(bucket):
                        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *lists], names=["bucket", "pairs", "units"])
                    lo = hi

            for d, a, b in _neighbours(batches, window, step):
                held.append((np.minimum(a, b) * n + np.maximum(a, b)) * scale + d)
                size += len(a)
                if size >= RUN:
                    yield from out()
                    size = 0
            if size:
                yield from out()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, units = np.zeros(0, np.int64), np.zeros(0, np.int64)
            held, size = [], 0
            for batch in batches:
                own, sizes = from_bytes(batch.column("pairs"))
                own, bucket = from_gaps(own, sizes), np.repeat(batch.column("bucket").to_numpy(), sizes)
                held.append((own // n * (buckets * n) + bucket * n + own % n, from_bytes(batch.column("units"))[0]))
                size += len(own)
                if size >= max(MERGED, len(keys)):
                    keys, units = summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([units, *(u for _, u in held)]))
                    held, size = [], 0
            if size:
                keys, units = summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([units, *(u for _, u in held)]))
            if len(keys):
                yield from made(keys // n, keys % n, units)

        rows = self.ids.mapInArrow(runs, "bucket long, pairs binary, units binary")
        return rows.repartition(parts, "bucket").mapInArrow(merge, schema)

    def named(self, rows: DataFrame, column: str, number: str | None = None) -> DataFrame:
        """rows with the terms in the place of the numbers of a column, which are kept as number, if that is given."""
        kept = {number: F.col(column)} if number else {}
        return rows.join(self.names.select(F.col("id").alias(column), F.col("term").alias("_term")), column).withColumns(kept | {column: F.col("_term")}).drop("_term")

    def pmi(self, alpha: float = 0.75) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """The PMI of pairs (a, b, units) with a smoothed distribution of b, from the marginals of all terms as an array."""
        table, unit, m = self.marginals.toArrow(), float(self.unit), np.zeros(max(self.n, 1))
        m[table.column("id").to_numpy()] = table.column("units").to_numpy() / unit
        total, smooth = float(m.sum()), float((m**alpha).sum())
        return lambda a, b, units: np.log((units / unit / total) / ((m[a] / total) * (m[b] ** alpha / smooth)))

    def rows(self) -> DataFrame:
        """(a, b, weight) by number."""
        unit = float(self.unit)

        def made(a: np.ndarray, b: np.ndarray, units: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(a), 1 << 16):
                own = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(a[own], pa.int32()), pa.array(b[own], pa.int32()), pa.array(units[own] / unit)], names=["a", "b", "weight"])

        return self.merged(made, "a int, b int, weight double")

    def contexts(self) -> DataFrame:
        """(term, n_contexts, weight): the number of distinct neighbours of each term that has any, and the sum of its weights."""
        unit = float(self.unit)

        def made(a: np.ndarray, b: np.ndarray, units: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            counts = np.diff(np.concatenate([first, [len(a)]]))
            yield pa.RecordBatch.from_arrays([pa.array(a[first], pa.int32()), pa.array(counts, pa.int64()), pa.array(np.add.reduceat(units, first) / unit)], names=["term", "n_contexts", "weight"])

        return self.named(self.merged(made, "term int, n_contexts long, weight double"), "term")

    def strongest(self, max_contexts: int, alpha: float = 0.75, packed: bool = False) -> DataFrame | None:
        """(term, ctxs, ws): the numbers and values of the contexts of most positive PMI of each term, equal ones (to nine digits) in the order of terms; None of too many terms.

        Packed, (term, ctxs, units) with the gaps of the numbers, in their order, and units as to_bytes has them.
        """
        if self.n > MOST_TERMS:
            return None
        pmi = self.pmi(alpha)

        def made(a: np.ndarray, b: np.ndarray, units: np.ndarray) -> Iterator[pa.RecordBatch]:
            w = pmi(a, b, units)
            kept = w > 0
            a, b, w, units = a[kept], b[kept], w[kept], units[kept]
            order = np.lexsort((b, -np.round(w, 9), a))
            a, b, w, units = a[order], b[order], w[order], units[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            place = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]])))
            kept = place < max_contexts
            a, b, w, units = a[kept], b[kept], w[kept], units[kept]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            for lo in range(0, len(first), 1 << 12):
                ends = np.concatenate([first, [len(a)]])[lo : lo + (1 << 12) + 1]
                own = slice(ends[0], ends[-1])
                offsets, terms = pa.array(ends - ends[0], pa.int32()), pa.array(a[ends[:-1]], pa.int32())
                if packed:
                    order, sizes = np.lexsort((b[own], a[own])), np.diff(ends)
                    yield pa.RecordBatch.from_arrays([terms, to_bytes(gaps(b[own][order], sizes), sizes), to_bytes(units[own][order], sizes)], names=["term", "ctxs", "units"])
                else:
                    yield pa.RecordBatch.from_arrays([terms, pa.ListArray.from_arrays(offsets, pa.array(b[own], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(w[own]))], names=["term", "ctxs", "ws"])

        return self.merged(made, "term int, ctxs binary, units binary" if packed else "term int, ctxs array<int>, ws array<double>")


def pairs(docs: DataFrame, vocab: DataFrame | None = None, window: int = 5) -> Pairs:
    """The pairs of docs (doc_id, tokens) among the terms of vocab (term), or all terms."""
    unit = lcm(*range(1, window + 1))
    names = numbered_terms(docs.select(F.explode("tokens").alias("term")) if vocab is None else vocab)
    n = names.count()
    ids = stored(_as_numbers(docs.select("doc_id", "tokens") if vocab is None else whole(docs), names, n), "numbered")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n, np.int64)
        for d, a, b in _neighbours(batches, window, RUN):
            own += (np.bincount(a, minlength=n) + np.bincount(b, minlength=n)) * (unit // d)
        at = np.flatnonzero(own)
        for lo in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + (1 << 16)], pa.int32()), pa.array(own[at[lo : lo + (1 << 16)]])], names=["id", "units"])

    marginals = ids.mapInArrow(sums, "id int, units long").groupBy("id").agg(F.sum("units").alias("units"))
    return Pairs(names, n, ids, window, unit, marginals)
