"""Near duplicates by SimHash and an anchor-point covering of the fingerprints.

Anchors are the codewords of a product of perfect cyclic codes (binary Golay codes
of 23 bits, Hamming codes of seven), each on bits of the fingerprint of its own:
each word of a block is within the code's covering radius of exactly one codeword.
A fingerprint is replicated to every anchor whose distance in each block is
within the covering radius plus an excess, the excesses of all blocks summing to
half the threshold at most.  Two fingerprints within the threshold have a point
between them that is within half of it of either; the anchor that covers this
point therefore has both, so none of their pairs is missed.  Fingerprints are compared
per anchor, whole.

Equal fingerprints are one row before they are replicated.  Rows of an anchor
are read sorted and compared within pieces of GROUP rows; of what is linked
there, stars are returned, never all pairs.  Pieces of one large anchor are also compared with its
first ones (pivots), and after that only fingerprints whose components differ are compared
across pieces, those outside the largest component with all, by blocks.

Nulls and odd cases: a null or empty text and one of white space have the fingerprint zero, which
links like any other.  Of an even split a bit is 0.  A row without an id has its fingerprint's component,
which is null if no row of the component has an id.  Repeated rows each give a row.
Columns beyond id and text are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.ngram_join import components
from tesserae.llm.storage import documents, small, stored
from tesserae.llm.wordhash import Places, parts, released

WORDS, THRESHOLD, SEED = 4, 4, 42
#: Rows of an anchor that are compared at once, groups compared by shifts, and pivots of a larger anchor.
GROUP, SHIFTED, PIVOTS = 512, 16, 64
#: Rows that are looked at together, and shingles whose bits are counted together.
ROWS, COUNTED = 1 << 16, 1 << 16
#: With more than so many fingerprints per comparison of one, another code takes part.
MOST_MEETINGS = 1 << 12


# --- fingerprints ----------------------------------------------------------------------------------------------------


def fingerprints(texts: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The SimHash of each text: of the XXH64 values of its shingles, repeated ones counted again, each bit that more than half of them have."""
    places = Places(texts.fill_null(""))
    joined = places.joined(np.arange(len(places.start))).lower()
    ends = np.cumsum(places.end - places.start + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    n = np.where(places.count >= words, places.count - words + 1, np.minimum(places.count, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + places.first[row]
    last = np.minimum(first + words, (places.first + places.count)[row]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins[first].tolist(), ends[last].tolist())), np.uint64, len(row))
    counts = np.zeros((len(n), 64), np.int64)
    for lo in range(0, len(h), COUNTED):
        own = row[lo : lo + COUNTED]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.unpackbits(h[lo : lo + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _emit_fingerprints(words: int, seed: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b, "text")):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text"), words, seed).view(np.int64))], names=["doc_id", "fp"])

    return run


# --- anchors ---------------------------------------------------------------------------------------------------------


class PerfectCode:
    """The cyclic code of a generator polynomial whose balls of a radius fill the space.

    patterns[e] has what leads from a word to the codewords in excess e of the
    radius (0: within it), by the word's syndrome: starts and the patterns.
    """

    def __init__(self, bits: int, generator: int, radius: int, excess: int) -> None:
        self.bits, self.generator, self.degree = bits, generator, generator.bit_length() - 1
        weighted = [np.array([sum(1 << i for i in c) for c in combinations(range(bits), w)], np.uint64) for w in range(min(bits, radius + excess) + 1)]
        levels = [np.concatenate(weighted[: radius + 1]), *weighted[radius + 1 :]]
        self.patterns = []
        for level in levels:
            s = self.syndrome(level)
            order = np.argsort(s, kind="stable")
            self.patterns.append((np.searchsorted(s[order], np.arange((1 << self.degree) + 1)), level[order]))
        if not (np.diff(self.patterns[0][0]) == 1).all():
            raise ValueError("the code is not perfect")

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        """The remainders modulo the generator."""
        left = words.copy()
        for shift in range(self.bits - self.degree - 1, -1, -1):
            top = (left >> np.uint64(shift + self.degree)) & np.uint64(1)
            left ^= top * np.uint64(self.generator << shift)
        return left.astype(np.int64)

    def number(self, codewords: np.ndarray) -> np.ndarray:
        """Codewords by their upper bits, which tell them apart."""
        return (codewords >> np.uint64(self.degree)).astype(np.int64)


#: Fixed values: (bits, generator polynomial, covering radius) of the binary Golay code and of a Hamming code.
GOLAY, HAMMING = (23, 0b110001110101, 3), (7, 0b1011, 1)
PRODUCT = (GOLAY, GOLAY, HAMMING, HAMMING)


@functools.cache
def _code(bits: int, generator: int, radius: int, excess: int) -> PerfectCode:
    return PerfectCode(bits, generator, radius, excess)


def codes_for(n: int, threshold: int = THRESHOLD) -> tuple:
    """The codes for n fingerprints: as few as keep the expected meetings of a fingerprint within MOST_MEETINGS, at most PRODUCT."""
    for k in range(1, len(PRODUCT) + 1):
        copies, anchors = np.array([1.0] + [0.0] * (-(-threshold // 2))), 1.0
        for bits, generator, radius in PRODUCT[:k]:
            code = _code(bits, generator, radius, -(-threshold // 2))
            mean = np.array([len(p[1]) / (1 << code.degree) for p in code.patterns])
            copies, anchors = np.convolve(copies, mean)[: len(copies)], anchors * 2 ** (bits - code.degree)
        if n * copies.sum() ** 2 / anchors <= MOST_MEETINGS:
            break
    return PRODUCT[:k]


def anchors(fp: np.ndarray, codes: tuple, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(place in fp, anchor) of all replicas."""
    half = -(-threshold // 2)
    own, anchor, spent, low = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), 0
    for bits, generator, radius in codes:
        code = _code(bits, generator, radius, half)
        word = (fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        syndrome = code.syndrome(word)
        found = []
        for excess, (starts, patterns) in enumerate(code.patterns):
            some = np.flatnonzero(spent + excess <= half)
            s = syndrome[own[some]]
            n = starts[s + 1] - starts[s]
            again = np.repeat(some, n)
            pattern = patterns[np.arange(len(again)) + np.repeat(starts[s] - (np.cumsum(n) - n), n)]
            number = code.number(word[own[again]] ^ pattern)
            found.append((own[again], (anchor[again] << (bits - code.degree)) | number, spent[again] + excess))
        own, anchor, spent = (np.concatenate(x) for x in zip(*found))
        low += bits
    return own, anchor


def _replicate(codes: tuple, threshold: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            own, anchor = anchors(fp, codes, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[own].view(np.int64))], names=["anchor", "fp"])

    return run


# --- comparison ------------------------------------------------------------------------------------------------------


def _stars(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each fingerprint that is linked, directly or not, to an earlier one of these, with the first that it reaches."""
    near = np.bitwise_count(fp[:, None] ^ fp) <= threshold
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label, len(fp)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    some = np.flatnonzero(label != np.arange(len(fp)))
    return fp[some], fp[label[some]]


def _shifted(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the linked pairs of the same anchor; rows are sorted by anchor."""
    found, k, at = [], 1, np.arange(len(fp))
    while len(at := at[at + k < len(fp)]) and len(at := at[anchor[at] == anchor[at + k]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= threshold]
        found.append((fp[near], fp[near + k]))
        k += 1
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64) for i in (0, 1))


class _Comparison:
    """Links of rows (anchor, fp) that come sorted by anchor, and the rows of anchors that have more than GROUP."""

    def __init__(self, threshold: int) -> None:
        self.threshold, self.large, self.pivots, self.out = threshold, None, None, []

    def _whole(self, anchor: np.ndarray, fp: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> None:
        few = np.repeat(sizes <= SHIFTED, sizes)
        self.out.append((False, *_shifted(anchor[few], fp[few], self.threshold)))
        for g in np.flatnonzero(sizes > SHIFTED).tolist():
            self._piece(fp[begins[g] : begins[g] + sizes[g]])

    def _piece(self, fp: np.ndarray) -> None:
        self.out.append((False, *_stars(fp, self.threshold)))

    def _part_of_large(self, anchor: int, fp: np.ndarray) -> None:
        if self.large != anchor:
            self.large, self.pivots = anchor, fp[:PIVOTS]
        self.out.append((True, np.full(len(fp), anchor, np.int64).view(np.uint64), fp))
        for lo in range(0, len(fp), GROUP):
            own = fp[lo : lo + GROUP]
            self._piece(own)
            near = np.bitwise_count(own[:, None] ^ self.pivots) <= self.threshold
            some = np.flatnonzero(near.any(axis=1))
            self.out.append((False, own[some], self.pivots[near[some].argmax(axis=1)]))

    def add(self, anchor: np.ndarray, fp: np.ndarray, last: bool) -> int:
        """Takes rows in; returns how many of the last ones, a group that may go on, are to be given again."""
        begins = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
        sizes = np.diff(np.append(begins, len(anchor)))
        is_large = sizes > GROUP
        if self.large is not None:
            is_large |= anchor[begins] == self.large
        held = 0 if last or is_large[-1] else int(sizes[-1])
        n = len(begins) - bool(held)
        begins, sizes, is_large = begins[:n], sizes[:n], is_large[:n]
        for g in np.flatnonzero(is_large).tolist():
            self._part_of_large(int(anchor[begins[g]]), fp[begins[g] : begins[g] + sizes[g]])
        rest, sizes = np.repeat(~is_large, sizes), sizes[~is_large]
        self._whole(anchor[: len(rest)][rest], fp[: len(rest)][rest], sizes, np.cumsum(sizes) - sizes)
        return held

    def taken(self) -> Iterator[pa.RecordBatch]:
        for large, a, b in self.out:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), large)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["large", "a", "b"])
        self.out = []


def _compare(threshold: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparison, held, n = _Comparison(threshold), [], 0
        for batch in batches:
            held.append((batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n >= ROWS:
                anchor, fp = (np.concatenate(x) for x in zip(*held))
                n = comparison.add(anchor, fp, False)
                held = [(anchor[len(anchor) - n :], fp[len(fp) - n :])]
                yield from comparison.taken()
        if n:
            comparison.add(*(np.concatenate(x) for x in zip(*held)), True)
            yield from comparison.taken()

    return run


def _across(threshold: int) -> Callable:
    """(a, b): fingerprints outside the anchor's largest component with those of one of its blocks that they link with, by component one each."""

    def run(table: pa.Table) -> pa.Table:
        side, fp, label = table.column("side").to_numpy(), table.column("fp").to_numpy().view(np.uint64), table.column("label").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero((np.bitwise_count(fp[x][:, None] ^ fp[y]) <= threshold) & (label[x][:, None] != label[y]))
        _, one = np.unique(np.stack([label[x[i]], label[y[j]]]), axis=1, return_index=True) if len(i) else (None, np.empty(0, np.int64))
        return pa.table({"a": pa.array(fp[x[i[one]]].view(np.int64)), "b": pa.array(fp[y[j[one]]].view(np.int64))})

    return run


def across(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between components of an anchor's rows (anchor, fp, label); those outside its largest component meet all, by blocks of GROUP."""
    counts = rows.groupBy("anchor", "label").agg(F.count("*").alias("n"))
    of = counts.groupBy("anchor").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest")).filter("rest > 0")
    of = small(stored(of.select("anchor", "major", F.ceil(F.col("all") / GROUP).cast("int").alias("blocks"), F.ceil(F.col("rest") / GROUP).cast("int").alias("parts")), "anchors"))
    own = rows.join(of, "anchor").withColumn("h", F.xxhash64("fp"))
    left = own.filter("label <> major").select("anchor", F.pmod("h", "parts").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), F.lit(0).alias("side"), "fp", "label")
    right = own.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.pmod("h", "blocks").cast("int").alias("q"), F.lit(1).alias("side"), "fp", "label")
    return left.unionByName(right).groupBy("anchor", "p", "q").applyInArrow(_across(threshold), "a long, b long").distinct()


def near_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component): of the distinct fingerprints (fp) those that link with others, and the smallest that each reaches."""
    codes = codes_for(distinct.count(), threshold)
    replicas = distinct.select("fp").mapInArrow(_replicate(codes, threshold), "anchor long, fp long")
    found = stored(replicas.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare(threshold), "large boolean, a long, b long"), "compared")
    links = found.filter("not large").select("a", "b")
    labels = components(links)
    large = found.filter("large").select(F.col("a").alias("anchor"), F.col("b").alias("fp"))
    if large.isEmpty():
        return labels
    rows = large.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").select("anchor", "fp", F.coalesce("component", "fp").alias("label"))
    more = stored(across(stored(rows, "large-anchors"), threshold), "more-links")
    return labels if more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text); fp is the fingerprint as a signed long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.mapInArrow(_emit_fingerprints(words, seed), "doc_id long, fp long"), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = near_fingerprints(distinct, threshold)
    of = distinct.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(of.join(first, "component").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return of.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
