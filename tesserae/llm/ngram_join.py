"""N-gram Jaccard join by parity sketches.

Each text is the set of its distinct word shingles.  Shingles are dealt into
chunks by a hash, and each chunk is XOR-ed: a shingle in which two texts differ
changes one chunk at most, so texts within the largest symmetric difference that
the threshold allows have equal chunks (pigeonhole), which an equi-join per size
band finds.  Candidates are compared by a longer parity sketch, one bit per
shingle, whose Hamming distance is at most the symmetric difference; what it
does not rule out is verified on the whole sets.

Texts with equal sets are one class and enter the join once per part of a batch.  Of a
chunk shared by many, all are compared with one pivot; after that, only members
of chunks whose classes are not yet connected are compared with those outside
the largest component.  A class leaves chunks that many share if enough of its other
chunks remain for the pigeonhole; classes for which that is not so are joined by
their rarest shingles (prefix filter) instead.  So no link is lost and no group
is expanded into all pairs.

Nulls and odd cases: a null or empty text has no words, an empty set and no
links.  Rows of one doc_id are one document for the join, and each gives a row.
A row with a null id belongs to the component of the rows with its set, if any
of them has an id; else its component is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.storage import NO_ID, documents, restricted, sealed, small, stored, unboxed
from tesserae.llm.wordhash import Words, mixed, parts, released

#: A chunk of more members than this is left by those that have enough others; the rest are joined by rare shingles.
HOT = 16
#: Members of a group that a task compares with as many others.
BLOCK = 512
#: Width of a size band, and sets up to which each shingle is its own chunk.
BAND = 1.6
SMALL = 64
#: Chunks for each shingle that may differ, so that some can be left.
SPARE = 1.25


@dataclass(frozen=True)
class Join:
    """Shingles of so many words; texts link when 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85

    def differ(self, a: int | np.ndarray, b: int | np.ndarray):
        """The largest symmetric difference of linked sets of these sizes."""
        return ((100 - self.percent) * (a + b)) // (100 + self.percent)

    def chunks(self, band: int) -> int:
        """How many chunks the sets of a band are dealt into; 0: one for each shingle."""
        top = ceil(BAND ** (band + 1))
        return 0 if top <= SMALL else ceil(SPARE * (self.differ(top, top) + 1))


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted, and each row's first place in them with the end appended."""
    words = Words(column.fill_null(""), lower=True)
    long = words.count >= n
    size = np.where(long, words.count - n + 1, words.count > 0)
    of_long = np.repeat(long, size)
    h = np.empty(len(of_long), np.uint64)
    left = np.repeat(words.first + words.count, words.count) - np.arange(len(words.hash))
    h[of_long] = words.runs(np.flatnonzero(left >= n), n)
    short = np.flatnonzero(~long & (words.count > 0))  # a text of fewer words is one shingle
    one = np.empty(len(short), np.uint64)
    for k in range(1, n):
        own = words.count[short] == k
        one[own] = words.runs(words.first[short[own]], k)
    h[~of_long] = one
    ends = np.cumsum(size)
    for lo, hi in zip((ends - size).tolist(), ends.tolist()):
        h[lo:hi].sort()
    row = np.repeat(np.arange(len(size)), size)
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[keep], h[keep]
    return row, h, np.searchsorted(row, np.arange(len(column) + 1))


def _xor(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """XOR of each row's values; 0 where a row has none."""
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(np.append(starts[:n], len(values))) > 0) if len(starts) == n else np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(values, starts[full])
    return out


def sketch(h: np.ndarray) -> bytes:
    """Parity bits of a set, as many as its size's next power of two."""
    bits = 64
    while bits < len(h):
        bits *= 2
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer folded to the shorter's length: a lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        # bit h % 2B goes to bit h % B: the upper half falls on the lower
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _emit_sets(join: Join) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text")):
            _, h, starts = shingles(batch.column("text"), join.words)
            n = np.diff(starts)
            one, two = _xor(mixed(h), starts, len(n)), _xor(mixed(h + np.uint64(77)), starts, len(n))
            bits = [sketch(h[a:b]) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(bits, pa.binary())],
                names=["doc_id", "n", "sig1", "sig2", "bits"],
            )

    return run


def _emit_chunks(join: Join) -> Callable:
    """KEY_ROWS: the chunks of each set of a part of a batch, one row for each chunk and band of the part.

    spare is how many of its chunks a document can leave and still share one of
    the others with every document that it links with.  Of a chunk that several
    documents of the part share, one row has all: their number n, the smallest,
    a sum x of their hashes, the first and the others (more).  So a chunk that a
    third of all texts share has a row for each part, not for each text.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text")):
            row, h, starts = shingles(batch.column("text"), join.words)
            n = np.diff(starts)
            ids = batch.column("doc_id")
            doc = ids.fill_null(0).to_numpy()
            # of equal sets in a part the one with the smallest id stands for all
            one, two = _xor(mixed(h), starts, len(n)), _xor(mixed(h + np.uint64(77)), starts, len(n))
            usable = np.flatnonzero((n > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
            order = usable[np.lexsort((doc[usable], two[usable], one[usable], n[usable]))]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (n[order][1:] != n[order][:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            chosen = np.zeros(len(n), dtype=bool)
            chosen[order[first]] = True
            band = np.zeros(len(n), np.int64)
            band[n > 0] = np.floor(np.log(n[n > 0]) / log(BAND)).astype(np.int64)
            ceiling = np.array([BAND ** (b + 1) for b in range(int(band.max(initial=0)) + 1)])
            # partners may be as large as n * 100 / percent, and so in the next band
            upper = 100 * n + join.percent > join.percent * ceiling[band]
            for up in (0, 1):
                for b in np.unique(band[chosen & (upper | (up == 0))]):
                    rows = chosen & (band == b) & (upper | (up == 0))
                    pick = rows[row]
                    r, v = row[pick], h[pick]
                    if not len(r):
                        continue
                    t = int(b) + up
                    m = join.chunks(t)
                    salt = mixed(np.array([t + 1], np.uint64))[0]
                    if m:  # a row's chunks are cells of a table, which has fewer cells than the rows have shingles
                        ids_, place = np.unique(r, return_inverse=True)
                        cell = place * m + (mixed(v ^ salt) % np.uint64(m)).astype(np.int64)
                        order = np.argsort(cell)
                        begins = np.flatnonzero(np.diff(cell[order], prepend=-1))
                        content = np.bitwise_xor.reduceat(mixed(v + np.uint64(5))[order], begins)
                        cell = cell[order[begins]]
                        own, chunk = ids_[cell // m], (cell % m).astype(np.uint64)
                    else:
                        own, chunk, content = r, v, mixed(v + np.uint64(5))
                    key = mixed(content ^ mixed(chunk ^ mixed(salt + np.uint64(9) + np.zeros(1, np.uint64))[0]))
                    has = np.bincount(own, minlength=len(n))
                    largest = (n * 100) // join.percent
                    spare = np.clip(has - join.differ(n, largest) - 1, -1, 30000)
                    yield _merged(key, doc[own], spare[own].astype(np.int16), t)

    return run


KEY_ROWS = "k long, band short, n long, least long, x long, doc long, spare short, more array<struct<doc:long,spare:short>>"


def _merged(key: np.ndarray, doc: np.ndarray, spare: np.ndarray, band: int) -> pa.RecordBatch:
    """KEY_ROWS of (key, doc, spare), rows of one key as one."""
    order = np.argsort(key, kind="stable")
    key, doc, spare = key[order], doc[order], spare[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key)))
    later = np.ones(len(key), dtype=bool)
    later[first] = False
    others = pa.StructArray.from_arrays([pa.array(doc[later]), pa.array(spare[later])], names=["doc", "spare"])
    more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n - 1)).astype(np.int32)), others, mask=pa.array(n == 1))
    x = np.bitwise_xor.reduceat(mixed(doc.astype(np.uint64)), first)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[first].view(np.int64)), pa.array(np.full(len(first), band, np.int16)), pa.array(n), pa.array(np.minimum.reduceat(doc, first)), pa.array(x.view(np.int64)), pa.array(doc[first]), pa.array(spare[first]), more],
        names=["k", "band", "n", "least", "x", "doc", "spare", "more"],
    )


def chunk_groups(docs: DataFrame, join: Join) -> DataFrame:
    """(g, pivot, doc, excess): documents that share a chunk; chunks with the same members are one group g.  Two may link only if their excesses sum to 0 at most."""
    over = "over (partition by k)"
    # the window's sums are of ids' hashes: equal groups have equal ones
    keys = docs.mapInArrow(_emit_chunks(join), KEY_ROWS)
    shared = keys.withColumns({"size": F.expr(f"sum(n) {over}"), "pivot": F.expr(f"min(least) {over}"), "g": F.expr(f"bit_xor(x) {over}")}).filter("size > 1")
    shared = shared.select("k", "band", "size", "pivot", "g", F.inline(F.concat(F.array(F.struct("doc", "spare")), F.coalesce("more", F.expr("cast(array() as array<struct<doc:bigint,spare:smallint>>)")))))
    # one pass over the keys: of cold chunks the groups, of hot ones the keys themselves
    is_hot = F.col("size") > HOT
    rows = shared.select(
        is_hot.alias("hot"), F.when(is_hot, F.col("k")).otherwise(F.col("g")).alias("g"), "pivot", "doc", F.when(is_hot, F.col("band")).alias("band"), F.when(is_hot, F.col("spare")).alias("spare")
    )
    rows = stored(rows.distinct(), "chunks")
    cold = rows.filter("not hot").select("g", "pivot", "doc", F.lit(-(1 << 60)).alias("excess"))
    # a document that cannot leave its hot chunks may share nothing else with another such document
    stuck = rows.filter("hot").groupBy("doc", "band", "spare").agg(F.count("*").alias("left")).filter(F.col("left") > F.col("spare")).select(F.col("doc").alias("doc_id")).distinct()
    return cold.unionByName(rare_groups(docs, stored(stuck, "stuck"), join))


def _emit_shingles(join: Join) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text")):
            row, h, starts = shingles(batch.column("text"), join.words)
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("doc_id").take(pa.array(row)), pa.array(n[row].astype(np.int32))], names=["k", "doc", "n"])

    return run


def rare_groups(docs: DataFrame, which: DataFrame, join: Join) -> DataFrame:
    """(g, pivot, doc, excess) for the documents of which: those that share one of their rarest shingles.

    Ordered by how many of these documents have them, of two linked sets each
    has one of the other's shingles among its first d + 1, d being the largest
    symmetric difference; the rarer of the first common ones is in both
    beginnings.  All before the first common one differs; excess is how much of
    that a document has beyond its part of what may differ, times 100 + percent,
    so that it is an integer and exact.  A passage that many share is common, and brings a group only to those that have little else,
    whose excesses then tell most of them apart.
    """
    each = stored(restricted(docs, which, ["doc_id"]).mapInArrow(_emit_shingles(join), "k long, doc long, n int").distinct(), "shingles")
    # counts are tables of their own, so that a join with a common shingle's rows can be broadcast or split
    df = small(stored(each.groupBy("k").agg(F.count("*").alias("df")).filter("df > 1"), "shingle-counts"))
    most = F.floor(F.lit(100 - join.percent) * (F.col("n") + F.floor(F.col("n") * 100 / join.percent)) / (100 + join.percent)) + 1
    # shingles of one document come first and bring no group; they only take places
    counted = each.join(df, "k", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    first = counted.withColumn("r", F.row_number().over(W.partitionBy("doc").orderBy("df", "k"))).filter(F.col("r") <= most).filter("df > 1")
    first = first.select("k", "doc", ((F.col("r").cast("long") - 1) * (100 + join.percent) - F.col("n").cast("long") * (100 - join.percent)).alias("excess"))
    first = stored(first, "rarest")
    of = first.groupBy("k").agg(F.count("*").alias("size"), F.min("doc").alias("pivot"), F.expr("bit_xor(xxhash64(doc))").alias("g")).filter("size > 1")
    shared = first.join(small(stored(of, "rare-groups")), "k")
    return shared.groupBy("g", "pivot", "doc").agg(F.min("excess").alias("excess"))


def _unlike(join: Join) -> Callable:
    """Keeps the pairs that size and sketches allow."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            most = join.differ(na, nb)
            keep = 100 * np.minimum(na, nb) >= join.percent * np.maximum(na, nb)
            for i in np.flatnonzero(keep):
                keep[i] = hamming(batch.column("bits_a")[i].as_py(), batch.column("bits_b")[i].as_py()) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(join: Join) -> Callable:
    """Keeps the pairs whose sets link."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text_a", "text_b")):
            _, x, xs = shingles(batch.column("text_a"), join.words)
            _, y, ys = shingles(batch.column("text_b"), join.words)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                p, q = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= join.percent * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _across(join: Join) -> Callable:
    """(a, b): of one block of a group those outside its largest component, with those of another block that sizes, sketches and excesses allow."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, label, n, excess = (table.column(c).to_numpy() for c in ("rep", "label", "n", "excess"))
        bits = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        shortest = min(map(len, bits))
        bits = np.array([np.bitwise_xor.reduce(x.reshape(-1, shortest), axis=0) for x in bits])  # folded to one length
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple] = []
        for lo in range(0, len(x), 32):
            p = x[lo : lo + 32, None]
            may = (label[p] != label[y]) & (excess[p] + excess[y] <= 0) & (100 * np.minimum(n[p], n[y]) >= join.percent * np.maximum(n[p], n[y]))
            i, j = np.nonzero(may)
            far = np.bitwise_count(bits[x[lo + i]] ^ bits[y[j]]).sum(axis=1) if len(i) else np.empty(0, int)
            near = far <= join.differ(n[x[lo + i]], n[y[j]])
            found.append((rep[x[lo + i[near]]], rep[y[j[near]]]))
        one, two = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})

    return run


def across(rows: DataFrame, sketches: DataFrame, join: Join) -> DataFrame:
    """(a, b): pairs of a group's members in different components that may link; rows (g, rep, label, excess).

    One of such a pair is outside the group's largest component.  Sets of a
    group are dealt into bands of sizes, so wide that linked sets are in the
    same band or in neighbouring ones, and bands into blocks of about BLOCK.
    Blocks of the outside meet the blocks of these three bands, so that a task
    holds two blocks and gives what the sketches leave.  What is joined by group
    has a row for each group or band and is broadcast when small.
    """
    width = 1.0001 * log(100 / join.percent)
    own = rows.join(sketches.select(F.col("doc_id").alias("rep"), "n", "bits"), "rep").withColumn("band", F.floor(F.log("n") / width).cast("int"))
    own = stored(own, "open-sets")
    labels = own.groupBy("g", "label").agg(F.count("*").alias("k"), F.min("excess").alias("e"))
    majors = stored(labels.groupBy("g").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.min("e").alias("least")), "majors")
    bands = stored(own.groupBy("g", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "bands")
    own = own.join(small(bands), ["g", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    columns = ("rep", "label", "n", "excess", "bits")
    outside = own.join(small(majors), "g").filter("label <> major and excess + least <= 0")
    reached = outside.withColumn("tb", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    left = reached.join(small(bands.select("g", F.col("band").alias("tb"), F.col("blocks").alias("tblocks"))), ["g", "tb"])
    left = left.select("g", F.col("band").alias("sb"), F.col("block").alias("s"), "tb", F.explode(F.sequence(F.lit(0), F.col("tblocks") - 1)).alias("t"), F.lit(0).alias("side"), *columns)
    met = stored(reached.select("g", F.col("band").alias("sb"), F.col("block").alias("s"), F.col("tb").alias("band")).distinct(), "met")
    right = own.join(small(met), ["g", "band"]).select("g", "sb", "s", F.col("band").alias("tb"), F.col("block").alias("t"), F.lit(1).alias("side"), *columns)
    return left.unionByName(right).groupBy("g", "sb", "s", "tb", "t").applyInArrow(_across(join), "a long, b long").distinct()


def linked(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that link: first by sketches (doc_id, n, bits), then by whole texts."""
    sized = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
    sized = sized.join(sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
    return verified(sized.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_unlike(join), "a long, b long").distinct(), docs, join)


def verified(pairs: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose whole texts link; of docs only the texts of these pairs are moved."""
    maybe = stored(pairs, "pairs")
    ids = maybe.select(F.col("a").alias("doc_id")).union(maybe.select("b"))
    texts = restricted(docs, ids, ["doc_id"])
    both = maybe.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(join), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the smallest node that it reaches, by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while not _is_stars(edges):
        near = edges.union(edges.select("v", "u"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small_, "stars")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select("v", "v").distinct())


def _is_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def joined(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(docs.mapInArrow(_emit_sets(join), "doc_id long, n long, sig1 long, sig2 long, bits binary"), "sets")
    reps = sets.filter("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("rep"))
    members = stored(sets.select("doc_id", "n", "sig1", "sig2").join(reps, ["n", "sig1", "sig2"], "left").select("doc_id", "n", "rep"), "members")
    sketches = stored(sets.select("doc_id", "n", "bits").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct(), "sketches")
    # rows of one id are one document, which stands for the smallest of its classes and links them
    classes = members.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    classes = stored(classes, "classes")
    same = members.join(classes.filter("rep <> other").select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    groups = stored(_of_classes(chunk_groups(docs, join), classes), "groups")
    links = stored(linked(groups.select(F.least("first", "rep").alias("a"), F.greatest("first", "rep").alias("b")).filter("a <> b").distinct(), docs, sketches, join).union(same), "links")
    labels = components(links)
    # a chunk of two classes is settled by their one pair
    open_ = groups.select("g", "rep", "excess").join(small(groups.groupBy("g").agg(F.count_distinct("rep").alias("n")).filter("n > 2").select("g")), "g")
    labelled = open_.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("g", "rep", "excess", F.coalesce("component", "rep").alias("label"))
    labelled = stored(labelled, "labelled")
    apart = labelled.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("g")
    rows = stored(labelled.join(small(apart), "g"), "open")
    found = stored(verified(across(rows, sketches, join), docs, join), "more-links")
    if not found.isEmpty():
        labels = components(links.union(found))
    out = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _of_classes(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, first, rep, excess): groups (g, pivot, doc, excess) with their classes in place of documents, without groups of one class."""
    of = classes.select(F.col("doc_id").alias("doc"), "rep")
    rows = groups.join(of, "doc").join(of.select(F.col("doc").alias("pivot"), F.col("rep").alias("first")), "pivot").groupBy("g", "first", "rep").agg(F.min("excess").alias("excess"))
    rows = stored(rows, "class-groups")
    return rows.join(small(rows.filter("first <> rep").select("g").distinct()), "g", "left_semi")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir).select("doc_id", "text"), Join(words=4, percent=85))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of documents with five-word shingles at a similarity of 0.8 or more, linked directly or through others, the one with the smallest id stays.

    Rows without an id stay.  Rows that share an id but not the text are
    documents of their own; of linked ones that with the smallest id, then the
    smallest hash of id and text stays, and of rows equal in both the first by
    their other columns, written as JSON.
    """
    join = Join(words=5, percent=80)
    n = docs.agg(F.count("doc_id").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        of = joined(docs.select("doc_id", "text"), join)
        gone = of.filter("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    rows = sealed(docs, keep_text=True)
    named = rows.filter(F.col("_id") != NO_ID)
    of = joined(named.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text")).distinct(), join).select(F.col("doc_id").alias("_key"), "component_id")
    first = named.select("_id", "_key").distinct().join(of, "_key").groupBy("component_id").agg(F.min(F.struct("_id", "_key")).alias("x")).select("x.*")
    kept = named.join(small(first), ["_id", "_key"], "left_semi")
    kept = kept.withColumn("_rank", F.row_number().over(W.partitionBy("_id", "_key").orderBy(F.to_json("_box")))).filter("_rank = 1").drop("_rank")
    return unboxed(kept.unionByName(rows.filter(F.col("_id") == NO_ID)), docs.columns)


def oracle_components(source: str, words: int, percent: int) -> str:
    """DuckDB CTEs of a WITH RECURSIVE: sizes (doc_id, n) and component (doc_id, component_id) of the table source with unique ids."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    ws AS (SELECT doc_id, list_filter(string_split_regex({lowered}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i+1:i+{words}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {words}, 0) + 1)) AS i FROM ws WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT x, y FROM both_ JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM {source} UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON r.other = l.x),
    component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)"""


ORACLE = f"""WITH RECURSIVE {oracle_components('documents', 4, 85)}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN component USING (doc_id)"""
