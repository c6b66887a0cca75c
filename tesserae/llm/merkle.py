"""Merkle manifest of a dataset: trees whose nodes are stored in van Emde Boas order.

The leaves of each partition (here a language), in the order of their ids, are
hashed in twos up to one subroot, and the subroots, in the order of the partitions,
up to the root.  A tree is cut into aligned blocks of 2^HEIGHT leaves.  A block is
stored as one row: the digests of its nodes in van Emde Boas order, in which
the upper half of the levels comes first and then, one after the other, the trees below it,
each of them ordered in the same way.  A path from a leaf upwards thus touches
few pieces of memory whatever their size.  The place of a node follows from its
depth and number by arithmetic alone (address); building a block and reading siblings
both use it.  The roots of blocks are the leaves of the next tier of blocks,
until one is left; so a tier has 2^HEIGHT times fewer rows than the one below.

Leaves are put in order by a range partitioning; their numbers are the place in the
partition plus the number of rows before it, so no partition, however many
rows it has, is in one task.  A proof is what a leaf's own block gives and what
the block's root has been given by the tier above.

Nulls and odd cases: a null partition is one of its own, first in order, and
not the empty string.  A null id comes before all others; rows of one id
are in the order of their leaves' digests, and equal rows are leaves of their own.  A null column is
hashed as '-'.  A row whose id is null is not tampered with.  An empty table has no
tree and gives no rows.  Texts of any length are hashed whole.  Columns beyond the
hashed ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.storage import documents, small, stored
from tesserae.llm.textsql import oracle_crc32
from tesserae.llm.wordhash import released

#: Levels of a block, whose leaves are 2^HEIGHT.
HEIGHT = 10
DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


# --- van Emde Boas order ---------------------------------------------------------------------------------------------


@cache
def veb_order(height: int) -> np.ndarray:
    """Addresses of the nodes of a complete tree with so many levels below its root, node k of depth d at index 2^d - 1 + k."""
    if height == 0:
        return np.zeros(1, np.int64)
    top = (height - 1) // 2  # levels below the root in the upper half
    bottom = height - 1 - top
    upper, lower = veb_order(top), veb_order(bottom)
    out = np.empty((2 << height) - 1, np.int64)
    out[: len(upper)] = upper
    trees = 1 << (top + 1)
    for d in range(bottom + 1):
        at = lower[(1 << d) - 1 : (2 << d) - 1]
        depth = top + 1 + d
        out[(1 << depth) - 1 : (2 << depth) - 1] = (len(upper) + np.arange(trees)[:, None] * len(lower) + at).ravel()
    return out


def address(height: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Where nodes of a depth stand in a block of so many levels below its root."""
    return veb_order(height)[(1 << depth) - 1 + number]


def hashed_pairs(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of every two successive ones as hexadecimal text; a last one alone is hashed alone."""
    text = digests.tobytes().hex().encode()
    step = 4 * DIGEST
    out = b"".join(hashlib.sha256(text[k : k + step]).digest() for k in range(0, len(text), step))
    return np.frombuffer(out, np.uint8).reshape(-1, DIGEST)


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """The nodes over leaves (n x 32 bytes, at most 2^height) in van Emde Boas order; places without a node are zero."""
    nodes = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[address(height, depth, np.arange(len(level)))] = level
        if depth:
            level = hashed_pairs(level)
    return nodes


def siblings(nodes: np.ndarray, height: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, leaves first, whether each of n leaves' nodes has a sibling, and the siblings' digests (n x 32 bytes)."""
    out, width = [], n
    for up in range(height):
        other = (np.arange(n) >> up) ^ 1
        out.append((other < width, nodes[address(height, height - up, other)]))
        width = (width + 1) // 2
    return out


# --- tiers of blocks -------------------------------------------------------------------------------------------------

LEAVES = "tree string, i long, n long, digest binary"
BLOCKS = "tree string, block long, n long, levels int, nodes binary, root binary, rows array<binary>"


def _levels(n: int) -> int:
    """Levels above n nodes until one is left."""
    return (n - 1).bit_length()


def _build(height: int, payload: bool) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            keys = pc.binary_join_element_wise(table.column("tree").cast(pa.string()), table.column("block").cast(pa.string()), "\n").to_pylist()
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:-1]):
                yield _block(table.slice(lo, hi - lo), height, payload)
            held = table.slice(cuts[-2]).combine_chunks()
        if held is not None and held.num_rows:
            yield _block(held, height, payload)

    return run


def _block(rows: pa.Table, height: int, payload: bool) -> pa.RecordBatch:
    n = rows.column("n")[0].as_py()
    levels = min(height, _levels(n))
    leaves = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
    nodes = build_block(leaves, levels)
    kept = [rows.column("payload").to_pylist()] if payload else [None]
    return pa.RecordBatch.from_arrays(
        [pa.array([rows.column("tree")[0].as_py()]), pa.array([rows.column("block")[0].as_py()]), pa.array([len(leaves)]), pa.array([levels], pa.int32()), pa.array([nodes.tobytes()], pa.binary()), pa.array([nodes[0].tobytes()], pa.binary()), pa.array(kept, pa.list_(pa.binary()))],
        names=["tree", "block", "n", "levels", "nodes", "root", "rows"],
    )


def tier(leaves: DataFrame, name: str, height: int = HEIGHT) -> DataFrame:
    """BLOCKS over leaves (LEAVES and, for the lowest tier, payload): all blocks of 2^height successive leaves of each tree."""
    payload = "payload" in leaves.columns
    dealt = leaves.withColumn("block", F.shiftright("i", height)).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return stored(dealt.mapInArrow(_build(height, payload), BLOCKS), name)


def tiers(leaves: DataFrame, name: str, height: int = HEIGHT) -> list[DataFrame]:
    """The blocks over leaves, tier by tier, until every tree has one root."""
    out = [tier(leaves, f"{name}-0", height)]
    sizes = leaves.groupBy("tree").agg(F.first("n").alias("n"))
    while True:
        sizes = stored(sizes.select("tree", F.shiftright(F.col("n") + (1 << height) - 1, height).alias("n")).filter("n > 1"), f"{name}-sizes")
        if sizes.isEmpty():
            return out
        above = out[-1].select("tree", F.col("block").alias("i"), F.col("root").alias("digest")).join(small(sizes), "tree").select("tree", "i", "n", "digest")
        out.append(tier(above, f"{name}-{len(out)}", height))


def roots(of: list[DataFrame]) -> DataFrame:
    """(tree, digest): the root of each tree, in the highest tier that the tree has."""
    firsts = [blocks.filter("block = 0").select("tree", F.lit(k).alias("tier"), "root") for k, blocks in enumerate(of)]
    return reduce(DataFrame.unionByName, firsts).groupBy("tree").agg(F.max_by("root", "tier").alias("digest"))


PATH = "steps string, path binary"


def _upper_paths(height: int) -> Callable:
    """(tree, i, steps, path) of each leaf of blocks that carry the path of their own root."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                steps, paths = _paths(row)
                first = row["block"] << height
                n = row["n"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(steps), pa.array(paths, pa.binary())], names=["tree", "i", "steps", "path"]
                )

    return run


def _paths(row: dict) -> tuple[list[str], list[bytes]]:
    """Of each leaf of a block the steps up to the root and the digests of the siblings on the way.

    A step is L (the sibling is on the left), R (on the right) or - (none).
    """
    n, levels = row["n"], row["levels"]
    nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
    found = siblings(nodes, levels, n)
    letters = np.empty((n, levels), "U1")
    for up, (has, _) in enumerate(found):
        letters[:, up] = np.where(has, np.where((np.arange(n) >> up) & 1, "L", "R"), "-")
    digests = [d.tobytes() for _, d in found]
    above_steps, above = row["steps"] or "", row["path"] or b""
    steps = ["".join(x) + above_steps for x in letters.tolist()]
    has = [h.tolist() for h, _ in found]
    paths = [b"".join(digests[u][k * DIGEST : (k + 1) * DIGEST] for u in range(levels) if has[u][k]) + above for k in range(n)]
    return steps, paths


def with_paths(of: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest tier's blocks, each with the steps and the path of its root; above has those of the trees' roots (tree, PATH)."""
    below = None
    for k in range(len(of) - 1, -1, -1):
        if below is None:
            blocks = of[k].join(small(above), "tree")
        else:  # a tree may end in this tier, and then its root has the path from above
            tops = above.withColumnsRenamed({"steps": "top_steps", "path": "top_path"})
            blocks = of[k].join(small(tops), "tree").join(small(below), ["tree", "block"], "left")
            blocks = blocks.withColumns({"steps": F.coalesce("steps", "top_steps"), "path": F.coalesce("path", "top_path")}).drop("top_steps", "top_path")
        if k:
            paths = blocks.drop("rows").mapInArrow(_upper_paths(height), "tree string, i long, steps string, path binary")
            below = stored(paths.withColumnRenamed("i", "block"), f"paths-{k}")
    return blocks


# --- leaves in order -------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree with their place in the partition's rows of that tree."""
    tree, done = None, 0
    for batch in batches:
        trees = batch.column("tree").to_pylist()
        place = []
        for t in trees:
            if t != tree:
                tree, done = t, 0
            place.append(done)
            done += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (with a column tree) with i, their number in their tree by order, from 0, and n, the rows of the tree.

    Rows are range-partitioned, so that large trees take many partitions, which are
    counted; the window over these counts has a row for each partition and tree.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stored(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_counted, f"{schema}, part int, place long"), name)
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    by_tree = W.partitionBy("tree")
    before = counts.select("tree", "part", (F.sum("rows").over(by_tree.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(by_tree).alias("n"))
    return placed.join(small(stored(before, f"{name}-counts")), ["tree", "part"]).withColumn("i", F.col("before") + F.col("place")).drop("part", "place", "before")


def field(c: Column) -> Column:
    """A value with its length in bytes before it; '-' for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The SHA-256 of the fields of columns."""
    return F.unhex(F.sha2(F.concat(*(field(c) for c in columns)), 256))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks with their proofs, and the roots that their claimed leaves lead to."""
    sha = hashlib.sha256
    for batch in batches:
        for row in batch.to_pylist():
            steps, paths = _paths(row)
            out = []
            leaves = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)[address(row["levels"], row["levels"], np.arange(row["n"]))]
            for k_row, (payload, step, path) in enumerate(zip(row["rows"], steps, paths)):
                doc = int.from_bytes(payload[1:9], "big", signed=True) if payload[0] else None
                own = leaves[k_row].tobytes()
                claimed = payload[9:] or own
                text = path.hex()
                node, k = claimed.hex(), 0
                for s in step:
                    if s == "-":
                        node = sha(node.encode()).hexdigest()
                        continue
                    other = text[k : k + 2 * DIGEST]
                    k += 2 * DIGEST
                    node = sha((other + node if s == "L" else node + other).encode()).hexdigest()
                out.append((doc, own.hex(), row["subroot"].hex(), row["top"].hex(), sha(text.encode()).hexdigest(), node, node == row["top"].hex()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64(), *[pa.string()] * 5, pa.bool_()])], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Manifest:
    """The trees over rows (tree, doc_id, leaf, claimed): one for each value of tree and one over their roots.

    leaf and claimed are digests; claimed is what is held against the manifest, null for the leaf itself.
    blocks and top have the stored tiers, subroots (tree, digest) the roots of the trees, root the one over all (None without rows).
    """

    def __init__(self, rows: DataFrame, height: int = HEIGHT) -> None:
        self.height = height
        first = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")
        placed = in_order(first, ["doc_id", "leaf", "uid"], "ordered")
        id_bytes = F.concat(F.when(F.col("doc_id").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), F.unhex(F.lpad(F.hex(F.coalesce("doc_id", F.lit(0).cast("long"))), 16, "0")))
        leaves = placed.select("tree", "i", "n", F.col("leaf").alias("digest"), F.concat(id_bytes, F.coalesce("claimed", F.lit(b""))).alias("payload"))
        self.blocks = tiers(leaves, "blocks", height)
        self.subroots = stored(roots(self.blocks), "subroots")
        ordered = in_order(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"], "ordered-roots")
        self.keys = stored(ordered, "keys")
        self.top = tiers(self.keys.select("tree", "i", "n", "digest"), "top", height)
        found = roots(self.top).first()
        self.root = bytes(found["digest"]) if found else None

    def proofs(self) -> DataFrame:
        """OUT: each row's digests, the hash of its proof, and the root that its claimed leaf and the proof lead to."""
        lit = F.lit(None).cast("string"), F.lit(None).cast("binary")
        alone = self.top[0].select("tree").distinct().select("tree", lit[0].alias("steps"), lit[1].alias("path"))
        upper = with_paths(self.top, alone, self.height).drop("rows").mapInArrow(_upper_paths(self.height), "tree string, i long, steps string, path binary")
        above = self.keys.select("i", "key", F.col("digest").alias("subroot")).join(upper.select("i", "steps", "path"), "i")
        above = stored(above.select(F.col("key").alias("tree"), "subroot", "steps", "path"), "upper-paths")
        blocks = with_paths(self.blocks, above.select("tree", "steps", "path"), self.height)
        blocks = blocks.join(small(above.select("tree", "subroot")), "tree").withColumn("top", F.lit(self.root).cast("binary"))
        return blocks.select("n", "levels", "nodes", "rows", "steps", "path", "subroot", "top").mapInArrow(_verified, OUT)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; every seventh id (by its CRC-32) claims one character more than it has."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 0
    columns = {c: F.col(c) for c in COLUMNS}
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf(*columns.values()).alias("leaf"), F.when(tampered, leaf(*(columns | {"n_chars": F.col("n_chars") + 1}).values())).alias("claimed"))
    return Manifest(rows).proofs()


ORACLE = f"""WITH RECURSIVE {oracle_crc32('crc_of', 'documents', 'doc_id')},
src AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) - 1 AS i, d.*, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS claimed_chars FROM documents d LEFT JOIN crc_of c ON c.doc_id = d.doc_id),
leaves AS (SELECT row_number() OVER () AS rid, coalesce('=' || lang, '') AS tree, i, doc_id, sha256(concat({{0}}, {{1}}, {{2}}, {{3}}, {{4}})) AS leaf, sha256(concat({{0}}, {{1}}, {{2}}, {{5}}, {{4}})) AS claimed FROM src),
lower_tree(tree, level, i, d) AS (SELECT tree, 0, i, leaf FROM leaves UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM lower_tree) WHERE c > 1 GROUP BY tree, level, i // 2),
subroots AS (SELECT tree, d, level, row_number() OVER (ORDER BY tree) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY level DESC) AS r FROM lower_tree) WHERE r = 1),
upper_tree(level, i, d) AS (SELECT 0, i, d FROM subroots UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM upper_tree) WHERE c > 1 GROUP BY level, i // 2),
root AS (SELECT d, level FROM upper_tree ORDER BY level DESC LIMIT 1),
path(rid, tree, level, i, node, sib) AS (SELECT rid, tree, 0, i, claimed, '' FROM leaves UNION ALL
  SELECT p.rid, p.tree, p.level + 1, p.i // 2, CASE WHEN s.d IS NULL THEN sha256(node) WHEN p.i % 2 = 1 THEN sha256(s.d || node) ELSE sha256(node || s.d) END, sib || coalesce(s.d, '')
    FROM path p JOIN subroots m ON m.tree = p.tree LEFT JOIN lower_tree s ON s.tree = p.tree AND s.level = p.level AND s.i = xor(p.i, 1) WHERE p.level < m.level),
upper_path(rid, subroot, level, i, node, sib) AS (SELECT rid, m.d, 0, m.i, node, sib FROM path p JOIN subroots m ON m.tree = p.tree AND m.level = p.level UNION ALL
  SELECT p.rid, p.subroot, p.level + 1, p.i // 2, CASE WHEN s.d IS NULL THEN sha256(node) WHEN p.i % 2 = 1 THEN sha256(s.d || node) ELSE sha256(node || s.d) END, sib || coalesce(s.d, '')
    FROM upper_path p LEFT JOIN upper_tree s ON s.level = p.level AND s.i = xor(p.i, 1) WHERE p.level < (SELECT level FROM root))
SELECT doc_id, leaf, subroot, root.d AS root, sha256(sib) AS proof_sha256, node AS folded_root, node = root.d AS verified
FROM leaves JOIN upper_path p USING (rid), root WHERE p.level = root.level"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
for _k, _c in enumerate((*COLUMNS, "claimed_chars")):
    ORACLE = ORACLE.replace("{" + str(_k) + "}", _FIELD.format(_c))
