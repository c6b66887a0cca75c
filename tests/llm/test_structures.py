"""Periodic runs, SimHash near duplicates and Merkle manifests against brute force, and their odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import merkle, packing, periods, simhash
from tesserae.llm.ngram_join import joined
from tesserae.llm.substrings import deduplicated
from tesserae.llm.wordhash import Places, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, _box string, n_words string, fp string, tree string, leaf string"
OWN = ("a", "b", "c", "d", "e", "f")


def thue_morse(k: int) -> tuple[str, str]:
    """A word over two letters of 2^k characters, and the one with the letters exchanged."""
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def odd_texts() -> list[tuple]:
    rng = random.Random(7)
    words = ["the", "River", "ßx", "été", "a", "of", "x1", "don't"]
    base = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(120))
    looped = "x y " + "one two three " * 12 + "one end"
    texts = [None, "", " \n\t", "one", "one two three", base, base, base.replace(base.split()[60], "changed", 1), looped, "a " * 30, "y" * 1_500_000, ("b c\n" * 40_000), base.upper(), *thue_morse(11)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, base), (None, None), (None, None), (-5, looped)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if k % 4 == 0 else "" if k % 4 == 1 else "en", "s" if k % 3 else None, len(t) if t else None, *OWN) for k, (i, t) in enumerate(odd_texts())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- words -----------------------------------------------------------------------------------------------------------


def test_words_that_defeat_polynomials_have_hashes_of_their_own(spark):
    words = [w for k in range(9, 14) for w in thue_morse(k)]
    assert len(set(Words(pa.array(words)).hash.tolist())) == len(words)
    a, b = thue_morse(11)
    memory = packing.memory(packing.tokenizer_path())
    starts, ids = memory.ids(pa.array([a, b, f"{a} {b}"]))
    for k, text in enumerate((a, b, f"{a} {b}")):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*memory.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
    rest = " ".join(f"w{k}" for k in range(3))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in joined(docs).collect()} == {1: 1, 2: 2}
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert [r["n_removed"] for r in deduplicated(docs).collect()] == [0, 0]


def test_places_and_numbers_of_words():
    texts = ["a b\ta", "", "é  é", "x" * 3_000_000 + " y", " "]
    places = Places(pa.array(texts))
    number, distinct = places.numbered()
    assert [distinct[int(k)].as_py().decode() for k in number] == [w for t in texts for w in t.split()]
    assert places.joined(np.arange(3)) == b"a b a " and places.count.tolist() == [3, 0, 2, 2, 0]


# --- periodic runs ---------------------------------------------------------------------------------------------------


def all_runs(w: list, least: int, times: int) -> list[tuple]:
    out, n = set(), len(w)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(least, times * q) and not any(all(w[k] == w[k - r] for k in range(s + r, s + length)) for r in range(1, q)):
                out.add((s, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        rows = []
        for _ in range(rng.randrange(1, 4)):
            w: list[int] = []
            for _ in range(rng.randrange(6)):
                u = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 12))]
                w += u * rng.randrange(1, 9) + u[: rng.randrange(len(u) + 1)]
            rows.append(w)
        least = rng.choice([24, 6, 1])
        names, row = np.array([x for w in rows for x in w], np.int64), np.array([k for k, w in enumerate(rows) for _ in w], np.int64)
        got = list(zip(*(x.tolist() for x in periods.find_runs(names, row, len(rows), least, 3))))
        firsts = np.cumsum([0] + [len(w) for w in rows])
        assert got == [(s + int(firsts[k]), n, q) for k, w in enumerate(rows) for s, n, q in all_runs(w, least, 3)]


def test_runs_of_a_million_equal_words_and_of_fibonacci_words():
    assert [x.tolist() for x in periods.find_runs(np.zeros(10**6, np.int64), np.zeros(10**6, np.int64), 1)] == [[0], [10**6], [1]]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    got = periods.find_runs(np.array(b), np.zeros(len(b), np.int64), 1)
    assert list(zip(*(x.tolist() for x in got))) == all_runs(b, 24, 3)


def test_runs_of_odd_rows(odd, none):
    got = periods.with_runs(odd).collect()
    assert len(got) == len(odd_texts()) and periods.with_runs(none).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [tuple(r) for r in by[-5]["runs"]] == [(2, 37, 3)] and by[-5]["collapsed"] == "x y one two three end" and by[-5]["_box"] == "b"
    assert by[0]["n_words"] == 0 and by[0]["collapsed"] == "" and by[10]["collapsed"] == "y" * 1_500_000
    assert [tuple(r) for r in by[11]["runs"]] == [(0, 80_000, 2)] and by[11]["collapsed"] == "b c"
    with pytest.raises(ValueError, match="three periods"):
        periods.with_runs(odd, least_periods=2)


def test_looped_texts_and_the_strongest_run(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i in range(200) for n in (0, 1, 57)] + [(i, None) for i in range(40)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", periods.looped(F.col("text"), F.col("doc_id")).alias("new")).collect()
    for r in got:
        h, w = zlib.crc32(str(r["doc_id"]).encode()), (r["text"] or "").split()
        g, n = h // 10, len(w)
        if h % 10 or not n:
            assert r["new"] == r["text"]
        else:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r["new"].split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(0, 24, 7), (5, 30, 10), (40, 24, 7), (50, 10**9, 10**8)]
    best = spark.createDataFrame([(runs,), ([],)], f"r {periods.RUNS}").select(periods.strongest(F.col("r")).alias("x")).collect()
    assert tuple(best[0]["x"]) == max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0])) and best[1]["x"] is None


# --- near duplicates -------------------------------------------------------------------------------------------------


def simhash_of(text: str | None) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels_of(fps: list[int], threshold: int = 4) -> dict[int, int]:
    values = np.array(sorted(set(fps)), np.uint64)
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values) <= threshold
    while True:
        new = np.where(near, label, len(values)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return dict(zip(values.tolist(), label.tolist()))
        label = new


def test_fingerprints_are_those_of_brute_force():
    texts = [t for _, t in odd_texts() if not t or len(t) < 200_000]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [simhash_of(t) for t in texts]


def test_codes_are_perfect_and_every_pair_within_the_threshold_shares_an_anchor():
    rng = np.random.default_rng(1)
    for k in (1, 2, 4):
        x = rng.integers(0, 2**64, 500, dtype=np.uint64)
        y = x.copy()
        for _ in range(4):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
        of_x, of_y = ({i: set(a[o == i].tolist()) for i in range(len(x))} for o, a in (simhash.anchors(v, simhash.PRODUCT[:k]) for v in (x, y)))
        assert all(of_x[i] & of_y[i] for i in range(len(x)))
    with pytest.raises(ValueError, match="not perfect"):
        simhash.PerfectCode(7, 0b1011, 2, 1)
    assert [len(simhash.codes_for(n)) for n in (10, 10**5, 10**9)] == [1, 2, 4]


@pytest.mark.parametrize("group", [512, 20])
def test_components_of_a_dense_ball_and_of_single_fingerprints(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rng = np.random.default_rng(group)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    values = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for c in centre for _ in range(500)] + rng.integers(0, 2**64, 500, dtype=np.uint64).tolist()
    values = sorted(set(values))
    if group == 20:  # in this process, since the workers have the module's own value
        comparison = simhash._Comparison(4)
        monkeypatch.setattr(simhash, "GROUP", group)
        own, anchor = simhash.anchors(np.array(values, np.uint64), simhash.PRODUCT[:1])
        order = np.lexsort((own, anchor))
        anchor, fp, at, links, large = anchor[order], np.array(values, np.uint64)[own[order]], 0, [], []
        step = 37
        held = 0
        while at < len(anchor):
            hi = min(at + step, len(anchor))
            held = comparison.add(anchor[at - held : hi], fp[at - held : hi], hi == len(anchor))
            at = hi
        for is_large, a, b in comparison.out:
            (large if is_large else links).extend(zip(a.tolist(), b.tolist()))
        exact = labels_of(values)
        assert all(exact[a] == exact[b] for a, b in links) and links and large
        sizes = dict(zip(*np.unique(anchor, return_counts=True)))
        assert sorted(large) == sorted((int(a), int(f)) for a, f in zip(anchor, fp) if sizes[a] > group)
        return
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    got = {r["node"] % 2**64: r["component"] for r in simhash.near_fingerprints(spark.createDataFrame(signed, "fp long").repartition(3)).collect()}
    groups: dict[int, set] = {}
    for v, k in labels_of(values).items():
        groups.setdefault(k, set()).add(got.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


def test_links_across_blocks_of_a_large_anchor(spark):
    values = [1 << 40, (1 << 40) | 0b111, (1 << 40) | 0b1111111, 0b111 << 50]
    rows = spark.createDataFrame([(9, v, k) for k, v in enumerate(values)] + [(8, 1, 1), (8, 3, 1)], "anchor long, fp long, label long")
    found = {frozenset((r["a"], r["b"])) for r in simhash.across(rows, 4).collect()}
    exact = {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}
    assert found and found <= exact


def test_near_duplicates_of_odd_rows(odd, none):
    assert simhash.near_duplicates(none).count() == 0
    rows = simhash.near_duplicates(odd).collect()
    texts = odd_texts()
    assert len(rows) == len(texts) and sorted(r["fp"] % 2**64 for r in rows) == sorted(simhash_of(t) for _, t in texts)
    label, least = labels_of([simhash_of(t) for _, t in texts]), {}
    for i, t in texts:
        if i is not None:
            k = label[simhash_of(t)]
            least[k] = min(i, least.get(k, i))
    assert all(r["component_id"] == least.get(label[r["fp"] % 2**64]) for r in rows)


def test_a_component_without_ids_has_none(spark):
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "quite another text here")], "doc_id long, text string")).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["4", "None", "None"]


# --- Merkle manifest -------------------------------------------------------------------------------------------------


def sha(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree_of(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf (side, sibling) from the leaf up; ('', '') where there is none."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append(("L" if i & 1 else "R", level[j]) if j < len(level) else ("", ""))
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i >> 1 for i in at]
    return level[0], paths


def digest_of(row: tuple) -> str:
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest_of(rows: list[tuple]) -> list[tuple]:
    """rows (doc_id, source, lang, n_chars, text)."""
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest_of(r)))
        built[x] = tree_of([digest_of(r) for r in trees[x]])
    root, upper = tree_of([built[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, path in zip(trees[x], built[x][1]):
            path = path + upper[k]
            own = node = digest_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = digest_of((*r[:3], r[3] + 1, r[4]))
            for side, other in path:
                node = sha(other, node) if side == "L" else sha(node, other)
            out.append((r[0], own, built[x][0], root, sha(*(s for _, s in path)), node, node == root))
    return out


def key(rows: list) -> list:
    return sorted(map(repr, map(tuple, rows)))


def proofs_of(spark, rows: list[tuple], height: int) -> list:
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    columns = [F.col(c) for c in merkle.COLUMNS]
    tampered = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 0
    claimed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return merkle.Manifest(docs.select(tree.alias("tree"), "doc_id", merkle.leaf(*columns).alias("leaf"), F.when(tampered, merkle.leaf(*claimed)).alias("claimed")), height).proofs().collect()


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_manifest_of_many_tiers(spark, height):
    rng = random.Random(height)
    langs = ["en"] * 40 + ["de"] * 16 + ["fr", "", None, "é", "zz"]
    rows = [(i - 5, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 3, 12]), f"text {i}") for i in range(90)]
    assert key(proofs_of(spark, rows, height)) == key(manifest_of(rows))


def test_manifest_of_one_row_and_of_one_tree(spark):
    for rows in ([(1, None, None, None, None)], [(i, "s", "en", 1, "t") for i in range(5)]):
        assert key(proofs_of(spark, rows, 2)) == key(manifest_of(rows))


def test_manifest_of_odd_rows(spark, odd, none, tmp_path):
    none.select(*merkle.COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op13_merkle(spark, f"{tmp_path}/none").count() == 0
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = [tuple(r) for r in odd.select(*merkle.COLUMNS).collect()]
    assert key(merkle.op13_merkle(spark, f"{tmp_path}/odd").collect()) == key(manifest_of(rows))


def test_addresses_keep_subtrees_together():
    for height in range(8):
        order = merkle.veb_order(height)
        assert sorted(order.tolist()) == list(range(len(order))) and order[0] == 0
    # a tree of four levels: the upper two first, then the four trees below, three nodes each
    assert merkle.veb_order(3).tolist() == [0, 1, 2, 3, 6, 9, 12, 4, 5, 7, 8, 10, 11, 13, 14]
    leaves = np.frombuffer(bytes(range(5 * 32)), np.uint8).reshape(5, 32)
    nodes = merkle.build_block(leaves, 3)
    assert nodes[0].tobytes().hex() == tree_of([x.tobytes().hex() for x in leaves])[0]


# --- pages that are hostile to parsers -------------------------------------------------------------------------------


def test_stray_quotes_are_read_in_linear_time():
    import itertools
    import time

    from tesserae.llm.htmltext import flat_blocks

    pieces = ['<b ="', ">", '="', "'", '"', "<b ='", ' =">', "<p>", '<a href="x']
    began = time.process_time()
    for n in (2, 3):
        for mix in itertools.product(pieces, repeat=n):
            unit = "".join(mix)
            flat_blocks(unit * (20_000 // len(unit)))
    flat_blocks('<b ="> =" ' * 100_000)
    assert time.process_time() - began < 60
    # what is outside quotes ends a tag; where no such end exists, the first one does
    assert [b["text"] for b in flat_blocks('<p class="a>b">x</p><i title=">y')] == ["x", "y"]
