"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Each item is cut into windows of consecutive words.  Of each window the rarest
terms by their frequency in the training texts are its anchors.  The index gives
the anchors' positions in the texts; shifted by the anchor's offset in the
window they are window starts, and the lists of a window's anchors are
intersected.  What remains is compared word by word (exact phrases), or reported
by distance (proximity matches).

Nulls and odd cases: a null or empty text or item has no words, hence no windows
and no hits; an item shorter than a window is one window.  Each document row
gives one row, repeated rows too (rows are joined by id and a hash of id and
text), null ids stay null; items with null ids count as the string 'null'.
Other columns keep their values; only the columns that are added take the place
of columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.storage import documents, restricted, sealed, small, stored, unboxed, with_row_key
from tesserae.llm.textsql import ascii_lower, bound, plain_words

WINDOW = 10
#: So many of a window's rarest terms are intersected.
ANCHORS = 2
#: Proximity: anchors may stand so many words further apart, or nearer, than in the window.
SLOP = 5


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, wid, n): each window of each item; wid is the hash of its words."""
    words = F.col("words")
    last = F.greatest(F.size(words) - window, F.lit(0))
    return (
        items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), plain_words(ascii_lower(F.col(text_col))).alias("words"))
        .filter(F.size("words") > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i + 1, F.lit(window)))).alias("words"))
        .select("item", "words", F.xxhash64("words").alias("wid"), F.size("words").alias("n"))
    )


def _loose(text: Column) -> Column:
    """Full lower case, in which the index is kept: words that are equal after A-Z are lowered stay equal, and word borders stay.

    Capital sigma is lowered first, since its lower case depends on what follows.
    """
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def word_lists(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_box, _id, _key, terms): for each row the loosely lowered words of its text in order, stored; what the index and its statistics are made from."""
    return stored(sealed(docs, text_col=text_col).select("_box", "_id", "_key", plain_words(_loose(F.col("_text"))).alias("terms")), "word-lists")


def term_frequencies(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, tf): how often each of the given distinct terms stands in all texts; absent ones have 0."""
    seen = lists.select(F.explode("terms").alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("tf"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("tf", F.lit(0)).alias("tf"))


def anchors(windows: DataFrame, lists: DataFrame, k: int = ANCHORS) -> DataFrame:
    """(term, wid, offset, bit, full): the k rarest places of each window; full has the bits of all its anchors."""
    places = windows.select("wid", "words").dropDuplicates(["wid", "words"]).select("wid", F.posexplode("words").alias("offset", "word")).select("wid", "offset", _loose(F.col("word")).alias("term"))
    tf = term_frequencies(lists, stored(places.select("term").distinct(), "terms"))
    ranked = places.join(tf, "term").withColumn("rank", F.row_number().over(W.partitionBy("wid").orderBy("tf", "offset")))
    ranked = ranked.withColumn("absent", F.min("tf").over(W.partitionBy("wid")) == 0)
    kept = ranked.filter((F.col("rank") <= k) & ~F.col("absent"))
    bit = F.expr("shiftleft(1, rank - 1)")
    return kept.withColumn("bit", bit).withColumn("full", F.sum("bit").over(W.partitionBy("wid")).cast("int")).select("term", "wid", "offset", "bit", "full")


def postings(lists: DataFrame, anchor: DataFrame) -> DataFrame:
    """The positional index, of the anchors' terms: (term, _id, _key, pos)."""
    terms = small(anchor.select("term").distinct())
    return lists.select("_id", "_key", F.posexplode("terms").alias("pos", "term")).join(terms, "term").select("term", "_id", "_key", "pos")


def met(index: DataFrame, anchor: DataFrame, slop: int) -> DataFrame:
    """(_id, _key, wid, starts, near): the posting lists of a window's anchors, shifted by their offsets, intersected.

    starts are the places where all anchors stand as they do in the window.
    near tells whether two anchors stand at most slop further apart than in it,
    or nearer: the closest hits of two anchors are neighbours in their order.
    A document has at most one hit for each anchor and word of it; those of
    repeated rows are next to each other.
    """
    hits = index.join(small(anchor), "term").select("_id", "_key", "wid", "full", F.struct((F.col("pos") - F.col("offset")).alias("start"), "bit").alias("hit"))
    lists = hits.groupBy("_id", "_key", "wid", "full").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    after = lambda i: F.get("hits", i + 1)
    alone = F.col("full") == 1
    starts = F.filter("hits", lambda h, i: (h["start"] >= 0) & (alone | F.coalesce((after(i)["start"] == h["start"]) & (after(i)["bit"] != h["bit"]), F.lit(False))))
    close = F.exists(F.transform("hits", lambda h, i: F.coalesce((after(i)["bit"] != h["bit"]) & (after(i)["start"] - h["start"] <= slop), F.lit(False))), lambda x: x)
    out = lists.select("_id", "_key", "wid", F.transform(starts, lambda h: h["start"]).alias("starts"), (alone | close).alias("near"))
    return out.filter("near or size(starts) > 0")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, text_col: str = "text", lists: DataFrame | None = None) -> DataFrame:
    """(_id, _key, n_hit, items, near_items): exact phrase and proximity matches of items in documents.

    items are those with a window whose words stand in the document as they are,
    n_hit the document's words in such windows.  near_items are those of which
    a window's two rarest terms stand within slop of their distance in it.  Only
    texts with candidates are read again; the words at each candidate place are
    cut out once and joined with the windows' words.
    """
    lists = lists if lists is not None else word_lists(docs, text_col)
    windows = stored(item_windows(items, window), "windows")
    anchor = stored(anchors(windows, lists), "anchors")
    found = stored(met(stored(postings(lists, anchor), "positions"), anchor, slop), "met")
    phrases = windows.select("wid", "words", "n").distinct()
    # distinct places: windows that share an anchor share their candidates
    places = found.join(small(phrases.select("wid", "n").distinct()), "wid").select("_id", "_key", F.explode("starts").alias("start"), "n").distinct()
    of = places.groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    texts = restricted(with_row_key(docs, text_col=text_col), places, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    cut = bound(plain_words(ascii_lower(F.col("_text"))), lambda words: F.transform("places", lambda p: F.struct(p["start"].alias("start"), F.slice(words, p["start"] + 1, p["n"]).alias("words"))))
    cuts = texts.join(of, ["_id", "_key"]).select("_id", "_key", F.explode_outer(cut).alias("c")).select("_id", "_key", "c.start", "c.words")
    hits = stored(cuts.join(small(phrases.select("words").distinct()), "words"), "hits")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.size("words") - 1)))))
    n_hit = hits.groupBy("_id", "_key").agg(covered.cast("long").alias("n_hit"))
    exact = hits.select("_id", "_key", "words").distinct().join(windows.select("words", "item").distinct(), "words").select("_id", "_key", "item", F.lit(True).alias("exact"))
    near = found.filter("near").select("_id", "_key", "wid").join(windows.select("wid", "item").distinct(), "wid").select("_id", "_key", "item", F.lit(False).alias("exact"))
    set_of = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("item"))))
    named = exact.union(near.distinct()).groupBy("_id", "_key").agg(set_of(F.col("exact")).alias("items"), set_of(~F.col("exact")).alias("near_items"))
    return named.join(n_hit, ["_id", "_key"], "left").select("_id", "_key", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items", "near_items")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, text_col: str = "text") -> DataFrame:
    """docs without their text, with n_words, n_hit, items and near_items (arrays) and contaminated."""
    lists = word_lists(docs, text_col)
    rows = lists.select("_box", "_id", "_key", F.size("terms").cast("long").alias("n_words"))
    out = rows.join(small(stored(matches(docs, items, window, slop, text_col, lists), "matches")), ["_id", "_key"], "left")
    none = F.expr("cast(array() as array<string>)")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return unboxed(out, [c for c in docs.columns if c != text_col], n_words="n_words", n_hit=n_hit, items=F.coalesce("items", none), near_items=F.coalesce("near_items", none), contaminated=n_hit > 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.array_join("near_items", ",").alias("near_items"),
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a window of the benchmark, with the columns they came with."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = stored(matches(docs, items).filter("n_hit > 0").select("_id", "_key"), "contaminated")
    kept = sealed(docs, keep_text=True).join(small(hit), ["_id", "_key"], "left_anti")
    return unboxed(kept, docs.columns)


WORDS_SQL = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def oracle_hits(source: str) -> str:
    """DuckDB CTEs: words per row (rid), hit positions and items of the table source."""
    return f"""
    src AS (SELECT row_number() OVER () AS rid, * FROM {source}),
    w AS (SELECT rid, {WORDS_SQL} AS ws FROM src),
    it AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS_SQL} AS ws FROM benchmark),
    iw AS (SELECT DISTINCT item, n, array_to_string(ws[i+1:i+n], ' ') AS g FROM (SELECT item, ws, least(len(ws), {WINDOW}) AS n, unnest(range(0, greatest(len(ws) - {WINDOW}, 0) + 1)) AS i FROM it WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT n FROM iw),
    dw AS (SELECT rid, n, i, array_to_string(ws[i+1:i+n], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM w, sizes WHERE len(ws) >= n)),
    hit AS (SELECT dw.rid, dw.n, dw.i, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
    nh AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
    ni AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)"""


_NEAR = f"""
    lw AS (SELECT rid, unnest(list_transform(ws, lambda x: lower(replace(x, 'Σ', 'σ')))) AS term, unnest(range(0, len(ws))) AS p FROM w),
    tf AS (SELECT term, count(*) AS tf FROM lw GROUP BY term),
    win AS (SELECT row_number() OVER () AS wid, g FROM (SELECT DISTINCT g FROM iw)),
    wt AS (SELECT wid, unnest(list_transform(string_split(g, ' '), lambda x: lower(replace(x, 'Σ', 'σ')))) AS term, unnest(range(0, len(string_split(g, ' ')))) AS off FROM win),
    rk AS (SELECT wid, term, off, row_number() OVER (PARTITION BY wid ORDER BY tf, off) AS r, count(*) FILTER (tf IS NULL) OVER (PARTITION BY wid) AS absent FROM wt LEFT JOIN tf USING (term)),
    an AS (SELECT wid, term, off, r, count(*) OVER (PARTITION BY wid) AS k FROM rk WHERE r <= {ANCHORS} AND absent = 0),
    ht AS (SELECT rid, wid, p - off AS s, r, k FROM lw JOIN an USING (term)),
    nr AS (SELECT DISTINCT a.rid, a.wid FROM ht a JOIN ht b ON a.rid = b.rid AND a.wid = b.wid AND (a.k = 1 OR a.r < b.r) AND abs(a.s - b.s) <= {SLOP}),
    nn AS (SELECT rid, string_agg(DISTINCT item, ',' ORDER BY item) AS near FROM nr JOIN win USING (wid) JOIN iw USING (g) GROUP BY rid)"""


ORACLE = f"""WITH {oracle_hits('documents')}, {_NEAR}
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near, '') AS near_items
FROM src JOIN w USING (rid) LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid) LEFT JOIN nn USING (rid)"""
