"""Chunking strategies: passages (doc_id, text, title, section) to chunks.

Sizes are in tokens of functions.text.  Fixed and hierarchical chunks are cut by
built-in functions; the sentence-based strategies take the sentences of one
text at a time from an Arrow-batched function and work on rows after that.
Bodies that parameters do not determine are this library's own definitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text as txt
from tesserae.functions.similarity import dot, jaccard, l2_normalize
from tesserae.operators.embed import PpmiModel
from tesserae.sources.tables import stored

# Chunk sizes in tokens.
FIXED_SIZE, FIXED_OVERLAP = 90, 22
RECURSIVE_MAX, RECURSIVE_MIN, RECURSIVE_OVERLAP = 120, 24, 16
WINDOW_SIDE, WINDOW_MIN = 2, 4
SEMANTIC_BREAK, SEMANTIC_MIN, SEMANTIC_MAX, SEMANTIC_BUFFER = 0.62, 30, 170, 1
PROPOSITION_MIN, PROPOSITION_MAX = 5, 48
CHILD, PARENT = 55, 220
LEAST, MOST = 4, 320
NEAR_DUPLICATE = 0.94

COLUMNS = ("chunk_id", "doc_id", "text", "strategy", "ordinal", "token_count", "char_count", "level", "parent_id", "window_before", "window_after")


def _finished(rows: DataFrame, strategy: str) -> DataFrame:
    """The chunk schema for rows with doc_id, ordinal and text; ids are made of document, strategy, level and ordinal."""
    have = set(rows.columns)
    level = F.col("level") if "level" in have else F.lit(0)
    out = rows.withColumns(
        {
            "strategy": F.lit(strategy),
            "level": level.cast("int"),
            "chunk_id": F.concat_ws("-", F.col("doc_id"), F.lit(strategy), level, F.col("ordinal")),
            "token_count": (F.col("token_count") if "token_count" in have else txt.count_tokens(F.col("text"))).cast("int"),
            "char_count": F.length("text"),
            **{c: F.lit(None).cast("string") if c == "parent_id" else F.lit("") for c in ("parent_id", "window_before", "window_after") if c not in have},
        }
    )
    return out.select(*COLUMNS)


def _slices(tokens: Column, size: int, stride: int) -> Column:
    """array<array<string>>: size tokens from each stride, until the last token is in one."""
    last = F.greatest(F.ceil((F.size(tokens) - size) / stride).cast("int"), F.lit(0))
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(tokens, k * stride + 1, F.lit(size))))


def fixed(passages: DataFrame, size: int = FIXED_SIZE, overlap: int = FIXED_OVERLAP) -> DataFrame:
    """Runs of size tokens, each sharing overlap with the one before; the text is the tokens joined by spaces."""
    rows = txt.token_rows(passages, "doc_id", only_content=False)
    rows = rows.select("doc_id", F.posexplode(_slices(F.col("tokens"), size, size - overlap)).alias("ordinal", "tokens"))
    return _finished(rows.select("doc_id", "ordinal", F.array_join("tokens", " ").alias("text"), F.size("tokens").alias("token_count")), "fixed")


def hierarchical(passages: DataFrame, child: int = CHILD, parent: int = PARENT) -> DataFrame:
    """Parents (level 1) of parent tokens, and their children (level 0) of child tokens with parent_id."""
    rows = txt.token_rows(passages, "doc_id", only_content=False)
    big = rows.select("doc_id", F.posexplode(_slices(F.col("tokens"), parent, parent)).alias("ordinal", "tokens")).withColumn("level", F.lit(1))
    per = -(-parent // child)
    small = big.select("doc_id", F.concat_ws("-", "doc_id", F.lit("hierarchical"), F.lit(1), "ordinal").alias("parent_id"), F.col("ordinal").alias("p"), F.posexplode(_slices(F.col("tokens"), child, child)).alias("c", "tokens"))
    small = small.select("doc_id", (F.col("p") * per + F.col("c")).alias("ordinal"), "tokens", F.lit(0).alias("level"), "parent_id")
    both = big.withColumn("parent_id", F.lit(None).cast("string")).select(*small.columns).unionByName(small)
    return _finished(both.select("doc_id", "ordinal", "level", "parent_id", F.array_join("tokens", " ").alias("text"), F.size("tokens").alias("token_count")), "hierarchical")


def sentences(passages: DataFrame) -> DataFrame:
    """(doc_id, ordinal, text, start, end, token_count) of each sentence."""
    rows = passages.select("doc_id", F.posexplode(txt.split_sentences(F.col("text"))).alias("ordinal", "s"))
    return rows.select("doc_id", "ordinal", F.col("s.sentence").alias("text"), "s.start", "s.end", txt.count_tokens(F.col("s.sentence")).alias("token_count"))


def sentence_window(passages: DataFrame, side: int = WINDOW_SIDE, least: int = WINDOW_MIN) -> DataFrame:
    """Sentences of at least so many tokens, with side sentences before and after as context."""
    order = W.partitionBy("doc_id").orderBy("ordinal")
    near = lambda lo, hi: F.array_join(F.collect_list("text").over(order.rowsBetween(lo, hi)), " ")
    rows = sentences(passages).withColumns({"window_before": near(-side, -1), "window_after": near(1, side)})
    return _finished(rows.filter(F.col("token_count") >= least), "sentence_window")


def context_text(chunks: DataFrame) -> Column:
    """What a chunk is read with: context before, text, context after, empties left out."""
    return F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in ("window_before", "text", "window_after")))


def _by_text(passages: DataFrame, cut: Callable[[str], list[str]], strategy: str) -> DataFrame:
    """Chunks that cut makes of each whole text."""
    kind = dict(passages.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _sliced(batches):
            made = [cut(t or "") for t in own.column("text").to_pylist()]
            yield _numbered(own, made, [pa.array([c for cs in made for c in cs], pa.string())], ["text"])

    return _finished(passages.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ordinal int, text string"), strategy)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about a megabyte of text: what is made of one is handed on before the next."""
    for batch in batches:
        for lo, n in txt.slices(batch.column("text")):
            yield batch.slice(lo, n)


def _numbered(own: pa.RecordBatch, made: list[list], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """Rows (doc_id, ordinal, ...) of what was made of each row."""
    ids = own.column("doc_id").take(pa.array([k for k, cs in enumerate(made) for _ in cs], pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array([k for cs in made for k in range(len(cs))], pa.int32()), *columns], names=["doc_id", "ordinal", *names])


_BLANK_LINES = re.compile(r"\n\s*\n")


def pieces(text: str, most: int) -> list[tuple[str, int]]:
    """A text's paragraphs with their token counts; of those with more than most tokens the sentences, and of such sentences even runs of words."""
    out = []
    for block in filter(None, map(str.strip, _BLANK_LINES.split(text))):
        n = txt.token_count(block)
        if n <= most:
            out.append((block, n))
            continue
        for lo, hi in txt.sentence_spans(block, min_chars=1):
            n = txt.token_count(block[lo:hi])
            out += [(p, txt.token_count(p)) for p in _evenly(block[lo:hi], most)] if n > most else [(block[lo:hi], n)]
    return out


def packed(parts: list[tuple[str, int]], most: int, least: int, overlap: int) -> list[str]:
    """Parts with token counts packed greedily up to most; a short end joins the chunk before; each chunk begins with the last overlap words of the one before."""
    out: list[list] = []
    for part, n in parts:
        if out and out[-1][1] + n <= most:
            out[-1] = [f"{out[-1][0]} {part}", out[-1][1] + n]
        elif n or out:
            out.append([part, n])
    if len(out) > 1 and out[-1][1] < least:
        part, n = out.pop()
        out[-1] = [f"{out[-1][0]} {part}", out[-1][1] + n]
    words = [o[0].split() for o in out]
    return [" ".join((words[k - 1][-overlap:] if k and overlap else []) + own) for k, own in enumerate(words)]


def recursive(passages: DataFrame, most: int = RECURSIVE_MAX, least: int = RECURSIVE_MIN, overlap: int = RECURSIVE_OVERLAP) -> DataFrame:
    """Paragraphs packed up to most tokens, longer ones by sentences, longer sentences by words."""
    return _by_text(passages, lambda text: packed(pieces(text, most), most, least, overlap), "recursive")


def semantic(passages: DataFrame, break_below: float = SEMANTIC_BREAK, least: int = SEMANTIC_MIN, most: int = SEMANTIC_MAX) -> DataFrame:
    """Sentences up to most tokens; once least tokens are reached, a new chunk begins where the cosine with the sentence before is below break_below.

    The cosine is that of the sentences' stem sets, so that chunking needs no
    model; own definition.
    """
    order = W.partitionBy("doc_id").orderBy("ordinal")
    rows = sentences(passages).withColumn("st", F.array_distinct(txt.stems(F.col("text"))))
    before = F.lag("st").over(order)
    rows = rows.withColumn("near", F.when(F.size("st") * F.size(before) > 0, F.size(F.array_intersect("st", before)) / F.sqrt(F.size("st") * F.size(before))))
    seq = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text", "token_count", "near"))).alias("ss"))
    closed = lambda a, s: (a["n"] + s["token_count"] > most) | ((a["n"] >= least) & (F.coalesce(s["near"], F.lit(0.0)) < break_below))
    start = F.expr("named_struct('out', cast(array() as array<string>), 'text', '', 'n', 0)")

    def step(a: Column, s: Column) -> Column:
        # a chunk that has no token yet takes whatever follows, so no text is lost
        new = (a["n"] > 0) & closed(a, s)
        return F.struct(
            F.when(new, F.concat(a["out"], F.array(a["text"]))).otherwise(a["out"]).alias("out"),
            F.when(new | (a["text"] == ""), s["text"]).otherwise(F.concat(a["text"], F.lit(" "), s["text"])).alias("text"),
            F.when(new, s["token_count"]).otherwise(a["n"] + s["token_count"]).alias("n"),
        )

    cut = F.aggregate("ss", start, step, lambda a: F.when(a["text"] != "", F.concat(a["out"], F.array(a["text"]))).otherwise(a["out"]))
    return _finished(seq.select("doc_id", F.posexplode(cut).alias("ordinal", "text")), "semantic")


def units_of(text: str, most: int) -> Iterator[tuple[str, int]]:
    """The units of one text with their numbers of tokens."""
    for lo, hi in txt.sentence_spans(text, min_chars=1):
        n = txt.token_count(text[lo:hi])
        yield from ((p, txt.token_count(p)) for p in _evenly(text[lo:hi], most)) if n > most else [(text[lo:hi], n)]


def units(passages: DataFrame, most: int) -> DataFrame:
    """(doc_id, ordinal, text, token_count): sentences, those of more than most tokens cut between words; all tokens are in one."""
    kind = dict(passages.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _sliced(batches):
            made = [list(units_of(t or "", most)) for t in own.column("text").to_pylist()]
            yield _numbered(own, made, [pa.array([u for us in made for u, _ in us], pa.string()), pa.array([n for us in made for _, n in us], pa.int32())], ["text", "token_count"])

    return passages.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ordinal int, text string, token_count int")


class Drifting:
    """Units in order become chunks of most tokens at most; once a chunk has least tokens, one whose similarity with the unit before is below break_below begins the next.

    Only the chunk that is open is held.  Units without tokens never begin a chunk, so that no text is lost.
    """

    def __init__(self, break_below: float, least: int, most: int) -> None:
        self.break_below, self.least, self.most = break_below, least, most
        self.texts: list[str] = []
        self.n = 0

    def add(self, text: str, n: int, near: float | None) -> str | None:
        """Takes a unit in; returns the chunk that it closes."""
        done = None
        if n and self.n and (self.n + n > self.most or (self.n >= self.least and (near or 0.0) < self.break_below)):
            done = self.end()
        self.texts.append(text)
        self.n += n
        return done

    def end(self) -> str | None:
        done = " ".join(self.texts) if self.texts else None
        self.texts, self.n = [], 0
        return done


def with_nearness(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], buffer: int = SEMANTIC_BUFFER) -> DataFrame:
    """units with near: the cosine of the vectors of a unit and of the one before, each taken together with buffer units on either side; null for the first.

    encode makes (doc_id, vector) of (doc_id, tokens); here each unit is a document of its own.
    """
    order = W.partitionBy("doc_id").orderBy("ordinal")
    keyed = rows.withColumn("key", F.concat_ws("#", "doc_id", "ordinal")).withColumn("tokens", txt.content_tokens(F.col("text")))
    own = stored(keyed.select("key", F.flatten(F.collect_list("tokens").over(order.rowsBetween(-buffer, buffer))).alias("tokens")), "buffers")
    vectors = encode(own.withColumnRenamed("key", "doc_id")).select(F.col("doc_id").alias("key"), l2_normalize(F.col("vector")).alias("vector"))
    placed = stored(keyed.drop("tokens").join(vectors, "key").drop("key"), "unit-vectors")
    before = F.lag("vector").over(order)
    return placed.withColumn("near", F.when(before.isNotNull(), dot(F.col("vector"), before))).drop("vector")


def _drift_by_model(passages: DataFrame, model: PpmiModel, break_below: float, least: int, most: int, buffer: int) -> DataFrame:
    """(doc_id, ordinal, text): the sums of a unit and its neighbours are those of their tokens, so each token is taken once."""
    kind, finished = passages.schema["doc_id"].dataType.simpleString(), model._finished

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _sliced(batches):
            made = [list(units_of(t or "", most)) for t in own.column("text").to_pylist()]
            words = [[txt.content_list(u) for u, _ in us] for us in made]
            columns = [([t for w in ws for t in w] for ws in words), ([len(w) for w in ws] for ws in words), ([u for u, _ in us] for us in made), ([n for _, n in us] for us in made)]
            arrays = [txt.lists(list(x), k) for x, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), *arrays], names=["doc_id", "tokens", "sizes", "texts", "counts"])

    def chunks(row: dict, sums: np.ndarray) -> list[tuple]:
        if not row["texts"]:
            return []
        padded, own = np.pad(sums, ((buffer, buffer), (0, 0))), Drifting(break_below, least, most)
        vectors = finished(sum(padded[k : k + len(sums)] for k in range(2 * buffer + 1)))
        near = [None, *np.einsum("ij,ij->i", vectors[1:], vectors[:-1]).tolist()]
        done = [own.add(text, k, x) for text, k, x in zip(row["texts"], row["counts"], near)]
        return [(row["doc_id"], k, d) for k, d in enumerate(d for d in [*done, own.end()] if d is not None)]

    rows = passages.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, tokens array<string>, sizes array<int>, texts array<string>, counts array<int>")
    return model.parts(rows, chunks, f"doc_id {kind}, ordinal int, text string")


def drift(passages: DataFrame, encode: Callable[[DataFrame], DataFrame] | PpmiModel, break_below: float = SEMANTIC_BREAK, least: int = SEMANTIC_MIN, most: int = SEMANTIC_MAX, buffer: int = SEMANTIC_BUFFER) -> DataFrame:
    """Chunks that end where the vectors of neighbouring sentences drift apart.

    Sentences of more than most tokens are cut, and every token of a passage is in
    one chunk.  The rows of a document are read in order and never gathered: a
    task holds the open chunk only.  With a model the vectors of a document's
    sentences are made where its chunks are, and no vector leaves a task.
    """
    kind = dict(passages.dtypes)["doc_id"]
    if isinstance(encode, PpmiModel):
        return _finished(_drift_by_model(passages, encode, break_below, least, most, buffer), "drift")
    rows = with_nearness(stored(units(passages, most), "units"), encode, buffer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, k, own = None, 0, Drifting(break_below, least, most)
        for batch in batches:
            out = []
            for d, text, n, near in zip(batch["doc_id"].tolist(), batch["text"], batch["token_count"].tolist(), batch["near"].tolist()):
                if d != doc:
                    if (done := own.end()) is not None:
                        out.append((doc, k, done))
                    doc, k = d, 0
                if (done := own.add(text, n, None if near != near else near)) is not None:
                    out.append((doc, k, done))
                    k += 1
            yield pd.DataFrame(out, columns=["doc_id", "ordinal", "text"]).astype({"ordinal": "int32"})
        if (done := own.end()) is not None:
            yield pd.DataFrame([(doc, k, done)], columns=["doc_id", "ordinal", "text"]).astype({"ordinal": "int32"})

    sorted_ = rows.repartition("doc_id").sortWithinPartitions("doc_id", "ordinal").select("doc_id", "text", "token_count", "near")
    return _finished(sorted_.mapInPandas(run, f"doc_id {kind}, ordinal int, text string"), "drift")


CLAUSE_END = re.compile(r"[;:]\s+|,\s+(?=(?:and|but|or|which|who|because|while)\s)", re.ASCII)


def _evenly(text: str, most: int) -> list[str]:
    """A text of more than most tokens cut between words into pieces of about equal size; a word of more tokens is cut where no token is, or else stays whole."""
    units: list[tuple[str, int]] = []
    for word in text.split():
        n = txt.token_count(word)
        if n > most:
            # two tokens at most for a character of a script without spaces: itself and the pair with the next one
            units += [(p, txt.token_count(p) + 1) for p in txt.word_pieces(word)]
            units[-1] = (units[-1][0] + " ", units[-1][1])
        else:
            units.append((word + " ", n))
    out, own, have, left = [], "", 0, sum(n for _, n in units)
    goal = ceil(left / ceil(left / most))
    for unit, n in units:
        if own and n and (have >= goal or have + n > most):
            out.append(own.strip())
            own, left, have = "", left - have, 0
            goal = ceil(left / ceil(left / most))
        own, have = own + unit, have + n
    return [*out, own.strip()]


def clauses(text: str, least: int, most: int) -> list[str]:
    """The clauses of a text's sentences: short ones joined to the one before, if both fit in most, or else to the next one; long ones cut between words."""
    own: list[tuple[str, int]] = []
    for lo, hi in txt.sentence_spans(text, min_chars=1):
        for clause in filter(str.strip, CLAUSE_END.split(text[lo:hi])):
            n = txt.token_count(clause)
            if own and (own[-1][1] < least or (n < least and own[-1][1] + n <= most)):
                own[-1] = f"{own[-1][0]} {clause}", own[-1][1] + n
            else:
                own.append((clause, n))
    if len(own) > 1 and own[-1][1] < least:
        clause, n = own.pop()
        own[-1] = f"{own[-1][0]} {clause}", own[-1][1] + n
    return [p for clause, n in own if n for p in (_evenly(clause, most) if n > most else [clause])]


def proposition(passages: DataFrame, least: int = PROPOSITION_MIN, most: int = PROPOSITION_MAX) -> DataFrame:
    """Clauses of sentences, cut at semicolons, colons and commas before a conjunction, of least to most tokens.  Own definition.

    Shorter clauses are joined to a neighbour and longer ones are split, so
    that all words are in a chunk; only a text with fewer than least tokens is
    a shorter one.
    """
    return _by_text(passages, lambda text: clauses(text, least, most), "proposition")


def metadata_aware(passages: DataFrame) -> DataFrame:
    """Fixed chunks with title and section, where there are any, before the text.  Own definition."""
    have = [c for c in ("title", "section") if c in passages.columns]
    head = F.concat_ws(" | ", *(F.when(F.col(c) != "", F.col(c)) for c in have)) if have else F.lit("")
    rows = fixed(passages).drop("strategy").join(passages.select("doc_id", head.alias("head")).distinct(), "doc_id")
    rows = rows.withColumn("text", F.when(F.col("head") != "", F.concat("head", F.lit(": "), "text")).otherwise(F.col("text")))
    return _finished(rows.select("doc_id", "ordinal", "text", "token_count"), "metadata_aware")


def guarded(chunks: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Chunks of least to most tokens."""
    return chunks.filter(F.col("token_count").between(least, most))


#: Terms whose document frequencies order the tokens of a set; rarer ones come first, in the order of their hashes.
MOST_FREQUENT = 1 << 20


def _prefixes(reps: DataFrame, threshold: float) -> DataFrame:
    """(h, rep, size, p): of each set of reps (rep, set) the hashes that its near duplicates have one of, and their places in the set.

    Tokens are ordered from the rarest. Any order that all sets share finds all
    pairs, and frequent tokens come last, so only the most frequent need
    to be known: they go to the tasks, and no token is shuffled to learn how
    frequent it is. Equal hashes of unequal tokens only add pairs to be compared.
    """
    hashed = reps.select("rep", F.transform("set", lambda t: F.xxhash64(t)).alias("hs"))
    df = stored(hashed.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    least, n = 2, 0
    for r in df.groupBy("df").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.orderBy(F.desc("df")))).filter(F.col("all") <= MOST_FREQUENT).agg(F.min("df").alias("least"), F.max("all").alias("n")).collect():
        least, n = r["least"] or 0, r["n"] or 0
    # without a single frequency that fits, tokens are ordered by hashes alone
    known = df.filter(F.col("df") >= least if n else F.lit(False)).toArrow()
    hashes, counts = known.column("h").to_numpy(), known.column("df").to_numpy()
    by = np.argsort(hashes)
    hashes, counts = hashes[by], counts[by]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("hs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = batch.column("hs").flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            common = np.where(hashes[at] == h, counts[at], 0) if len(hashes) else np.zeros(len(h), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, common, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            most = sizes - np.ceil(sizes * threshold).astype(np.int64) + 1
            kept = place <= most[row]
            own = row[kept]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][kept], pa.int64()), batch.column("rep").take(pa.array(own)), pa.array(sizes[own], pa.int32()), pa.array(place[kept], pa.int32())], names=["h", "rep", "size", "p"])

    return hashed.mapInArrow(cut, f"h long, rep {reps.schema['rep'].dataType.simpleString()}, size int, p int")


def near_duplicates(chunks: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """(a, b, similarity): of each chunk b (chunk_id, tokens) that has near duplicates with smaller ids at least one of them, a.

    Near duplicates have token sets with a Jaccard of at least threshold.  Equal
    sets, told by their SHA-256, are one class, each member linked with its
    smallest one.  Of the classes only prefixes are joined: with tokens in one
    order, two such sets share one of their first n - ceil(threshold *
    n) + 1.  The classes that share a token are compared with the smallest of
    them; only those that this does not settle meet all smaller ones, so that a
    family of copies is not expanded into its pairs.  What two sets share is at most what their prefixes
    do and what comes after the last place of it; sets are fetched only for pairs that can still be alike.
    """
    sets = chunks.select("chunk_id", F.sort_array(F.array_distinct("tokens")).alias("set")).filter(F.size("set") > 0)
    # read by each join below, so stored
    sets = stored(sets.select("chunk_id", "set", F.sha2(F.array_join("set", " "), 256).alias("sha")), "token-sets")
    classes = stored(sets.groupBy("sha").agg(F.min("chunk_id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("sha", "a"), "classes")
    copies = stored(sets.select("sha", F.col("chunk_id").alias("b")).join(classes, "sha").filter("a <> b").select("a", "b", F.lit(1.0).alias("similarity")), "copies")
    reps = sets.join(copies.select(F.col("b").alias("chunk_id")), "chunk_id", "left_anti").select(F.col("chunk_id").alias("rep"), "set")
    prefix = stored(_prefixes(reps, threshold), "prefixes")

    def close(shared: DataFrame, all_tokens: bool) -> DataFrame:
        """Of (a, b, sa, sb, pa, pb), a row for each token that both prefixes have, or for some of these tokens, the pairs that are alike."""
        after = lambda pa, pb: F.least(F.col("sa") - pa, F.col("sb") - pb)
        pairs = shared.groupBy("a", "b", "sa", "sb").agg(F.count("*").alias("n"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min(F.least("pa", "pb") + after(F.col("pa"), F.col("pb"))).alias("most"))
        most = F.least("most", F.col("n") + after(F.col("pa"), F.col("pb"))) if all_tokens else F.col("most")
        pairs = stored(pairs.filter(most >= (F.col("sa") + F.col("sb")) * (threshold / (1 + threshold)) - 1e-6).select("a", "b"), "candidates")
        met = stored(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "met")
        some = reps.join(met, "rep", "left_semi")
        with_sets = pairs.join(some.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(some.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
        return with_sets.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold)

    alike = f"a < b and sa >= {threshold} * sb and sb >= {threshold} * sa"
    first = prefix.groupBy("h").agg(F.min(F.struct(F.col("rep").alias("a"), F.col("size").alias("sa"), F.col("p").alias("pa"))).alias("x"), F.count("*").alias("n")).filter("n > 1").select("h", "x.*")
    members = prefix.select("h", F.col("rep").alias("b"), F.col("size").alias("sb"), F.col("p").alias("pb"))
    smaller = prefix.select("h", F.col("rep").alias("a"), F.col("size").alias("sa"), F.col("p").alias("pa"))
    # a pair is met here by the tokens whose smallest set is a, which need not be all that the two share
    settled = stored(close(members.join(first, "h").filter(alike), False), "settled")
    open_ = members.join(settled.select("b").distinct(), "b", "left_anti")
    rest = close(open_.join(smaller, "h").filter(alike), True)
    return copies.unionByName(settled).unionByName(rest)


def collapsed(chunks: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """chunks without those that have a near duplicate with a smaller id."""
    return chunks.join(near_duplicates(chunks, threshold).select(F.col("b").alias("chunk_id")).distinct(), "chunk_id", "left_anti")


def of_strategies(chunks: DataFrame, strategies: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of the given strategies; all if none is given.  A filter that prunes partitions where chunks are stored by strategy."""
    return chunks.filter(F.col("strategy").isin(*strategies)) if strategies else chunks


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed": fixed, "recursive": recursive, "sentence_window": sentence_window, "semantic": semantic,
    "proposition": proposition, "metadata_aware": metadata_aware, "hierarchical": hierarchical,
}
