"""Chunkers as polymorphic table functions of SQL, over the ordered rows of each document.

    SELECT * FROM chunk_rows(TABLE(rows) PARTITION BY doc_id ORDER BY ordinal, strategy => 'recursive', most => 120)

rows have doc_id, ordinal, text and token_count, and near for the strategy drift.
The table's own doc_id type is kept, and a strategy decides which columns there are beyond
doc_id, ordinal, text and token_count: sentence_window adds window_before and window_after.
chunk_parts and chunk_units make such rows of a text, as lateral joins.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tesserae.functions import text as txt
from tesserae.operators import chunk

#: Sizes of each strategy: the parameters that it takes and their defaults.
STRATEGIES = {
    "sentence_window": {"side": chunk.WINDOW_SIDE, "least": chunk.WINDOW_MIN},
    "recursive": {"most": chunk.RECURSIVE_MAX, "least": chunk.RECURSIVE_MIN, "overlap": chunk.RECURSIVE_OVERLAP},
    "drift": {"most": chunk.SEMANTIC_MAX, "least": chunk.SEMANTIC_MIN, "break_below": chunk.SEMANTIC_BREAK},
}
NEEDED = ("doc_id", "ordinal", "text", "token_count")


def _sizes(strategy: str, given: dict) -> dict:
    known = STRATEGIES[strategy]
    if unknown := sorted(k for k, v in given.items() if v is not None and k not in known):
        raise ValueError(f"{strategy} takes {', '.join(known)}, not {', '.join(unknown)}")
    return {k: given[k] if given.get(k) is not None else v for k, v in known.items()}


class ChunkRows:
    """The chunks of documents, from the rows of each in order."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, strategy: AnalyzeArgument, **sizes: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if strategy.value not in STRATEGIES:
            raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
        _sizes(strategy.value, {k: v.value for k, v in sizes.items()})
        fields = {f.name: f.dataType for f in rows.dataType.fields}
        if missing := [c for c in (*NEEDED, *(("near",) if strategy.value == "drift" else ())) if c not in fields]:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        # this runs without a session, which type names would need
        schema = T.StructType().add("doc_id", fields["doc_id"]).add("ordinal", T.IntegerType()).add("text", T.StringType()).add("token_count", T.IntegerType())
        if strategy.value == "sentence_window":
            schema = schema.add("window_before", T.StringType()).add("window_after", T.StringType())
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.doc, self.run = None, None

    def eval(self, rows: T.Row, strategy: str, **sizes: float) -> Iterator[tuple]:
        if self.run is None or rows["doc_id"] != self.doc:  # a partition may have several documents
            yield from self.terminate()
            self.doc, self.run = rows["doc_id"], _RUNS[strategy](**_sizes(strategy, sizes))
        yield from ((self.doc, *out) for out in self.run.add(rows))

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield from ((self.doc, *out) for out in self.run.end())


class _Window:
    """Sentences with their neighbours; 2 * side + 1 of them are held."""

    def __init__(self, side: int, least: int) -> None:
        self.side, self.least = int(side), least
        self.before: deque[str] = deque(maxlen=self.side)
        self.waiting: deque[tuple] = deque()

    def _first(self) -> Iterator[tuple]:
        ordinal, text, n = self.waiting.popleft()
        if n >= self.least:
            yield ordinal, text, n, " ".join(self.before), " ".join(w[1] for w in list(self.waiting)[: self.side])
        self.before.append(text)

    def add(self, row: T.Row) -> Iterator[tuple]:
        self.waiting.append((row["ordinal"], row["text"], row["token_count"]))
        if len(self.waiting) > self.side:
            yield from self._first()

    def end(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._first()


class _Packed:
    """Parts of one document packed by size."""

    def __init__(self, most: int, least: int, overlap: int) -> None:
        self.sizes, self.parts = (most, least, int(overlap)), []

    def add(self, row: T.Row) -> Iterator[tuple]:
        self.parts.append((row["text"], row["token_count"]))
        return iter(())

    def end(self) -> Iterator[tuple]:
        for k, text in enumerate(chunk.packed(self.parts, *self.sizes)):
            yield k, text, txt.token_count(text)


class _Drift:
    """Units whose similarity with the one before, near, decides; the open chunk is held."""

    def __init__(self, most: int, least: int, break_below: float) -> None:
        self.own, self.k = chunk.Drifting(break_below, least, most), 0

    def _numbered(self, text: str | None) -> Iterator[tuple]:
        if text is not None:
            yield self.k, text, txt.token_count(text)
            self.k += 1

    def add(self, row: T.Row) -> Iterator[tuple]:
        return self._numbered(self.own.add(row["text"], row["token_count"], row["near"]))

    def end(self) -> Iterator[tuple]:
        return self._numbered(self.own.end())


_RUNS = {"sentence_window": _Window, "recursive": _Packed, "drift": _Drift}


class ChunkParts:
    """Paragraphs of a text, of those with more than most tokens the sentences, and of such sentences runs of words."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        for k, (part, n) in enumerate(chunk.pieces(text or "", most)):
            yield k, part, n


class ChunkSentences:
    """Sentences of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for k, (lo, hi) in enumerate(txt.sentence_spans(text or "")):
            yield k, text[lo:hi], txt.token_count(text[lo:hi])


def register(spark: SparkSession) -> None:
    """Makes chunk_rows, chunk_parts and chunk_sentences known to SQL."""
    spark.udtf.register("chunk_rows", F.udtf(ChunkRows))
    spark.udtf.register("chunk_parts", F.udtf(ChunkParts, returnType="ordinal: int, text: string, token_count: int"))
    spark.udtf.register("chunk_sentences", F.udtf(ChunkSentences, returnType="ordinal: int, text: string, token_count: int"))
