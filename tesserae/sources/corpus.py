"""Corpus sources and sinks: JSONL and Parquet passages, validation, paged remote rows, and JSON output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

# Corpus settings.
LANGUAGES = ("en", "hi", "bn", "ta", "te", "mr")
MOST_PASSAGES, PAGE = 4000, 100
JSONL_SCHEMA = "id string, passage string, lang string, source string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Passages (doc_id, text, lang, source) from lines with id, passage, lang and source; other keys are not read."""
    return spark.read.schema(JSONL_SCHEMA).json(path).select(F.col("id").alias("doc_id"), F.col("passage").alias("text"), F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("source", F.lit("corpus")).alias("source"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Passages from a Parquet table with doc_id, text, lang and source."""
    return spark.read.parquet(path).select("doc_id", "text", "lang", "source")


def evenly(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small table that too few row groups hold are dealt to all cores by key; a table that fills its partitions stays as it is.

    A Parquet row group is read by one task.  Only tables of few partitions are
    looked at, without reading a column.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() > 2 * cores:
        return rows
    full = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows if full >= cores else rows.repartition(cores, key)


def of_languages(passages: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    return passages.filter(F.col("lang").isin(*languages))


# What makes a record of each kind invalid, in order.
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "passage": (("doc_id is empty", "doc_id is null or cast(doc_id as string) = ''"), ("text is empty", "text is null or trim(text) = ''")),
    "chunk": (("chunk_id is empty", "chunk_id is null or chunk_id = ''"), ("text is empty", "text is null or trim(text) = ''"), ("end before start", "end < start")),
    "request": (("neither text nor audio", "(text is null or trim(text) = '') and (audio_b64 is null or audio_b64 = '')"), ("top_k out of range", "top_k not between 1 and 50")),
    "transcript": (("text is missing", "text is null"),),
    "answer": (("confidence out of range", "confidence is null or confidence not between 0 and 1"),),
}


def reason(kind: str) -> Column:
    """The first rule of a kind that a record breaks; null for none."""
    return reduce(lambda out, r: F.when(F.expr(f"coalesce({r[1]}, false)"), r[0]).otherwise(out), reversed(RULES[kind]), F.lit(None).cast("string"))


def validated(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason)."""
    judged = rows.withColumn("reason", reason(kind))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def strict(rows: DataFrame, kind: str) -> DataFrame:
    """rows, failing the job at the first that breaks a rule."""
    why = reason(kind)
    return rows.filter(F.when(why.isNull(), True).otherwise(F.raise_error(why).cast("boolean")))


def to_json(rows: DataFrame, hidden: tuple[str, ...] = ("audio_b64", "api_key", "token")) -> DataFrame:
    """One JSON string a row, without hidden columns."""
    return rows.select(F.to_json(F.struct(*(c for c in rows.columns if c not in hidden))).alias("json"))


class _Page(InputPartition):
    def __init__(self, offset: int, length: int, langs: tuple[str, ...] | None = None) -> None:
        self.offset, self.length, self.langs = offset, length, langs


@dataclass(frozen=True)
class Remote:
    """What a paged source needs of a remote table: all of it runs on the driver or the executors alike.

    fetch(offset, length) gives (id, passage, lang, source) rows; languages(offset,
    length), if there, the languages of a page without fetching it; size() how many
    rows there are by now, for streams; put(key, rows) stores a part of a write under a key, and
    publish(keys) or discard(keys) ends the write.
    """

    fetch: Callable[[int, int], list[tuple]]
    languages: Callable[[int, int], set[str]] | None = None
    size: Callable[[], int] | None = None
    put: Callable[[str, list[tuple]], None] | None = None
    publish: Callable[[list[str]], None] | None = None
    discard: Callable[[list[str]], None] | None = None


class PagedReader(DataSourceReader):
    """One partition for each page.  With languages, pages without rows of these are no partitions, and other rows of a page are not returned."""

    def __init__(self, remote: Remote, total: int, page: int, langs: tuple[str, ...] | None = None) -> None:
        self.remote, self.total, self.page, self.langs = remote, total, page, langs

    def partitions(self) -> list[InputPartition]:
        pages = [_Page(k, min(self.page, self.total - k), self.langs) for k in range(0, self.total, self.page)]
        if self.langs is None or self.remote.languages is None:
            return pages
        return [p for p in pages if self.remote.languages(p.offset, p.length) & set(self.langs)]

    def read(self, partition: _Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark reads a source without partitions as one that has none
            return
        rows = self.remote.fetch(partition.offset, partition.length)
        yield from (r for r in rows if partition.langs is None or r[2] in partition.langs)


class FilteredPagedReader(PagedReader):
    """A reader that takes filters on lang over.

    Spark 4.1 refuses it in a session that does not set spark.sql.python.filterPushdown.enabled, and keeps
    what a table was filtered by for later reads of the same table object; so load the table again for each query.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("lang",) or any(v is None for v in values):
                yield f
            else:
                self.langs = values if self.langs is None else tuple(v for v in self.langs if v in values)


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are numbers of rows; a batch is the pages between two of them, so that it reads the same again."""

    def __init__(self, remote: Remote, page: int) -> None:
        if remote.size is None:
            raise ValueError("a stream needs the remote table's size")
        self.remote, self.page = remote, page

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.remote.size()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(k, min(self.page, end["rows"] - k)) for k in range(start["rows"], end["rows"], self.page)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from self.remote.fetch(partition.offset, partition.length)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a committed batch."""


@dataclass
class _Part(WriterCommitMessage):
    key: str


class PagedWriter(DataSourceWriter):
    """A write in two phases: tasks put their rows under keys of their own, page by page, and the driver publishes all keys or discards them.

    A task that fails puts nothing that is published; a second attempt has another key.
    """

    def __init__(self, remote: Remote, page: int) -> None:
        if not (remote.put and remote.publish and remote.discard):
            raise ValueError("a write needs put, publish and discard")
        self.remote, self.page = remote, page

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, held, n = TaskContext.get(), [], 0
        key = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        for row in rows:
            held.append(tuple(row))
            if len(held) == self.page:
                self.remote.put(f"{key}/{n}", held)
                held, n = [], n + 1
        if held:
            self.remote.put(f"{key}/{n}", held)
            n += 1
        return _Part(f"{key}:{n}")

    def _keys(self, messages: list[WriterCommitMessage | None]) -> list[str]:
        parts = [m.key.rsplit(":", 1) for m in messages if m is not None]
        return [f"{key}/{k}" for key, n in parts for k in range(int(n))]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.remote.publish(self._keys(messages))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.remote.discard(self._keys(messages))


def paged_source(name: str, remote: Remote | Callable[[int, int], list[tuple]], total: int = MOST_PASSAGES, page: int = PAGE, pushdown: bool = False) -> type[DataSource]:
    """A data source for spark.dataSource.register over a remote table, given whole or by its fetch alone: read page by page, as a table or a stream, and written in two phases.

    The option languages (joined by commas) restricts what is fetched; with pushdown so do filters on lang (FilteredPagedReader).
    """
    remote = remote if isinstance(remote, Remote) else Remote(remote)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return JSONL_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            langs = self.options.get("languages")
            return (FilteredPagedReader if pushdown else PagedReader)(remote, total, page, tuple(langs.split(",")) if langs else None)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PagedStreamReader(remote, page)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return PagedWriter(remote, page)

    return Paged


def load_corpus(spark: SparkSession, source: str = "auto", path: str | None = None, remote: type[DataSource] | None = None, languages: tuple[str, ...] = ()) -> DataFrame:
    """auto takes the remote source if there is one, else the file; hf and offline insist on theirs.  With languages only passages of these."""
    rows = _corpus_rows(spark, source, path, remote, languages)
    return of_languages(rows, languages) if languages else rows


def _corpus_rows(spark: SparkSession, source: str, path: str | None, remote: type[DataSource] | None, languages: tuple[str, ...] = ()) -> DataFrame:
    if source not in ("auto", "hf", "offline"):
        raise ValueError(f"unknown corpus source {source}")
    if source == "hf" or (source == "auto" and remote is not None):
        if remote is None:
            raise ValueError("the remote source needs a data source")
        spark.dataSource.register(remote)
        rows = spark.read.format(remote.name()).options(**({"languages": ",".join(languages)} if languages else {})).load()
        return rows.select(F.col("id").alias("doc_id"), F.col("passage").alias("text"), "lang", "source")
    if path is None:
        raise ValueError("the offline source needs a path")
    return read_jsonl(spark, path)


def write_vector_store(indexed: DataFrame, path: str, files: int = 8) -> None:
    """Vectors (chunk_id, vector, cluster) as Parquet partitioned by cluster, so that probes read their clusters only.

    A cluster is written by as many tasks as files, so that a large one is not
    one task's alone.
    """
    indexed.repartition("cluster", F.pmod(F.xxhash64("chunk_id"), F.lit(files))).write.partitionBy("cluster").parquet(path)


def read_vector_store(spark: SparkSession, path: str, clusters: list[int] | None = None) -> DataFrame:
    """Vectors of a store, of the given clusters only if there are any; other clusters' files are not opened."""
    rows = spark.read.parquet(path)
    return rows if clusters is None else rows.filter(F.col("cluster").isin(clusters))
