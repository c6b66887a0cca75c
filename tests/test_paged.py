"""The paged source against a remote table of files: filters, streams and writes in two phases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tesserae.sources import corpus

LANGS = ("en", "en", "hi", "de")


def remote(folder: str) -> corpus.Remote:
    """400 rows, a hundred of each language in turn; what is fetched is noted in the folder."""

    def fetch(offset: int, length: int) -> list[tuple]:
        open(f"{folder}/fetched-{offset}-{os.getpid()}-{len(os.listdir(folder))}", "w").close()
        return [(str(i), f"text {i}", LANGS[i // 100 % 4], "s") for i in range(offset, offset + length)]

    def size() -> int:
        with open(f"{folder}/size") as f:
            return int(f.read())

    def put(key: str, rows: list[tuple]) -> None:
        with open(f"{folder}/put-{key.replace('/', '-')}", "w") as f:
            json.dump(rows, f)

    def discard(keys: list[str]) -> None:
        for k in keys:
            os.remove(f"{folder}/put-{k.replace('/', '-')}")

    def publish(keys: list[str]) -> None:
        with open(f"{folder}/published", "w") as f:
            json.dump([json.load(open(f"{folder}/put-{k.replace('/', '-')}")) for k in keys], f)

    return corpus.Remote(fetch, lambda offset, length: {LANGS[i // 100 % 4] for i in range(offset, offset + length)}, size, put, publish, discard)


@pytest.fixture
def folder(tmp_path, spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    (tmp_path / "r").mkdir()
    yield str(tmp_path / "r")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def fetched(folder: str) -> set[int]:
    return {int(x.split("-")[1]) for x in os.listdir(folder) if x.startswith("fetched")}


def test_pages_without_the_languages_are_not_fetched(spark, folder):
    spark.dataSource.register(corpus.paged_source("pages_of_langs", remote(folder), total=400, page=50, pushdown=True))
    rows = lambda: spark.read.format("pages_of_langs").load()
    assert sorted(int(r["id"]) for r in rows().filter("lang in ('hi', 'ta')").collect()) == list(range(200, 300)) and fetched(folder) == {200, 250}
    assert rows().filter(F.col("lang") == "de").filter("id > '39'").count() == 10 and fetched(folder) == {200, 250, 300, 350}
    assert rows().filter("lang = 'xx'").count() == 0 and rows().filter("lang = 'hi' and lang = 'de'").count() == 0 and fetched(folder) == {200, 250, 300, 350}
    assert rows().count() == 400 and len(fetched(folder)) == 8


def test_languages_as_an_option(spark, folder):
    source = corpus.paged_source("pages_by_option", remote(folder), total=400, page=50)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    rows = corpus.load_corpus(spark, remote=source, languages=("hi", "ta"))
    assert sorted(int(r["doc_id"]) for r in rows.collect()) == list(range(200, 300)) and fetched(folder) == {200, 250}
    assert corpus.load_corpus(spark, remote=source).count() == 400


def test_a_stream_reads_what_came_since(spark, folder, tmp_path):
    spark.dataSource.register(corpus.paged_source("pages_of_stream", remote(folder), page=30))
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/c"
    for n in (70, 70, 200):
        with open(f"{folder}/size", "w") as f:
            f.write(str(n))
        stream = spark.readStream.format("pages_of_stream").load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        assert sorted(int(r["id"]) for r in spark.read.parquet(out).collect()) == list(range(n))


def test_a_write_is_published_whole_or_not_at_all(spark, folder):
    spark.dataSource.register(corpus.paged_source("pages_to_write", remote(folder), page=20))
    rows = spark.range(0, 130, numPartitions=4).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("passage"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows.write.format("pages_to_write").mode("append").save()
    with open(f"{folder}/published") as f:
        parts = json.load(f)
    assert sorted(int(r[0]) for p in parts for r in p) == list(range(130)) and max(map(len, parts)) == 20
    before = set(os.listdir(folder))
    bad = rows.withColumn("passage", F.when(F.col("id") == "125", F.raise_error(F.lit("no"))).otherwise("t"))
    with pytest.raises(Exception, match="no"):
        bad.coalesce(1).write.format("pages_to_write").mode("append").save()
    left = set(os.listdir(folder)) - before
    with open(f"{folder}/published") as f:
        assert json.load(f) == parts  # nothing of it is published
    assert all(x.startswith("put-") for x in left)


def test_a_source_without_the_means_refuses(spark):
    source = corpus.paged_source("pages_alone", lambda offset, length: [])
    with pytest.raises(ValueError, match="size"):
        source({}).streamReader(None)
    with pytest.raises(ValueError, match="put, publish and discard"):
        source({}).writer(None, False)
