import glob

import pytest
from pyspark.sql import functions as F

from tesserae.llm import storage
from tesserae.sources import tables


class Session:
    """A stand-in for a session with the given settings."""

    def __init__(self, **settings: str) -> None:
        self.settings = settings
        self.conf = self

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.settings.get(name, default)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(**{"spark.master": "spark://h:7077"}))
    assert storage.shared_dir(Session(**{"spark.master": "spark://h:7077", "spark.checkpoint.dir": "/shared"})) == "/shared"


def test_stored_tables_can_be_dropped(spark):
    storage.drop_stored(spark)
    rows = storage.stored(spark.range(5), "five")
    assert rows.count() == 5 and len(tables._written) == 1
    path = tables._written[0].removeprefix("file://")
    assert glob.glob(f"{path}/*.parquet") and storage.drop_stored(spark) == 1 and not glob.glob(path)


def test_keys_are_broadcast_by_their_bytes(spark, monkeypatch):
    keys = spark.range(100).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(storage.small(keys))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 100 * (storage.ROW_BYTES + 16 + 100) - 1)
    assert not hinted(storage.small(keys)) and hinted(storage.small(keys.select("id")))


def test_boxed_columns_come_back(spark):
    rows = spark.createDataFrame([(1, "t", "a", "b")], "doc_id long, text string, _id string, `_box` string")
    back = storage.unboxed(storage.sealed(rows, keep_text=True), rows.columns, n=F.lit(1))
    assert back.columns == [*rows.columns, "n"] and tuple(back.first()) == (1, "t", "a", "b", 1)
