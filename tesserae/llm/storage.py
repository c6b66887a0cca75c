"""Keys that restrict tables, and rows whose columns cannot clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.corpus import evenly
from tesserae.sources.tables import drop_stored, shared_dir, stored, table_path

__all__ = ["boxed", "documents", "drop_stored", "restricted", "sealed", "shared_dir", "small", "stored", "table_path", "unboxed", "with_row_key"]

#: Keys are broadcast up to so many bytes, taking what an executor's hash table needs for a row; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 40
#: Stands for a null document id in join keys; no real id is the smallest long.
NO_ID = -(2**63)

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; a small one that too few row groups hold is dealt to all cores."""
    return evenly(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def _row_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, _text): _id (never null) and _key (hash of id and text) name a row; equal rows share both."""
    return docs.select(_row_id(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))


def boxed(columns: list[str]) -> Column:
    """The given columns as one struct _box, out of the way of an operator's own columns."""
    return F.struct(*(F.col(f"`{c}`") for c in columns), *([] if columns else [F.lit(None).cast("int").alias("_none")])).alias("_box")


def unboxed(rows: DataFrame, columns: list[str], **new: Column | str) -> DataFrame:
    """The given columns of boxed rows, and new ones, which take the place of columns of their names."""
    fresh = {k: F.col(v) if isinstance(v, str) else v for k, v in new.items()}
    return rows.select(*(F.col("_box")[c].alias(c) for c in columns if c not in fresh), *(v.alias(k) for k, v in fresh.items()))


def sealed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(_box, _id, _key, _text): the columns of docs boxed, with the text only on request, and what with_row_key gives."""
    own = [c for c in docs.columns if keep_text or c != text_col]
    return docs.select(boxed(own), _row_id(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))


def small(keys: DataFrame) -> DataFrame:
    """keys with a broadcast hint when their counted size is within BROADCAST_BYTES, else as they are, for a join by a shuffle."""
    texts = [F.octet_length(F.col(f.name)) for f in keys.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(ROW_BYTES + 8 * len(keys.columns)))
    size = keys.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def restricted(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of docs whose key is in keys, which are broadcast only when they are few."""
    return docs.join(small(keys.select(*on).distinct()), on, "left_semi")
