"""Row keys. Two rows that agree in doc_id and text have one key; others differ (but for a collision of 128 bits of hash)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["k0", "k1", "k2"]
KEY_TYPES = "k0 long, k1 long, k2 long"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def key0() -> Column:
    """doc_id, null the lowest."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _keys() -> list[Column]:
    none = F.col("doc_id").isNull()
    return [key0().alias("k0"), F.xxhash64(_text(), none).alias("k1"), F.xxhash64(F.lit(7), none, _text()).alias("k2")]


def keyed(docs: DataFrame) -> DataFrame:
    """k0 (doc_id, null the lowest), k1 and k2 (hashes of text and of whether doc_id is null), doc_id, text (null: empty)."""
    return docs.select(*_keys(), F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))


def with_keys(docs: DataFrame) -> DataFrame:
    """Keys, and the whole rows in one column, so that no name of theirs clashes: select("row.*") gives them back."""
    return docs.select(*_keys(), F.struct("*").alias("row"))
