"""Winnowed document fingerprints: hashes of all k-grams of code points, of each window of w hashes the
smallest (of equal ones the rightmost), with places. Texts that share k + w - 1 code points share one."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.llm import textops as T

GRAM, WIN = 16, 48


def fingerprint(text: str, hasher: T.Hasher, k: int = GRAM, w: int = WIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and places of a text's chosen k-grams. A text shorter than k is one gram, an empty one none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(points))
    sums = T.rolling(T.mix(points.astype(np.uint64)), hasher)
    at = np.arange(len(points) - k + 1)
    h = (hasher.spans(sums, at, at + k) >> np.uint64(32)).astype(np.uint32)
    pick = np.unique(T.sliding_argmin(h, min(w, len(h))))
    return h[pick], pick


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def _fingerprints(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.Hasher()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            both = [fingerprint(x or "", hasher, k, w) for x in text]
            rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([as_text(h) for h, _ in both]), pa.array([p.astype(np.int32) for _, p in both], pa.list_(pa.int32()))], [f.name for f in batch.schema if f.name != "text"] + ["fingerprint", "places"])

    return run


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WIN) -> DataFrame:
    """doc_id, fingerprint (8 hex digits for each chosen k-gram, in order), places (of their first code points).

    Null text is empty; equal texts have equal fingerprints; repeated rows and ids stay rows of their own.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(k, w), "doc_id long, fingerprint string, places array<int>")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part, tail: rows dealt to `parts` partitions by descending doc_id, sorted inside.

    Each part also gets, as its tail, the first row of the next part (the last part that of the first), so
    that the next document of every row stands in its own part. Null doc_ids come last, of equal ids the
    smaller text first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = docs.select(F.percentile_approx("key", shares, 20 * parts)).first()[0] if shares else []
    place = _part(np.unique(np.array(cuts or [], np.int64)))
    # one number for each part: the doc_id that it begins with
    firsts = docs.select("key", place("key").alias("part")).groupBy("part").agg(F.max("key").alias("first")).collect()
    firsts = np.array(sorted(r["first"] for r in firsts), np.int64)
    n = max(1, len(firsts))
    own = docs.withColumn("part", _part(firsts)("key"))
    starts = _begins(firsts)("key")
    before = F.when(starts, F.pmod(F.col("part") - 1, F.lit(n)).cast("int"))
    at = F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("tail")), F.struct(before.alias("p"), F.lit(True).alias("tail")))
    rows = own.select("key", "doc_id", "text", F.explode(at).alias("at")).filter("at.p is not null")
    rows = rows.select("key", "doc_id", "text", F.col("at.p").alias("part"), F.col("at.tail").alias("tail"))
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("tail", F.desc("key"), "text").select("doc_id", "text", "tail")


def _part(firsts: np.ndarray):
    """Of ascending first keys, the part of a key: 0 for the largest keys."""
    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series((len(firsts) - 1 - np.minimum(np.searchsorted(firsts, key.to_numpy()), len(firsts) - 1)).clip(0).astype(np.int32))

    return part


def _begins(firsts: np.ndarray):
    @F.pandas_udf("boolean")
    def begins(key: pd.Series) -> pd.Series:
        return pd.Series(np.isin(key.to_numpy(), firsts))

    return begins


def _edited(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows = T.Hasher(), []
        last = None  # the row that waits for its next one

        def out(rows: list) -> pa.RecordBatch:
            names = ["doc_id", "n_chars", "edited_text", "fingerprint", "places", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        done = False
        for batch in batches:
            ids, texts, tails = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "tail"))
            for i, text, tail in zip(ids.to_pylist(), texts, tails.to_pylist(), strict=True):
                if done:
                    continue  # more tails: only the first counts
                text = text.as_py()
                own = fingerprint(text, hasher, k, w)
                if last is not None:
                    j, t, (h, places) = last
                    half = len(t) // 2
                    new = t[: len(t) - half] + text[:half]
                    e, _ = fingerprint(new, hasher, k, w)
                    rows.append((j, len(t), new, as_text(h), places.astype(np.int32), as_text(e), likeness(h, e), likeness(h, own[0])))
                    if len(rows) >= 500:
                        yield out(rows)
                        rows = []
                last, done = (i, text, own), tail
        if rows:
            yield out(rows)

    return run


def edited_fingerprints(docs: DataFrame, k: int = GRAM, w: int = WIN, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the likeness of its own to both the edited
    text's and the next document's: doc_id, n_chars, edited_text, fingerprint, places, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document by descending doc_id; after the last comes the first. Order: see in_order().
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs, parts)
    return rows.mapInArrow(_edited(k, w), "doc_id long, n_chars long, edited_text string, fingerprint string, places array<int>, edited_fingerprint string, near_edited double, near_next double")
