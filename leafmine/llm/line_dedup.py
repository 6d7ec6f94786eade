"""Line dedup over overlapping windows of three lines: a window that an earlier document or place has
is a later occurrence, and the lines that later occurrences cover go."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.llm.keys import KEY, KEY_TYPES, keyed
from leafmine.llm.scratch import Scratch

WINDOW = 3


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            out: list[tuple] = []
            for row, text in enumerate(texts):
                lines = text.split("\n")
                n = min(size, len(lines))
                for i in range(len(lines) - n + 1):
                    window = "\n".join(lines[i : i + n])
                    if window and not window.isspace():
                        h = hashlib.blake2b(window.encode("utf-8", "surrogatepass"), digest_size=16, salt=n.to_bytes(8, "little")).digest()
                        out.append((row, i, h))
            if out:
                at = np.frombuffer(b"".join(x[2] for x in out), np.int64).reshape(-1, 2)
                rows = pa.array([x[0] for x in out], pa.int64())
                keys = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in KEY]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([x[1] for x in out], pa.int32()), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], [*KEY, "line", "h1", "h2"])

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, starts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "starts"))
            n_lines, n_removed, kept = [], [], []
            for text, at in zip(texts.to_pylist(), starts.to_pylist(), strict=True):
                lines = text.split("\n")
                gone = {j for i in at or () for j in range(i, min(i + size, len(lines)))}
                n_lines.append(len(lines))
                n_removed.append(len(gone))
                kept.append("\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])

    return run


def remove_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: each text without the lines that later occurrences cover.

    Lines are what stands between line feeds, compared as they are; a window is `size` of them in a row
    (all lines of a shorter text, equal to such texts only), and one of nothing but white space counts
    nowhere. Its first occurrence is that of the smallest doc_id (null first), then the smallest line;
    every other one is later. Windows are judged on the input. Rows that agree in doc_id and text are
    one document. Null text: one empty line. Other columns of docs are ignored.
    """
    docs = keyed(docs)
    scratch = Scratch(docs.sparkSession, "lines")
    windows = scratch.write(docs.select(*KEY, "text").mapInArrow(_windows(size), f"{KEY_TYPES}, line int, h1 long, h2 long"), "windows")
    place = F.struct(*KEY, "line")
    many = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    many = scratch.write(many.filter("first < last").select("h1", "h2", "first"), "many")
    later = windows.join(many, ["h1", "h2"]).filter(place > F.col("first"))
    later = scratch.write(later.groupBy(*KEY).agg(F.collect_set("line").alias("starts")), "later")
    scratch.drop("windows", "many")
    return docs.hint("merge").join(later, KEY, "left").select("doc_id", "text", "starts").mapInArrow(_cut(size), "doc_id long, n_lines long, n_removed long, kept_text string")
