"""A quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are grown level by level to one depth over binned features, and kept as flat arrays, so that a
whole batch of documents walks all trees at once.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafmine.llm import textops as T

#: Most labelled rows that a model learns from; they are gathered on the driver.
SAMPLE_ROWS = 20_000
#: Bytes of text that a worker reads at once.
READ_BYTES = 1 << 18
_CLASSES = ["lower", "upper", "digit", "space", "newline", "high", ".", ",", "!", "|", "*$%&#", "<>{}[]()", "/:@_=-", "other"]
NAMES = ["log_bytes", "log_words", "word_bytes", "line_bytes", "distinct_words", "repeated_grams", "repeated_lines", "no_letter_words", "long_words", "entropy", *(f"share {c}" for c in _CLASSES)]


def _class_table() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), np.int64)
    out[128:] = _CLASSES.index("high")
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (32, 9, 11, 12, 13)), ("newline", (10,))):
        out[list(chars)] = _CLASSES.index(name)
    for name in _CLASSES[6:-1]:
        out[[ord(c) for c in name]] = _CLASSES.index(name)
    return out


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of n rows has; row is ascending."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: T.Hasher, classes: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * len(_CLASSES) + classes[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    start, end, first = T.words(data, offsets)
    of = np.repeat(np.arange(n), np.diff(first))
    n_words = np.diff(first).astype(float)
    sums = hasher.sums(data)
    h = hasher.spans(sums, start, end)
    letters = np.concatenate(([0], np.cumsum((classes[data] < 2) | (classes[data] == 5))))
    bare = letters[end] == letters[start]
    grams = T.grams(h, 5)
    inside = np.flatnonzero(of[: len(grams)] == of[4:]) if len(of) > 4 else np.zeros(0, np.int64)
    n_grams = np.bincount(of[inside], minlength=n)
    # lines: spans between line feeds that are not empty
    edge = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1)))
    ls, le = edge[:-1], edge[1:]
    full = data[ls] != 10 if len(ls) else np.zeros(0, bool)
    ls, le = ls[full], le[full]
    line_of = np.searchsorted(offsets, ls, "right") - 1
    n_lines = np.bincount(line_of, minlength=n)
    share = counts / some[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(1)
    part = lambda a, b: np.divide(a, np.maximum(b, 1))
    cols = [
        np.log1p(size), np.log1p(n_words), part(np.bincount(of, end - start, n), n_words), part(size, n_lines), part(_distinct(of, h, n), n_words),
        1 - part(_distinct(of[inside], grams[inside], n), n_grams), 1 - part(_distinct(line_of, hasher.spans(sums, ls, le), n), n_lines),
        part(np.bincount(of, bare, n), n_words), part(np.bincount(of, end - start > 16, n), n_words), entropy,
    ]
    return np.column_stack([*cols, share])


@dataclass
class Trees:
    """Trees of one depth in flat arrays: node i's children are 2 i + 1 and 2 i + 2."""

    base: float
    depth: int
    feature: np.ndarray  # tree, inner node
    limit: np.ndarray  # tree, inner node: right if the feature is larger
    leaf: np.ndarray  # tree, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree = np.arange(len(self.leaf))
        at = np.zeros((len(x), len(tree)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.limit[tree, at])
        z = self.base + self.leaf[tree, at - (1 << self.depth) + 1].sum(1)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0) -> Trees:
    """Boosted trees for the log-loss. One class only, or no rows: a constant score."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = np.zeros((0, (1 << depth) - 1))
    if len(np.unique(y)) < 2:
        return Trees(base, depth, none.astype(int), none, np.zeros((0, 1 << depth)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    z = np.full(len(y), base)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros((1 << depth) - 1, int), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(len(y), int)
        for level in range(depth):
            n, at = 1 << level, (1 << level) - 1
            best = np.full(n, 1e-6)
            cut = np.full(n, bins)
            for j in range(x.shape[1]):
                k = node * bins + binned[:, j]
                gs = np.bincount(k, g, n * bins).reshape(n, bins).cumsum(1)
                hs = np.bincount(k, h, n * bins).reshape(n, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[:, len(edges[j]) :] = -1
                b = gain.argmax(1)
                better = gain[np.arange(n), b] > best
                best = np.where(better, gain[np.arange(n), b], best)
                feature[at : at + n] = np.where(better, j, feature[at : at + n])
                cut = np.where(better, b, cut)
            f = feature[at : at + n]
            limit[at : at + n] = [edges[j][c] if c < len(edges[j]) else np.inf for j, c in zip(f, cut, strict=True)]
            node = 2 * node + (x[np.arange(len(y)), f[node]] > limit[at : at + n][node])
        value = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        z = z + value[node]
        features.append(feature)
        limits.append(limit)
        leaves.append(value)
    return Trees(base, depth, np.array(features), np.array(limits), np.array(leaves))


def _mapped(model: Trees | None, column: str = "features"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, classes = T.Hasher(), _class_table()
        for batch in batches:
            parts = [statistics(data, offsets, hasher, classes) for _, _, data, offsets in T.rows(batch, limit=READ_BYTES)]
            if not parts:
                continue
            x = np.concatenate(parts)
            if model is None:
                new = pa.array(list(x), pa.list_(pa.float64()))
            else:
                new = pa.array(np.concatenate([model.score(x[i : i + 2000]) for i in range(0, len(x), 2000)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, column])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """A model from at most `rows` labelled documents that are not held out, chosen by a hash of their id.

    Labels without doc_id or quality don't count; of several for one id the largest does.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    some = some.select("doc_id", "quality", "text").mapInArrow(_mapped(None), "doc_id long, quality int, text string, features array<double>")
    got = some.select("doc_id", "quality", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features").limit(rows).collect()
    x = np.array([r["features"] for r in got]).reshape(len(got), len(NAMES))
    return fit(x, np.array([float(r["quality"] > 0) for r in got]))


def score(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """docs with one more column (0 to 1, higher: the better label is likelier). Only the text is an input.

    Null text counts as empty; an empty text is scored like any other; other columns stay.
    A column of docs that has the name is replaced.
    """
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(_mapped(model, column), schema)
