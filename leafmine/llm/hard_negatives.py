"""Hard negatives from labelled vectors, by a multiway tree of split points.

A node of the tree has up to WAYS split points; a row goes to the nearest one, level by level, down to a cell. Each split point
keeps the smallest and largest distance to the rows under each of its siblings. The tree is learned from a bounded sample; every
row is routed, and the distances that the ranges hold are those of all rows.

Scores are inner products. One more coordinate, the square root of R - |x|^2 with R the largest |x|^2, and 0 for an anchor, makes
them distances: d^2 = |a|^2 + R - 2 score. So a window of scores is an annulus around the anchor. A cell is left out
if, at some split point p on the way down, no distance in the annulus fits both d(a, p) and the range that p keeps for
the cell's side. What is left is compared exactly, a block of anchors with a block of a cell's rows at a time.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmine.llm.scratch import Scratch

#: Rows that the tree is learned from, at most; split points of a node; rows that a cell aims at, and that one block holds on
#: average; anchors of a block on average.
SAMPLE_ROWS, WAYS, CELL_ROWS, ANCHORS = 8_192, 8, 4_096, 512
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: Sums of products are exact in a double up to here; beyond it integers of any size are used.
_EXACT = float(1 << 52)
#: Distances are rounded; what lies closer to a bound than this share of the largest lengths counts as inside.
_SLACK = 1e-6

Range = dict[tuple[int, int, int], tuple[float, float]]


def prepared(embeddings: DataFrame) -> DataFrame:
    """id, label, vec (components as floor(256 x), doubles) of the rows that take part.

    Rows without label or vector, or with a null or non-finite component, take no part; nor do rows without vec_id, as nothing can
    name them. Of rows that share a vec_id the one with the smallest label and vector stands for all.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")).dropna()
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.filter(finite).select("id", label.alias("label"), F.transform("x", lambda v: F.floor(v * 256).cast("double")).alias("vec"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")


def _matrix(vecs: list, dim: int) -> np.ndarray:
    """Rows of vectors; shorter ones are filled up with zeros."""
    out = np.zeros((len(vecs), dim))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < _EXACT:
        return a @ b.T
    return np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T


@dataclass
class Tree:
    """split[node]: its points with the added coordinate; child[node]: a node (>= 0) or a cell (-1 - cell) under each."""

    dim: int
    norm: float
    split: list[np.ndarray] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)
    cells: int = 0

    def lift(self, x: np.ndarray, anchor: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(self.norm - (x**2).sum(1), 0))
        return np.column_stack([x, more])

    def grow(self, x: np.ndarray, cell: int) -> int:
        """Split points far from each other, from the sample; sides of more than `cell` sample rows are split again."""
        if len(x) <= max(cell, WAYS):
            self.cells += 1
            return -self.cells
        points = [0]
        d = ((x - x[0]) ** 2).sum(1)
        for _ in range(WAYS - 1):
            if d.max() <= 0:
                break
            points.append(int(d.argmax()))
            d = np.minimum(d, ((x - x[points[-1]]) ** 2).sum(1))
        if len(points) == 1:  # copies of one vector
            self.cells += 1
            return -self.cells
        node = len(self.split)
        self.split.append(x[points])
        self.child.append([])
        side = distances(x, x[points]).argmin(1)
        self.child[node] = [self.grow(x[side == j], cell) for j in range(len(points))]
        return node

    def route(self, x: np.ndarray, ranges: Range | None = None) -> np.ndarray:
        """The cell of each row. ranges: gets (node, split point, side): smallest and largest distance."""
        cell = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.split else []
        while todo:
            node, at = todo.pop()
            d = distances(x[at], self.split[node])
            side = d.argmin(1)
            for j, to in enumerate(self.child[node]):
                some = side == j
                if not some.any():
                    continue
                if ranges is not None:
                    low, high = d[some].min(0), d[some].max(0)
                    for i in range(len(low)):
                        was = ranges.get((node, i, j), (np.inf, 0.0))
                        ranges[node, i, j] = min(was[0], float(low[i])), max(was[1], float(high[i]))
                if to >= 0:
                    todo.append((to, at[some]))
                else:
                    cell[at[some]] = -1 - to
        return cell

    def reached(self, x: np.ndarray, near: np.ndarray, far: np.ndarray, ranges: Range) -> Iterator[tuple[int, np.ndarray]]:
        """Cells that hold rows, with the anchors whose annulus may meet them. x: lifted anchors; near, far: annulus of each."""
        todo = [(0, np.arange(len(x)))] if self.split else []
        if not todo:
            yield 0, np.arange(len(x))
        slack = _SLACK * (1 + np.sqrt(self.norm) + np.sqrt((x**2).sum(1)))
        while todo:
            node, at = todo.pop()
            d = distances(x[at], self.split[node])
            for j, to in enumerate(self.child[node]):
                stays = np.full(len(at), (node, 0, j) in ranges)
                for i in range(d.shape[1]):
                    low, high = ranges.get((node, i, j), (np.inf, 0.0))
                    # the distance of a row under j to the anchor lies between these two
                    least = np.maximum(low - d[:, i], d[:, i] - high)
                    stays &= (least <= far[at] + slack[at]) & (d[:, i] + high >= near[at] - slack[at])
                if stays.any():
                    if to >= 0:
                        todo.append((to, at[stays]))
                    else:
                        yield -1 - to, at[stays]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def learn(rows: DataFrame, sample: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> Tree:
    """A tree from the `sample` rows with the smallest hash of their id; cells aim at `cell_rows` of all rows."""
    square = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v * v)
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(square).alias("norm")).first()
    tree = Tree(total["dim"] or 0, total["norm"] or 0.0)
    some = [r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()]
    if some:
        tree.grow(tree.lift(_matrix(some, tree.dim)), max(1, cell_rows * len(some) // total["n"]))
    tree.cells = max(1, tree.cells)
    return tree


def _routed(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = tree.lift(_matrix(batch.column("vec").to_pylist(), tree.dim))
            yield batch.append_column("cell", pa.array(tree.route(x)))

    return run


def _ranges(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Range = {}
        for batch in batches:
            tree.route(tree.lift(_matrix(batch.column("vec").to_pylist(), tree.dim)), found)
        if found:
            key, value = np.array(list(found)), np.array(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(key[:, 2]), pa.array(value[:, 0]), pa.array(value[:, 1])], ["node", "i", "j", "low", "high"])

    return run


def ranges_of(rows: DataFrame, tree: Tree) -> Range:
    """Distance ranges of all rows: at most WAYS * WAYS for each node of the tree, which the sample bounds."""
    found = rows.select("vec").mapInArrow(_ranges(tree), "node long, i long, j long, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return {(r["node"], r["i"], r["j"]): (r["low"], r["high"]) for r in found.collect()}


def _raw(x: np.ndarray) -> bytes:
    """Whole numbers in the smallest of three kinds that holds them, named by a first byte."""
    most = np.abs(x).max(initial=0)
    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([kind]) + x.astype([np.int16, np.int32, np.float64][kind]).tobytes()


def _unraw(b: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(b, [np.int16, np.int32, np.float64][b[0]], offset=1).astype(float).reshape(rows, -1)


def _packed(dim: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        packed = (ids.tobytes(), labels.tobytes(), _raw(_matrix(table.column("vec").to_pylist(), dim)))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "salt": pa.array([key[1].as_py()], pa.int64()), **{n: pa.array([b], pa.binary()) for n, b in zip(("ids", "labels", "vecs"), packed, strict=True)}})

    return run


def blocks(routed: DataFrame, dim: int, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """cell, salt, ids, labels, vecs: rows of a cell packed by about `cell_rows`, and the number of blocks of each cell. A
    crowded cell has many blocks, by a hash of the id; there are no more cells than the sample has rows."""
    counts = {r["cell"]: -(-r["count"] // cell_rows) for r in routed.groupBy("cell").count().collect()}
    salts = routed.sparkSession.createDataFrame(list(counts.items()), "at_cell long, salts long")
    salted = routed.join(F.broadcast(salts), F.col("cell") == F.col("at_cell")).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), "salts"))
    groups = salted.select("cell", "salt", "id", "label", "vec").groupBy("cell", "salt")
    return groups.applyInArrow(_packed(dim), "cell long, salt long, ids binary, labels binary, vecs binary"), counts


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _sent(tree: Tree, ranges: Range, salts: dict[int, int], home: bool) -> Callable:
    """Anchors, packed once for each block of each cell that their annuli meet; home: of their own cell alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = _matrix(batch.column("vec").to_pylist(), tree.dim)
            if home:
                cell = tree.route(tree.lift(vec))
                cells = [(int(c), np.flatnonzero(cell == c)) for c in np.unique(cell)]
            else:
                square = (vec**2).sum(1) + tree.norm
                low = np.array([min(x) for x in batch.column("lows").to_pylist()], float)
                high = np.array([max(x) for x in batch.column("highs").to_pylist()], float)
                cells = tree.reached(tree.lift(vec, True), np.sqrt(np.maximum(square - 2 * high, 0)), np.sqrt(np.maximum(square - 2 * low, 0)), ranges)
            for cell, some in cells:
                for k in range(0, len(some), ANCHORS):
                    n, asked = salts[cell], _stream(batch.take(pa.array(some[k : k + ANCHORS])))
                    for salt in range(n):
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([salt], pa.int64()), pa.array([asked], pa.binary())], ["to_cell", "to_salt", "asked"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of at with the highest scores, of equal ones the smallest ids."""
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], -k)[-k]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _compared(same: bool, k: int) -> Callable:
    """For each pair of a block and packed anchors, the k best rows of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                ids, labels = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("ids", "labels"))
                rows = _unraw(batch.column("vecs")[r].as_py(), len(ids))
                asked = pa.ipc.open_stream(batch.column("asked")[r].as_py()).read_all().to_pylist()
                scores = _products(_matrix([a["vec"] for a in asked], rows.shape[1]), rows).astype(np.int64)
                out = []
                for a, score in zip(asked, scores, strict=True):
                    fits = (labels == a["label"]) & (ids != a["id"]) if same else labels != a["label"]
                    for low, high, tag in zip(a["lows"], a["highs"], a["tags"], strict=True):
                        best = _best(score, ids, np.flatnonzero(fits & (score >= low) & (score <= high)), k)
                        out += [(a["id"], tag, high, int(ids[i]), int(score[i])) for i in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["anchor", "tag", "high", "id", "score"])

    return run


@dataclass
class Index:
    tree: Tree
    ranges: Range
    blocks: DataFrame
    salts: dict[int, int]

    def search(self, asked: DataFrame, same: bool, k: int, home: bool = False) -> DataFrame:
        """anchor, tag, high, id, score, rank: of each window the k best rows of the same or of other labels. asked: id, label,
        vec, and windows lows, highs with tags. Each cell's best go to one ranking, which keeps k of each task before it shuffles."""
        parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sent = asked.repartition(parts, "id").mapInArrow(_sent(self.tree, self.ranges, self.salts, home), "to_cell long, to_salt long, asked binary")
        met = sent.hint("merge").join(self.blocks, (F.col("to_cell") == F.col("cell")) & (F.col("to_salt") == F.col("salt")))
        found = met.select("ids", "labels", "vecs", "asked").mapInArrow(_compared(same, k), "anchor long, tag long, high long, id long, score long")
        order = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def build(rows: DataFrame, scratch: Scratch, sample: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> Index:
    """The tree over prepared rows, the distance ranges of all of them, and their blocks."""
    tree = learn(rows, sample, cell_rows)
    ranges = ranges_of(rows, tree)
    routed = scratch.write(rows.mapInArrow(_routed(tree), "id long, label long, vec array<double>, cell long"), "routed")
    packed, salts = blocks(routed, tree.dim, cell_rows)
    return Index(tree, ranges, scratch.write(packed, "blocks"), salts)


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def mine(embeddings: DataFrame, sample: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by 100; an anchor's positives are its POSITIVES best other rows of its label; of each
    positive come the first NEGATIVES rows of other labels that score between 80 and 100 percent of it. Higher scores come
    first, of equal ones smaller ids. Who takes part: see prepared(). Shorter vectors count as filled up with zeros. A score must
    fit in 64 bits, else the job fails. No rows, no anchors or one label only give an empty table.
    """
    scratch = Scratch(embeddings.sparkSession, "negatives")
    rows = scratch.write(prepared(embeddings), "rows")
    index = build(rows, scratch, sample, cell_rows)
    window = lambda low: [F.array(low).alias("lows"), F.array(F.lit(_MOST)).alias("highs"), F.array(F.lit(0).cast("long")).alias("tags")]
    anchors = rows.filter("id % 100 = 0")
    # the worst of an anchor's best in its own cell bounds what can be among its best elsewhere
    near = index.search(anchors.select("*", *window(F.lit(_LEAST))), True, POSITIVES, home=True)
    bound = scratch.write(near.filter(F.col("rank") == POSITIVES).select("anchor", F.col("score").alias("bound")), "bounds")
    bounded = anchors.join(bound, F.col("id") == F.col("anchor"), "left").select(*anchors.columns, *window(F.coalesce("bound", F.lit(_LEAST))))
    positives = scratch.write(index.search(bounded, True, POSITIVES).select("anchor", F.col("id").alias("positive"), "score"), "positives")
    pair = F.collect_list(F.struct((F.col("score") - F.expr("score div 5")).alias("low"), F.col("score").alias("high"), F.col("positive").alias("tag")))
    asked = positives.filter("score >= 0").groupBy("anchor").agg(pair.alias("w"))
    asked = anchors.join(asked, F.col("id") == F.col("anchor")).select(*anchors.columns, F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.col("w.tag").alias("tags"))
    found = index.search(asked, False, NEGATIVES)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))
