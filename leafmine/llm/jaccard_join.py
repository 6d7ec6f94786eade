"""Exact Jaccard join of documents' shingle sets in the metric space of Jaccard distance.

1. Equal sets become one class; only classes are compared.
2. A bounded number of pivots, drawn from all classes, goes to every task. Each class learns its distance
   to the pivots within twice the radius and so lies in their Voronoi regions. Classes within the
   radius of a pivot are linked to it.
3. By the triangle inequality a partner of a linked class is at most one radius farther from the pivot.
   If no unlinked class stands in that window, the class is done; otherwise it is replicated into the next
   level, with all classes that are far from every pivot.
4. There, classes that share a shingle form regions: two sets within the radius share enough of their first
   shingles in one order, common shingles last. Linked classes have a colour; a pair of one colour needs
   no look. Regions of many colours get pivots of their own, measured exactly against all classes in
   such regions, round after round, which merges colours. Pairs of different colours that share
   enough first shingles are compared exactly.

Nothing is capped or sampled away: bounds on pivots, rounds and common shingles steer cost only.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.llm import textops as T
from leafmine.llm.components import components
from leafmine.llm.keys import KEY, KEY_TYPES, keyed
from leafmine.llm.scratch import Scratch

WORDS, PERCENT = 5, 75
#: Pivots a level, and the largest set of one: what each task gets is below PIVOTS * PIVOT_SIZE hashes.
PIVOTS, PIVOT_SIZE = 256, 8192
#: The same for the pivots of regions.
REGION_PIVOTS, REGION_PIVOT_SIZE = 4096, 2048
#: Regions with more colours than CROWD get pivots of their own while they hold REGION_ROWS classes, in at most so many rounds.
CROWD, REGION_ROWS, ROUNDS = 32, 500, 6
#: Common shingles that each task knows; one class in COMMON_OF is looked at to find them.
COMMON, COMMON_OF, COMMON_COUNT = 100_000, 64, 3
#: Classes of a shingle up to which it is paired beside the others that the same classes share.
TOGETHER = 32
_SIGS = 1 << 19


def sets(data: np.ndarray, offsets: np.ndarray, hasher: T.Hasher, over: T.Hasher, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of each row: row of each shingle, its hash (ascending in a row, once), and the rows' offsets."""
    n = len(offsets) - 1
    start, end, first = T.words(data, offsets)
    w = hasher.spans(hasher.sums(data), start, end)
    run = T.rolling(w, over)
    count = np.diff(first)
    last = first[1:]
    i = T.ranges(first[:-1], np.maximum(last - k + 1, first[:-1]))
    short = np.flatnonzero((count > 0) & (count < k))
    h = np.concatenate((over.spans(run, i, i + k), over.spans(run, first[short], last[short])))
    row = np.concatenate((np.repeat(np.arange(n), np.maximum(count - k + 1, 0)), short))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(n + 1))


class _Shingler:
    def __init__(self, k: int):
        self.k, self.hasher, self.over = k, T.Hasher(lower=True, seed=5), T.Hasher(seed=6)

    def __call__(self, batch: pa.RecordBatch, text: str = "text", limit: int = T.SLICE_BYTES):
        for lo, hi, data, offsets in T.rows(batch, text, limit):
            yield lo, hi, *sets(data, offsets, self.hasher, self.over, self.k)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return T.signed(total[at[1:]] - total[at[:-1]])


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingler(k)
        for batch in batches:
            for lo, hi, _, h, at in shingles(batch):
                cols = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in KEY]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(at).astype(np.int64)), pa.array(_sums(T.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)), pa.array(_sums(T.mix(h + np.uint64(0x14057B7EF767814F)), at))], [*KEY, "n", "d1", "d2"])

    return run


def _hashes(k: int, nested: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingler(k)
        for batch in batches:
            for lo, hi, _, h, at in shingles(batch):
                if nested:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "h"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(T.signed(h))], ["h"])

    return run


class _Lookup:
    """Which of some hashes are in a sorted list; a table of bits answers most at once."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are known, and their places in the list."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.known, h[some]), len(self.known) - 1)
        same = self.known[at] == h[some]
        return some[same], at[same]


class _Pivots:
    """The pivots of a level: nodes, set sizes, all hashes, and later the window of each (outside)."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
        self.nodes, self.sizes = nodes, sizes
        self.outside = np.full(len(nodes), np.inf)
        order = np.argsort(hashes, kind="stable")
        known, first = np.unique(hashes[order], return_index=True)
        self.lookup, self.first = _Lookup(known), np.append(first, len(hashes))
        self.owner = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)[order]

    def near(self, row: np.ndarray, h: np.ndarray, at: np.ndarray, percent: int) -> tuple:
        """Rows and pivots within twice the radius, sizes of union and intersection."""
        hit, where = self.lookup(h)
        n = self.first[where + 1] - self.first[where]
        r, total, found, lo, p = row[hit], np.cumsum(n), [], 0, len(self.nodes)
        while lo < len(hit):
            # whole rows, about a million shared shingles at once
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), "right"))
            hi = int(np.searchsorted(r, r[max(lo, min(hi, len(r) - 1))], "left")) if hi < len(r) else hi
            hi = hi if hi > lo else int(np.searchsorted(r, r[lo], "right"))
            pair = np.repeat(r[lo:hi] - r[lo], n[lo:hi]) * p + self.owner[T.ranges(self.first[where[lo:hi]], self.first[where[lo:hi] + 1])]
            cells = int(r[hi - 1] - r[lo] + 1) * p
            if cells <= 4 * len(pair) + (1 << 20):
                count = np.bincount(pair, minlength=cells)
                pair = np.flatnonzero(count)
                count = count[pair]
            else:
                pair, count = np.unique(pair, return_counts=True)
            found.append((pair // p + r[lo], pair % p, count))
            lo = hi
        none = np.zeros(0, np.int64)
        r, p, both = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)
        either = np.diff(at)[r] + self.sizes[p] - both
        close = 100 * both >= max(1, 2 * percent - 100) * either
        return r[close], p[close], either[close], both[close]

    def done(self, row: np.ndarray, h: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
        """Rows that are linked to a pivot in whose window no unlinked class stands."""
        r, p, either, both = self.near(row, h, at, percent)
        inside = (100 * both >= percent * either) & (2 - percent / 100 - both / either + 1e-9 < self.outside[p])
        return r[inside]


def _near(sent, k: int, percent: int):
    """What a task learns of its classes' distances to pivots: a, b, apart.

    A link of each class to its first pivot within the radius, links that hold together the pivots that share a
    class (a row for each pivot at most), and for each pivot (a = b) the smallest distance of a class that isn't linked to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, shingles = sent.value, _Shingler(k)
        one = np.arange(len(pivots.nodes))
        outside = np.full(len(one), np.inf)
        for batch in batches:
            node = _column(batch, "node")
            for lo, _, row, h, at in shingles(batch):
                r, p, either, both = pivots.near(row, h, at, percent)
                linked = 100 * both >= percent * either
                np.minimum.at(outside, p[~linked], (1 - both / either)[~linked])
                r, p = r[linked], p[linked]
                own, first = np.unique(r, return_index=True)
                f = p[first][np.searchsorted(own, r)]
                while (one[f] != one[p]).any():
                    a, b = one[f], one[p]
                    low = np.minimum(a, b)
                    np.minimum.at(one, a, low)  # the labels themselves move, and with them all that bear them
                    np.minimum.at(one, b, low)
                    while (one[one] != one).any():
                        one = one[one]
                yield pa.RecordBatch.from_arrays([pa.array(node[lo + own]), pa.array(pivots.nodes[p[first]]), pa.nulls(len(own), pa.float64())], ["a", "b", "apart"])
        to = np.flatnonzero(one != np.arange(len(one)))
        yield pa.RecordBatch.from_arrays([pa.array(pivots.nodes[to]), pa.array(pivots.nodes[one[to]]), pa.nulls(len(to), pa.float64())], ["a", "b", "apart"])
        to = np.flatnonzero(np.isfinite(outside))
        yield pa.RecordBatch.from_arrays([pa.array(pivots.nodes[to]), pa.array(pivots.nodes[to]), pa.array(outside[to])], ["a", "b", "apart"])

    return run


def first_count(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n are compared: more than a partner can lack, and n / 8 besides."""
    return np.minimum(n, n - -(-percent * n // 100) + 1 + n // 8)


def least_shared(a: str, b: str, percent: int) -> str:
    """SQL: first shingles that two sets of these sizes share at least if they are within the radius."""
    first = lambda n: f"least({n}, {n} - ({percent} * {n} + 99) div 100 + 1 + {n} div 8)"
    need = f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}"
    return f"greatest(1, least({need} - {a} + {first(a)}, {need} - {b} + {first(b)}))"


def _signatures(common, sent, k: int, percent: int, buckets: int):
    """The first shingles of the classes that the pivots left open, dealt to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, shingles = _Lookup(common.value), _Shingler(k)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            m, node = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((m >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            m, node, bucket = m[order], node[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            end = np.append(at[1:], len(bucket))
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([m[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary()), pa.array([node[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary())], ["bucket", "prints", "nodes"])

        for batch in batches:
            node = _column(batch, "node")
            for lo, _, row, h, at in shingles(batch):
                late = np.zeros(len(h), bool)
                late[lookup(h)[0]] = True
                order = np.lexsort((h, late, row))
                rank = np.arange(len(h)) - at[row]
                is_open = np.ones(len(at) - 1, bool)
                is_open[sent.value.done(row, h, at, percent)] = False
                take = (rank < first_count(np.diff(at), percent)[row]) & is_open[row]
                held.append((T.mix(h[order][take]), node[lo + row[take]]))
                if sum(len(x) for x, _ in held) >= _SIGS:
                    yield dealt()
                    held.clear()
        if any(len(x) for x, _ in held):  # the pivots may have left none open
            yield dealt()

    return run


def _shared(buckets: int):
    """Of one bucket after another: the first shingles that several classes have, dealt anew.

    A shingle goes to the bucket of one class that has it, the one that comes first by a hash, so those that the same classes
    share meet in one bucket or a few, and a pair of classes is counted there and not in every bucket. A shingle of
    more than TOGETHER classes may go to as many buckets as it has TOGETHER classes, so that a large group isn't one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: dict[int, list[bytes]] = {}
        nodes: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, p, q in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                prints.setdefault(b, []).append(p)
                nodes.setdefault(b, []).append(q)
        for b in list(prints):
            f, node = np.frombuffer(b"".join(prints.pop(b)), np.uint64), np.frombuffer(b"".join(nodes.pop(b)), np.int64)
            order = np.argsort(f, kind="stable")
            f, node = f[order], node[order]
            same = np.zeros(len(f) + 1, bool)
            same[1:-1] = f[1:] == f[:-1]
            many = same[1:] | same[:-1]
            f, node = f[many], node[many]
            if not len(f):
                continue
            at = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
            n = np.diff(np.append(at, len(f)))
            low = np.minimum.reduceat(T.mix(node.view(np.uint64) + np.uint64(1)), at)
            part = T.mix(f[at]) % (-(-n // TOGETHER)).astype(np.uint64)
            to = np.repeat((T.mix(low + part) % np.uint64(buckets)).astype(np.int32), n)
            for i in range(0, len(f), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 200_000]), pa.array(f[i : i + 200_000].view(np.int64)), pa.array(node[i : i + 200_000])], ["bucket", "print", "node"])

    return run


def _pairs(percent: int):
    """Pairs of classes of different colours that share first shingles of this partition's buckets (see _shared), with how many.

    tag: 3 a pivot of all classes, 2 a pivot of all hot classes, 1 a hot class. What was measured isn't paired again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[_column(b, c) for c in ("print", "node", "n", "colour", "tag")] for b in batches]
        if not cols:
            return
        f, node, n, colour, tag = (np.concatenate(x) for x in zip(*cols, strict=True))
        del cols
        key = f  # says the bucket, too
        order = np.lexsort((colour, key))
        key, node, n, colour, tag = key[order], node[order], n[order], colour[order], tag[order]
        names, local = np.unique(node, return_inverse=True)
        size = np.zeros(len(names), np.int64)
        size[local] = n
        at = np.arange(len(key))
        last = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        run_end = last[np.searchsorted(last, at, "right")]
        last = np.append(np.flatnonzero((key[1:] != key[:-1]) | (colour[1:] != colour[:-1])) + 1, len(key))
        own_end = last[np.searchsorted(last, at, "right")]
        total = np.cumsum(run_end - own_end)
        held, kept, lo = [], 0, 0

        def counted():
            pair, c = np.unique(np.concatenate(held), return_counts=True)
            a, b = pair >> 32, pair & 0xFFFFFFFF
            return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b]), pa.array(size[a]), pa.array(size[b]), pa.array(c.astype(np.int64))], ["a", "b", "na", "nb", "c"])

        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 18), "right")))
            i = np.repeat(at[lo:hi], (run_end - own_end)[lo:hi])
            j = T.ranges(own_end[lo:hi], run_end[lo:hi])
            fits = (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])) & (np.maximum(tag[i], tag[j]) < 3)
            fits &= (np.maximum(tag[i], tag[j]) < 2) | (np.minimum(tag[i], tag[j]) < 1)
            x, y = local[i[fits]], local[j[fits]]
            held.append(np.minimum(x, y) << 32 | np.maximum(x, y))
            kept += len(x)
            lo = hi
            if kept > 1 << 20:
                yield counted()
                held, kept = [], 0
        if held:
            yield counted()

    return run


def _compared(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingler(k)
        for batch in batches:
            a, b = _column(batch, "a"), _column(batch, "b")
            linked = np.zeros(len(a), bool)
            for at in range(0, len(a), 200):
                part = batch.slice(at, 200)
                left = [h[x[i] : x[i + 1]] for lo, hi, _, h, x in shingles(part, "text_a", 1 << 20) for i in range(hi - lo)]
                right = [h[x[i] : x[i + 1]] for lo, hi, _, h, x in shingles(part, "text_b", 1 << 20) for i in range(hi - lo)]
                for j, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[at + j] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(linked)], ["a", "b", "linked"])

    return run


def _compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(_compared(k, percent), "a long, b long, linked boolean")


def _measured(texts: DataFrame, drawn: DataFrame, scratch: Scratch, name: str, k: int, percent: int) -> tuple[_Pivots, DataFrame]:
    """Pivots (node) with their sets, and the distances of all texts to them."""
    got = texts.join(F.broadcast(drawn), "node").select("node", "text").mapInArrow(_hashes(k, True), "node long, h binary").collect()
    sizes = np.array([len(r["h"]) // 8 for r in got], np.int64)
    pivots = _Pivots(np.array([r["node"] for r in got], np.int64), sizes, np.frombuffer(b"".join(r["h"] for r in got), np.uint64))
    sent = scratch.spark.sparkContext.broadcast(pivots)
    near = texts.select("node", "text").mapInArrow(_near(sent, k, percent), "a long, b long, apart double")
    return pivots, scratch.write(near, name)


def _stars(near: DataFrame) -> DataFrame:
    return near.filter("a <> b").select("a", "b")


def _windows(near: DataFrame, pivots: _Pivots) -> None:
    """For each pivot the smallest distance of a class that isn't linked to it."""
    rows = near.filter("apart is not null").groupBy("a").agg(F.min("apart").alias("outside")).collect()  # a row for each pivot
    outside = {r["a"]: r["outside"] for r in rows}
    pivots.outside = np.array([outside.get(n, np.inf) for n in pivots.nodes.tolist()])


def _coloured(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return components(scratch.write(links, f"{name}-edges"), scratch, name)


def classes_of(docs: DataFrame, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame]:
    """Each document's set (keys, n, d1, d2), and each class of equal sets with a member's text (node, n, text)."""
    meta = scratch.write(docs.select(*KEY, "text").mapInArrow(_digests(k), f"{KEY_TYPES}, n long, d1 long, d2 long"), "meta")
    classes = meta.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct(*KEY)).alias("rep"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("node"), "n", "d1", "d2", *[f"rep.{c}" for c in KEY]), "classes")
    texts = docs.select(*KEY, "text").join(classes.select("node", "n", *KEY), KEY)
    if meta.groupBy(*KEY).count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])  # a row that repeats stands once
    return meta, scratch.write(texts.select("node", "n", "text"), "texts")


def links(texts: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """node, label: how classes hang together; classes without links may lack."""
    spark = scratch.spark
    drawn = texts.filter((F.col("n") > 0) & (F.col("n") <= PIVOT_SIZE)).orderBy(F.xxhash64("node"), "node").limit(PIVOTS).select("node")
    pivots, near = _measured(texts, drawn, scratch, "near", k, percent)
    _windows(near, pivots)
    stars = _stars(near)
    tags = [(n, 3) for n in pivots.nodes.tolist()]
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(COMMON_OF)) == 0).select("node", "text").mapInArrow(_hashes(k, False), "h long")
    some = some.groupBy("h").count().filter(F.col("count") >= COMMON_COUNT).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    common = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in some], np.int64).view(np.uint64)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(pivots)
    sigs = texts.select("node", "text").mapInArrow(_signatures(common, sent, k, percent, buckets), "bucket int, prints binary, nodes binary")
    shared = scratch.write(sigs.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared(buckets), "bucket int, print long, node long"), "shared")
    # a class needs so many shared ones even with the smallest partner
    live = shared.groupBy("node").agg(F.count("*").alias("c")).join(texts.select("node", "n"), "node")
    live = live.filter(f"c >= {least_shared('n', f'(({percent} * n + 99) div 100)', percent)}").select("node", "n")
    live = scratch.write(live, "live")
    kept = scratch.write(shared.join(live, "node").select("bucket", "print", "node", "n"), "kept")
    scratch.drop("shared")
    # regions that hold many colours get pivots of their own, those first that no pivot is linked to yet
    label, hot = _coloured(stars, scratch, "colour"), None
    for i in range(ROUNDS):
        # pivots are measured already
        seen = spark.createDataFrame(tags, "node long, tag int")
        paint = live.select("node").join(F.broadcast(seen), "node", "left_anti").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("colour"))
        paint = scratch.write(paint, f"paint{i}")
        crowd = kept.join(paint, "node").groupBy("bucket", "print").agg(F.approx_count_distinct("colour", 0.1).alias("colours")).filter(F.col("colours") > CROWD)
        crowd = scratch.write(crowd, f"crowd{i}")
        inside = kept.join(crowd, ["bucket", "print"]).groupBy("node").agg(F.max("colours").alias("colours"))
        inside = scratch.write(inside.join(paint, "node"), f"inside{i}")
        if inside.count() < REGION_ROWS:
            break
        if hot is None:
            hot = scratch.write(texts.join(inside.select("node"), "node", "left_semi"), "hot")
        alone = F.col("colour") == F.col("node")
        drawn = hot.filter(F.col("n") <= REGION_PIVOT_SIZE).select("node").join(inside, "node").orderBy(F.desc("colours"), F.desc(alone), F.xxhash64("node", F.lit(i)), "node").limit(REGION_PIVOTS).select("node")
        more, near = _measured(hot, drawn, scratch, f"near{i}", k, percent)
        tags += [(n, 2) for n in more.nodes.tolist()]
        stars = stars.union(_stars(near))
        label = _coloured(stars, scratch, f"colour{i}")
    seen = spark.createDataFrame(tags, "node long, tag int")
    marks = live.select("node").join(label, "node", "left").join(F.broadcast(seen), "node", "left")
    if hot is not None:
        marks = marks.join(hot.select("node", F.lit(1).alias("hot")), "node", "left")
    else:
        marks = marks.withColumn("hot", F.lit(0))
    marks = scratch.write(marks.select("node", F.coalesce("label", "node").alias("colour"), F.greatest(F.coalesce("tag", F.lit(0)), F.coalesce("hot", F.lit(0))).alias("tag")), "marks")
    rows = kept.join(marks, "node").repartitionById(buckets, F.col("bucket"))
    pairs = rows.mapInArrow(_pairs(percent), "a long, b long, na long, nb long, c long").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    pairs = pairs.filter(f"c >= {least_shared('na', 'nb', percent)}")
    pairs = scratch.write(pairs.select("a", "b", (F.col("c") / F.col("na")).alias("likely")), "pairs")
    scratch.drop("kept", "live")
    # the likeliest partner of each first; then what is not held together yet
    ends = pairs.select(F.col("a").alias("node"), F.struct("likely", (-F.col("b")).alias("other")).alias("x")).union(pairs.select(F.col("b").alias("node"), F.struct("likely", (-F.col("a")).alias("other")).alias("x")))
    best = ends.groupBy("node").agg(F.max("x").alias("x")).select("node", (-F.col("x.other")).alias("other"))
    best = scratch.write(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "best")
    held = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = scratch.write(texts.hint("merge").join(held, "node", "left_semi").select("node", "text"), "held")
    checked = scratch.write(_compare(best, held, k, percent), "checked")
    edges = stars.union(checked.filter("linked").select("a", "b"))
    label = _coloured(edges, scratch, "first")
    rest = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(best, ["a", "b"], "left_anti")
    la, lb = (label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    rest = rest.join(la, "a", "left").join(lb, "b", "left").filter("la is null or lb is null or la <> lb")
    rest = scratch.write(rest.select("a", "b"), "rest")
    if not rest.limit(1).count():
        return label
    more = scratch.write(_compare(rest, held, k, percent).filter("linked").select("a", "b"), "more")
    if not more.limit(1).count():
        return label
    return _coloured(edges.union(more), scratch, "second")


def near_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """k0, k1, k2 (see keys), n_shingles, component, label: the documents in groups that hang together by links.

    A set: the distinct k-word shingles of the text, A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; with fewer
    words the whole sequence as one. Two documents link if 100 * intersection >= percent * union; an empty
    set (null text, no words) links with nothing. component: the smallest k0 of the group, which is the
    smallest doc_id (null the lowest). Rows that repeat, also in doc_id, are rows of one group. Groups that are not
    linked can share a doc_id and so a component; label tells them apart (null: an empty set, a group of its own row).
    Other columns of docs are ignored. An empty table gives no rows.
    """
    docs = keyed(docs)
    scratch = Scratch(docs.sparkSession, "jaccard")
    meta, texts = classes_of(docs, scratch, k)
    label = links(texts, scratch, k, percent)
    scratch.drop("texts", "held", "hot", "pairs", "near")
    classes = scratch.read("classes", scratch.spark.read.parquet(f"{scratch.root}/classes")).select("node", "n", "d1", "d2")
    group = scratch.write(classes.join(label, "node", "left").select("n", "d1", "d2", F.coalesce("label", "node").alias("label")), "group")
    low = scratch.write(meta.join(group, ["n", "d1", "d2"], "left").select(*KEY, "n", "label"), "low")
    least = scratch.write(low.filter("label is not null").groupBy("label").agg(F.min("k0").alias("component")), "least")
    return low.join(least, "label", "left").select(*KEY, F.col("n").alias("n_shingles"), F.coalesce("component", "k0").alias("component"), "label")
