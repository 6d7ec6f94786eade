"""Substring dedup by seed and extend.

Seeds: a window of `length` words always picks the same k-gram of its own (the smallest hash, of equal
ones the rightmost), so two equal windows pick equal seeds at equal places. Each seed owns the run of
windows that picked it. Seeds that occur once are dropped; the others are extended: occurrences of a
seed whose whole runs agree are one class, and where a seed has several classes, one member of each
is extended window by window, to the left and right as far as its run goes. Windows that repeat side by side are
one match, and matches that meet or overlap in a document, also those of neighbouring seeds, are one stretch:
it can't be made longer to either side. Work follows occurrences and classes, never pairs of occurrences.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.llm import textops as T
from leafmine.llm.keys import KEY, KEY_TYPES, keyed
from leafmine.llm.scratch import Scratch

LENGTH, SEED = 35, 6
_CLASS = ["a", "c1", "c2"]


def _digests(h1, h2, s1, s2, data, offsets):
    """Words with two independent hashes each, and their running sums."""
    start, end, first = T.words(data, offsets)
    w1 = h1.spans(h1.sums(data), start, end)
    w2 = h2.spans(h2.sums(data), start, end)
    return start, end, first, w1, T.rolling(w1, s1), T.rolling(w2, s2)


def _seeds(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, s1, s2 = T.Hasher(), T.Hasher(seed=1), T.Hasher(seed=2), T.Hasher(seed=3)
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in KEY]
            for lo, hi, data, offsets in T.rows(batch):
                start, _, first, w1, r1, r2 = _digests(h1, h2, s1, s2, data, offsets)
                if len(start) < length:
                    continue
                row = np.repeat(np.arange(lo, hi), np.diff(first))
                g = T.grams(w1, k)
                pick = T.sliding_argmin(g, length - k + 1)
                own = np.flatnonzero(row[: len(pick)] == row[length - 1 :])  # windows inside one row
                if not len(own):
                    continue
                new = np.ones(len(own), bool)
                new[1:] = (pick[own[1:]] != pick[own[:-1]]) | (row[own[1:]] != row[own[:-1]])
                ws = own[new]
                we = own[np.append(np.flatnonzero(new)[1:], len(own)) - 1]
                r, base = row[ws], first[row[ws] - lo]
                # the place of the seed in its run belongs to the class
                c1 = s1.spans(r1, ws, we + length) + (pick[ws] - ws).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x[r]) for x in keys], pa.array(T.signed(g[pick[ws]])), pa.array((ws - base).astype(np.int32)), pa.array((we - base).astype(np.int32)), pa.array(T.signed(c1)), pa.array((s2.spans(r2, ws, we + length) >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                    [*KEY, "a", "ws", "we", "c1", "c2"],
                )

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, s1, s2 = T.Hasher(), T.Hasher(seed=1), T.Hasher(seed=2), T.Hasher(seed=3)
        for batch in batches:
            runs = batch.column(batch.schema.get_field_index("runs"))
            at = runs.offsets.to_numpy()
            at = at - at[0]
            f = {c: runs.flatten().field(i).to_numpy() for i, c in enumerate(("a", "c1", "c2", "ws", "we", "n"))}
            for lo, hi, data, offsets in T.rows(batch):
                _, _, first, _, r1, r2 = _digests(h1, h2, s1, s2, data, offsets)
                pick = slice(at[lo], at[hi])
                base = np.repeat(first[:-1], np.diff(at[lo : hi + 1]))
                ws, we = f["ws"][pick] + base, f["we"][pick] + base
                i = T.ranges(ws, we + 1)
                of = np.repeat(np.arange(pick.start, pick.stop), we + 1 - ws)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[c][of]) for c in _CLASS] + [pa.array((i - np.repeat(ws, we + 1 - ws)).astype(np.int32)), pa.array(T.signed(s1.spans(r1, i, i + length))), pa.array(T.signed(s2.spans(r2, i, i + length))), pa.array(f["n"][of])],
                    [*_CLASS, "off", "h1", "h2", "n"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        cover = batch.column(batch.schema.get_field_index("cover")).fill_null([])
        at = cover.offsets.to_numpy()
        at = at - at[0]
        s, e = (cover.flatten().field(i).to_numpy() for i in range(2))
        for lo, hi, data, offsets in T.rows(batch):
            start, end, first = T.words(data, offsets)
            base = np.repeat(first[:-1], np.diff(at[lo : hi + 1]))
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, s[at[lo] : at[hi]] + base, 1)
            np.add.at(edge, e[at[lo] : at[hi]] + base, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept, to = T.joined(data, offsets, start, end, first, keep)
            texts = [kept[a : max(a, b - 1)] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            removed = np.concatenate(([0], np.cumsum(~keep)))[first]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )


def covered(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """The word ranges of each document that repeat somewhere: keys, cover array<struct<s, e>>. docs: from keyed()."""
    seeds = docs.select(*KEY, "text").mapInArrow(_seeds(length, k), f"{KEY_TYPES}, a long, ws int, we int, c1 long, c2 int")
    seeds = scratch.write(seeds, "seeds")
    twice = scratch.write(seeds.groupBy("a").count().filter("count > 1").select("a"), "twice")
    live = scratch.write(seeds.join(twice, "a"), "live")
    scratch.drop("seeds", "twice")
    firsts = [F.first(c).alias(c) for c in (*KEY, "ws", "we")]
    classes = scratch.write(live.groupBy(*_CLASS).agg(F.count("*").alias("n"), *firsts), "classes")
    several = scratch.write(classes.groupBy("a").count().filter("count > 1").select("a"), "several")
    runs = classes.join(several, "a").groupBy(*KEY).agg(F.collect_list(F.struct(*_CLASS, "ws", "we", "n")).alias("runs"))
    # rows that agree in key are one text, of which one copy is enough here
    windows = docs.select(*KEY, "text").join(runs, KEY).mapInArrow(_windows(length), "a long, c1 long, c2 int, off int, h1 long, h2 long, n long")
    windows = scratch.write(windows, "windows")
    place = F.xxhash64(*_CLASS, "off")
    again = windows.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("n").alias("n"))
    again = scratch.write(again.filter("p < q or n > 1").select("h1", "h2"), "again")
    parts = windows.join(again, ["h1", "h2"]).groupBy(*_CLASS).agg(F.collect_set("off").alias("offs"))
    # windows that repeat side by side are one match, as long as it can be: words from the start of the run
    first, last = (F.filter("offs", lambda o: ~F.array_contains("offs", o + step)) for step in (-1, 1))
    longest = F.zip_with(F.array_sort(first), F.array_sort(last), lambda a, b: F.struct(a.alias("s"), (b + length).alias("e")))
    found = classes.select(*_CLASS, "n", (F.col("we") - F.col("ws") + length).alias("all")).join(parts, _CLASS, "left").filter("n > 1 or offs is not null")
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("all").alias("e")))
    found = scratch.write(found.select(*_CLASS, F.when(F.col("n") > 1, whole).otherwise(longest).alias("matches")), "found")
    cover = live.join(found, _CLASS).select(*KEY, F.transform("matches", lambda m: F.struct((F.col("ws") + m["s"]).alias("s"), (F.col("ws") + m["e"]).alias("e"))).alias("c"))
    return scratch.write(cover.groupBy(*KEY).agg(F.flatten(F.collect_list("c")).alias("cover")), "cover")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of each document that meet or overlap made one: a stretch begins where all before it have ended."""
    for batch in batches:
        cover = batch.column(batch.schema.get_field_index("cover"))
        row = np.repeat(np.arange(len(cover)), cover.value_lengths().to_numpy())
        s, e = (cover.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
        order = np.lexsort((s, row))
        row, s, e = row[order], s[order], e[order]
        far = np.int64(1) << 32
        reach = np.maximum.accumulate(row * far + e)
        new = np.ones(len(s), bool)
        new[1:] = row[1:] * far + s[1:] > reach[:-1]
        at = np.flatnonzero(new)
        end = (reach - row * far)[np.append(at[1:], len(s)) - 1] if len(s) else s
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row[at])), pa.array(s[at]), pa.array(end)], ["doc_id", "start", "end"])


def stretches(docs: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """doc_id, start, end (words): the longest stretches of each text in which every word is covered by a window that repeats.
    Each row has its own, also if rows repeat. See remove_repeats()."""
    docs = keyed(docs)
    cover = covered(docs, Scratch(docs.sparkSession, "stretches"), length, k)
    return docs.join(cover, KEY).select("doc_id", "cover").mapInArrow(_joined, "doc_id long, start long, end long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each text without the words that a repeated window covers.

    A window is `length` consecutive words `[^\\x20\\x09-\\x0D]+` of one document; it repeats if its word
    sequence starts anywhere else, in the same document too. Null text: no words. A text shorter than a
    window, or an empty table: nothing is removed. Repeated rows repeat each other's windows. Other
    columns of docs are ignored. Kept words are joined by one space.
    """
    if not 1 <= k <= length:
        raise ValueError("the seed must fit into the window")
    docs = keyed(docs)
    scratch = Scratch(docs.sparkSession, "repeats")
    cover = covered(docs, scratch, length, k)
    scratch.drop("live", "classes", "several", "windows", "again", "found")
    return docs.join(cover, KEY, "left").select("doc_id", "text", "cover").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
