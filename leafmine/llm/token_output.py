"""Token-ID output: whole texts as ids of a public tokenizer, written in order of doc_id as compressed segments.

A part is a range of documents that one task tokenizes and codes; its segments hold whole documents, so
each row of the written table is a unit of its own: which documents, how many ids each, how many ids of
the part come before, and the coded ids (see range_coder).
"""

import json
import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.llm import range_coder
from leafmine.llm import textops as T

END_ID = 2
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = range_coder.BLOCK * 4096
#: Pieces whose ids a worker remembers, in about 45 MB.
WORDS_KEPT = 1_250_000
#: Bytes of text that are encoded at once: an executor's workers share its memory with a JVM that earlier stages have filled.
ENCODED_BYTES = 1 << 18
SEGMENT = "part int, segment int, ids_before long, doc_ids array<long>, n_tokens array<int>, payload binary"


class _Plain:
    """Ids of whole texts from any tokenizer, one text at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, each with the end id, and how many each text has."""
        raw = data.tobytes()
        got = [[*self.ids_of(raw[a:b].decode("utf-8", "replace")), END_ID] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for ids in got for x in ids), self.kind, int(n.sum())), n

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


# How a tokenizer must normalise and split texts for _Pieces.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kinds() -> np.ndarray:
    """Of each byte: 1 a letter, 2 a digit, 3 another printable sign, 0 a sign whose piece the tokenizer must find itself."""
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = 3
    for low, high, kind in ((0x30, 0x3A, 2), (0x41, 0x5B, 1), (0x61, 0x7B, 1)):
        out[low:high] = kind
    out[ord("'")] = 0  # begins a piece of its own before some letters
    return out


def _signs() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the signs from 256 on, in order."""
    other = (b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))
    return {b: 256 + i for i, b in enumerate(other)}


class _Pieces(_Plain):
    """Ids of texts from those of their pieces, for tokenizers that lower-case, drop white space and never join across
    it (see applies()). Pieces are runs of Latin letters, single digits, and runs of other ASCII signs; a word
    with anything else (or with what could be a special token) is a piece as a whole. Each worker encodes a piece
    once and finds its ids by a hash again."""

    BITS = 21

    def __init__(self, path: str):
        super().__init__(path)
        self.hasher, self.kinds, self.signs = T.Hasher(lower=True, seed=9), _kinds(), _signs()
        self.clear()

    @staticmethod
    def applies(path: str) -> bool:
        """Whether the tokenizer's own file says that it works on pieces, and lower-cased ones."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, split, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
        steps = [x["type"] for x in normal.get("normalizers", [])]
        parts = split.get("pretokenizers", [])
        fits = steps == _NORMALIZER and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and normal["normalizers"][1]["content"] == " "
        fits = fits and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _SPLIT} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        fits = fits and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"] and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        return bool(fits) and all("<|" in x["content"] and not x["normalized"] and not x["lstrip"] and not x["rstrip"] for x in spec["added_tokens"])

    def clear(self) -> None:
        self.keys, self.place = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32)
        # number 0 is no piece, and the end id lies at place 0
        self.at, self.n = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.ids = np.full(1, END_ID, self.kind)
        self.known = 1

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pieces by their hashes; 0 where one is not known. Eight slots from a hash's own hold it."""
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.place[slot], 0)
        todo = np.flatnonzero((out == 0) & (self.keys[slot] != 0))
        for step in range(1, 8):
            s = slot[todo] + step & (1 << self.BITS) - 1
            k = self.keys[s]
            same = k == h[todo]
            out[todo[same]] = self.place[s[same]]
            todo = todo[~same & (k != 0)]
            if not len(todo):
                break
        return out

    def _keep(self, h: np.ndarray, number: np.ndarray) -> None:
        """Enter new hashes; one whose slots are all taken is not kept, and so encoded again where it recurs."""
        for step in range(8):
            s = (h >> np.uint64(64 - self.BITS)).astype(np.int64) + step & (1 << self.BITS) - 1
            free = np.flatnonzero(self.keys[s] == 0)
            s, first = np.unique(s[free], return_index=True)
            done = free[first]
            self.keys[s], self.place[s] = h[done], number[done]
            rest = np.ones(len(h), bool)
            rest[done] = False
            h, number = h[rest], number[rest]
            if not len(h):
                break

    def _learn(self, single: list[str], whole: list[str]) -> None:
        """Ids of pieces that are one for the tokenizer, too, and of words whose pieces only it can tell."""
        model = self.tokenizer.model
        # what the model itself reads: lower-cased, and each byte as its sign
        got = [[t.id for t in model.tokenize(w.lower().encode().decode("latin-1").translate(self.signs))] for w in single]
        got += [self.ids_of(w) for w in whole]
        n = np.fromiter(map(len, got), np.int32, len(got))
        self.at = np.concatenate((self.at, (len(self.ids) + np.cumsum(n) - n).astype(np.int32)))
        self.n = np.concatenate((self.n, n))
        self.ids = np.concatenate((self.ids, np.fromiter((x for w in got for x in w), self.kind, int(n.sum()))))

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Start and end of each piece, the first piece of each text, and which pieces are whole words."""
        start, end, _ = T.words(data, offsets)
        kind = self.kinds[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # of Latin-1's letters
        lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        bar = np.flatnonzero(data == ord("|"))
        bar = bar[(bar > 0) & (data[bar - 1] == ord("<"))]
        odd = np.concatenate((np.flatnonzero((kind == 0) & ~T.SPACE[data]), bar))
        whole = np.unique(np.searchsorted(start, odd, "right") - 1)
        # inside the other words, a piece begins where the kind changes, and at each digit
        cut = np.zeros(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[1:-1] |= kind[1:] == 2
        cut[1:-1] &= (kind[1:] != 0) & (kind[:-1] != 0)
        for i in whole.tolist():
            cut[start[i] : end[i]] = False
        cut[start] = False
        edge = cut[:-1].copy()
        edge[start] = True
        at = np.flatnonzero(edge)
        stop = np.append(at[1:], len(data))
        stop[np.append(~cut[at[1:]], True)[: len(at)]] = end  # the last pieces of words
        alone = np.zeros(len(at), bool)
        alone[np.searchsorted(at, start[whole])] = True
        return at, stop, np.searchsorted(at, offsets), alone

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(offsets) == 2 and len(data) > 2 * T.SLICE_BYTES:
            return self._long(data)
        start, end, first, whole = self._cut(data, offsets)
        h = self.hasher.spans(self.hasher.sums(data), start, end) | np.uint64(1)
        # upper and lower case count in special tokens, so words that may hold one are never remembered
        special = np.flatnonzero(whole)
        special = special[[b"<|" in data[a:b].tobytes() for a, b in zip(start[special].tolist(), end[special].tolist(), strict=True)]] if len(special) else special
        number = self._find(h)
        number[special] = 0
        new = np.flatnonzero(number == 0)
        if len(new):
            if self.known + len(new) > WORDS_KEPT:  # forget all and begin anew
                self.clear()
                number = self._find(h)
                new = np.arange(len(h))
            h[special] = np.uint64(2) * np.arange(len(special), dtype=np.uint64)  # one by one, and even
            keys, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            order = np.argsort(whole[where], kind="stable")  # single pieces first
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) + self.known
            raw, of, n = data.tobytes(), where[order], int((~whole[where]).sum())
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[of].tolist(), end[of].tolist(), strict=True)]
            self._learn(texts[:n], texts[n:])
            self.known += len(keys)
            number[new] = rank[back]
            kept = (keys & np.uint64(1)).astype(bool)
            self._keep(keys[kept], rank[kept])
        at, n = self.at[number], self.n[number]
        # the end id as one more piece of each text
        at, n = np.insert(at, first[1:], 0), np.insert(n, first[1:], 1)
        first = first + np.arange(len(first))
        total = np.concatenate(([0], np.cumsum(n)))
        return self.ids[T.ranges(at, at + n)], np.diff(total[first])

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A long text in slices that end before white space, so that memory doesn't follow its length."""
        got, lo = [], 0
        while lo < len(data):
            hi = min(lo + T.SLICE_BYTES, len(data))
            if hi < len(data):
                space = np.flatnonzero(T.SPACE[data[hi:]])[:1] if not T.SPACE[data[lo + 1 : hi]].any() else np.flatnonzero(T.SPACE[data[lo + 1 : hi]])[-1:] + lo + 1 - hi
                hi = hi + int(space[0]) if len(space) else len(data)
            got.append(self.encode(data[lo:hi], np.array([0, hi - lo]))[0][:-1])
            lo = hi
        got.append(np.array([END_ID], self.kind))
        return np.concatenate(got), np.array([sum(map(len, got))])


def _vocabulary(path: str) -> _Plain:
    """One for each worker process, kept between tasks."""
    kept = sys.modules.setdefault("_leafmine_worker", types.ModuleType("_leafmine_worker")).__dict__
    if path not in kept:
        kept[path] = _Pieces(path) if _Pieces.applies(path) else _Plain(path)
    return kept[path]


def _written(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(tokenizer)
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, held, total = [], [], [], 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            payload = range_coder.encode(ids)
            del ids
            T.release()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
                ["part", "segment", "ids_before", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, offsets in T.rows(batch, limit=ENCODED_BYTES):
                got, n = vocabulary.encode(data, offsets)
                doc_ids += keys.slice(lo, hi - lo).to_pylist()
                sizes.append(n)
                held.append(got)
                total += len(got)
                if total >= SEGMENT_IDS:
                    yield made()
                    segment, before = segment + 1, before + total
                    doc_ids, sizes, held, total = [], [], [], 0
        if held:
            yield made()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, parts: int | None = None) -> None:
    """Write docs (doc_id, text) as segments under path, in ascending order of doc_id (null first), of equal
    ids by a hash of the text. Null text is empty and has the end id only; rows that repeat stay; other columns are ignored.

    A part is a range of that order, so an id (or null) that many rows share is dealt to several parts."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_written(tokenizer), SEGMENT).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
        for i in range(len(batch)):
            ids = range_coder.decode(get("payload")[i].as_py())
            n = get("n_tokens")[i].values.to_numpy()
            end = np.cumsum(n.astype(np.int64))
            start = end - n
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([get("doc_ids")[i].values, pa.array(start + get("before")[i].as_py()), pa.array(n.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before it, over all parts), n_tokens, ids_crc32 of every document, from the coded ids."""
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.max(F.col("ids_before") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()  # a number for each part
    rows, at = [], 0
    for r in sorted(totals):
        rows.append((r["part"], at))
        at += r["n"]
    base = spark.createDataFrame(rows, "part int, base long")
    files = files.join(F.broadcast(base), "part").select("doc_ids", "n_tokens", "payload", (F.col("base") + F.col("ids_before")).alias("before"))
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(files: DataFrame) -> DataFrame:
    """doc_id, ids: the ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, n = range_coder.decode(batch.column(2)[i].as_py()), batch.column(1)[i].values.to_numpy()
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return files.select("doc_ids", "n_tokens", "payload").mapInArrow(run, "doc_id long, ids array<int>")
