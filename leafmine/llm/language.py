"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone. A trigram's vector is the product of its
letters' vectors, turned by two, one and no places so that order counts. The sum over all trigrams of a text is its profile, the
sum over the profiles of a language's documents that language's prototype, and the prototype with the largest cosine wins.

Texts are read as lower-case letters; whatever stands between letters is one gap. Profiles are whole numbers, so the
order in which tasks and batches come changes nothing.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from leafmine.llm import textops as T

#: Length of a vector.
DIM = 1024
#: Documents of a language that its prototype is learned from, on average; and languages at most, the most frequent first.
DOCS_PER_LANGUAGE, LANGUAGES = 4_000, 1_000
#: A text of no letter has this language.
UNKNOWN = "und"
#: Sum of the weights of one document's trigrams in a prototype.
_WEIGHT = 1 << 16
#: Code points, rows and trigrams that are worked on at once; longer texts come in pieces.
_POINTS, _ROWS, _GRAMS = 1 << 19, 1024, 4096


@dataclass
class Letters:
    """Numbers and vectors of the letters met so far. Number 0 is the gap between words."""

    dim: int = DIM
    number: np.ndarray = field(default_factory=lambda: np.full(0x110000, -1, np.int32))
    points: list[int] = field(default_factory=lambda: [0])
    vectors: np.ndarray | None = None

    def numbers(self, points: np.ndarray) -> np.ndarray:
        out = self.number[points]
        for p in np.unique(points[out < 0]).tolist():
            low = chr(p).lower()[0] if chr(p).isalpha() else ""
            if not low:
                self.number[p] = 0
                continue
            if self.number[ord(low)] < 0:
                self.number[ord(low)] = len(self.points)
                self.points.append(ord(low))
            self.number[p] = self.number[ord(low)]
        return self.number[points]

    def table(self) -> np.ndarray:
        """A row of +1 and -1 for each letter."""
        have = 0 if self.vectors is None else len(self.vectors)
        if have < len(self.points):
            new = [np.random.default_rng([17, p]).integers(0, 2, self.dim, np.int8) * 2 - 1 for p in self.points[have:]]
            self.vectors = np.array(new) if self.vectors is None else np.concatenate([self.vectors, new])
        return self.vectors

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """The vector of each trigram, as single-precision numbers."""
        n, v = len(self.points), self.table()
        first, second, third = codes // (n * n), codes // n % n, codes % n
        return (np.roll(v[first], 2, 1) * np.roll(v[second], 1, 1) * v[third]).astype(np.float32)


def _collapsed(numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One gap of each run of gaps in a row."""
    keep = numbers != 0
    keep[1:] |= (numbers[:-1] != 0) | (row[1:] != row[:-1])
    keep[:1] = True
    return numbers[keep], row[keep]


def _add(out: np.ndarray, seq: np.ndarray, row: np.ndarray, letters: Letters) -> None:
    """Add the vectors of all trigrams of each row; they are exact, as counts stay under 2^24."""
    n = len(letters.points)
    inside = row[2:] == row[:-2]
    codes, row = ((seq[:-2] * n + seq[1:-1]) * n + seq[2:])[inside], row[:-2][inside]
    if n**3 <= 1 << 20:  # few letters: numbers of kinds from a table, without sorting
        seen = np.bincount(codes, minlength=n**3) > 0
        kinds, which = np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]
    else:
        kinds, which = np.unique(codes, return_inverse=True)
    for k in range(0, len(kinds), _GRAMS):
        width = min(_GRAMS, len(kinds) - k)
        some = slice(None) if len(kinds) <= _GRAMS else (which >= k) & (which < k + width)
        counts = np.bincount(row[some] * width + which[some] - k, minlength=len(out) * width).reshape(len(out), width)
        out += counts.astype(np.float32) @ letters.grams(kinds[k : k + width])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def profiles(column: pa.Array, letters: Letters) -> Iterator[np.ndarray]:
    """Profiles of the rows, some rows at a time; a text without letters has zeros. A long text comes in pieces,
    each after the last two symbols of the one before."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(size):
        to = at + max(1, min(_ROWS, int(np.searchsorted(np.cumsum(size[at : at + _ROWS]), _POINTS, "right"))))
        out = np.zeros((to - at, letters.dim))
        if size[at] > _POINTS:
            text, tail = column[at].as_py(), np.zeros(1, np.int64)
            for k in range(0, len(text), _POINTS):
                seq = np.concatenate([tail, letters.numbers(_points(text[k : k + _POINTS])), np.zeros(int(k + _POINTS >= len(text)), np.int64)])
                seq, row = _collapsed(seq, np.zeros(len(seq), np.int64))
                _add(out, seq, row, letters)
                tail = seq[-2:]
        else:
            row = np.repeat(np.arange(to - at), size[at:to] + 2)
            seq = np.zeros(len(row), np.int64)
            begin = np.cumsum(size[at:to] + 2) - size[at:to] - 1
            seq[T.ranges(begin, begin + size[at:to])] = letters.numbers(_points("".join(column.slice(at, to - at).to_pylist())))
            _add(out, *_collapsed(seq, row), letters)
        yield out
        at = to
    T.release()


@dataclass
class Prototypes:
    """names in order, a unit vector for each."""

    names: list[str]
    vectors: np.ndarray

    def predict(self, profile: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The closest language of each row (of equal ones the first by name), and its cosine, 0 at least."""
        length = np.sqrt((profile**2).sum(1))
        if not self.names:
            return [UNKNOWN] * len(profile), np.zeros(len(profile))
        cosine = (profile @ self.vectors.T / np.maximum(length, 1e-9)[:, None]).clip(0, 1).round(9)
        best = cosine.argmax(1)
        known = length > 0
        # a profile can be zero where vectors cancel each other; such a text has letters, but no direction
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, cosine[np.arange(len(best)), best], 0.0)


def held_out(doc_id: Column) -> Column:
    """Rows that no prototype learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A language's sum over the rows of this task; each document weighs the same."""
    letters, total = Letters(), {}
    for batch in batches:
        lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        at = 0
        for profile in profiles(batch.column(batch.schema.get_field_index("text")), letters):
            length = np.sqrt((profile**2).sum(1, keepdims=True))
            whole = np.rint(profile * (_WEIGHT / np.maximum(length, 1e-9))).astype(np.int64)
            for i, name in enumerate(lang[at : at + len(profile)]):
                total[name] = total.get(name, 0) + whole[i]
            at += len(profile)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.int64()))], ["lang", "total"])


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, languages: int = LANGUAGES) -> Prototypes:
    """Prototypes from text and lang of documents that are not held out.

    Rows without doc_id, text or lang teach nothing. Of a language with more documents than `docs_per_language`, a share of so many on
    average is taken by a hash of doc_id (rows of one id go together); of more than `languages` languages the most frequent
    count, of equal ones the first by name. What reaches the driver is a sum for each language and task, with
    as many tasks as `docs_per_language` / 500, at least one.
    """
    known = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang")).dropna()
    rates = known.groupBy(F.col("lang").alias("name")).count().orderBy(F.desc("count"), "name").limit(languages)
    rates = rates.select("name", (F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.col("count")) * (1 << 31)).alias("below"))
    some = known.join(F.broadcast(rates), F.col("lang") == F.col("name")).filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < F.col("below"))
    tasks = max(1, docs_per_language // 500)
    got = some.select("doc_id", "text", "lang").repartition(tasks, "doc_id").select("text", "lang").mapInArrow(_summed, "lang string, total array<long>").collect()
    total: dict[str, np.ndarray] = {}
    for r in got:
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["total"], np.int64)
    total = {k: v for k, v in sorted(total.items()) if v.any()}
    vectors = np.array([v / np.sqrt((v.astype(float) ** 2).sum()) for v in total.values()]).reshape(len(total), -1 if total else 0)
    return Prototypes(list(total), vectors)


def _predicted(model: Prototypes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for profile in profiles(batch.column(batch.schema.get_field_index("text")), letters):
                name, score = model.predict(profile)
                names += name
                scores.append(score)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(names, pa.string()), pa.array(np.concatenate(scores))], [*[batch.schema.names[i] for i in keep], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Prototypes) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 to 1) of each row, from its whole text alone.

    A null text, an empty one or one without letters has `und` and 0; so has every text if no language was learned. Repeated
    rows and ids stay rows of their own; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    kinds = StructType([rows.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_predicted(model), kinds)
