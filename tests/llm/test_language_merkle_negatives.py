"""Language profiles, the Merkle manifest and hard negatives against brute force, on rows with nulls, empty and long texts, ties,
repeated rows and clashing column names, and on empty tables."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafmine.llm import hard_negatives, language, merkle
from leafmine.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, group string, rank string, hash string, score string, path string"


def _docs() -> list[tuple]:
    rng = np.random.default_rng(3)
    kinds = {"aa": ["tal", "lor", "mir", "sen"], "bb": ["öwü", "ßka", "küd", "äng"], "cc": ["zhi", "qux", "vex", "wyn"]}
    make = lambda lang, n: " ".join("".join(rng.choice(kinds[lang], 2)) for _ in range(n))
    rows = [(i, make(lang := list(kinds)[i % 3], int(rng.integers(5, 60))), lang, f"s{i % 4}" if i % 6 else None, i) for i in range(90)]
    rows += [(90, None, "aa", "s1", None), (91, "", "bb", "s1", 0), (92, "12 !? 34\n", None, "s2", 9), (93, "A", "aa", "", 1), (94, make("bb", 9).upper() + "\n\n", None, "s1", 5), (None, make("cc", 9) + "\n", "cc", None, 5), (None, None, None, None, None)]
    rows += [rows[4], rows[4], (4, "another text\nof this id", "aa", rows[4][3], 1), (4, None, "aa", rows[4][3], 1), (200, "alone", "aa", "solo", 5)]
    return [(*r, "g", "r", "h", "s", "p") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def _profile(text: str, letters: language.Letters) -> np.ndarray:
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    line = f" {' '.join(words)} " if words else ""
    vector = lambda c: np.random.default_rng([17, 0 if c == " " else ord(c)]).integers(0, 2, letters.dim, np.int8).astype(int) * 2 - 1
    out = np.zeros(letters.dim)
    for gram, n in Counter(line[i : i + 3] for i in range(len(line) - 2)).items():
        a, b, c = map(vector, gram)
        out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_profiles(rows, monkeypatch):
    monkeypatch.setattr(language, "_POINTS", 64)  # many texts come in pieces
    monkeypatch.setattr(language, "_GRAMS", 7)
    texts = [r[1] for r in rows] + ["x" * 200, "a" * 63 + "  b" * 50, " " * 130 + "ab", "İǅ ß"]
    letters = language.Letters(64)
    got = np.concatenate(list(language.profiles(pa.array(texts, pa.string()), letters)))
    for text, have in zip(texts, got, strict=True):
        assert (have == _profile(text or "", letters)).all(), text


def test_many_letters():
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    assert (next(language.profiles(pa.array([text]), letters := language.Letters(32)))[0] == _profile(text, letters)).all()


def test_language(spark, docs, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    model = language.train(docs)
    letters, total = language.Letters(), defaultdict(int)
    for i, text, lang, *_ in rows:
        p = _profile(text or "", letters)
        if not held(i) and i is not None and lang is not None and p.any():
            total[lang] = total[lang] + np.rint(p * (65536 / np.sqrt((p**2).sum()))).astype(np.int64)
    assert model.names == sorted(total)
    for name, v in zip(model.names, model.vectors, strict=True):
        assert np.allclose(v, total[name] / np.sqrt((total[name].astype(float) ** 2).sum()))
    got = sorted(map(tuple, language.identify(docs, model).collect()), key=repr)
    assert len(got) == len(rows)
    want = []
    for i, text, *_ in rows:
        p = _profile(text or "", letters)
        score = {n: round(max(0.0, float(p @ v) / math.sqrt(p @ p)), 6) if p.any() else 0.0 for n, v in zip(model.names, model.vectors, strict=True)}
        best = max(model.names, key=score.get) if p.any() else "und"
        want.append((i, best, score.get(best, 0.0)))
    assert [(a, b, round(c, 6)) for a, b, c in got] == sorted(want, key=repr)
    assert all(b == r[2] for a, b, _ in got if a is not None and a < 90 for r in rows[:90] if r[0] == a and a != 4)


def test_no_language(spark, docs):
    none = language.train(docs.filter("false"))
    assert none.names == []
    assert {(r[1], r[2]) for r in language.identify(docs, none).collect()} == {("und", 0.0)}
    assert language.identify(docs.filter("false"), none).count() == 0


def test_sampled_learning(docs, rows):
    n = Counter(r[2] for r in rows if r[2] and r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5)
    most = sorted(n, key=lambda x: (-n[x], x))[:2]
    assert language.train(docs, docs_per_language=20, languages=2).names == sorted(most)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_language_held_out(spark):
    from leafmine.llm.queries import op11_language

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = [r["lang_pred"] == truth[r["doc_id"]] for r in op11_language(spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert np.mean(got) > 0.95


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(level: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    paths, under = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for k, run in enumerate(runs):
            for j in range(len(run)):
                for i in under[3 * k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
        under = [sum(under[3 * k : 3 * k + 3], []) for k in range(len(runs))]
        level = [_h(*run) for run in runs]
    return level[0], paths


def _manifest(rows: list[tuple]) -> list[tuple]:
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _h(*map(show, (r[0], r[3], r[2], r[4], text)))
    sources = defaultdict(list)
    for r in rows:
        less = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, less), r[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in sorted(sources[s])]) for s in order]
    root, ups = _tree([t[0] for t in trees])
    out = []
    for s, (sub, paths), up in zip(order, trees, ups, strict=True):
        for (_, _, own, other, doc_id), path in zip(sorted(sources[s]), paths, strict=True):
            folded = other
            for before, after in path + up:
                folded = _h(before, folded, after)
            out.append((doc_id, own, sub, root, _h(*[a + b for a, b in path + up]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_manifest(docs, rows, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    got = sorted(map(tuple, merkle.manifest(docs).collect()), key=repr)
    assert got == _manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_one_row_and_none(docs):
    alone = merkle.manifest(docs.filter("source = 'solo'")).collect()
    assert len(alone) == 1 and alone[0]["leaf"] == alone[0]["root"] == alone[0]["folded_root"] and alone[0]["proof"] == _h("")
    assert merkle.manifest(docs.filter("false")).count() == 0


def test_ranks_of_a_large_group(spark):
    rows = spark.range(5000).selectExpr("'one' as group", "id div 1000 as x").repartition(4)  # ties of a thousand
    got = merkle.ranked(rows, ["x"], Scratch(spark, "ranks"), "r").collect()
    assert sorted(r["rank"] for r in got) == list(range(5000))
    assert all(r["x"] == r["rank"] // 1000 for r in got)


VECS = "vec_id long, embedding array<float>, label int, cell string, salt string, rank string"


def _vecs(n: int = 900, dim: int = 6, clusters: int = 0) -> list[tuple]:
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, dim)) * 0.3 + 0.2
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 3 + rng.normal(size=(n, dim)) * 0.01
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(i, rows[5][1], i % 3) for i in range(n, n + 60)]  # copies of one vector
    rows += [(5000, None, 1), (5001, [1.0], None), (5002, [float("nan")] * dim, 1), (5003, [float("inf")] + [0.0] * (dim - 1), 1), (5004, [None] * dim, 2), (None, [1.0] * dim, 1), (5005, [], 1), (5006, [0.5], 2), (-700, [0.3] * dim, 3), (5007, [0.5, 0.25], 0)]
    rows += [rows[3], rows[200], (200, [0.25] * dim, 9)]
    return [(*r, "c", "s", "r") for r in rows]


def _mined(rows: list[tuple]) -> list[tuple]:
    best = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        best[i] = min(best.get(i, (99, [])), (label, [math.floor(256 * x) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(best[a][1], best[b][1], strict=False))
    out = []
    for a in best:
        if a % 100:
            continue
        other = sorted((-score(a, b), b, best[b][0]) for b in best if b != a)
        for p, i, _ in [x for x in other if x[2] == best[a][0]][:5]:
            fits = [(n, j) for n, j, label in other if label != best[a][0] and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, i, k + 1, j, -p, -n) for k, (n, j) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("rows", [_vecs(), _vecs(dim=3, clusters=12)], ids=["spread", "clusters"])
def test_hard_negatives(spark, rows):
    table = spark.createDataFrame(rows, VECS).repartition(3)
    want = _mined(rows)
    assert len(want) > 50
    for sample, cell in ((8192, 4096), (300, 20)):  # one cell, and a tree of many, of which one is crowded
        assert sorted(map(tuple, hard_negatives.mine(table, sample, cell).collect())) == want


def test_cells_are_left_out(spark):
    """In clusters most cells lie outside the annuli; the ranges are those of all rows, not of the sample."""
    rows = hard_negatives.prepared(spark.createDataFrame(_vecs(3000, 3, 40), VECS)).cache()
    index = hard_negatives.build(rows, Scratch(spark, "cells"), 500, 60)
    vec = np.array([r["vec"] for r in rows.filter("id < 900 and id % 100 = 0").collect()])
    tree = index.tree
    assert tree.cells > 20
    high = np.array([(v**2).sum() for v in vec])
    far = np.sqrt(np.maximum(high + tree.norm - 2 * 0.95 * high, 0))
    met = sum(len(at) for _, at in tree.reached(tree.lift(vec, True), np.zeros(len(vec)), far, index.ranges))
    assert 0 < met < 0.7 * tree.cells * len(vec)


def test_large_components(spark):
    rows = [(0, [3e6, -2e6], 1), (1, [2.5e6, 1.0], 1), (2, [2.4e6, 7.0], 2), (3, [2.2e6, -1e6], 3)]
    table = spark.createDataFrame([(*r, "", "", "") for r in rows], VECS.replace("float", "double"))
    assert sorted(map(tuple, hard_negatives.mine(table).collect())) == _mined(rows)


def test_no_vectors(spark):
    table = spark.createDataFrame(_vecs(), VECS)
    assert hard_negatives.mine(table.filter("false")).count() == 0
    assert hard_negatives.mine(table.filter("vec_id % 100 <> 0")).count() == 0
