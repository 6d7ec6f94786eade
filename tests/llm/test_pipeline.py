"""Each stage of the pipeline over all documents of the smallest tables, on its predecessor's rows: exactly the rows that brute force
(or SQL, where it can say it) keeps."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from leafmine.llm import quality, textops
from leafmine.llm.queries import SQL, tokenizer_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, rows = {}, [tuple(r) for r in docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out[name] = (rows, [tuple(r) for r in new.collect()], new.columns)
        docs, rows = new, out[name][1]
    return out


@pytest.fixture(scope="module")
def duck():
    def over(rows: list[tuple]):
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
        con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
        return con

    return over


def test_quality_stage(spark, stages):
    got, kept, _ = stages["quality classifier"]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    hasher, classes = textops.Hasher(), quality._class_table()

    def score(text: str | None) -> float:
        data = np.frombuffer((text or "").encode(), np.uint8)
        x = quality.statistics(data, np.array([0, len(data)]), hasher, classes)[0]
        z = model.base
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + (x[feature[node]] > limit[node])
            z += leaf[node - (1 << model.depth) + 1]
        return 1 / (1 + np.exp(-z))

    assert Counter(kept) == Counter(r for r in got if score(r[1]) >= 0.5)
    assert 0.5 * len(got) < len(kept) < len(got)


def test_near_copies_stage(stages):
    got, kept, _ = stages["n-gram Jaccard join"]
    sets = []
    for r in got:
        w = WORD.findall((r[1] or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(got)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = [got[k] for g in set(group) for k in [min((k for k in range(len(got)) if group[k] == g), key=lambda k: got[k][0])]]
    assert Counter(kept) == Counter(want) and len(kept) < len(got)


def test_benchmark_stage(stages, duck):
    got, kept, _ = stages["benchmark decontamination"]
    held = {r[0] for r in duck(got).sql(f"select distinct doc_id from ({SQL['op4_decontaminate']})").fetchall()}
    assert Counter(kept) == Counter(r for r in got if r[0] not in held) and held


def test_mix_stage(stages, duck):
    got, kept, _ = stages["mixing sources to target weights"]
    times = {d: taken // size for d, size, taken in duck(got).sql(f"select doc_id, size, taken from ({SQL['op8_mix']}) where size > 0").fetchall()}
    words = lambda r: len(WORD.findall(r[1] or ""))
    assert Counter(r for r in kept if words(r)) == Counter({r: times[r[0]] for r in got if words(r) and times[r[0]]})


def test_token_stage(stages):
    from tokenizers import Tokenizer

    got, kept, columns = stages["token-ID output"]
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(got, key=lambda r: r[0]):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    at = [columns.index(c) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    assert sorted(tuple(r[i] for i in at) for r in kept) == sorted(want)
