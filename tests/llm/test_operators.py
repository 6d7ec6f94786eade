"""Each operator against a brute-force version on one fixture with nulls, empty and long texts, ties, repeated rows and
clashing column names, and on an empty table."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmine.llm import chat_tree, decontaminate, jaccard_join, keys, line_dedup, mixing, quality, range_coder, repeats, secret_ledger, token_output, winnow
from leafmine.llm.queries import tokenizer_path
from leafmine.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 string, node string, score string, size string, label string, h string, part string"


def _texts() -> list[tuple]:
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(vocab, n))
    passage = make(60)
    base = make(200)
    edited = base.split(" ")
    edited[50] = "edited"
    long = make(30_000)
    texts = [None, "", "  \n\t ", "one two three", "ONE two\tthree", base, " ".join(edited), base.upper(), make(40) + "\n" + passage + "\n" + make(30), passage, make(10) + " " + passage, long, long[:-5] + "x y z",
             "line a\nline b\nline c\nline d", "x\nline a\nline b\nline c\ny", "line a\nline b\nline c\nline d", "é" * 30 + " ü\r\n\x0b token: abcdefgh1234 AKIA" + "A" * 20 + " " + "0a" * 15, "a" * 7 + " " + "same " * 90]
    texts += [make(int(n)) for n in rng.integers(1, 120, 30)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [rows[5], (5, base, "de", "other"), (3, "another text with the same id", "en", "s1"), (None, base, "en", None), (None, None, "en", None), rows[8]]
    return [(*r, 0, "x", "x", "x", "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_repeats(docs, rows, none):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, words, strict=True):
        cover = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r[0], len(w), len(cover), " ".join(x for j, x in enumerate(w) if j not in cover)))
    assert _got(repeats.remove_repeats(docs)) == sorted(want, key=repr)
    ranges = []
    for r, w in zip(rows, words, strict=True):
        gone = [any(seen[tuple(w[i : i + 35])] > 1 for i in range(max(0, j - 34), min(j, len(w) - 35) + 1)) for j in range(len(w))]
        edges = [j for j in range(len(w) + 1) if (gone[j] if j < len(w) else False) != (gone[j - 1] if j else False)]
        ranges += [(r[0], a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    assert _got(repeats.stretches(docs)) == sorted(ranges, key=repr)
    assert not repeats.remove_repeats(none).count()


def test_line_dedup(docs, rows, none):
    key = lambda r: (r[0] is not None, r[0] or 0)
    texts = {(r[0], r[1] or "") for r in rows}
    places, first = {}, {}
    for d, t in texts:
        lines = t.split("\n")
        n = min(3, len(lines))
        for i in range(len(lines) - n + 1):
            w = (n, *lines[i : i + n])
            if "".join(w[1:]).strip():
                places.setdefault(w, []).append((key((d,)), i, d, t))
    for w, p in places.items():
        first[w] = min(p)[:2]
        # in the fixture, texts of one id share no window, so that the order among them doesn't count
        assert len({x[3] for x in p if x[0] == first[w][0]}) == 1
    want = []
    for r in rows:
        t = r[1] or ""
        lines = t.split("\n")
        gone = {j for w, p in places.items() for at, i, d, x in p if (d, x) == (r[0], t) and (at, i) > first[w] for j in range(i, i + w[0])}
        want.append((r[0], len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    assert _got(line_dedup.remove_lines(docs)) == sorted(want, key=repr)
    kept = {r.doc_id: r for r in line_dedup.remove_lines(docs).collect() if r.doc_id in (13, 14, 15)}
    assert kept[14].kept_text == "x\ny" and kept[15].kept_text == "" and kept[14].n_removed == 3
    assert not line_dedup.remove_lines(none).count()


def test_jaccard_groups(docs, rows, none):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    low = -(1 << 63)
    k0 = [low if r[0] is None else r[0] for r in rows]
    least = {g: min(k for k, h in zip(k0, group, strict=True) if h == g) for g in group}
    want = sorted((k, len(s), least[g]) for k, s, g in zip(k0, sets, group, strict=True))
    assert sorted((r.k0, r.n_shingles, r.component) for r in jaccard_join.near_groups(docs).collect()) == want
    assert not jaccard_join.near_groups(none).count()


def test_jaccard_pairs_are_counted_in_few_places():
    """Groups of similar classes: a pair of them isn't a row in every bucket that one of its shingles could be in."""
    rng, buckets = np.random.default_rng(3), 64
    prints, nodes = [], []
    for g in range(20):
        pool = rng.integers(0, 1 << 63, 150).astype(np.uint64)
        for i in range(24):
            prints.append(rng.choice(pool, 100, replace=False))
            nodes.append(np.full(100, 24 * g + i))
    everyone = [np.full(600, 5, np.uint64), np.arange(1000, 1600)]
    f, node = np.concatenate([*prints, everyone[0]]), np.concatenate([*nodes, everyone[1]]).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([f.tobytes()], pa.binary()), pa.array([node.tobytes()], pa.binary())], ["bucket", "prints", "nodes"])
    rows = pa.Table.from_batches(jaccard_join._shared(buckets)(iter([batch]))).to_pandas()
    assert len(rows) == len(f) and (rows.groupby("print").bucket.nunique() == 1).all()
    rows = rows[rows.node < 1000].assign(n=100, tag=0)
    rows["colour"] = rows.node
    parts = [pa.RecordBatch.from_pandas(x, preserve_index=False) for _, x in rows.groupby("bucket")]
    got = pa.Table.from_batches([b for p in parts for b in jaccard_join._pairs(75)(iter([p]))]).to_pandas()
    pairs = got.groupby(["a", "b"]).c.sum()
    assert len(pairs) == 20 * 24 * 23 // 2 and len(got) < 10 * len(pairs)
    sets = {int(n[0]): set(p.tolist()) for p, n in zip(prints, nodes, strict=True)}
    assert all(c == len(sets[a] & sets[b]) for (a, b), c in pairs.items())
    # the shingles of one large group go to many buckets
    some = np.concatenate([np.full(600, k, np.uint64) for k in range(200)])
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([some.tobytes()], pa.binary()), pa.array([np.tile(everyone[1], 200).tobytes()], pa.binary())], ["bucket", "prints", "nodes"])
    assert pa.Table.from_batches(jaccard_join._shared(buckets)(iter([batch]))).to_pandas().bucket.nunique() > 12


def test_jaccard_region_rounds(spark, monkeypatch):
    """A chain of edits around one text: dense regions that pivots of their own take apart."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(260):
        w = list(base)
        for j in rng.integers(0, 150, rng.integers(0, 7)):
            w[j] = f"e{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, value in (("PIVOTS", 4), ("REGION_PIVOTS", 30), ("CROWD", 5), ("REGION_ROWS", 20)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = {r.k0: r.component for r in jaccard_join.near_groups(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                group[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in range(len(texts))}


def test_leaks(spark, docs, rows, none):
    item = rows[9][1]
    bench = spark.createDataFrame([(1, item, 5), (2, "too short here", 5), (3, None, 5), (4, " ".join(f"z{i}" for i in range(40)), 5), (1, item, 5)], "item_id long, text string, node int")
    near = item.split(" ")
    near[30] = "other"
    extra = spark.createDataFrame([(900, "head " + " ".join(near) + " tail"), (901, " ".join(item.split(" ")[:30]))], "doc_id long, text string")
    found = decontaminate.leaks(docs.select("doc_id", "text").union(extra), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, 1) for d in (8, 9, 10, 900)}
    assert {r.doc_id: r.start for r in found}[900] == 1 and all(r.similarity == 1 for r in found if r.doc_id != 900)
    assert not decontaminate.leaks(none, bench).count() and not decontaminate.leaks(docs, bench.limit(0)).count()


def test_leaks_at_exactly_the_similarity(spark):
    """Copies whose last words are replaced until 3 of 4 shingles are shared: no distance of fingerprints loses one."""
    rng = np.random.default_rng(5)
    items, texts = [], []
    for i in range(400):
        n, cut = ((39, 5), (53, 7))[i % 2]
        w = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        items.append((i, " ".join(w)))
        texts.append((i, " ".join(w[:-cut] + [f"t{x}" for x in rng.integers(0, 10**9, cut)])))
        texts.append((1000 + i, " ".join(w[: -cut - 1] + [f"t{x}" for x in rng.integers(0, 10**9, cut + 1)])))
    found = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in found) == [(i, i, 0, 0.75) for i in range(400)]


def _similarity(window: list, item: list, weight, k: int = 5) -> float:
    a, b = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (window, item))
    both = sum(min(n, b[g]) * weight(g) for g, n in a.items())
    return both / (sum(n * weight(g) for g, n in a.items()) + sum(n * weight(g) for g, n in b.items()) - both)


def test_leaks_against_every_window(spark):
    """Edits at several rates, in place, by insertion and by removal: what a comparison of every window finds is found."""
    rng = np.random.default_rng(11)
    items = [[f"w{x}" for x in rng.integers(0, 3000, int(n))] for n in rng.integers(12, 60, 40)]
    texts = []
    for rate in (0, 0.01, 0.02, 0.04, 0.07, 0.1):
        for item in items:
            w = []
            for x in item:
                r = rng.random() / max(rate, 1e-9)
                w += [x] if r > 1 else [f"e{rng.integers(0, 99)}"] if r > 0.5 else [] if r > 0.25 else [x, f"e{rng.integers(0, 99)}"]
            texts.append([f"n{x}" for x in rng.integers(0, 500, 30)] + w + [f"n{x}" for x in rng.integers(0, 500, int(rng.integers(0, 30)))])
    has = Counter(g for item in items for g in {tuple(item[i : i + 5]) for i in range(len(item) - 4)})
    weight = lambda g: int(np.floor(1000 * np.log(1 + len(items) / max(1, has[g])) + 0.5))
    want = {}
    for d, w in enumerate(texts):
        for j, item in enumerate(items):
            if not {tuple(w[i : i + 5]) for i in range(len(w) - 4)} & {tuple(item[i : i + 5]) for i in range(len(item) - 4)}:
                continue
            best = max(_similarity(w[s : s + len(item)], item, weight) for s in range(len(w) - 4))
            if best >= 0.75:
                want[d, j] = best
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(table(texts, "doc_id"), table(items, "item_id")).collect()}
    print(f"{len(got)} of {len(want)} pairs")
    assert len(want) > 90 and set(got) <= set(want)
    assert len(got) >= 0.98 * len(want) and all(want[p] >= s - 1e-12 for p, s in got.items())


def test_leaks_of_long_and_repetitive_items(spark):
    rng = np.random.default_rng(4)
    long = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
    edited = [x if rng.random() > 0.02 else "e" for x in long]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "same " * 40_000), (3, " ".join(f"u{i}" for i in range(700)))], "item_id long, text string")
    texts = [(1, "head " * 50 + " ".join(edited) + " tail" * 60), (2, "same " * 60), (3, " ".join(long[:1500])), (4, " ".join(f"u{i}" for i in range(40, 700)))]
    found = {(r.doc_id, r.item_id): r.start for r in decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert found == {(1, 1): 50, (4, 3): 0}  # and 40,000 equal words overflow no counter


def test_secrets(spark, docs, rows, none):
    rules = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    tricky = ["token:token: abcdefgh", "token=secret=abcdefg PASSWORD = 'hunter2!'", "AKIAAKIA" + "B" * 18, "f" * 23 + " " + "f" * 24, "api key api_key\": 12345 apikey=123456"]
    more = spark.createDataFrame(list(enumerate(tricky, 500)), "doc_id long, text string")
    versions = secret_ledger.versions(docs.select("doc_id", "text").union(more))
    scratch = Scratch(spark, "test")
    empty = secret_ledger.empty_ledger(spark)
    ledger = scratch.write(secret_ledger.scan_unseen(versions, empty), "a")
    assert ledger.count() == versions.select("blob").distinct().count()
    assert not secret_ledger.scan_unseen(versions, ledger).count()  # nothing is scanned twice
    assert secret_ledger.scan_unseen(versions, ledger, "2").count() == ledger.count()
    got = sorted(((r.path, [(f.kind, f.start, f.end) for f in r.findings]) for r in secret_ledger.by_path(versions, ledger).collect()), key=repr)
    want = []
    for d, t in [(r[0], r[1]) for r in rows] + list(enumerate(tricky, 500)):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in p.finditer(t or "") if ok(m))
        want.append((d, [(rules[k][0], s, e) for s, k, e in spans]))
    assert got == sorted(want, key=repr)
    assert not secret_ledger.by_path(secret_ledger.versions(none), ledger).count()


def test_winnow(docs, rows, none):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, n = r[1] or "", nxt[1] or ""
        half = len(t) // 2
        want.append((r[0], len(t), t[: len(t) - half] + n[:half]))
    got = winnow.edited_fingerprints(docs, parts=3).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_text) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.doc_id: r for r in winnow.fingerprints(docs).filter("doc_id in (5, 6, 13, 15)").collect()}
    assert prints[13].fingerprint == prints[15].fingerprint
    hashes = lambda s: np.frombuffer(bytes.fromhex(s), ">u4")
    assert winnow.likeness(hashes(prints[5].fingerprint), hashes(prints[6].fingerprint)) > 0.8
    assert not winnow.edited_fingerprints(none, parts=3).count()
    # brute force: every window's smallest hash, of equal ones the rightmost; likeness of sets of hashes
    hasher = winnow.T.Hasher()

    def naive(t: str, k: int = winnow.GRAM, w: int = winnow.WIN) -> list[tuple[int, int]]:
        k = min(k, len(t))
        h = [int(winnow.fingerprint(t[i : i + k], hasher, k, 1)[0][0]) for i in range(len(t) - k + 1)] if t else []
        w = min(w, len(h))
        return sorted({min((h[j], -j) for j in range(i, i + w)) for i in range(len(h) - w + 1)} if h else [], key=lambda x: -x[1])

    sets = lambda s: set(hashes(s).tolist())
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    by_text = {}
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        for t in (r[1] or "", nxt[1] or ""):
            if t not in by_text and len(t) < 3000:
                by_text[t] = naive(t)
    long = "".join(f"{chr(97 + i % 26)}{i % 7}" for i in range(800))
    assert winnow.fingerprint(long, hasher)[1].tolist() == [-j for _, j in naive(long)]
    for r in got:
        t = next(x[1] or "" for x in rows if x[0] == r.doc_id and len(x[1] or "") == r.n_chars)
        if t in by_text and [x[0] for x in rows].count(r.doc_id) == 1:
            assert list(r.places) == [-j for _, j in by_text[t]] and hashes(r.fingerprint).tolist() == [h for h, _ in by_text[t]]
        assert abs(r.near_edited - jaccard(sets(r.fingerprint), sets(r.edited_fingerprint))) < 1e-12
    following = {(r.doc_id, r.n_chars, r.edited_text): r for r in got}
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, n = r[1] or "", nxt[1] or ""
        mine = following[(r[0], len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2])]
        if t in by_text and n in by_text and [x[0] for x in rows].count(r[0]) == 1:
            assert abs(mine.near_next - jaccard({h for h, _ in by_text[t]}, {h for h, _ in by_text[n]})) < 1e-12
    # the rightmost of equal hashes, and a shared run of k + w - 1 shares a print
    h, at = winnow.fingerprint("ab" * 50, winnow.T.Hasher(), 4, 6)
    assert len(h) and at[0] >= 4
    a, b = "x" * 40 + "the shared passage of some length, long enough for one window" + "y" * 9, "zz" + "the shared passage of some length, long enough for one window" + "q" * 30
    assert set(winnow.fingerprint(a, winnow.T.Hasher(), 16, 40)[0]) & set(winnow.fingerprint(b, winnow.T.Hasher(), 16, 40)[0])


def test_chat(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no \\</s>[INST]"), (2, 2, "user", None), (3, 0, None, "hi"), (3, 0, "assistant", "tie"), (4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (None, 0, "system", "[/INST]\\")]
    df = spark.createDataFrame([(*t, "c") for t in talk], "conv_id long, turn long, role string, text string, node string")
    scratch = Scratch(spark, "test")
    packed, leaves = chat_tree.tree(df, scratch)
    nodes = packed.orderBy("start").collect()
    assert nodes[0].start == 0 and all(a.start + a.n == b.start for a, b in zip(nodes, nodes[1:], strict=False))
    by = {r.node: r for r in nodes}
    for r in nodes:  # attention covers the ancestors, the parent comes before
        assert [tuple(x) for x in r.attend] == sorted((by[p].start, by[p].start + by[p].n) for p in r.path[:-1])
        assert r.position == sum(by[p].n for p in r.path[:-1])
    assert len(nodes) == 5  # runs of turns that the same conversations pass are one node
    got = {r.conv_id: r for r in chat_tree.digests(chat_tree.read_back(packed, leaves, scratch)).collect()}
    for c in (1, 2, 3, 4, None):
        turns = sorted(((t[1], t[2] or "", t[3] or "") for t in talk if t[0] == c))
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    for s in ("", "\\", "</s>", "<\\s>", "[INST\\]\\\\[/INST]", "<s><s>"):
        assert chat_tree.unescape(chat_tree.escape(s)) == s and not re.search(r"</?s>|\[/?INST\]", chat_tree.escape(s))
    empty, ends = chat_tree.tree(df.limit(0), Scratch(spark, "test"))
    assert not chat_tree.read_back(empty, ends, Scratch(spark, "test")).count()


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 9000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.zipf(1.3, n) % 49408, np.zeros(n, int), np.arange(n) % 7):
        data = range_coder.encode(ids.astype(np.uint32))
        assert (range_coder.decode(data) == ids).all()
    if n > 1000:
        assert len(range_coder.encode((np.arange(n) % 7).astype(np.uint32))) < n / 3
        bad = bytearray(range_coder.encode(rng.integers(0, 49408, n).astype(np.uint32)))
        bad[-n] ^= 64  # among the coded words
        with pytest.raises(range_coder.Corrupt):
            range_coder.decode(bytes(bad))
        good = range_coder.encode(rng.integers(0, 49408, n).astype(np.uint32))
        for at in (2, 8, 30, 200):  # the head has a checksum, too
            bad = bytearray(good)
            bad[at] ^= 1
            with pytest.raises(range_coder.Corrupt):
                range_coder.decode(bytes(bad))
        for size in (0, 3, 20, 100, len(good) - 5):
            with pytest.raises(range_coder.Corrupt):
                range_coder.decode(good[:size])


@pytest.mark.parametrize("n", [1, 2, 3, 2 * range_coder.PACKED - 1, 2 * range_coder.PACKED + 1])
def test_packed_words(n):
    words = np.random.default_rng(n).integers(0, 1 << 20, n).astype(np.uint32)
    data = range_coder._packed(words)
    assert len(data) == -(-n // 2) * 5 and (range_coder._unpacked(data, n) == words).all()


def test_token_output_memory(monkeypatch):
    """What a worker needs beside its input, while texts are encoded and ids coded. Pipelines have little left for it."""
    rng, path = np.random.default_rng(5), tokenizer_path("word_bpe_49k.json")
    words = np.array(["".join(x) for x in rng.choice(list("abcdefghij"), (20_000, 6))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([" ".join(rng.choice(words, 300)) for _ in range(2000)])], ["doc_id", "text"])
    monkeypatch.setattr(token_output.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    token_output._vocabulary(path)
    ids = rng.integers(0, 3000, 1 << 21).astype(np.uint16)
    tracemalloc.start()
    try:
        got = list(token_output._written(path)(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 60e6 and sum(sum(b.column("n_tokens")[0].as_py()) for b in got) > 600_000
        tracemalloc.reset_peak()
        data = range_coder.encode(ids)
        assert tracemalloc.get_traced_memory()[1] < 30 * len(ids)
    finally:
        tracemalloc.stop()
    assert (range_coder.decode(data) == ids).all()


def test_quality_memory():
    text = " ".join(np.random.default_rng(6).choice([f"word{i}" for i in range(999)], 300))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([text] * 2000)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        got = list(quality._mapped(None)(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 40e6 and sum(map(len, got)) == 2000
    finally:
        tracemalloc.stop()


def test_token_output(spark, docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = Scratch(spark, "test").root
    token_output.write(docs, f"{out}/a", path, 3)
    files = spark.read.schema(token_output.SEGMENT).parquet(f"{out}/a")
    tokenizer = Tokenizer.from_file(path)
    coded = lambda r: np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
    want = sorted(((r[0], len(ids := coded(r)), zlib.crc32(ids.tobytes())) for r in rows), key=repr)
    got = sorted((tuple(r) for r in token_output.read(files).collect()), key=lambda r: r[1])
    assert sorted(((r[0], *r[2:]) for r in got), key=repr) == want
    keys = [(r[0] is not None, r[0] or 0) for r in got]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert keys == sorted(keys)
    assert sum(len(r.ids) for r in token_output.ids_of(files).collect()) == at
    token_output.write(none, f"{out}/b", path, 3)
    assert not token_output.read(spark.read.schema(token_output.SEGMENT).parquet(f"{out}/b")).count()


def test_pieces_are_what_the_tokenizer_says():
    """Special strings, contractions, accents, composed and other letters, odd white space, digits, and a long text."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    fast, plain = token_output._Pieces(path), token_output._Plain(path)
    assert fast.applies(path) and not fast.applies(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "x<|ENDOFTEXT|>y <|endoftext|>z<|startoftext|>", "it's it'S I'll 'tis ''s !!'s ", "e\u0301 \u00e9 E \u00c9 \u00c0\u00c9 \u00df \u00d7 a\u00d7b", "\u0661\u0662 x\u00a0y \x85 \x00 \x1c", "12ab34.5%%%|<|", "<|", "\u017f \u212a \u212b \u0130 \u03a3", "a\u0300b \u3000x", "", " \n", "\u65e5\u672c x1\u65e5", "'re're'", "\ufffd\u200b"]
    rng = np.random.default_rng(2)
    alphabet = [*"abzAZ019 .,!<|>'\t\n", "\u00e9", "\u00d7", "\u0301", "\u00a0", "\u4e00", "endoftext|>"]
    texts += ["".join(rng.choice(alphabet, 60)) for _ in range(400)]
    texts.append(" ".join(f"word{i} <|endoftext|>" for i in range(150_000)))
    for _ in range(2):  # once new, once remembered
        for x in (texts[:-1], texts[-1:]):
            data = [t.encode() for t in x]
            flat, at = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))
            ids, n = fast.encode(flat, at)
            ids2, n2 = plain.encode(flat, at)
            assert n.tolist() == n2.tolist() and ids.tolist() == ids2.tolist()


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len(WORD.findall(r[1] or "")) for r in rows)
    sources = sorted({r.source for r in got}, key=lambda s: (s is None, s))
    size = {s: sum(r.size for r in got if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and r.taken <= 2 * r.size
    for s in sources:
        taken = sum(r.taken for r in got if r.source == s)
        # documents of one hash go together, and the boundary one is taken if that lands nearer
        together = Counter()
        for r in got:
            if r.source == s:
                together[r.doc_id] += r.size
        assert abs(target[s] - taken) <= max(together.values()) / 2 + 1
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert not mixing.mix(none).count()


def test_mix_is_nested(docs):
    small, large = ({(r.doc_id, r.source, r.size): r.taken for r in mixing.mix(docs, share=x).collect()} for x in (0.5, 0.9))
    assert all(small[k] <= large[k] for k in small)


def test_quality(spark, docs, rows, none):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"], 60)) + ".", "c") for i in range(300)]
    bad = [(i, " ".join(rng.choice(["LOREM!!", "IPSUM***", "$$$"], 60)), "c") for i in range(300, 400)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, features string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    scored = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert all((scored[i] >= 0.5) == (i < 300) for i in range(400))
    out = quality.score(docs, model)
    assert out.columns.count("score") == 1 and out.count() == len(rows) and all(0 <= r.score <= 1 for r in out.select("score").collect())
    assert not quality.score(none, model).count()
    constant = quality.train(none, labels)
    assert all(r.score == 0.5 for r in quality.score(docs, constant).select("score").collect())
    # brute force: one walk down each tree for each row
    x = np.random.default_rng(2).normal(size=(200, 3))
    trees = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=7, depth=3)

    def walk(row, t: int, node: int = 0) -> float:
        inner = (1 << trees.depth) - 1
        return trees.leaf[t, node - inner] if node >= inner else walk(row, t, 2 * node + (2 if row[trees.feature[t, node]] > trees.limit[t, node] else 1))

    z = np.array([trees.base + sum(walk(row, t) for t in range(7)) for row in x])
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-z)), atol=1e-12)
    held = {r.doc_id: r.h for r in table.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(400)}


def test_quality_on_held_out_labels(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).select((F.col("score") >= 0.5).alias("says"), (F.col("quality") == 1).alias("good")).collect()
    assert len(rows) > 50 and sum(r.says == r.good for r in rows) >= 0.95 * len(rows)


def test_keys_of_many_rows_without_an_id(spark):
    """No two of 400,000 different texts share a key, as they would with a hash of 32 bits."""
    docs = spark.range(400_000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text")
    assert keys.keyed(docs).select(*keys.KEY).distinct().count() == 400_000
    mixed = spark.createDataFrame([(None, "a", 1), (-(1 << 63), "a", 2), (1, None, 3), (1, "", 4)], "doc_id long, text string, k0 int")
    rows = {r.k0: tuple(r[:3]) for r in keys.with_keys(mixed).select(*keys.KEY, F.col("row.k0")).toDF("a", "b", "c", "k0").collect()}
    assert rows[1] != rows[2] and rows[3] == rows[4]


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        if "mixing" not in name:
            assert kept.join(docs, "doc_id", "left_anti").count() == 0 and 0 < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_pipeline_groups_that_share_a_doc_id(spark):
    """Unlinked rows without doc_id, or with one doc_id, all stay; of a linked group one does, and no empty text goes."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("c")), (9, text("a")), (None, text("e")), (10, text("e") + " tail"), (11, text("f")), (11, text("f")), (12, text("f"))]
    rows += [(None, None), (None, ""), (13, " \n"), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, text("a")), (None, text("b")), (None, text("e")), (7, text("c")), (7, text("d")), (11, text("f")), (None, None), (None, ""), (13, " \n"), (13, "")]
    assert _got(corpus_pipeline.one_of_each_group(spark, docs, "")) == sorted(want, key=repr)


def test_pipeline_stages_give_back_columns_whose_names_clash(spark):
    """Nulls, empty texts, repeated rows and columns that are called like the stages' own; and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    names = ["k0", "k1", "k2", "k", "own", "of", "times", "score", "row", "label", "node"]
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, None, None), (None, "", "s"), (7, "words of an odd row", None), (7, "words of an odd row", None)], real.schema)
    docs = real.union(odd).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(f"own {n}" for n in names)], name
        assert not stage(spark, docs.limit(0), sf).count(), name
