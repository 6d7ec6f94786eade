"""What spares pages a search loses no hit; what is read in parts is read as a whole."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmine import rules as R
from leafmine.functions import columns as C
from leafmine.functions import needles as N
from leafmine.functions import reading
from leafmine.operators import answers as A
from leafmine.operators import candidates as K
from leafmine.operators import lookups, pages
from leafmine.sources import files as S

RULES = R.RuleSet()

WORDS = st.text("abcdeiksCDIKS ", min_size=1, max_size=5).map(re.escape)
ATOMS = st.one_of(WORDS, st.sampled_from([r"\s{0,3}", r"\d", "[abk]", "[^ab]", ".", r"\bab", "k?", "d{0,2}", "ca{0,2}b", "(?:ka){2}", "s{1,3}?", "^ab", "(?=ca)ca", "(?i:Sk)", "(?>ab)c", "i{1,2}"]))


@st.composite
def patterns(draw, depth: int = 1):
    parts = draw(st.lists(ATOMS, min_size=1, max_size=3))
    if depth:
        inner = draw(st.lists(patterns(depth - 1), min_size=0, max_size=3))
        if inner:
            parts.insert(draw(st.integers(0, len(parts))), draw(st.sampled_from(["(?:%s)", "(%s)?", "(?:%s){0,2}", "(%s){1,2}"])) % "|".join(inner))
    return "".join(parts)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(patterns(), st.lists(st.text("abcdeiksABCDEIKS \u0130\u0131\u017f\u212a", max_size=12), min_size=1, max_size=4), st.data())
def test_needles_lose_no_hit(pattern, texts, data):
    find = re.compile(pattern, re.I)
    texts = [*texts, data.draw(st.from_regex(find, fullmatch=False))]
    finder = N.Finder()
    finder.add("zzz")
    mine = reading.Pattern(pattern, finder)
    for text, mask in zip(texts, finder.masks(texts), strict=True):
        assert mine.may(mask) or not find.search(text), (pattern, N.needles(pattern), text)
        m = find.search(text)
        assert not m or N.fold(m[0]).startswith(N.lead(pattern))


def test_every_letter_that_matches_without_case_folds_alike():
    for p in range(0x110000):
        c = chr(p)
        if p > 127 and re.match("[a-z0-9]", c, re.I):
            assert any(re.match(a, c, re.I) and N.fold(c) == a for a in "abcdefghijklmnopqrstuvwxyz"), hex(p)
    assert all(len(N.fold(chr(p))) == 1 for p in range(0x110000))


@pytest.mark.parametrize(("pattern", "words"), [(r"colou{0,1}r\s*code", [{"colo"}, {"code"}]), (r"(?:Cost|Value)\s*of", [{"cost", "value"}, {"of"}]), (r"e?mail", [{"mail"}]), ("a|", []), (r"Products?", [{"product"}]), (r"[Yy]ear", [{"ear"}]), ("(?:abc)?", []), (r"PRE[\s-]*QUAL(?:X)?", [{"pre"}, {"qual"}])])
def test_needles(pattern, words):
    assert N.needles(pattern) == words


def test_all_wordings_are_spared_somewhere():
    everything = [p for ps in (*R.LABELS.values(), *R.HEADINGS.values()) for p in ps]
    assert all(N.needles(p) for p in everything)


def test_many_texts_at_once():
    finder = N.Finder()
    a, b, none = reading.Pattern("alpha", finder), reading.Pattern(r"alpha\s*(?:beta|gam+a)", finder), reading.Pattern("b+", finder)
    assert [(a.may(m), b.may(m), none.may(m)) for m in finder.masks(["x ALPHA", "", "alp", "ha", "alphaGAMMA", "beta"])] == [(True, False, True), (False, False, True), (False, False, True), (False, False, True), (True, True, True), (False, False, True)]
    assert finder.masks([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("xy\n", max_size=30) | st.just("\n<<<FILE: a"), max_size=12), st.integers(5, 40), st.integers(1, 6))
def test_cutting_in_parts(parts, size, most):
    for chars in (None, 50):
        cutter = reading.Cutter(size, most, chars)
        got = [x for part in parts for x in cutter.add(part)]
        got += cutter.end()
        assert got == reading.chunks("".join(parts)[:chars], size, most)


def test_two_forms_of_a_rule_agree(spark):
    texts = ["Rs. 5 % of the total Contract Price", "3.5 per cent on Work value", "none", "Bid Opening Date/Time 01-02-2026", "bid opening: N.A. here", "Bid Opening not known", "Date :", "Custom Bid for Services", "Audit of the stores", "Ntpc Limited", "Gate 1, Main Road, Pune", "........ x ........", "बोली"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    label = re.compile(R.OPENING, re.I)
    for r in df.select("s", C.percent_of(F.col("s")).alias("p"), C.value_after_label(F.col("s"), R.OPENING).alias("v"), C.is_junk_line(F.col("s")).alias("j"), *[C.is_weak_value(F.lit(f), F.col("s")).alias(f) for f in ("purpose", "location")]).collect():
        m = label.search(r.s)
        assert r.p == reading.percent_of(r.s) and r.v == (reading.after_label(r.s, m) if m else "") and r.j == reading.is_junk_line(r.s)
        assert (r.purpose, r.location) == (reading.is_weak("purpose", r.s), reading.is_weak("location", r.s))


def _long_file(spark, name: str, n: int, said: dict, size: int = 3000) -> list[tuple]:
    return [("t", name, i, said.get(i, f"page {i} " + "text of no interest; " * (size // 21)), False) for i in range(1, n + 1)]


def test_eligibility_reads_what_a_section_can_reach(spark):
    """Sections of long files equal those of whole files, though few pages are read; a heading may be parted by a page's end."""
    rows = _long_file(spark, "a.pdf", 60, {20: "end of it.\nELIGIBILITY CRITERIA\n(i) first\n" + "(ii) more of this\n" * 30, 40: "runs on\nWHO CAN", 41: "APPLY\n(a) all firms"})
    rows += _long_file(spark, "b.pdf", 30, {3: "no heading, but eligibility criteria, as said", 9: "QUALIFICATION CRITERIA\n(x) last words"}) + _long_file(spark, "c.pdf", 30, {})
    df = spark.createDataFrame(rows, "tender string, file string, page int, text string, ocr boolean")
    found = K.scan_pages(df, RULES)
    need = K.eligibility_pages(found)
    few = df.join(need, ["tender", "file", "page"], "left_semi")
    assert few.filter("file = 'c.pdf'").count() == 0 and few.count() < 40
    assert {19, 20, 21, 24, 40, 41} <= {r.page for r in need.filter("file = 'a.pdf'").collect()}
    show = lambda d: sorted((r.file, r.pat_ix, r.ref, r.value, r.conf) for r in K.block_candidates(d, RULES).collect())
    assert show(few) == show(df) and len(show(df)) >= 3


def test_among(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 7 as k", "'text' as text")
    keys = spark.range(0, 20_000, 400).selectExpr("id", "id % 7 as k", "id * 2 as more")
    assert sorted(map(tuple, lookups.among(rows, keys, ["id", "k"]).select("id", "more").collect())) == [(i, 2 * i) for i in range(0, 20_000, 400)]
    assert lookups.maybe_among(rows, keys, ["id", "k"]).count() < 200
    assert lookups.among(rows, keys.limit(0), ["id", "k"]).count() == 0


def test_files_are_packed_by_their_bytes(spark):
    sizes = [417, *[1] * 11, *[3] * 40, 30, 12]
    files = spark.createDataFrame([(f"f{i}", n * 1000) for i, n in enumerate(sizes)], "path string, length long")
    parts = [sum(r.length for r in part) for part in S.packed(files, 20_000, 10).rdd.glom().collect()]
    assert sum(parts) == sum(sizes) * 1000
    assert sorted(parts)[-2:] == [30_000, 417_000] and all(p <= 20_000 for p in sorted(parts)[:-2])
    assert S.packed(files.limit(0)).count() == 0


def test_folder_tree(spark, tmp_path):
    for name in ("a/b/c.txt", "a/d.txt", "e.txt", "f/g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    spark.dataSource.register(S.FolderTree)
    got = {r.rel_path: r.length for r in spark.read.format("folder_tree").option("path", f"file:{tmp_path}").option("tasks", 2).load().collect()}
    assert got == {n: len(n) for n in ("a/b/c.txt", "a/d.txt", "e.txt", "f/g.txt")}


def test_walks_end_in_cycles_and_leave_hidden_files(spark):
    rows = [("r", "a", "docs", True), ("a", "r", "back", True), ("a", "b", "deep", True), ("b", "a", "again", True), ("a", "f1", "one.pdf", False), ("a", "f2", "~$two.pdf", False), ("b", "f3", ".three", False), ("b", "f4", "four.txt", False), ("r", "w", " working folder", True), ("w", "f5", "draft.txt", False)]
    listing = spark.createDataFrame(rows, "parent_id string, id string, name string, is_folder boolean")
    got = S.walk_listing(listing, spark.createDataFrame([("r",)], "root string"))
    assert sorted((r.rel_path, r.id, r.depth) for r in got.collect()) == [("docs/deep/four.txt", "f4", 2), ("docs/one.pdf", "f1", 1)]
    assert S.walk_listing(listing.filter("false"), listing.selectExpr("parent_id root").distinct()).count() == 0


def test_text_choice_beyond_the_cap(spark):
    rows = [("t", "f", p, "short" if p != 4 else "a text layer that is long enough to be used as it stands, no doubt about it", "recognised text of the page", None) for p in range(1, 9)]
    got = pages.choose_page_text(spark.createDataFrame(rows, "tender string, file string, page int, text_layer string, ocr_text string, error string").drop("error"), most_ocr=3)
    assert sorted((r.page, r.ocr) for r in got.collect()) == [(1, True), (2, True), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False)]


def _pages(spark, n: int = 40):
    rng = __import__("random").Random(4)
    rows = [(f"t{t}", f"{'tender' if f % 2 else 'boq'}{f}.txt", p, "x" * rng.randint(0, 90), p % 7 == 0) for t in range(8) for f in range(4) for p in range(1, rng.randint(2, n))]
    flags = [(f"t{t}", f"{'tender' if f % 2 else 'boq'}{f}.txt", t == 0 or (f == 3 and t != 1)) for t in range(8) for f in range(4)]
    return spark.createDataFrame(rows, "tender string, file string, page int, text string, ocr boolean").repartition(3), spark.createDataFrame(flags, "tender string, file string, boilerplate boolean")


@pytest.mark.parametrize(("size", "most"), [(200, 3), (500, 40), (100_000, 8)])
def test_chunks_without_a_corpus_in_one_row(spark, size, most):
    df, flags = _pages(spark)
    want = [(r.tender, i, c) for r in A.corpus(df.join(flags, ["tender", "file"])).collect() for i, c in enumerate(reading.chunks(r.corpus[: size * most], size, most))]
    got = [tuple(r) for r in A.corpus_chunks(df, flags, size, most).collect()]
    assert sorted(got) == sorted(want) and len(got) >= 8


def test_waves_spare_calls(spark, tmp_path):
    """Same rows as asking for all chunks; a tender that has all its fields is asked no more."""
    import json

    import pandas as pd

    fields = list(R.ORDER)
    asked = str(tmp_path)

    def model(frames):
        for frame in frames:
            out = []
            for tender, chunk in zip(frame["tender"], frame["chunk"], strict=True):
                open(f"{asked}/{tender}-{chunk}", "w").close()
                k = int(tender[1:])
                some = fields if chunk >= k else fields[:chunk]
                if k != 6 or chunk % 2:
                    out.append((tender, chunk, "one", json.dumps({"fields": {f: {"value": f"{tender} {chunk} {f}", "confidence": "high"} for f in some}}) if some else ""))
            yield pd.DataFrame(out, columns=["tender", "chunk", "provider", "json"])

    chunks = spark.createDataFrame([(f"t{k}", c, "text") for k in range(8) for c in range(12) if k != 7 or c < 3], A._CHUNK)
    rows = lambda answers: sorted(map(tuple, A.early_stop(A.answer_rows(answers)).collect()))
    got = rows(A.ask(chunks, model, ["one"], 12))
    calls = len(list(tmp_path.iterdir()))
    want = rows(A.pick_provider_answer(A.answer(chunks, model), ["one"]))
    assert got == want and got
    assert A.waves(12) == [0, 1, 3, 7, 11] and A.waves(1) == [0]
    ends = {0: 1, 1: 2, 2: 4, 3: 4, 4: 8, 5: 8, 6: 8, 7: 3}
    assert calls == sum(ends.values()) < 12 * 7 + 3
