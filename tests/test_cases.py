"""Single-operator cases from real false positives, and cases around them."""

import pytest
from pyspark.sql import functions as F

from leafmine import rules as R
from leafmine.functions import columns as C
from leafmine.functions import parsed, reading
from leafmine.operators import answers as A
from leafmine.operators import candidates as K
from leafmine.operators import outputs as O
from leafmine.operators import pages as P
from leafmine.operators import review as V
from leafmine.operators import winners as W
from leafmine.operators.places import split_places
from leafmine.plans import extraction as X
from leafmine.sources import files as S

RULES = R.RuleSet()


def _col(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("text", "bare", "value"),
    [
        ("9722687", False, None), ("1976, the Act provides", True, None), ("2028 onwards", True, None), ("0404214000030,", True, None), ("T-168 Estt. branch", True, None),
        ("GeM-Bidding-9722687.pdf", True, None), ("5.00 % of contract value", False, None), ("Rs. 5,500/-", False, 5500), ("Rs. 2,50,000/-", False, 250000),
        ("Rs. 4.50 Lakh", False, 450000), ("Rs. 6 Crores", False, 6e7), ("1500000", True, 1500000), ("30000", True, 30000), ("145600.0", True, 145600),
        ("Rs.500", False, None), ("INR500", False, None), ("₹500", False, 500), ("500 credits", False, 5e9), ("7 lak", False, 7), ("12345678901234/-", False, None),
    ],
)
def test_first_amount(text, bare, value):
    assert reading.first_amount(text, bare)[0] == value


def test_amount_alone_loses_its_surroundings():
    assert reading.first_amount_at("Bidding-9722687", True)[::2] == (9722687, 8)
    assert reading.first_amount_at("Rs. 5%")[0] == 5


@pytest.mark.parametrize(("text", "value"), [("Rs. 2,50,000/- (Rupees Two Lakhs fifty thousand only)", 250000), ("Rs. 4.50 Lakh", 450000), ("3 cr", 3e7), ("3 credits", 3), ("nil", None)])
def test_money_number(spark, text, value):
    assert _col(spark, text, C.money_number) == value


@pytest.mark.parametrize(("line", "junk"), [("", True), ("बोली Bid", True), ("......, dated: ......", True), ("12 Main Road, Pune 411001", False), ("....", False)])
def test_junk_line(spark, line, junk):
    assert _col(spark, line, C.is_junk_line) == junk == reading.is_junk_line(line)


def _pages(spark, *texts, file="a.txt"):
    return spark.createDataFrame([("t", file, i + 1, x, False) for i, x in enumerate(texts)], "tender string, file string, page int, text string, ocr boolean")


def _label(spark, field, *texts):
    got = W.pick_label_winner(K.label_candidates(_pages(spark, *texts), RULES), ["tender"]).filter(F.col("field") == field).collect()
    return got[0] if got else None


def test_sections(spark):
    def scope(text):
        return [r.value for r in X.section_fields(_pages(spark, text), RULES).filter("field = 'scope_of_work'").collect()]

    assert scope("as defined in the scope of work above, and so on.\nmore text") == []
    assert scope("2. SCOPE OF WORK\n(a) audit of stores\n(b) report")[0].startswith("(a) audit")
    assert scope("1. ITEM\n") == []


def test_section_longer_than_most_is_won_by_the_last(spark):
    body = "(a) " + "word " * 900
    got = X.section_fields(_pages(spark, "SCOPE OF WORK\n" + body + "first", "SCOPE OF WORK\n" + body + "second", "SCOPE OF WORK\nshort one here"), RULES).first()
    assert got.ref == "a.txt (p.2)" and len(got.value) == 4000


def test_labels(spark):
    assert _label(spark, "location", "Consignees/Reporting Officer and Quantity\nx") is None
    far = "EMD BG to be uploaded on the portal" + " and so on" * 15 + " Rs. 9,99,000/-"
    assert _label(spark, "emd", far) is None
    bid = "Bid Number: GEM/2026/B/77\nEMD Amount 30000\n" + "text without figures " * 8 + "\nEstimated Bid Value 1500000"
    assert _label(spark, "emd", bid).numeric == 30000 and _label(spark, "estimated_cost", bid).numeric == 1500000
    fields = {r.field: r for r in X.rules_fields(_pages(spark, bid), RULES).collect()}
    assert fields["tender_fees"].value.startswith("Nil") and fields["tender_name"].value == "GEM/2026/B/77" and fields["tender_name"].conf == "high"
    # a threshold word before the figures makes both readings weak, of which the first counts
    twice = _label(spark, "emd", "EMD Amount up to 50000 but Rs. 7000/- in cash")
    assert (twice.numeric, twice.conf) == (50000, "low")
    weak = _label(spark, "emd", "EMD up to Rs. 100000/- by transfer")
    assert weak.conf == "low" and weak.value.endswith("verify]")


def test_label_winner_equals_the_sequential_fold(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for t in range(40):
        for i in range(int(rng.integers(1, 12))):
            weak, loose, ix, late, prio, page = (int(x) for x in rng.integers(0, 3, 6))
            rows.append((f"t{t}", bool(late > 1), -prio, "f", page, f"r{i}", "emd", bool(loose > 1), ix, i, bool(weak > 1), f"v{i}", "high", 1.0, "EMD"))
    df = spark.createDataFrame(rows, K.LABEL)
    got = {r.tender: r.value.split(" ")[0] for r in W.pick_label_winner(df, ["tender"]).collect()}
    for t in got:
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (r[7], r[8], r[1], r[2], r[3], r[4], r[9]))
        pick = next((r for r in mine if not r[10]), mine[0])
        assert got[t] == pick[11]


def test_boilerplate(spark):
    gcc = [("t", "g.pdf", i, "GENERAL CONDITIONS OF CONTRACT" if i == 1 else "x", False) for i in range(1, 51)]
    two = [("t", "h.pdf", i, "Instructions to\nBidders" if i < 3 else "x", False) for i in range(1, 5)]
    one = [("t", "i.pdf", i, "table of clauses" if i == 3 else "x", False) for i in range(1, 5)]
    df = spark.createDataFrame(gcc + two + one, "tender string, file string, page int, text string, ocr boolean")
    assert {r.file: r.b for r in P.mark_boilerplate(df).groupBy("file").agg(F.max("boilerplate").alias("b")).collect()} == {"g.pdf": True, "h.pdf": True, "i.pdf": False}


def test_penalty_scores(spark):
    texts = ["Penalty of 10 % with banning of the firm and forfeit of all sums due.", "Liquidated damages at � percent per week of delay on the contract value are levied.", "Penalty of 2 % shall be levied for each default in the work done."]
    got = X.penalty_fields(_pages(spark, *texts), RULES).first()
    assert got.value.startswith("Liquidated damages at [?]") and got.conf == "low" and got.ref == "a.txt (p.2)"


def test_city_state(spark):
    f = lambda a: tuple(_col(spark, a, C.split_city_state))
    assert f("SOLAPUR") == ("Solapur", "Maharashtra") and f("Old Town Ward, Bihar") == ("Town Ward", "Bihar") and f("nowhere") == ("", "")


def test_due_dates(spark):
    f = lambda s: str(_col(spark, s, C.due_date))
    assert f("31-02-2026") == "2026-03-03" and f("1/13/26") == "2027-01-01" and f("2026-08-25") == "2025-08-26" and f("5 Sept 2026") == "2026-09-05" and f("x") == "None"


def test_chunks():
    text = "<<<FILE: a | PAGE: 1>>>\n" + "x" * 60 + "\n<<<FILE: a | PAGE: 2>>>\n" + "y" * 60
    assert reading.chunks(text, 500, 8) == [text]
    assert reading.chunks(text, 100, 8)[1].startswith("\n<<<FILE: a | PAGE: 2")
    assert len(reading.chunks("z" * 1000, 100, 3)) == 3


def test_chunks_beyond_most(spark):
    text = "<<<FILE: a | PAGE: 1>>>\n" + "x" * 5000
    corpora = spark.createDataFrame([("t", text)], "tender string, corpus string")
    join = lambda most: "".join(r.text for r in A.chunk_corpus(corpora, 900, most).orderBy("chunk").collect())
    assert join(3) == text[:2700] and join(6) == text


def test_answers(spark):
    rows = [("t", 1, "one", ""), ("t", 1, "two", '{"fields": {"emd": {"value": "NOT FOUND", "confidence": "high"}, "scope_of_work": {"value": "short"}}}'), ("t", 2, "one", '```json\n{"fields": {"emd": {"value": "Rs. 5", "confidence": "odd"}, "scope_of_work": {"value": "longer text"}, "zzz": {"value": "x"}}}\n```'), ("t", 3, "one", "no json")]
    df = spark.createDataFrame(rows, "tender string, chunk int, provider string, json string")
    got = {r.field: r for r in A.merge_answers(A.answer_rows(A.pick_provider_answer(df, ["one", "two"]))).collect()}
    assert got["emd"].value == "Rs. 5" and got["emd"].conf == "medium" and got["scope_of_work"].value == "longer text" and set(got) == {"emd", "scope_of_work"}


def test_files(spark, tmp_path):
    for path, text in (("A/docs/one.txt", "hello\r\nworld"), ("A/Working Folder/two.txt", "no"), ("three.TXT", " loose "), ("B/~$x.txt", "no"), ("B/y.exe", "no")):
        p = tmp_path / "root" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "root" / "A" / "bad.txt").write_bytes(b"ok \xff\xfe end")
    got = {(r.tender, r.file): r.text for r in S.read_text_pages(spark, str(tmp_path / "root")).collect()}
    assert got == {("A", "one.txt"): "hello\n\nworld", ("root", "three.TXT"): "loose", ("A", "bad.txt"): "ok end"}
    listed = S.list_files(spark, str(tmp_path / "root")).collect()
    assert {(r.tender, r.rel_path) for r in listed} == {("A", "docs/one.txt".replace("docs", "A/docs")), ("A", "A/bad.txt"), ("root", "three.TXT")}


def test_page_text_stays_out_of_the_winners_shuffle(spark):
    plan = X.label_fields(_pages(spark, "EMD Amount 30000"), RULES)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "text#" not in line


def test_slots(spark, tmp_path):
    """Decoder and answer slots, and chunks that flow through a model into the merge. A file that can't be decoded is its own loss."""
    import pandas as pd

    for name, content in (("a.bin", b"one|two"), ("b.bin", b""), ("c.bin", b"one|broken"), ("d.exe", b"x")):
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([("t", p.name, p.suffix, p.stat().st_size, str(p)) for p in sorted(tmp_path.iterdir())], "tender string, file string, suffix string, length long, path string")

    def decoder(content):
        for i, x in enumerate(content.decode().split("|")):
            if x == "broken":
                raise ValueError("no such page")
            if x:
                yield i + 1, x, None

    decoded = S.decode(files, {".bin": decoder})
    assert sorted((r.file, r.page, r.text_layer, r.error) for r in decoded.collect()) == [("a.bin", 1, "one", None), ("a.bin", 2, "two", None), ("c.bin", None, None, "ValueError: no such page")]
    pages = P.choose_page_text(decoded.filter("error is null"))
    assert sorted((r.file, r.page, r.text) for r in pages.collect()) == [("a.bin", 1, "one"), ("a.bin", 2, "two")]
    docs = {r.file: (r.pages, r.note) for r in O.documents_read(files, pages, decoded.filter("error is not null")).collect()}
    assert docs["a.bin"] == (2, "") and docs["c.bin"] == (0, "no text extracted - check the file (ValueError: no such page)") and docs["b.bin"] == (0, "no text extracted - check the file")

    def model(frames):
        for f in frames:
            body = ['{"fields": {"emd": {"value": "%d", "confidence": "high"}}}' % len(x) for x in f["text"]]
            yield pd.DataFrame({"tender": f["tender"], "chunk": f["chunk"], "provider": "one", "json": body})

    chunks = A.corpus_chunks(pages, pages.selectExpr("tender", "file", "false boilerplate").distinct(), 70, 1)
    text = chunks.first().text
    assert text.startswith("<<<FILE: a.bin | PAGE: 1>>>\none\n\n<<<FILE") and len(text) <= 70
    got = A.merge_answers(A.answer_rows(A.pick_provider_answer(A.answer(chunks, model), ["one"]))).collect()
    assert [(r.field, r.value, r.ref) for r in got] == [("emd", str(len(text)), "AI")]


def test_sort_orders(spark):
    rows = [("b", 2, 1, 5.0, 0), ("a", 30, 2, 7.0, 3), ("c", None, 3, 1.0, 1), ("d", 1, 0, 7.0, 1)]
    board = spark.createDataFrame(rows, "tender string, days int, state_rank int, emd double, review long")
    order = lambda by: "".join(r.tender for r in V.sort_rows(board, by).collect())
    assert [order(by) for by in ("due", "folder", "emd", "review")] == ["dbac", "abcd", "adbc", "acdb"]


def test_gazetteer_is_whole():
    places = R.default_gazetteer()
    assert len(places) == 205 and places["VASCO DA GAMA"] == "Goa" and set(places.values()) <= set(R.STATES)


def test_amount_signs_look_at_their_own_place_only():
    """What follows an amount says nothing about what stands before one."""
    assert reading.first_amount("fee 5 lakh7")[0] == 500000 and reading.first_amount("fee 5 cr05")[0] == 5e7
    assert reading.first_amount("sum,500/-")[0] == 500 and reading.first_amount("T-12,345/-")[0] is None


def test_places_in_a_table_are_found_as_in_a_pattern(spark):
    import random

    rng = random.Random(2)
    places = R.default_gazetteer()
    names = [*places, *[n.title() for n in places], *R.STATES, "Plot 5", "near Gate", "PO", "Old-Town", "413215", "navi", "Goa road", "", "Delhi6"]
    rows = [(i, rng.choice([", ", " ", "-", " - ", "/"]).join(rng.choices(names, k=rng.randint(0, 5)))) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "i int, a string")
    want = {r.i: tuple(r.p) for r in df.select("i", C.split_city_state(F.col("a")).alias("p")).collect()}
    table = spark.createDataFrame(list(places.items()), "city string, state string")
    assert {r.i: tuple(r.place) for r in split_places(df, "a", table).collect()} == want


def test_many_places(spark):
    table = spark.range(200_000).selectExpr("concat('Place ', id) city", "concat('S', id % 9) state")
    rows = spark.createDataFrame([("at place 77777, Road",), ("Place 5 Place 6",), ("nowhere",)], "a string")
    assert sorted((r.a, *r.place) for r in split_places(rows, "a", table).collect()) == [("Place 5 Place 6", "Place 5", "S5"), ("at place 77777, Road", "place 77777", "S8"), ("nowhere", "", "")]


def test_search_by_index_equals_the_scan(spark):
    import random

    rng = random.Random(9)
    words = ["Rs. 500/-", "Pune", "NOT FOUND - verify manually", "GEM/2026/B/77", "ÄÖ x", "a", ""]
    rows = [(f"T{t}", f, rng.choice(words) + rng.choice(["", " ", "b"]) + rng.choice(words)) for t in range(60) for f in rng.sample(list(R.ORDER), 4)]
    results = spark.createDataFrame(rows, "tender string, field string, value string")
    texts = V.search_texts(results).cache()
    index = V.search_index(texts).cache()
    board = texts.selectExpr("tender", "1 review", "3 days")
    known = {r.tender: r.text for r in texts.collect()}
    for _ in range(12):
        text = rng.choice(sorted(known.values()))
        at, n = rng.randrange(max(1, len(text) - 8)), rng.choice([1, 2, 3, 5, 8])
        q = rng.choice([text[at : at + n], text[at : at + n].upper(), text[at : at + 2] + "zz"])
        want = {t for t, x in known.items() if q.lower() in x}
        assert {r.tender for r in V.search(board, results, q, index=index).collect()} == want == {r.tender for r in V.search(board, results, q).collect()}, q
