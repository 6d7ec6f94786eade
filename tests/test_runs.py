"""Runs that last: stored snapshots, runs that break off, what moves in a run."""

import pytest
from pyspark.sql import functions as F

from leafmine import rules as R
from leafmine.operators import outputs as O
from leafmine.plans import extraction as X
from leafmine.plans import job as J
from leafmine.sources import snapshots as N

PAGES = {"a/one.txt": "Bid Number: GEM/2026/B/1\nEMD Amount 30000\nBid Opening Date/Time 01-02-2026", "b/two.txt": "EMD Amount Rs. 500/-", "c/bad.pdf": None, "d/bad.pdf": None, "d/good.txt": "EMD Amount Rs. 700/-"}


def _files(spark, later: str = "", without: str = "-"):
    rows = [(*path.split("/"), 9, 1_700_000_000 + 60 * path.startswith(later or "-")) for path in PAGES if not path.startswith(without)]
    return spark.createDataFrame(rows, "tender string, file string, length long, at long").selectExpr("tender", "file", "length", "timestamp_seconds(at) mtime", "cast(null as string) remote_id")


def _read(log):
    def read(part):
        names = sorted((r.tender, r.file) for r in part.collect())
        log.append(names)
        rows = [(t, f, None if PAGES[f"{t}/{f}"] is None else 0, PAGES[f"{t}/{f}"], None, "no pdf" if PAGES[f"{t}/{f}"] is None else None) for t, f in names]
        return part.sparkSession.createDataFrame(rows, "tender string, file string, page int, text_layer string, ocr_text string, error string")

    return read


def _model():
    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"tender": frame["tender"], "chunk": frame["chunk"], "provider": "one", "json": '{"fields": {"period": {"value": "9 months", "confidence": "high"}}}'})

    return run


def test_stored_runs(spark, tmp_path, monkeypatch):
    """A second session reuses what the first one stored; a run that breaks off shows nothing; a failed tender is tried again, one with a
    broken file beside a good one is not."""
    log, root = [], str(tmp_path / "store")
    first = J.run_stored(N.Store(spark, root), _files(spark), _read(log), model=_model(), defaults={"Layout": "Main"})
    other = spark.newSession()
    store = N.Store(other, root)
    monkeypatch.setattr(N.Store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        J.run_stored(store, _files(other, later="b"), _read(log), model=_model())
    monkeypatch.undo()
    assert N.Store(other, root).snapshot() == first
    second = J.run_stored(store, _files(other, later="b", without="a"), _read(log), model=_model())
    assert second.version == 2
    assert [sorted({t for t, _ in names}) for names in log] == [["a", "b", "c", "d"], ["b", "c"], ["b", "c"]]
    rows = {r.tender: r for r in store.read("rows", second, J.CACHE).collect()}
    assert set(rows) == {"b", "c", "d"} and not rows["c"].ai_ok and rows["d"].ai_ok
    assert {r["flag"] for r in rows["c"].results.values()} == {"processing error"} and rows["d"].results["emd"]["value"].startswith("Rs. 700")
    notes = {(r.tender, r.file): r.note for r in other.read.parquet(*[f"{root}/{p}" for p in second.tables["documents"].values()]).collect()}
    assert notes == {("b", "two.txt"): "", ("c", "bad.pdf"): "no text extracted - check the file (no pdf)", ("d", "bad.pdf"): "no text extracted - check the file (no pdf)", ("d", "good.txt"): ""}
    # whoever has pinned the first snapshot goes on reading it
    assert store.read("rows", first, J.CACHE).count() == 4
    for table in ("summary", "evidence", "crm", "dashboard"):
        n = other.read.parquet(*[f"{root}/{p}" for p in second.tables[table].values()]).count()
        assert n == (3 * len(R.FIELDS) if table == "evidence" else 3)
    with pytest.raises(RuntimeError, match="another run"):
        store.commit(store.write({}, first))
    store.clean(1)
    assert store.versions() == [2] and store.read("rows", store.snapshot(), J.CACHE).count() == 3


def test_untouched_buckets_are_named_again(spark, tmp_path):
    store = N.Store(spark, str(tmp_path))
    rows = spark.range(500).selectExpr("cast(id as string) tender", "1 as v")
    first = store.commit(store.write({"rows": rows}, store.snapshot()))
    touched = [r[0] for r in rows.filter("tender = '7'").select(N.bucket()).collect()]
    second = store.commit(store.write({"rows": rows.withColumn("v", F.lit(2)).filter(N.bucket().isin(touched))}, first, touched))
    assert len({b for b in second.tables["rows"] if second.tables["rows"][b] != first.tables["rows"][b]}) == 1
    got = store.read("rows", second, "tender string, v int")
    assert got.count() == 500 and got.filter("v = 2").count() == rows.filter(N.bucket().isin(touched)).count()


def _nodes(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_what_moves(spark, tmp_path, monkeypatch):
    """In the rules reader page texts pass no exchange, sort or window, but for pages that the bitmap lets through."""
    pages = spark.createDataFrame([("t", "a.txt", i, "EMD Amount 30000\nELIGIBILITY CRITERIA\n(i) all" if i == 2 else "x", False) for i in range(1, 9)], "tender string, file string, page int, text string, ocr boolean")
    pages.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    plans = []
    write = X.Scratch.write

    def kept(self, df, name):
        plans.append((name, _nodes(df)))
        return write(self, df, name)

    monkeypatch.setattr(X.Scratch, "write", kept)
    fields = X.Rules(pages, R.RuleSet()).fields
    assert {r.field for r in fields.collect()} >= {"emd", "eligibility"}
    for name, nodes in plans:
        for line in nodes:
            assert not any(f"{kind} " in line and "text#" in line for kind in ("Exchange", "Sort", "Window")), (name, line)
    # in the rest texts move behind the bitmaps alone: of pages in reach, and of summary sheets
    assert sum("BroadcastHashJoin [" in line and "_at" in line for line in _nodes(fields)) >= 2


def test_several_evidence_rows_of_one_label(spark):
    results = spark.createDataFrame([("t", f, "v", "", "", "", "", "") for f in R.ORDER], "tender string, field string, value string, ref string, conf string, rules_value string, ai_value string, flag string")
    told = O.evidence(results)
    assert O.rows_from_outputs(O.tender_summary(results), told.union(told.withColumn("value", F.lit("w")))).filter("value = 'w'").count() == len(R.FIELDS)
