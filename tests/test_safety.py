"""What must never pass silently: subjects without an id, files that weren't read, names left in headers, prints of files that weren't written."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from tests.test_scenarios import frames, report
from veilframe.functions import ids
from veilframe.operators import mapping, redact
from veilframe.plans.batch import recorded, run_batch
from veilframe.sources import dicom, pdf, writer
from veilframe.sources.mapping_csv import SCHEMA
from veilframe.streaming import incremental


def test_every_counter_has_a_code(spark):
    rows = spark.range(231_700, 231_800).select("id", ids.permuted(F.col("id"), "secret").alias("p")).collect()
    assert all(r.p == ids.permuted_number(r.id, "secret") for r in rows)
    assert spark.range(200_000).select(ids.permuted(F.col("id"), "secret").alias("p")).where("p IS NULL").count() == 0


def test_counters_without_a_code_are_left_out(spark, monkeypatch):
    real = mapping.permuted
    monkeypatch.setattr(mapping, "permuted", lambda n, secret: F.when(n % 3 != 1, real(n, secret)))
    arrivals = spark.createDataFrame([(f"k{i}", "n", f"{i}") for i in range(5)], "key string, name string, first_seen string")
    got = mapping.assign(arrivals, spark.createDataFrame([], SCHEMA), "s").collect()
    assert len({r.anon_id for r in got}) == 5 and None not in {r.anon_id for r in got} and sorted(r.s_no for r in got) == [1, 2, 3, 4, 5]


def test_unreadable_files_are_refused(spark):
    reports = {"/in/p1/a.pdf": ("p1", report("11111", "A Bee")), "/in/p1/b.pdf": ("p1", ""), "/in/p2/c.pdf": ("p2", report("22222", "C Dee"))}
    files, pages, words, images = frames(spark, reports)
    streams = b"%PDF-1.5\n1 0 obj\n<< /Type /ObjStm /N 1 /First 4 >>\nstream\nx\nendstream\nendobj\n"
    broken = pdf.page_texts(spark.createDataFrame([("/in/p1/b.pdf", streams)], "path string, content binary"))
    read = pages.where("doc_id <> '/in/p1/b.pdf'").withColumn("error", F.lit(None).cast("string"))
    pages = read.unionByName(broken, allowMissingColumns=True)
    r = run_batch(files, pages, words, images, spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "path string"), "/out", "egfr", "s")
    refused = {x.path: x.reason for x in r.refused.collect()}
    assert set(refused) == {"/in/p1/a.pdf", "/in/p1/b.pdf"} and refused["/in/p1/b.pdf"] == "unreadable: ValueError"
    assert [x.src for x in r.plan.collect()] == ["/in/p2/c.pdf"] and [x.key for x in r.done.collect()] == ["22222"]


def test_partial_write_failure(spark, tmp_path):
    reports = {"/in/p1/a.pdf": ("p1", report("11111", "A Bee")), "/in/p1/b.pdf": ("p1", report("11111", "A Bee", "2")), "/in/p2/c.pdf": ("p2", report("22222", "C Dee"))}
    known = spark.createDataFrame([], SCHEMA)
    (tmp_path / "blocked").write_text("a file where a folder should be")
    r = run_batch(*frames(spark, reports), known, spark.createDataFrame([], "path string"), str(tmp_path), "egfr", "s")
    to = r.plan.select(F.when(F.col("src").endswith("b.pdf"), f"{tmp_path}/blocked/b.pdf").otherwise(F.col("out")).alias("out"), F.lit(b"x").alias("content"), F.col("out").alias("planned"))
    done = writer.write_files(to).join(to.select("out", "planned"), "out").select(F.col("planned").alias("out"), "written", "error")
    rows = {x.original_key: x for x in recorded(known, r, done).collect()}
    assert rows["22222"].fingerprints and rows["22222"].last_anonymized
    assert not rows["11111"].fingerprints and not rows["11111"].last_anonymized and rows["11111"].anon_id
    assert writer.write_files(to.where("planned LIKE '%c.pdf'")).first().written  # again over what is there


def test_barcode_fonts(spark):
    d = spark.createDataFrame([("IDAutomationHC39M",), ("idautomation2d",), ("3of9Barcode",), ("Arial",)], "font string")
    assert {r.font for r in redact.coded_spans(d).collect()} == {"IDAutomationHC39M", "idautomation2d", "3of9Barcode"}


def test_names_in_headers():
    e = lambda g, n, vr, raw: dicom.Element((g, n), vr, raw)
    regions = dicom.Element((0x18, 0x6011), b"SQ", items=[[e(0x18, 0x601A, b"UL", struct.pack("<I", 0))]])
    person = dicom.Element((8, 0x1072), b"SQ", items=[[e(0x40, 0x1101, b"LO", b"OPERATOR-ID")]])
    some = [e(8, 0x9C, b"PN", b"Consult^A"), person, e(0x10, 0x10, b"PN", b"Real^Name"), regions, e(0x40, 6, b"PN", b"Sched^B"), e(0x40, 0xA999, b"PN", b"Other^C")]
    from veilframe.operators import tags
    from veilframe.rules import HeaderRules
    import re

    rules = HeaderRules()
    out = dicom.rewritten(dicom.build([], some), "ABCD1234", lambda k: k in rules.keywords or bool(re.search(rules.pattern, k)) and k not in tags.SUBJECT_TAGS, lambda kind, old: "2.25.1")
    assert b"ABCD1234" in out and not any(x in out for x in (b"Consult", b"OPERATOR-ID", b"Real", b"Sched", b"Other^C"))


def test_values_in_longer_figures_stay(spark):
    pages = spark.createDataFrame([(1, 0, "CR No : 17\nResult 175 17, x17 (17)")], "doc_id long, page_no int, text string")
    targets = spark.createDataFrame([(1, "17", "blank")], "doc_id long, value string, action string")
    assert redact.redacted(pages, targets, pages.select("doc_id", F.lit(None).cast("string").alias("anon_id"))).first().text == "CR No : \nResult 175 , x17 ()"
    glued = pages.withColumn("text", F.lit("x17"))
    assert redact.guard(glued, targets, whole=True).count() == 1 and redact.guard(pages, targets, whole=True).count() == 0


def test_arriving_files_keep_their_subject(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    key = lambda d: d.select(F.element_at(F.split("path", "/"), -1).substr(1, 2).alias("key"), F.lit("n").alias("name"), F.sha2("content", 256).alias("fp"))
    seen = []
    for i, name in enumerate(("k1-a", "k1-b", "k2-a")):
        (inbox / name).write_text(name)
        incremental.accumulate(incremental.arriving(spark, str(inbox)), key, store, str(tmp_path / "ck"), "s").awaitTermination()
        seen.append({(r.key, r.anon_id) for r in spark.read.parquet(store).collect()})
    assert len(seen[0]) == len(seen[1]) == 1 and seen[0] == seen[1] and len(seen[2]) == 2 and spark.read.parquet(store).count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no table")
    with pytest.raises(Exception):  # noqa: B017  an unreadable store is no empty one
        incremental.accumulate(incremental.arriving(spark, str(inbox)), key, str(tmp_path / "bad"), str(tmp_path / "ck2"), "s").awaitTermination()
