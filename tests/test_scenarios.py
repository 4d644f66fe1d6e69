"""Whole runs on made-up reports: first run, the same again, an output gone, one more file, another subject's file, refusals."""

from __future__ import annotations

import pytest

from veilframe.plans.batch import run_batch
from veilframe.sources.mapping_csv import SCHEMA

PAGE = "path string, package string, parent string, content binary"


def report(key, name, extra=""):
    return f"Department of Biochemistry\nCR No : {key}\nPatient Name : {name}\nWard : W9\nInvestigation\nok {extra}\nPage 1 of 1"


def frames(spark, reports):
    """reports: path -> (package, text)."""
    files = spark.createDataFrame([(p, pk, pk, t.encode()) for p, (pk, t) in reports.items()], PAGE)
    pages = spark.createDataFrame([(p, 0, t, 100.0, 100.0) for p, (_, t) in reports.items()], "doc_id string, page_no int, text string, width double, height double")
    words = spark.createDataFrame([], "doc_id string, page_no int, n int, x0 double, y0 double, word string")
    images = spark.createDataFrame([], "doc_id string, page_no int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    return files, pages, words, images


def run(spark, reports, known=None, listing=(), study="egfr"):
    known = known if known is not None else spark.createDataFrame([], SCHEMA)
    return run_batch(*frames(spark, reports), known, spark.createDataFrame([(x,) for x in listing], "path string"), "/out", study, "secret")


@pytest.fixture(scope="module")
def first(spark):
    reports = {"/in/p1/a.pdf": ("p1", report("11111", "Vela Quist")), "/in/p1/b.pdf": ("p1", report("11111", "Vela Quist", "2")), "/in/p2/c.pdf": ("p2", report("22222", "Oro Bant"))}
    r = run(spark, reports)
    known = spark.createDataFrame(r.mapping.collect(), SCHEMA)
    return reports, r, known, [x.out for x in r.plan.collect()]


def verdicts(r):
    return {x.key: x.verdict for x in r.verdicts.collect()}


def test_first_run(first):
    reports, r, known, outs = first
    assert verdicts(r) == {"11111": "new", "22222": "new"}
    rows = known.orderBy("ordinal").collect()
    assert [x.s_no for x in rows] == ["1", "2"] and len({x.anon_id for x in rows}) == 2 and all(x.fingerprints and x.last_anonymized for x in rows)
    assert len(outs) == 3 and r.refused.count() == 0 and r.incomplete.count() == 0
    for p in r.pages.collect():
        assert "Vela" not in p.text and "Oro" not in p.text and "11111" not in p.text and "22222" not in p.text and "Subject ID: " in p.text


def test_same_again(spark, first):
    reports, _, known, outs = first
    r = run(spark, reports, known, outs)
    assert set(verdicts(r).values()) == {"duplicate"} and r.plan.count() == 0 and r.pages.count() == 0
    assert not any(x.is_new for x in r.subjects.collect()) and r.mapping.count() == known.count()


def test_output_gone(spark, first):
    reports, _, known, outs = first
    r = run(spark, reports, known, [x for x in outs if not x.endswith("c.pdf")])
    assert verdicts(r) == {"11111": "duplicate", "22222": "recreate"}


def test_one_more_file(spark, first):
    reports, _, known, outs = first
    r = run(spark, reports | {"/in/p1/d.pdf": ("p1", report("11111", "Vela Quist", "3"))}, known, outs)
    assert verdicts(r) == {"11111": "partial", "22222": "duplicate"} and r.plan.count() == 3


def test_other_subject(spark, first):
    reports, _, known, outs = first
    rekeyed = known.selectExpr("s_no", "CASE WHEN original_key = '22222' THEN '99999' ELSE original_key END AS original_key", "anon_id", "name", "fingerprints", "last_anonymized", "extra", "ordinal")
    r = run(spark, reports, spark.createDataFrame(rekeyed.collect(), SCHEMA), outs)
    assert [(x.path, x.owner) for x in r.conflicts.collect()] == [("/in/p2/c.pdf", "99999")] and verdicts(r)["22222"] == "new"


def test_refusals(spark):
    reports = {"/in/p1/a.pdf": ("p1", report("11111", "A Bee")), "/in/p1/b.pdf": ("p1", report("33333", "C Dee")), "/in/p2/c.pdf": ("p2", "a text of more than twenty characters, no signs"), "/in/p3/d.pdf": ("p3", report("44444", "E Eff"))}
    r = run(spark, reports)
    assert {x.path for x in r.refused.collect()} == {"/in/p1/a.pdf", "/in/p1/b.pdf", "/in/p2/c.pdf"}
    assert [x.src for x in r.plan.collect()] == ["/in/p3/d.pdf"]


def test_guard_refuses_a_page_without_the_value(spark):
    files, pages, words, images = frames(spark, {"/in/p1/a.pdf": ("p1", report("11111", "A Bee"))})
    pages = pages.unionByName(spark.createDataFrame([("/in/p1/a.pdf", 1, "second page without it", 100.0, 100.0)], pages.schema))
    r = run_batch(files, pages, words, images, spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "path string"), "/out", "egfr", "s")
    assert r.incomplete.count() > 0 and r.pages.count() == 0 and all(not x.fingerprints for x in r.mapping.collect())


def test_lab_study_groups_by_key(spark):
    reports = {"/in/a.pdf": ("", report("11111", "A Bee")), "/in/b.pdf": ("", report("33333", "C Dee")), "/in/c.pdf": ("", "short")}
    r = run(spark, reports, study="kfre")
    assert verdicts(r) == {"11111": "new", "33333": "new"} and [x.path for x in r.refused.collect()] == ["/in/c.pdf"]
