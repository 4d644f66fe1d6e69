"""A registered query redacts every customer's report, in all three forms of the room."""

from __future__ import annotations

from veilframe.plans import queries as core

SF = "/root/testdata/sf0.001"


def test_all_reports(spark):
    got = core.QUERIES["redact_all_reports"](spark, SF).collect()
    keys = {r.c_custkey for r in core.table(spark, SF, "customer").select("c_custkey").collect()}
    assert {r.doc_id for r in got} == keys and len(got) == 2 * len(keys)
    first = {r.doc_id: r.text for r in got if r.page_no == 0}
    assert {d % 3: [x for x in t.split("\n") if x.startswith("Room")] for d, t in first.items()} == {0: [], 1: ["Room/Bed :"], 2: ["Room/Bed : "]}
