from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import geometry, ids, text
from veilframe.operators import extract, mapping, redact, tags


def test_codes_are_a_bijection(spark):
    rows = spark.range(0, 4000).select(F.col("id"), ids.permuted(F.col("id"), "k").alias("p")).withColumn("code", ids.unrank(F.col("p"))).collect()
    assert len({r.code for r in rows}) == 4000 and all(ids.rank(r.code) == r.p for r in rows)
    assert all(r.p == ids.permuted_number(r.id, "k") for r in rows[:50])
    ends = spark.createDataFrame([(0,), (ids.CODES - 1,)], "n long").select(ids.unrank(F.col("n")).alias("c")).collect()
    assert [r.c for r in ends] == ["ABCD0123", "ZYXW9876"]


@given(st.integers(0, ids.CODES - 1))
def test_permutation_stays_in_range(n):
    assert 0 <= ids.permuted_number(n, "s") < ids.CODES


def test_literal_patterns(spark):
    d = spark.createDataFrame([("a.b $5\\E", "x A.B\n  $5\\e y"), ("no", "yes")], "v string, t string")
    assert [r.n for r in d.select(F.regexp_count("t", text.literal_pattern(F.col("v"))).alias("n")).collect()] == [1, 0]


def test_row_fold_is_greedy(spark):
    r = spark.range(1).select(extract.row_numbers(F.array(F.lit(0.0), F.lit(1.5), F.lit(3.0), F.lit(3.1)), 1.6).alias("r")).first().r
    assert r == [1, 1, 2, 2]


def test_empty_field_takes_no_label(spark):
    d = spark.createDataFrame([("CR No : \nPatient Name : X  Y\nWard/OPD : Ward",)], "t string")
    r = d.select(extract.labelled_value(F.col("t"), "CR No").alias("a"), extract.labelled_value(F.col("t"), "Patient Name").alias("b"), extract.labelled_value(F.col("t"), "Ward/OPD").alias("c"), extract.labelled_value(F.col("t"), "Room/Bed").alias("d")).first()
    assert tuple(r) == (None, "X Y", "Ward", None)


def test_redaction_leaves_no_hit_and_bad_replacements_are_literal(spark):
    pages = spark.createDataFrame([("d", 0, "key 55 Name Any Body 55 any\nbody")], "doc_id string, page_no int, text string")
    targets = spark.createDataFrame([("d", "55", "replace"), ("d", "Any Body", "blank")], "doc_id string, value string, action string")
    out = redact.redacted(pages, targets, spark.createDataFrame([("d", "$1\\x")], "doc_id string, anon_id string"))
    assert out.first().text == "key $1\\x Name  $1\\x \nSubject ID: $1\\x"
    assert redact.hits(out, targets.where("action = 'blank'")).first().hits == 0


def test_uid_map_is_injective_per_subject(spark):
    t = spark.createDataFrame([(f"f{i}", "StudyInstanceUID", f"1.{i % 3}") for i in range(9)], "file string, keyword string, value string")
    s = spark.createDataFrame([(f"f{i}", f"S{i % 2}") for i in range(9)], "file string, anon_id string")
    m = tags.uid_map(t, s, "k").collect()
    assert len({r.new_uid for r in m}) == len(m) == 6


def test_banner_of_every_frame(spark):
    px = bytes(range(1, 25))
    d = spark.createDataFrame([(bytearray(px), 1), (bytearray(px), None), (bytearray(px), 9)], "p binary, y0 int")
    n = lambda v: F.lit(v)
    r = [x.o for x in d.select(tags.banner_zeroed(F.col("p"), F.col("y0"), n(3), n(4), n(1), n(2)).alias("o")).collect()]
    assert bytes(r[0]) == b"\0" * 4 + px[4:12] + b"\0" * 4 + px[16:] and r[1] is None and bytes(r[2]) == b"\0" * 24


def test_ranges_and_places(spark):
    r = spark.range(1).select(mapping.range_name("S", F.lit(0), F.lit(20)).alias("a"), mapping.range_name("S", F.lit(40), F.lit(40)).alias("b"), geometry.signature_area(F.lit(100.0), F.lit(None).cast("double"), F.lit(9.0)).alias("c"), geometry.signature_area(F.lit(100.0), F.lit(200.0), F.lit(9.0)).alias("d")).first()
    assert (r.a, r.b, r.c.y0, r.d) == ("S_1_20", "S_40_40", 10.0, None)


def test_numbers_run_over_partitions(spark):
    d = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"))
    assert all(r.n == r.k + 1 for r in mapping.numbered(d, F.col("k")).collect())


def test_mapping_last_row_counts_and_blanks_do_not(spark):
    m = spark.createDataFrame([(" a ", "ONE", 0), ("a", "TWO", 1), (" ", "X", 2)], "original_key string, anon_id string, ordinal long")
    assert [tuple(r) for r in mapping.keys(m).collect()] == [("a", "TWO")]
