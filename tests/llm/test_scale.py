"""Near-duplicates hidden among many unlinked documents of one template."""

from __future__ import annotations

import glob
import time

from veilframe.llm import common, near_dedup, substring_dedup
from veilframe.llm.common import shared_dir


def test_pairs_in_template(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "STRAYS", 24)  # as a template of many thousand documents has it with 1024
    template, rows = " ".join(f"t{i}" for i in range(164)), []
    for d in range(1600):
        own = [f"d{d}x{i}" for i in range(40)]
        rows.append((d, " ".join([template, *own])))
        if d < 800:  # 178 of 222 shingles
            rows.append((10_000 + d, " ".join([template, *own[:18], *(f"e{d}x{i}" for i in range(22))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    lost = [d for d, _ in rows if got[d] != d % 10_000]
    assert len(got) == len(rows) and all(got[d] == d for d in lost)
    assert not lost  # of 800 at the threshold


def test_recall_at_the_threshold(spark):
    """2,000 pairs with 80 of 100 shingles in common, and as many with 79."""
    rows, want = [], {}
    for d in range(2000):
        for kind, same in ((0, 84), (1, 83)):  # 80 and 79 five-word shingles of a run of words
            a, b = 4 * d + 2 * kind, 4 * d + 2 * kind + 1
            run = [f"c{d}k{kind}x{i}" for i in range(same)]
            rows += [(a, " ".join(run + [f"a{d}k{kind}x{i}" for i in range(10)])), (b, " ".join(run + [f"b{d}k{kind}x{i}" for i in range(10 + kind)]))]
            want[a], want[b] = a, a if kind == 0 else b
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    missed = sum(got[4 * d + 1] != 4 * d for d in range(2000))
    assert missed <= 2 and all(got[i] == want[i] for i in want if i % 4 != 1)


def test_small_tables_are_written_by_few_tasks(spark):
    """As many files as the documents ask for, not one for each shuffle partition: what check_h's time went to."""
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = [(i, " ".join(f"g{i // 2}x{j}" for j in range(30))) for i in range(400)] + [(1000 + i, f"alone{i}") for i in range(10)]
    docs = spark.createDataFrame([(d, f"{t} own{d}" if d < 400 else t) for d, t in rows], "doc_id long, text string")
    folder = f"{shared_dir(spark).removeprefix('file:').rstrip('/')}/veilframe/{spark.sparkContext.applicationId}"
    old = set(glob.glob(f"{folder}/*"))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {d: d // 2 * 2 if d < 400 else d for d, _ in rows}
    files = {t: len(glob.glob(f"{t}/part-*")) for t in set(glob.glob(f"{folder}/*")) - old}
    most = 4 * spark.sparkContext.defaultParallelism
    assert len(files) > 10 and not {t: n for t, n in files.items() if n > most and "/reps-" not in t and "/features-" not in t}


def test_substring_steps_leave_no_files(spark):
    """Shuffle files and tables of ended steps are gone before the last step begins: they were what the disk went to."""
    rows = [(i if i % 50 else None, " ".join(f"s{i // 2}x{j}" for j in range(300)) + f" own{i}") for i in range(400)]
    folder = f"{shared_dir(spark).removeprefix('file:').rstrip('/')}/veilframe/{spark.sparkContext.applicationId}"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f.getName(): f.length() for f in map(disk.getAllFiles().apply, range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}

    tables, files = set(glob.glob(f"{folder}/*")), set(shuffled())
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    end = time.time() + 10
    while (left := sum(n for f, n in shuffled().items() if f not in files)) > 100_000 and time.time() < end:
        time.sleep(0.2)  # executors are told to remove them, not waited for
    assert left <= 100_000  # sums of a few rows
    assert {t.rsplit("/", 1)[1].split("-")[0] for t in set(glob.glob(f"{folder}/*")) - tables} == {"candidates", "starts"}
    assert spark.conf.get(common._SWEEP, None) is None
    assert [(r.n_words, r.n_removed) for r in got.collect()] == [(301, 300)] * 400
