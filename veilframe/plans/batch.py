"""Whole runs: files to subjects, verdicts, redacted page text and scrubbed images, and the new mapping."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import classify, extract, fingerprints, identity, mapping, plan, redact, tags
from veilframe.operators.keep import kept
from veilframe.rules import HeaderRules
from veilframe.sources import dicom


@dataclass
class Run:
    """Frames of one run. Nothing is written until the caller writes the plan's files; the mapping to keep is then recorded()."""

    verdicts: DataFrame  # key, total, already, fresh, verdict
    subjects: DataFrame  # key, anon_id, is_new
    refused: DataFrame  # path, reason (an unreadable file with its error)
    plan: DataFrame  # src, out, category, anon_id
    pages: DataFrame  # doc_id, page_no, text
    incomplete: DataFrame  # doc_id, value, missing: refused by the guard
    conflicts: DataFrame  # files that another subject had first
    mapping: DataFrame  # the mapping after the run, if all of the plan gets written
    done: DataFrame  # key, fp, out: what becomes known once it is written


def run_batch(files: DataFrame, pages: DataFrame, words: DataFrame, images: DataFrame, known: DataFrame, listing: DataFrame, root: str, study: str, secret: str) -> Run:
    """One bounded pass over files (path, package, parent, content), page texts, words and image placements.

    known is the mapping as read; listing (path) tells which outputs are there. A package with two
    identities, an unknown template or no identity goes to `refused` with all its files; a package
    whose files are all known and written is left out of the plan.
    """
    docs = files.where("lower(path) LIKE '%.pdf'").select(F.col("path").alias("doc_id"))
    if "error" in pages.columns:  # as page_texts() gives them
        broken = pages.where("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("error"))
        pages = pages.where("error IS NULL").drop("error")
    else:
        broken = docs.select("doc_id", F.lit(None).cast("string").alias("error")).limit(0)
    full = classify.full_page_images(pages, images)
    kinds = classify.kinds(docs, pages.join(full, ["doc_id", "page_no"]), study).join(broken, "doc_id", "left")
    # Only a file that was read can be a scanned form.
    unread = F.col("error").isNotNull() | (F.col("page_count") == 0)
    kinds = kinds.withColumn("kind", F.when(unread, "unknown").otherwise(F.col("kind"))).withColumn("error", F.when(unread, F.concat(F.lit("unreadable: "), F.coalesce("error", F.lit("no pages")))))
    found = kinds.join(extract.fields_a(pages), "doc_id", "left").join(extract.fields_b(words).withColumnRenamed("name", "name_b"), "doc_id", "left")
    found = found.withColumnRenamed("doc_id", "path").withColumn("name", F.coalesce("patient_name", "name_b"))
    f = files.select("path", "package", "parent", fingerprints.fingerprint(F.col("content"), F.col("path")).alias("fp")).join(found, "path", "left")
    f = identity.file_keys(f.withColumn("kind", F.coalesce("kind", F.lit("image"))))
    own = F.col("key") if study == "kfre" else F.col("package")
    f = f.withColumn("unit", F.coalesce(own, F.col("package")))
    units = identity.packages(f.select(F.col("unit").alias("package"), "key", "name")).withColumnRenamed("package", "unit")
    bad = F.coalesce(F.col("error"), F.col("refusal"), F.when(F.col("status") != "ok", F.col("status")))
    f = f.drop("key", "name").join(units.select("unit", "key", "name", "status"), "unit").withColumn("reason", bad)
    f = kept(f)
    stopped = f.where("reason IS NOT NULL").select("unit").distinct() if study == "egfr" else f.where("reason IS NOT NULL AND kind <> 'scanned'").select("unit").distinct()
    good = f.join(stopped, "unit", "left_anti").where("reason IS NULL")
    refused = f.join(stopped, "unit", "left_semi").select("path", F.coalesce("reason", F.lit("package refused")).alias("reason"))
    arrivals = good.groupBy("key").agg(F.min("name").alias("name"), F.min("path").alias("first_seen"))
    subjects = kept(mapping.assign(arrivals, known, secret))
    placed = kept(good.join(subjects.select("key", "anon_id"), "key"))
    side = F.when(F.lower("parent").contains("kidney"), F.col("parent"))
    outputs = plan.planned(placed.select("path", "kind", "anon_id", side.alias("side")), root)
    there = listing.select(F.col("path").alias("out")).distinct().withColumn("written", F.lit(True))
    state = placed.select("key", "fp", F.col("path").alias("src")).join(outputs.select("src", "out"), "src").join(there, "out", "left").withColumn("written", F.coalesce("written", F.lit(False)))
    prints = mapping.known_fingerprints(known)
    verdicts = kept(fingerprints.verdicts(state, prints))
    todo = verdicts.where("verdict <> 'duplicate'").select("key")
    work = placed.join(todo, "key", "left_semi")
    targets = kept(extract.targets_a(extract.fields_a(pages)).unionByName(extract.targets_b(extract.fields_b(words))))
    reports = work.where("kind IN ('A', 'B')").select(F.col("path").alias("doc_id"), "anon_id")
    own_pages, own_targets = pages.join(reports.select("doc_id"), "doc_id", "left_semi"), targets.join(reports.select("doc_id"), "doc_id", "left_semi")
    incomplete = kept(redact.guard(own_pages, own_targets, whole=True))
    whole = own_pages.join(incomplete.select("doc_id").distinct(), "doc_id", "left_anti")
    redacted = redact.redacted(whole, own_targets, reports)
    # A subject with a refused report is not done, whatever else of it gets written.
    halted = work.join(incomplete.select(F.col("doc_id").alias("path")).distinct(), "path", "left_semi").select("key").distinct()
    done = kept(work.join(halted, "key", "left_anti").join(outputs.select(F.col("src").alias("path"), "out"), "path").select("key", "fp", "out"))
    return Run(verdicts, subjects, refused, outputs.join(work.select(F.col("path").alias("src")), "src", "left_semi"), redacted, incomplete, fingerprints.conflicts(placed.select("key", "fp", "path"), prints), updated(known, subjects, done.select("key", "fp")), done)


def recorded(known: DataFrame, run: Run, written: DataFrame) -> DataFrame:
    """The mapping to keep once files were written (out, written, ...): fingerprints and the date are added for subjects all of whose planned files are there."""
    there = written.where("written").select("out").distinct()
    missing = run.done.join(there, "out", "left_anti").select("key").distinct()
    return updated(known, run.subjects, run.done.join(missing, "key", "left_anti").select("key", "fp"))


def updated(known: DataFrame, subjects: DataFrame, done: DataFrame) -> DataFrame:
    """The mapping with new subjects after its rows and done (key, fp) fingerprints and today's date added. Known names stay."""
    keys = F.regexp_replace("original_key", r"(?U)^\s+|\s+$", "").alias("key")
    prints = fingerprints.accumulate(mapping.known_fingerprints(known), done)
    today = F.date_format(F.current_date(), "yyyy-MM-dd")
    touched = done.select("key").distinct().withColumn("touched", F.lit(True))
    old = known.select("*", keys)
    last, n = known.agg(F.max("ordinal"), F.count("*")).first()
    place = (F.col("s_no") - n + (-1 if last is None else last)).alias("ordinal")
    new = subjects.where("is_new").select(F.col("s_no").cast("string").alias("s_no"), F.col("key").alias("original_key"), "anon_id", "name", F.lit("").alias("fingerprints"), F.lit("").alias("last_anonymized"), F.lit(None).cast("map<string,string>").alias("extra"), place, "key")
    rows = old.unionByName(new).join(prints.withColumnRenamed("fingerprints", "__fp"), "key", "left").join(touched, "key", "left")
    return rows.select("s_no", "original_key", "anon_id", "name", F.coalesce("__fp", "fingerprints").alias("fingerprints"), F.when(F.col("touched"), today).otherwise(F.col("last_anonymized")).alias("last_anonymized"), "extra", "ordinal")


def scrubbed_images(files: DataFrame, subjects: DataFrame, secret: str, rules: HeaderRules = HeaderRules()) -> DataFrame:
    """Image files (path, content) of subjects (path, anon_id) rewritten: path, content, error. A file that can't be done has no content."""
    import hashlib
    import re

    pattern = re.compile(rules.pattern)

    def run(batches):
        for b in batches:
            done, errors = [], []
            for path, content, subject in zip(*(c.to_pylist() for c in b.columns)):
                def uid(kind: str, old: str, path: str = path, subject: str = subject) -> str:
                    h = hashlib.sha256("|".join([secret, subject, old, *([path] if kind == tags.FILE_UID else [])]).encode()).hexdigest()
                    return f"2.25.{int(h[:15], 16)}{int(h[15:30], 16):019d}"

                try:
                    done.append(dicom.rewritten(content or b"", subject, lambda k: k in rules.keywords or bool(pattern.search(k)) and k not in tags.SUBJECT_TAGS, uid))
                    errors.append(None)
                except (ValueError, KeyError) as e:
                    done.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "content").join(subjects.select("path", "anon_id"), "path").select("path", "content", "anon_id").mapInArrow(run, "path string, content binary, error string")


__all__ = ["Run", "recorded", "run_batch", "scrubbed_images", "updated"]
