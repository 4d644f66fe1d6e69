"""Queries over the driver's tables, one or more for each operator family, with the SQL that must give the same rows.

The tables hold no reports, headers or file lists, so queries render them from customers, orders,
lineitems, documents and events, and put the rendered material through the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import geometry, ids
from veilframe.functions.text import short_path, subject_file_name
from veilframe.operators import classify, extract, fingerprints, identity, mapping, plan, redact, tags
from veilframe.rules import PRIORITY_TAGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SECRET = "fixture"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of their source, known ones (every third, and two whole sources), and whether a label marks an output as there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("key"), fingerprints.fingerprint(F.col("text")).alias("fp"))
    out = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("written", F.lit(True))
    files = d.join(out, "doc_id", "left").withColumn("written", F.coalesce("written", F.lit(False)) | (F.col("key") == "src2"))
    known = d.where("doc_id % 3 = 0 OR key IN ('src1', 'src2')").select("key", "fp", F.col("doc_id").alias("ordinal"))
    return files, known


_FILES_SQL = """files AS (SELECT d.doc_id, source AS key, left(sha256(coalesce(text, '')), 16) AS fp, (l.doc_id IS NOT NULL OR source = 'src2') AS written FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
known AS (SELECT key, fp, doc_id AS ordinal FROM files WHERE doc_id % 3 = 0 OR key IN ('src1', 'src2'))"""
_VERDICT_SQL = f"""{_FILES_SQL},
seen AS (SELECT f.*, k.fp IS NOT NULL AS already FROM files f LEFT JOIN (SELECT DISTINCT key, fp FROM known) k ON k.key = f.key AND k.fp = f.fp),
v AS (SELECT key, count(*) AS total, count(*) FILTER (already) AS already, count(*) FILTER (NOT already) AS fresh,
 CASE WHEN NOT bool_or(already) THEN 'new' WHEN NOT bool_and(already) THEN 'partial' WHEN bool_and(written) THEN 'duplicate' ELSE 'recreate' END AS verdict FROM seen GROUP BY key),
owners AS (SELECT fp, arg_min(key, ordinal) AS owner FROM known GROUP BY fp),
clash AS (SELECT f.doc_id, f.key, f.fp, o.owner FROM files f JOIN owners o ON o.fp = f.fp WHERE o.owner <> f.key AND NOT EXISTS (SELECT 1 FROM known k WHERE k.key = f.key AND k.fp = f.fp))"""


@query(f"WITH {_VERDICT_SQL} SELECT key, total, already, fresh, verdict FROM v")
def repeat_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.verdicts(*_files(spark, sf_dir))


@query(f"WITH {_VERDICT_SQL} SELECT doc_id, key, fp, owner FROM clash")
def fingerprint_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.conflicts(*_files(spark, sf_dir)).select("doc_id", "key", "fp", "owner")


@query(f"""WITH {_VERDICT_SQL}, n AS (SELECT key, count(*) AS n FROM clash GROUP BY key)
SELECT count(*) AS total, count(*) FILTER (already % 5 <> 1) AS succeeded, count(*) FILTER (already % 5 = 1) AS failed, count(*) FILTER (already = 0) AS new_ids, count(*) FILTER (already > 0) AS reused_ids,
 count(*) FILTER (verdict = 'duplicate') AS skipped_duplicates, count(*) FILTER (verdict IN ('partial', 'recreate')) AS partial_repeats, coalesce(sum(n), 0)::BIGINT AS conflicts FROM v LEFT JOIN n USING (key)""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, known = _files(spark, sf_dir)
    n = fingerprints.conflicts(files, known).groupBy("key").agg(F.count("*").alias("n_conflicts"))
    v = fingerprints.verdicts(files, known).join(n, "key", "left")
    return fingerprints.batch_summary(v.select((F.col("already") % 5 != 1).alias("success"), (F.col("already") == 0).alias("is_new_id"), F.col("key").alias("anon_id"), "verdict", "n_conflicts"))


@query(f"""WITH {_VERDICT_SQL} SELECT key, count(*) AS n, string_agg(DISTINCT owner, ', ' ORDER BY owner) AS owners,
 array_to_string(list_sort(list('doc' || doc_id))[1:6], ', ') || CASE WHEN count(*) > 6 THEN ', ...' ELSE '' END AS names FROM clash GROUP BY key""")
def conflict_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.conflicts(*_files(spark, sf_dir))
    return fingerprints.conflict_notes(found.select("key", F.concat(F.lit("doc"), "doc_id").alias("name"), "owner"))


@query(f"""WITH {_FILES_SQL}, both_ AS (SELECT key, fp FROM known UNION SELECT key, fp FROM files WHERE written)
SELECT key, string_agg(fp, ' ' ORDER BY fp) AS fingerprints FROM both_ GROUP BY key""")
def fingerprint_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, known = _files(spark, sf_dir)
    return fingerprints.accumulate(known, files.where("written"))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer is in the mapping, twice with other ids where the key is also divisible by 7."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    row = lambda c, prefix, off: c.select(F.concat(F.lit(" CR"), "c_custkey").alias("original_key"), F.concat(F.lit(prefix), "c_custkey").alias("anon_id"), (F.col("c_custkey") * 2 + off).alias("ordinal"))
    return row(c, "OLD", 0).unionByName(row(c.where("c_custkey % 7 = 0"), "LAST", 1))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("CR"), "o_custkey").alias("key"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("first_seen"))


_MAPPING_SQL = """mapping AS (SELECT 'CR' || c_custkey AS key, 'OLD' || c_custkey AS anon_id, c_custkey * 2 AS ordinal FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT 'CR' || c_custkey, 'LAST' || c_custkey, c_custkey * 2 + 1 FROM customer WHERE c_custkey % 21 = 0),
have AS (SELECT key, arg_max(anon_id, ordinal) AS anon_id FROM mapping GROUP BY key),
asked AS (SELECT 'CR' || o_custkey AS key, arg_min(o_custkey::VARCHAR, o_orderkey) AS name, min(o_orderkey) AS first_seen FROM orders GROUP BY o_custkey)"""


@query(f"""WITH {_MAPPING_SQL}
SELECT NULL::BIGINT AS s_no, key, anon_id, name, false AS is_new, 0 AS id_length FROM asked JOIN have USING (key)
UNION ALL SELECT (SELECT count(*) FROM mapping) + row_number() OVER (ORDER BY first_seen, key), key, NULL, name, true, 8 FROM asked WHERE key NOT IN (SELECT key FROM have)""")
def mapping_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mapping.assign(_arrivals(spark, sf_dir), _mapping(spark, sf_dir), SECRET)
    shaped = F.col("anon_id").rlike("^[A-Z]{4}[0-9]{4}$")
    return a.select("s_no", "key", F.when(~F.col("is_new"), F.col("anon_id")).alias("anon_id"), "name", "is_new", F.when(F.col("is_new") & shaped, F.length("anon_id")).otherwise(0).alias("id_length"))


@query("SELECT count(*) AS n_rows, count(DISTINCT k)::BIGINT AS n_subjects FROM (SELECT 'OLD' || c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'LAST' || c_custkey FROM customer WHERE c_custkey % 21 = 0)")
def mapping_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.describe(_mapping(spark, sf_dir))


@query("""SELECT o_custkey, n AS before_, n + m AS after_, 'Set_' || CASE WHEN m > 0 THEN n + 1 ELSE n END || '_' || (n + m) AS name
FROM (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS n, count(*) FILTER (o_orderkey % 2 = 1 AND o_custkey % 2 = 0) AS m FROM orders GROUP BY o_custkey)""")
def ranged_output_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("before_"), F.count_if((F.col("o_orderkey") % 2 == 1) & (F.col("o_custkey") % 2 == 0)).alias("m"))
    o = o.withColumn("after_", F.col("before_") + F.col("m"))
    return o.select("o_custkey", "before_", "after_", mapping.range_name("Set", F.col("before_"), F.col("after_")).alias("name"))


def _pick_sql(alphabet: str, radices: tuple[int, ...], n: str) -> str:
    """DuckDB: n in falling radices picks from the alphabet, one nested step a letter."""
    size = 1
    for r in radices:
        size *= r
    sql, left = f"SELECT c_custkey, {n} % {size} AS n, {size} AS size, '{alphabet}' AS rest, '' AS out FROM customer", size
    for r in radices:
        left //= r
        sql = f"SELECT c_custkey, n % {left} AS n, {left} AS size, substr(rest, 1, (n // {left})::INT) || substr(rest, (n // {left})::INT + 2) AS rest, out || substr(rest, (n // {left})::INT + 1, 1) AS out FROM ({sql})"
    return sql


_N = "((c_custkey * 7919) % 1808352000)"


@query(f"SELECT a.c_custkey, a.out || b.out AS code FROM ({_pick_sql('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (26, 25, 24, 23), f'({_N} // 5040)')}) a JOIN ({_pick_sql('0123456789', (10, 9, 8, 7), _N)}) b USING (c_custkey)")
def anon_id_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ids.unrank(F.pmod(F.col("c_custkey") * 7919, F.lit(ids.CODES))).alias("code"))


@query("SELECT count(*) AS n, count(*) AS distinct_ids, 0 AS badly_formed FROM orders")
def anon_id_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(ids.unrank(ids.permuted(F.col("o_orderkey"), SECRET)).alias("id"))
    bad = ~F.col("id").rlike("^[A-Z]{4}[0-9]{4}$") | F.col("id").rlike(r"(.).*\1")
    return o.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.count_if(bad).cast("int").alias("badly_formed"))


def _reports(spark: SparkSession, sf_dir: str, key: str = "c_custkey", room_no: str = "c_nationkey") -> DataFrame:
    """Customers as running-text reports: names wrapped over lines, ward variants, a missing or an empty room, two pages. key and room_no are SQL."""
    c = table(spark, sf_dir, "customer")
    name = F.replace("c_name", F.lit("#"), F.lit("\n  "))
    head = F.concat(F.lit("Department of Biochemistry\nCR No : "), F.expr(key), F.lit("\nPatient Name :"), name, F.lit("\nWard"), F.when(F.col("c_custkey") % 2 == 0, "/OPD").otherwise(""), F.lit(" :"), "c_mktsegment")
    room = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "\nRoom/Bed :").otherwise(F.concat(F.lit("\nRoom/Bed : "), F.expr(room_no)))
    tail = F.concat(F.lit("\nClinician : "), F.when(F.col("c_custkey") % 5 == 0, "--").otherwise(F.concat(F.lit("Dr "), "c_nationkey")), F.lit("\nInvestigation\nResult 1\nPage 1 of 2"))
    pages = c.select("c_custkey", F.posexplode(F.array(F.concat(head, room, tail), F.concat(head, F.lit("\nPage 2 of 2")))).alias("page_no", "text"))
    return pages.select(F.col("c_custkey").alias("doc_id"), "page_no", "text")


@query(r"""SELECT c_custkey AS doc_id, c_custkey::VARCHAR AS cr_no, replace(c_name, '#', ' ') AS patient_name, CASE WHEN c_custkey % 2 = 0 THEN 'Ward/OPD' ELSE 'Ward' END AS ward_label, c_mktsegment AS ward_value,
 CASE WHEN c_custkey % 3 = 2 THEN c_nationkey::VARCHAR END AS room_bed, CASE WHEN c_custkey % 5 = 0 THEN '--' ELSE 'Dr ' || c_nationkey END AS clinician FROM customer""")
def report_roundtrip_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.fields_a(_reports(spark, sf_dir)).select("doc_id", "cr_no", "patient_name", "ward_label", "ward_value", "room_bed", "clinician")


@query(r"""SELECT doc_id, action, count(*) AS n, string_agg(value, '|' ORDER BY value) AS vals FROM (
 SELECT c_custkey AS doc_id, 'replace' AS action, c_custkey::VARCHAR AS value FROM customer UNION ALL SELECT c_custkey, 'blank', replace(c_name, '#', ' ') FROM customer UNION ALL SELECT c_custkey, 'blank', c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 'blank', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT c_custkey, 'blank', 'Dr ' || c_nationkey FROM customer WHERE c_custkey % 5 <> 0) GROUP BY ALL""")
def redaction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = extract.targets_a(extract.fields_a(_reports(spark, sf_dir)))
    return t.groupBy("doc_id", "action").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("vals"))


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'scanned' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'unknown' ELSE 'scanned' END AS kind,
 CASE c_custkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 26 + length(c_name) WHEN 2 THEN 12 + length(c_name) WHEN 3 THEN 12 ELSE 0 END::BIGINT AS total_chars, CASE c_custkey % 5 WHEN 4 THEN 0 ELSE 1 END::BIGINT AS page_count FROM customer""")
def template_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds by turns: an image with little text, the two templates, short text without an image, and no page at all."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", (F.col("c_custkey") % 5).alias("k"))
    text = F.when(F.col("k") == 0, " stamp ").when(F.col("k") == 1, F.concat(F.lit("Department of Biochemistry"), "c_name")).when(F.col("k") == 2, F.concat(F.lit("Lab No.\nName"), F.regexp_replace("c_name", "^.", "\n"))).otherwise("no signs 123")
    pages = c.where("k <> 4").select("doc_id", F.lit(0).alias("page_no"), text.alias("text"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), "k")
    share = F.when(F.col("k") == 0, 180.0).otherwise(179.0)
    images = pages.select("doc_id", "page_no", geometry.rect(0.0, 0.0, 100.0, share).alias("rect"))
    full = classify.full_page_images(pages, images)
    made = classify.kinds(c, pages.join(full, ["doc_id", "page_no"]), "kfre")
    return made.select("doc_id", "kind", "total_chars", "page_count")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as positioned words: labels left, values in their band, jitter within the row, a later row that repeats a label."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment")
    w = lambda n, x, y, word: F.struct(F.lit(n).alias("n"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), (word if not isinstance(word, str) else F.lit(word)).alias("word"))
    parts = F.array(
        w(0, 91.0, 101.2, F.element_at(F.split("c_name", "#"), 1)), w(1, 140.0, 100.9, F.element_at(F.split("c_name", "#"), -1)), w(2, 300.0, 100.5, "Age"), w(3, 24.0, 100.0, "Name"), w(4, 84.0, 100.4, ":"),
        w(5, 24.0, 111.0, "Lab"), w(6, 45.0, 111.3, "No."), w(7, 91.0, 112.5, F.col("doc_id").cast("string")), w(8, 291.0, 111.1, "out"), w(9, 24.0, 122.0, "Ref"), w(10, 40.0, 122.0, "By"), w(11, 92.0, 122.0, "c_mktsegment"), w(12, 24.0, 133.0, "Ref"), w(13, 40.0, 133.0, "By"),
        w(14, 92.0, 134.7, "late"),
    )
    return c.select("doc_id", F.lit(0).alias("page_no"), F.explode(parts).alias("w")).select("doc_id", "page_no", "w.*")


@query("SELECT c_custkey AS doc_id, replace(c_name, '#', ' ') AS name, c_custkey::VARCHAR AS lab_no, NULL::VARCHAR AS ref_by FROM customer")
def report_roundtrip_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.fields_b(_placed(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 3600000000.0 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT user_id, rn, y AS first, 1 AS row_no FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.y - w.first > 8 THEN e.y ELSE w.first END, w.row_no + CASE WHEN e.y - w.first > 8 THEN 1 ELSE 0 END FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, max(row_no)::INT AS n_rows, count(*) AS n_events FROM walk GROUP BY user_id""")
def row_cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row fold over each user's events: a burst lasts eight hours from its first event."""
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("y"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list("y")).alias("y"))
    return g.select("user_id", F.element_at(extract.row_numbers(F.col("y"), 8.0), -1).alias("n_rows"), F.size("y").cast("long").alias("n_events"))


def _keyed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a customer's package; some carry the other template, some another key, some none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey") % 7
    return identity.file_keys(o.select(
        F.concat(F.lit("p"), "o_custkey").alias("package"), F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), F.concat(F.lit("d"), F.col("o_orderkey") % 9).alias("folder"),
        F.when(k == 0, "scanned").when(k == 1, "unknown").when((k == 2) & (F.col("o_custkey") % 4 == 0), "B").otherwise("A").alias("kind"), F.when(k != 3, F.col("o_custkey").cast("string")).alias("cr_no"), F.col("o_custkey").cast("string").alias("lab_no"),
        F.when(k % 2 == 0, F.concat(F.lit("N"), "o_custkey")).otherwise("").alias("name"),
    ))


_KEYED_SQL = """files AS (SELECT 'p' || o_custkey AS package, 'f' || lpad(o_orderkey::VARCHAR, 9, '0') AS path, 'd' || (o_orderkey % 9) AS folder, CASE WHEN (o_orderkey % 7) % 2 = 0 THEN 'N' || o_custkey ELSE '' END AS name,
 CASE o_orderkey % 7 WHEN 0 THEN 'scanned' WHEN 1 THEN 'unknown' ELSE CASE WHEN o_orderkey % 7 = 2 AND o_custkey % 4 = 0 THEN 'B' ELSE 'A' END END AS kind,
 CASE WHEN o_orderkey % 7 IN (0, 1, 3) THEN NULL WHEN o_orderkey % 7 = 2 AND o_custkey % 4 = 0 THEN 'Lab No.:' || o_custkey ELSE o_custkey::VARCHAR END AS key FROM orders)"""


@query(f"WITH {_KEYED_SQL} SELECT key, min(path) AS first_path, arg_min(name, path) FILTER (name <> '') AS name, count(*) AS n_files FROM files WHERE key IS NOT NULL GROUP BY key")
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.groups(_keyed_files(spark, sf_dir))


@query(f"""WITH {_KEYED_SQL}, g AS (SELECT package, count(DISTINCT key) AS n_keys, min(key) AS key, min(name) AS name, count(DISTINCT name) AS n_names FROM files GROUP BY package)
SELECT package, n_keys, CASE WHEN n_keys = 1 THEN key END AS key, CASE WHEN n_keys = 1 THEN name END AS name, n_names, CASE WHEN n_keys > 1 THEN 'conflict' WHEN n_keys = 0 THEN 'no identity' ELSE 'ok' END AS status FROM g""")
def package_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.packages(_keyed_files(spark, sf_dir))


@query(f"""WITH {_KEYED_SQL}, g AS (SELECT package, list_sort(list(DISTINCT key) FILTER (key IS NOT NULL)) AS k, list_sort(list(DISTINCT folder)) AS f FROM files GROUP BY package)
SELECT package, len(k)::BIGINT AS n_keys, array_to_string(k, ', ') AS keys, array_to_string(f[1:6], ', ') || CASE WHEN len(f) > 6 THEN ', ...' ELSE '' END AS folders FROM g WHERE len(k) > 1""")
def several_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.several(_keyed_files(spark, sf_dir))


@query(f"""WITH {_KEYED_SQL} SELECT path, CASE WHEN kind = 'unknown' THEN 'unknown template' ELSE 'no identity' END AS refusal FROM files WHERE kind = 'unknown' OR (kind IN ('A', 'B') AND key IS NULL)""")
def refused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed_files(spark, sf_dir).where("refusal IS NOT NULL").select("path", "refusal")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[mail]', 'g'), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[ip]', 'g') AS text,
 len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+'))::BIGINT AS mails FROM documents""")
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail, ip = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", redact.patterns_blanked(redact.patterns_blanked(F.col("text"), mail, by="[mail]"), ip, by="[ip]").alias("text"), F.regexp_count("text", F.lit(mail)).cast("long").alias("mails"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.targets_a(extract.fields_a(_reports(spark, sf_dir)))


@query(r"""SELECT c_custkey AS doc_id, p.n AS page_no, 'Department of Biochemistry' || chr(10) || 'CR No : SUBJ$' || chr(10) || 'Patient Name :' || chr(10) || 'Ward' || CASE WHEN c_custkey % 2 = 0 THEN '/OPD' ELSE '' END || ' :'
 || CASE WHEN p.n = 1 THEN chr(10) || 'Page 2 of 2' ELSE CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Room/Bed :' ELSE chr(10) || 'Room/Bed : ' END
 || chr(10) || 'Clinician : ' || CASE WHEN c_custkey % 5 = 0 THEN '--' ELSE '' END || chr(10) || 'Investigation' || chr(10) || 'Result 1' || chr(10) || 'Page 1 of 2' END || chr(10) || 'Subject ID: SUBJ$' AS text
FROM customer, (VALUES (0), (1)) p(n)""")
def redact_all_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all customers, with all forms of the room, redacted and stamped. Keys and rooms have a letter and a fixed width, so they are part of no other figure."""
    pages = _reports(spark, sf_dir, "concat('K', lpad(c_custkey, 12, '0'))", "concat('W', lpad(c_nationkey, 3, '0'))")
    return redact.redacted(pages, extract.targets_a(extract.fields_a(pages)), pages.select("doc_id").distinct().withColumn("anon_id", F.lit("SUBJ$")))


_HITS_SQL = """WITH pages AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no FROM documents),
hits AS (SELECT doc_id, v AS value, page_no, ((length(t) - length(replace(lower(t), v, ''))) // length(v))::BIGINT AS hits FROM pages, (VALUES ('the'), ('ing'), ('que')) x(v))"""


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    pages = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text"))
    return pages, d.select("doc_id", F.explode(F.array(*map(F.lit, ("the", "ing", "que")))).alias("value"))


@query(f"{_HITS_SQL} SELECT doc_id, value, count(*)::BIGINT AS n_missing, min(page_no)::BIGINT AS first_missing FROM hits WHERE hits < 1 GROUP BY ALL")
def page_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.guard(*_lines(spark, sf_dir)).select("doc_id", "value", F.size("missing").cast("long").alias("n_missing"), F.get("missing", F.lit(0)).cast("long").alias("first_missing"))


@query(f"{_HITS_SQL} SELECT doc_id, sum(hits)::BIGINT AS hits, count(*) AS expected, sum(hits) < count(*) AS short FROM hits GROUP BY doc_id")
def sum_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.sum_guard(*_lines(spark, sf_dir))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as headers: a file each, with subject, clear-list, swept, private, nested and plain tags."""
    c = table(spark, sf_dir, "customer")
    t = lambda grp, elem, keyword, value, private=False: F.struct(F.lit(grp).alias("grp"), F.lit(elem).alias("elem"), F.lit(keyword).alias("keyword"), value.cast("string").alias("value"), F.lit(private).alias("is_private"))
    rows = F.array(
        t(0x10, 0x10, "PatientName", F.col("c_name")), t(0x10, 0x20, "PatientID", F.col("c_custkey")), t(0x8, 0x80, "InstitutionName", F.col("c_mktsegment")), t(0x8, 0x1048, "PhysiciansOfRecordName", F.lit("x")),
        t(0x8, 0x1070, "OperatorsName", F.lit("y")), t(0x9, 0x10, "", F.lit("vendor"), True), t(0x20, 0xD, "StudyInstanceUID", F.concat(F.lit("1.2."), F.col("c_nationkey"))), t(0x8, 0x18, "SOPInstanceUID", F.concat(F.lit("1.2.3."), F.col("c_custkey"))),
        t(0x8, 0x60, "Modality", F.lit("US")), t(0x7FE0, 0x10, "PixelData", F.lit("..")), t(0x8, 0x1030, "StudyDescription", F.repeat(F.lit("a"), (F.col("c_custkey") % 500).cast("int"))),
    )
    return c.select(F.concat(F.lit("f"), "c_custkey").alias("file"), F.explode(rows).alias("t")).select("file", "t.*")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("file"), F.concat(F.lit("S"), F.col("c_custkey") % 50).alias("anon_id"))


_TAGS_SQL = """rows_(grp, elem, keyword, value, is_private, file, subject, nk) AS (
 SELECT unnest([16, 16, 8, 8, 8, 9, 32, 8, 8, 32736, 8]), unnest([16, 32, 128, 4168, 4208, 16, 13, 24, 96, 16, 4144]),
 unnest(['PatientName', 'PatientID', 'InstitutionName', 'PhysiciansOfRecordName', 'OperatorsName', '', 'StudyInstanceUID', 'SOPInstanceUID', 'Modality', 'PixelData', 'StudyDescription']),
 unnest([c_name, c_custkey::VARCHAR, c_mktsegment, 'x', 'y', 'vendor', '1.2.' || c_nationkey, '1.2.3.' || c_custkey, 'US', '..', repeat('a', (c_custkey % 500)::INT)]),
 unnest([false, false, false, false, false, true, false, false, false, false, false]), 'f' || c_custkey, 'S' || (c_custkey % 50), c_nationkey FROM customer),
scrubbed AS (SELECT file, grp, elem, keyword, CASE WHEN keyword IN ('PatientName', 'PatientID') THEN subject WHEN keyword IN ('InstitutionName', 'PhysiciansOfRecordName', 'OperatorsName') THEN '' ELSE value END AS value, is_private FROM rows_ WHERE NOT is_private),
flat AS (SELECT file, printf('(%04X,%04X)', grp, elem) AS tag, keyword, left(value, 400) AS value FROM rows_ WHERE grp <> 32736),
flat2 AS (SELECT file, printf('(%04X,%04X)', grp, elem) AS tag, keyword, left(value, 400) AS value FROM scrubbed WHERE grp <> 32736),
diff AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.tag, b.tag) AS tag, coalesce(a.keyword, b.keyword) AS keyword, a.value AS original, b.value AS anonymized,
 CASE WHEN b.file IS NULL THEN 'removed' WHEN a.file IS NULL THEN 'added' WHEN a.value = b.value THEN 'unchanged' ELSE 'changed' END AS status FROM flat a FULL JOIN flat2 b ON a.file = b.file AND a.tag = b.tag)"""


@query(f"WITH {_TAGS_SQL} SELECT file, grp, elem, keyword, value FROM scrubbed")
def tag_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.scrubbed(_tags(spark, sf_dir), _subjects(spark, sf_dir)).select("file", "grp", "elem", "keyword", "value")


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tags(spark, sf_dir)
    return tags.compared(tags.flattened(t), tags.flattened(tags.scrubbed(t, _subjects(spark, sf_dir))))


@query(f"WITH {_TAGS_SQL} SELECT file, tag, keyword, original, anonymized, status, coalesce(list_position([{', '.join(repr(x) for x in PRIORITY_TAGS)}], keyword) - 1, {len(PRIORITY_TAGS)})::BIGINT AS place FROM diff")
def tag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.in_review_order(_diff(spark, sf_dir)).withColumn("place", tags.review_rank(F.col("keyword")))


@query(f"WITH {_TAGS_SQL} SELECT file, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'added') AS added FROM diff GROUP BY file")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.status_counts(_diff(spark, sf_dir))


@query(f"""WITH {_TAGS_SQL}, h AS (SELECT *, sha256('{SECRET}|' || subject || '|' || value || CASE WHEN keyword = 'SOPInstanceUID' THEN '|' || file ELSE '' END) AS h FROM rows_ WHERE keyword IN ('StudyInstanceUID', 'SOPInstanceUID'))
SELECT file, keyword, '2.25.' || ('0x' || substr(h, 1, 15))::BIGINT || lpad((('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR, 19, '0') AS uid FROM h""")
def uid_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tags.uids_replaced(_tags(spark, sf_dir), _subjects(spark, sf_dir), SECRET)
    return t.where("keyword IN ('StudyInstanceUID', 'SOPInstanceUID')").select("file", "keyword", F.col("value").alias("uid"))


@query("SELECT vec_id, list_transform(embedding, lambda v, i: CASE WHEN i <= (label % 5) * 8 THEN 0::FLOAT ELSE v END) AS embedding FROM embeddings")
def banner_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", tags.banner_zeroed_array(F.col("embedding"), F.col("label") % 5, F.lit(8)).alias("embedding"))


@query(r"""SELECT c_custkey, 'ABCD1234_' || coalesce(nullif(regexp_replace(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN '_- left ' || c_custkey || '.dcm' ELSE 'plain' || c_custkey || '.pdf' END, '^[_\- ]+', ''), ''),
 'NP 00' || c_custkey) AS name, 'NP1/' || CASE WHEN c_custkey % 3 = 0 THEN 'NP 00' || c_custkey WHEN c_custkey % 3 = 1 THEN 'np' || c_custkey || '_- left ' || c_custkey || '.dcm' ELSE 'plain' || c_custkey || '.pdf' END AS short FROM customer""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("NP 00"), k)).when(k % 3 == 1, F.concat(F.lit("np"), k, F.lit("_- left "), k, F.lit(".dcm"))).otherwise(F.concat(F.lit("plain"), k, F.lit(".pdf")))
    path = F.concat(F.lit("/in/NP1/"), name)
    return table(spark, sf_dir, "customer").select("c_custkey", subject_file_name(F.lit("ABCD1234"), path).alias("name"), short_path(path).alias("short"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'left kidney/' ELSE '' END || (c_custkey % 40) || '.dcm' AS rel_path, count(*) OVER (PARTITION BY c_custkey % 2, c_custkey % 40) > 1 AS clash FROM customer""")
def staged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/in/"), F.when(k % 2 == 0, "left kidney").otherwise("other"), F.lit("/"), k % 40, F.lit(".dcm")).alias("path"))
    return plan.staged(c).select("c_custkey", "rel_path", "clash")


@query("""SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 SECOND AND event_type = 'purchase')""")
def written_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    listing = e.where("event_type = 'purchase'").select(F.col("user_id").alias("path"), F.col("ts").alias("mtime"))
    return fingerprints.written_now(e.select("event_id", F.col("user_id").alias("out")), listing, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position, count(*) OVER (PARTITION BY conv_id) AS of_total, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 4 AS page FROM conversations""")
def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.review_pages(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "position", "of_total", "page")


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '.dcm' WHEN 1 THEN '.PDF' ELSE '.txt' END AS ext FROM pages WHERE page_id % 5 <> 0)
SELECT list, count(*) AS n FROM (SELECT 'images' AS list FROM p WHERE ext = '.dcm' UNION ALL SELECT 'metadata' FROM p WHERE ext = '.dcm' UNION ALL SELECT 'reports' FROM p WHERE ext = '.PDF') GROUP BY list""")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", k, F.when(k % 3 == 0, ".dcm").when(k % 3 == 1, ".PDF").otherwise(".txt")).alias("original"), F.concat(F.lit("out"), k).alias("output"), F.lit("c").alias("category"))
    listing = p.select(F.col("original").alias("path")).unionByName(p.where("page_id % 5 <> 0").select(F.col("output").alias("path")))
    return plan.manifest(p, listing).groupBy("list").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS package, CASE WHEN bool_or(o_orderkey % 11 = 0) THEN 'egfr' ELSE 'kfre' END AS study FROM orders GROUP BY o_custkey")
def study_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return plan.study_of(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.concat(k, F.when(k % 11 == 0, ".DCM").otherwise(".pdf")).alias("path")))


@query("""SELECT l_orderkey, l_linenumber, greatest(6.0, least(11.0, l_quantity * 0.72)) AS size, CASE WHEN coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - 5 END, l_tax * 1000 - 90) < l_tax * 1000 THEN coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - 5 END, l_tax * 1000 - 90) END AS top,
 l_quantity > 0 AND l_quantity < 70 AND l_discount * 1000 / l_quantity BETWEEN 2 AND 6 AS signature FROM lineitem""")
def clamp_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, end = F.col("l_quantity"), F.col("l_tax") * 1000
    area = geometry.signature_area(end, F.when(F.col("l_linenumber") % 2 == 0, q), F.lit(595.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.label_size(q).alias("size"), area["y0"].alias("top"), geometry.signature_shaped(geometry.rect(0.0, 0.0, F.col("l_discount") * 1000, q)).alias("signature"))


@query("""SELECT c_custkey AS doc_id, n::INT AS n FROM customer, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14)) t(n) WHERE NOT (n IN (0, 1, 2, 3, 4) AND c_custkey % 2 = 0)""")
def region_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every second page a band over the first row; words it touches go."""
    w = _placed(spark, sf_dir).select("*", (F.col("x0") + 10).alias("x1"), (F.col("y0") + 5).alias("y1"))
    r = w.where("doc_id % 2 = 0").select("doc_id", "page_no", geometry.rect(0.0, 95.0, 595.0, 108.0).alias("rect")).distinct()
    return redact.without_regions(w, r).select("doc_id", "n")


@query("SELECT s_suppkey AS package, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN 'OK' ELSE 'NEEDS REVIEW' END AS status FROM supplier")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, some, none = F.col("s_suppkey"), F.array(F.lit("x")), F.array().cast("array<string>")
    s = table(spark, sf_dir, "supplier").select(k.alias("package"), F.when(k % 2 == 0, "ABCD1234").alias("anon_id"), F.when(k % 3 == 0, some).otherwise(none).alias("failed"), F.when(k % 5 == 0, some).otherwise(none).alias("errors"))
    return identity.outcomes(s).select("package", "status")
