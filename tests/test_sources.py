from __future__ import annotations

import os
import struct
import zlib

import pytest

from veilframe.sources import dicom, files, mapping_csv, pdf
from veilframe.sources.dicom import Element


def image(y0=2, frames=2, name="Someone"):
    e = [
        Element((8, 0x18), b"UI", b"1.2.3"), Element((8, 0x80), b"LO", b"Place "), Element((9, 0x10), b"LO", b"vendor"), Element((0x10, 0x10), b"PN", name.encode()), Element((0x10, 0x20), b"LO", b"77"),
        Element((0x18, 0x6011), b"SQ", items=[[Element((8, 0x1070), b"PN", b"Nested"), *([Element((0x18, 0x601A), b"UL", struct.pack("<I", y0))] if y0 is not None else [])]]),
        Element((0x20, 0xD), b"UI", b"9.9"), Element((0x28, 2), b"US", struct.pack("<H", 1)), Element((0x28, 8), b"IS", str(frames).encode()), Element((0x28, 0x10), b"US", struct.pack("<H", 4)), Element((0x28, 0x11), b"US", struct.pack("<H", 3)),
        Element((0x28, 0x100), b"US", struct.pack("<H", 8)), Element((0x7FE0, 0x10), b"OW", bytes(range(1, 4 * 3 * frames + 1))),
    ]
    return dicom.build([Element((2, 3), b"UI", b"1.2.3")], e)


def test_image_rewritten():
    clear = lambda k: k in ("InstitutionName", "OperatorsName")
    new = dicom.rewritten(image(), "ABCD1234", clear, lambda k, old: f"2.25.{len(k)}")
    meta, e = dicom.parse(new)
    by = {x.keyword: x.text() for x in e}
    assert by["PatientName"] == by["PatientID"] == "ABCD1234" and by["InstitutionName"] == ""
    assert not any(x.tag[0] % 2 for x in e)
    assert next(x for x in e if x.items)  .items[0][0].text() == ""
    assert by["SOPInstanceUID"] == next(x.text() for x in meta if x.tag == (2, 3)) != "1.2.3"
    px = next(x.raw for x in e if x.keyword == "PixelData")
    assert px[:6] == b"\0" * 6 and px[12:18] == b"\0" * 6 and px[6:12] == bytes(range(7, 13))
    assert b"Someone" not in new and b"Nested" not in new and b"vendor" not in new
    with pytest.raises(ValueError):
        dicom.rewritten(image(y0=None), "X", clear, lambda *a: "1")


def test_headers_and_errors(spark):
    d = spark.createDataFrame([("a.dcm", image()), ("b.dcm", b"nothing"), ("c.dcm", None)], "path string, content binary")
    rows = dicom.headers(d).collect()
    assert {r.file for r in rows if r.error} == {"b.dcm", "c.dcm"}
    assert any(r.keyword == "OperatorsName" and r.depth == 1 for r in rows) and any(r.is_private for r in rows)
    assert not any(r.grp == 0x7FE0 for r in rows)


def test_pdf_pages(spark):
    body = zlib.compress(b"BT (CR No : 7\\)) Tj 0 -10 Td [(Na) 3 (me)] TJ ET")
    raw = b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Filter /FlateDecode /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n"
    d = spark.createDataFrame([("a.pdf", raw), ("b.pdf", b"zzz")], "path string, content binary")
    rows = {r.doc_id: r for r in pdf.page_texts(d).collect()}
    assert rows["a.pdf"].text == "CR No : 7)\nName" and rows["b.pdf"].error == "ValueError"


def test_mapping_table(spark, tmp_path):
    p = str(tmp_path / "m.csv")
    assert mapping_csv.read_mapping(spark, p).count() == 0 and not os.path.exists(p)
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write('S. No,Original CR No,Anonymized ID,Name,Note\n1,007,ABCD1234,"A ""B"", C",x\n')
    m = mapping_csv.read_mapping(spark, p)
    r = m.first()
    assert (r.original_key, r.name, r.fingerprints, r.extra) == ("007", 'A "B", C', "", {"Note": "x"})
    mapping_csv.write_mapping(m, p)
    assert open(p, encoding="utf-8").read().splitlines()[0] == "S. No,Original CR No,Anonymized ID,Name,Source Fingerprints,Last Anonymized,Note"
    with open(p, "w") as f:
        f.write("S. No,Name\n")
    with pytest.raises(ValueError):
        mapping_csv.read_mapping(spark, p)
    with pytest.raises(ValueError):
        mapping_csv.check_locations("/a/out/m.csv", "/a/in", "/a/out")
    with pytest.raises(ValueError):
        mapping_csv.check_locations("/m.csv", "/a", "/a/out")


def test_catalog(spark, tmp_path):
    for rel in ("NP 1/left kidney/a.DCM", "NP 1/r e%p(1).pdf", "other/b.pdf"):
        os.makedirs(tmp_path / os.path.dirname(rel), exist_ok=True)
        (tmp_path / rel).write_bytes(b"x")
    rows = {r.rel: r for r in files.catalog(spark, str(tmp_path), ".dcm").drop("content").collect()}
    assert rows["NP 1/left kidney/a.DCM"].parent == "left kidney" and rows["NP 1/left kidney/a.DCM"].package == "NP 1"
    pdfs = files.catalog(spark, str(tmp_path), ".pdf")
    assert {r.name for r in pdfs.collect()} == {"r e%p(1).pdf", "b.pdf"}
    assert [r.package for r in files.subject_folders(pdfs).collect()] == ["NP 1"]
    (tmp_path / "other/_c.pdf").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.catalog(spark, str(tmp_path), ".pdf")
