"""PDF files that the small reader can't read in full raise, so they become error rows."""

from __future__ import annotations

import pytest

from veilframe.sources import pdf

PAGE = b"%%PDF-1.5\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <<>> stream\n%s\nendstream endobj\n"


@pytest.fixture(autouse=True)
def small_reader(monkeypatch):
    monkeypatch.setattr(pdf, "fitz", None)


@pytest.mark.parametrize("content", [b"%PDF-1.5\n1 0 obj <</Type /Catalog>> endobj", PAGE % b"(a) Tj" + b"3 0 obj <</Type /ObjStm /N 1>> stream\nx\nendstream endobj", PAGE % b"BT <4142> Tj ET", PAGE % b"BT [(a) -20 <42>] TJ ET", PAGE % b"BT (a) Tj <42> Tj ET"])
def test_raises(content):
    with pytest.raises(ValueError):
        pdf.pages(content)


def test_reads():
    assert pdf.pages(PAGE % b"BT (it's <a> \"b\") Tj 0 -12 Td [(x) -20 (y)] TJ T* (z) ' ET") == ["it's <a> \"b\"\nxy\nz"]
