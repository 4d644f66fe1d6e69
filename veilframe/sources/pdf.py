"""Page text of simple PDF files: uncompressed or Flate streams with text operators.

With the optional library installed its text is taken instead. A file that neither can read gives an
error row; so do files without page objects, with object streams, or with text in hex strings.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    import fitz  # optional
except ImportError:
    fitz = None

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?:[^()\\]|\\.)*\)\s*(?:Tj|'|\")|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|-?[\d.]+\s+-?[\d.]+\s+T[dD]", re.S)
_SHOWS = re.compile(rb"\bT[jJ]\b|['\"]")
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> str:
    return _ESCAPE.sub(lambda m: _NAMED.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), raw).decode("latin-1")


def _stream_text(raw: bytes) -> str:
    out, left = [], len(_SHOWS.findall(_STRING.sub(b"()", raw)))
    for m in _SHOW.finditer(raw):
        left -= not m[0].endswith((b"T*", b"Td", b"TD"))
        if b"<" in _STRING.sub(b"", m[0]):
            left += 1
        if m[0].endswith((b"T*", b"Td", b"TD")):
            out.append("\n")
        else:
            out += [_plain(s[1]) for s in _STRING.finditer(m[0])] + (["\n"] if m[0].endswith((b"'", b'"')) else [])
    if left:
        raise ValueError("text operators that are not supported")
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


def pages(content: bytes) -> list[str]:
    """The text of each page in order."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if fitz is not None:
        with fitz.open(stream=content, filetype="pdf") as doc:
            return [p.get_text() for p in doc]
    if re.search(rb"/Type\s*/ObjStm\b", content):
        raise ValueError("object streams are not supported")
    objects = {int(n): body for n, body in _OBJECT.findall(content)}
    out = []
    for body in (b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)):
        text = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b"", b""])[1]):
            one = objects.get(int(ref), b"")
            if m := _STREAM.search(one):
                if re.search(rb"/Filter\s*(?:\[\s*)?/(?!FlateDecode)", one):
                    raise ValueError("a stream's filter is not supported")
                text.append(_stream_text(zlib.decompress(m[1]) if b"FlateDecode" in one else m[1]))
        out.append("\n".join(text))
    if not out:
        raise ValueError("no page objects")
    return out


def page_texts(files: DataFrame) -> DataFrame:
    """files (path, content) to (doc_id, page_no, text, error); the path is the doc_id."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(pages(content or b""))]
                except Exception as e:  # noqa: BLE001  whatever a broken file does, it becomes an error row
                    rows.append((path, None, None, type(e).__name__))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "page_no", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "doc_id string, page_no int, text string, error string")
