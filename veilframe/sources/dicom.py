"""Image headers and pixels: a parser and a rewriter for little-endian files without compression.

Other transfer syntaxes give an error row, so no file passes through undone.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

EXPLICIT, IMPLICIT = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2"
_LONG = frozenset(b"OB OD OF OL OW SQ UC UN UR UT".split())
_NUMBERS = {b"US": "<H", b"UL": "<I", b"SS": "<h", b"SL": "<i", b"FL": "<f", b"FD": "<d"}
#: Names and types of the elements that the rules speak of.
KEYWORDS = {
    (0x0008, 0x0018): ("SOPInstanceUID", b"UI"), (0x0008, 0x0020): ("StudyDate", b"DA"), (0x0008, 0x0030): ("StudyTime", b"TM"), (0x0008, 0x0050): ("AccessionNumber", b"SH"), (0x0008, 0x0060): ("Modality", b"CS"),
    (0x0008, 0x0080): ("InstitutionName", b"LO"), (0x0008, 0x0081): ("InstitutionAddress", b"ST"), (0x0008, 0x0090): ("ReferringPhysicianName", b"PN"), (0x0008, 0x1010): ("StationName", b"SH"), (0x0008, 0x1040): ("InstitutionalDepartmentName", b"LO"),
    (0x0008, 0x1048): ("PhysiciansOfRecord", b"PN"), (0x0008, 0x1050): ("PerformingPhysicianName", b"PN"), (0x0008, 0x1060): ("NameOfPhysiciansReadingStudy", b"PN"), (0x0008, 0x1070): ("OperatorsName", b"PN"), (0x0008, 0x1080): ("AdmittingDiagnosesDescription", b"LO"),
    (0x0010, 0x0010): ("PatientName", b"PN"), (0x0010, 0x0020): ("PatientID", b"LO"), (0x0010, 0x0030): ("PatientBirthDate", b"DA"), (0x0010, 0x0040): ("PatientSex", b"CS"), (0x0010, 0x1000): ("OtherPatientIDs", b"LO"), (0x0010, 0x1010): ("PatientAge", b"AS"),
    (0x0010, 0x1040): ("PatientAddress", b"LO"), (0x0010, 0x2160): ("EthnicGroup", b"SH"), (0x0010, 0x21B0): ("AdditionalPatientHistory", b"LT"), (0x0010, 0x4000): ("PatientComments", b"LT"), (0x0018, 0x1000): ("DeviceSerialNumber", b"LO"),
    (0x0018, 0x5010): ("TransducerData", b"LO"), (0x0018, 0x6011): ("SequenceOfUltrasoundRegions", b"SQ"), (0x0018, 0x601A): ("RegionLocationMinY0", b"UL"), (0x0020, 0x000D): ("StudyInstanceUID", b"UI"), (0x0020, 0x000E): ("SeriesInstanceUID", b"UI"),
    (0x0020, 0x0010): ("StudyID", b"SH"), (0x0020, 0x4000): ("ImageComments", b"LT"), (0x0028, 0x0002): ("SamplesPerPixel", b"US"), (0x0028, 0x0008): ("NumberOfFrames", b"IS"), (0x0028, 0x0010): ("Rows", b"US"), (0x0028, 0x0011): ("Columns", b"US"),
    (0x0008, 0x0092): ("ReferringPhysicianAddress", b"ST"), (0x0008, 0x009C): ("ConsultingPhysicianName", b"PN"), (0x0008, 0x1072): ("OperatorIdentificationSequence", b"SQ"), (0x0010, 0x1001): ("OtherPatientNames", b"PN"), (0x0010, 0x1005): ("PatientBirthName", b"PN"),
    (0x0010, 0x1060): ("PatientMotherBirthName", b"PN"), (0x0010, 0x2297): ("ResponsiblePerson", b"PN"), (0x0032, 0x1032): ("RequestingPhysician", b"PN"), (0x0040, 0x0006): ("ScheduledPerformingPhysicianName", b"PN"), (0x0040, 0xA075): ("VerifyingObserverName", b"PN"),
    (0x0040, 0xA123): ("PersonName", b"PN"), (0x0070, 0x0084): ("ContentCreatorName", b"PN"), (0x0040, 0x1010): ("NamesOfIntendedRecipientsOfResults", b"PN"), (0x0040, 0x2008): ("OrderEnteredBy", b"PN"), (0x4008, 0x0114): ("PhysicianApprovingInterpretation", b"PN"),
    (0x0028, 0x0100): ("BitsAllocated", b"US"), (0x0038, 0x0010): ("AdmissionID", b"LO"), (0x7FE0, 0x0010): ("PixelData", b"OW"), (0x0002, 0x0003): ("MediaStorageSOPInstanceUID", b"UI"), (0x0002, 0x0010): ("TransferSyntaxUID", b"UI"),
}


class Element:
    __slots__ = ("tag", "vr", "raw", "items")

    def __init__(self, tag: tuple[int, int], vr: bytes, raw: bytes = b"", items: list[list[Element]] | None = None) -> None:
        self.tag, self.vr, self.raw, self.items = tag, vr, raw, items

    @property
    def keyword(self) -> str:
        return KEYWORDS.get(self.tag, ("",))[0]

    def text(self) -> str:
        if self.items is not None:
            return f"{len(self.items)} item(s)"
        if self.vr in _NUMBERS:
            f = _NUMBERS[self.vr]
            return "\\".join(str(x[0]) for x in struct.iter_unpack(f, self.raw[: len(self.raw) // struct.calcsize(f) * struct.calcsize(f)]))
        return self.raw.decode("utf-8", "replace").rstrip("\0 ") if self.vr not in (b"OB", b"OW", b"UN") else f"{len(self.raw)} bytes"


def _elements(b: bytes, at: int, end: int, explicit: bool, stop_at_pixels: bool, closed: bool = False) -> tuple[list[Element], int]:
    out: list[Element] = []
    while at + 8 <= end:
        tag = struct.unpack_from("<HH", b, at)
        if tag == (0xFFFE, 0xE00D) and closed:
            return out, at + 8
        if tag == (0x7FE0, 0x0010) and stop_at_pixels:
            return out, at
        if explicit:
            vr = b[at + 4 : at + 6]
            size, at = (struct.unpack_from("<I", b, at + 8)[0], at + 12) if vr in _LONG else (struct.unpack_from("<H", b, at + 6)[0], at + 8)
        else:
            vr, size, at = KEYWORDS.get(tag, ("", b"UN"))[1], struct.unpack_from("<I", b, at + 4)[0], at + 8
        if vr == b"SQ" or size == 0xFFFFFFFF:
            items, stop = [], end if size == 0xFFFFFFFF else at + size
            while at + 8 <= stop:
                mark, n = struct.unpack_from("<HH", b, at), struct.unpack_from("<I", b, at + 4)[0]
                at += 8
                if mark == (0xFFFE, 0xE0DD):
                    break
                if mark != (0xFFFE, 0xE000):
                    raise ValueError("a sequence is broken")
                inner, at2 = _elements(b, at, stop if n == 0xFFFFFFFF else at + n, explicit, False, n == 0xFFFFFFFF)
                items.append(inner)
                at = at2 if n == 0xFFFFFFFF else at + n
            out.append(Element(tag, b"SQ", items=items))
        else:
            if at + size > end:
                raise ValueError("an element passes the end")
            out.append(Element(tag, vr, b[at : at + size]))
            at += size
    return out, at


def parse(content: bytes, stop_at_pixels: bool = False) -> tuple[list[Element], list[Element]]:
    """(file meta, elements); raises ValueError for what it can't read."""
    if content[128:132] != b"DICM":
        raise ValueError("not an image file")
    if struct.unpack_from("<HH", content, 132) != (2, 0):
        raise ValueError("no length of the file meta group")
    at = 144 + struct.unpack_from("<I", content, 140)[0]
    meta = _elements(content, 132, at, True, False)[0]
    syntax = next((e.text() for e in meta if e.tag == (2, 0x10)), IMPLICIT)
    if syntax not in (EXPLICIT, IMPLICIT):
        raise ValueError("compressed or unknown transfer syntax")
    return meta, _elements(content, at, len(content), syntax == EXPLICIT, stop_at_pixels)[0]


def _encode(elements: list[Element]) -> bytes:
    out = []
    for e in elements:
        raw = e.raw
        if e.items is not None:
            raw = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in map(_encode, e.items))
        if len(raw) % 2:
            raw += b"\0" if e.vr in (b"UI", b"OB") else b" "
        head = struct.pack("<HH", *e.tag) + e.vr
        out.append(head + (b"\0\0" + struct.pack("<I", len(raw)) if e.vr in _LONG else struct.pack("<H", len(raw))) + raw)
    return b"".join(out)


def build(meta: list[Element], elements: list[Element]) -> bytes:
    """A file in the explicit syntax."""
    meta = [e for e in meta if e.tag not in ((2, 0), (2, 0x10))] + [Element((2, 0x10), b"UI", EXPLICIT.encode())]
    body = _encode(sorted(meta, key=lambda e: e.tag))
    return b"\0" * 128 + b"DICM" + _encode([Element((2, 0), b"UL", struct.pack("<I", len(body)))]) + body + _encode(elements)


def rewritten(content: bytes, subject: str, cleared: Callable[[str], bool], uid: Callable[[str, str], str]) -> bytes:
    """The file with subject name and id, cleared and private elements and other names of persons at any depth, new uids, and its banner rows zero in every frame."""
    meta, elements = parse(content)
    regions = next((e.items for e in elements if e.keyword == "SequenceOfUltrasoundRegions" and e.items), None)
    y0 = next((int(e.text()) for e in (regions or [[]])[0] if e.keyword == "RegionLocationMinY0"), None)
    if y0 is None:
        raise ValueError("no region tells where the banner ends")

    def scrub(some: list[Element]) -> list[Element]:
        kept = []
        for e in some:
            if e.tag[0] % 2:
                continue
            if e.items is not None:
                e = Element(e.tag, e.vr, items=[] if cleared(e.keyword) else [scrub(x) for x in e.items])
            elif e.keyword in ("PatientName", "PatientID"):
                e = Element(e.tag, e.vr, subject.encode())
            elif cleared(e.keyword) or e.vr == b"PN":  # any other person's name, known or not
                e = Element(e.tag, e.vr)
            elif e.keyword in ("StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "MediaStorageSOPInstanceUID"):
                kind = "SOPInstanceUID" if e.keyword.startswith("Media") else e.keyword
                e = Element(e.tag, e.vr, uid(kind, e.text()).encode())
            kept.append(e)
        return kept

    number = lambda k, d: next((int(e.text() or d) for e in elements if e.keyword == k), d)
    rows, line = number("Rows", 0), number("Columns", 0) * number("SamplesPerPixel", 1) * (number("BitsAllocated", 8) // 8)
    for e in elements:
        if e.keyword == "PixelData":
            top, px = min(y0, rows) * line, bytearray(e.raw)
            for f in range(number("NumberOfFrames", 1)):
                at = f * rows * line
                px[at : at + top] = b"\0" * len(px[at : at + top])
            e.raw = bytes(px)
    return build(scrub(meta), scrub(elements))


def _rows(elements: list[Element], depth: int = 0) -> Iterator[tuple]:
    for e in elements:
        yield e.tag[0], e.tag[1], e.keyword, e.vr.decode(), e.text(), bool(e.tag[0] % 2), depth
        for item in e.items or ():
            yield from _rows(item, depth + 1)


def headers(files: DataFrame) -> DataFrame:
    """files (path, content) to tag rows (file, grp, elem, keyword, vr, value, is_private, depth, error). A file that can't be read is one row with its error."""
    schema = "file string, grp int, elem int, keyword string, vr string, value string, is_private boolean, depth int, error string"

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, *r, None) for r in _rows(parse(content or b"", True)[1])]
                except (ValueError, struct.error) as e:
                    rows.append((path, *[None] * 7, str(e)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)
