"""Rule tables: what the operators know about report templates, headers and folders. All are parameters.

The values under "Fixed values" must equal what existing collections and mappings were made with.
"""

from __future__ import annotations

from dataclasses import dataclass

# The mapping table's header, in order; the first four are required.
MAPPING_COLUMNS = ("S. No", "Original CR No", "Anonymized ID", "Name", "Source Fingerprints", "Last Anonymized")
MAPPING_REQUIRED = MAPPING_COLUMNS[:4]

# Thresholds of documents without text.
SCANNED_CHARS = 20
FULL_PAGE_SHARE = 0.90

# Running-text template. Labels end a value where they start a line before a colon; sections where they start a line.
LABELS_A = (r"CR No", r"Lab/Study No\.", r"Requisition Date", r"Patient Name", r"Age/Sex", r"Coll\./Study Date", r"Sample Type/No", r"Clinician", r"Reporting Date", r"Dept/Unit", r"Diagnosis", r"Ward/OPD", r"\bWard\b", r"Room/Bed", r"Validated By")
SECTIONS_A = (r"Investigation", r"Comments\s*:", r"\*{3,}\s*END OF THE REPORT", r"Test results relate only to item received", r"This is computer generated report", r"Page\s+\d+\s+of\s+\d+")
FIELDS_A = (("cr_no", r"CR No"), ("patient_name", r"Patient Name"), ("ward_opd", r"Ward/OPD"), ("ward", r"\bWard\b"), ("room_bed", r"Room/Bed"), ("lab_study_no", r"Lab/Study No\."), ("validated_by", r"Validated By"), ("clinician", r"Clinician"))
PLACEHOLDERS = ("", "-", "--", "---", "n/a", "na")

# Anchors of the two templates; positioned template's bands in points and row tolerance.
ANCHOR_A = "Department of Biochemistry"
ANCHORS_B = ("Dr Lal PathLabs", "SUJATHA DIAGNOSTICS")
LABEL_BAND, VALUE_BAND, ROW_TOLERANCE = (0.0, 70.0), (88.0, 291.0), 1.6
LABELS_B = (("name", "Name"), ("lab_no", "Lab No."), ("ref_by", "Ref By"))
CODE_ANCHOR, PLACE_ANCHOR, END_ANCHOR = "Authenticity assured", "Processed at", "End of report"
TOP_BAND, FOOT_BAND = (0.0, 36.0, 595.0, 66.0), (0.0, 799.0, 595.0, 841.0)
BARCODE_FONTS = ("IDAutomation", "Barcode", "3of9")

# Header keywords to clear, patterns of others to clear, and the order a review shows tags in.
CLEAR_KEYWORDS = (
    "PatientBirthDate", "InstitutionName", "InstitutionalDepartmentName", "ReferringPhysicianName", "PerformingPhysicianName", "OperatorsName", "StationName", "DeviceSerialNumber", "AccessionNumber",
    "OtherPatientIDs", "PatientComments", "AdditionalPatientHistory", "PatientAddress", "TransducerData", "AdmissionID", "AdmittingDiagnosesDescription", "ImageComments", "EthnicGroup",
)
CLEAR_PATTERN = r"(?i)Physician.*Name|Operator"
PRIORITY_TAGS = (
    "PatientName", "PatientID", "PatientBirthDate", "PatientSex", "PatientAge", "InstitutionName", "InstitutionAddress", "ReferringPhysicianName", "PerformingPhysicianName", "OperatorsName",
    "StationName", "StudyDate", "StudyTime", "AccessionNumber", "StudyID", "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID",
)

# Folder and file names.
FOLDER_TOKEN = r"(?i)NP\s*0*(\d+)"
SIDE_WORD = "kidney"
STUDIES = ("egfr", "kfre")
LAB_PREFIX = "Lab No.:"


@dataclass(frozen=True)
class HeaderRules:
    """What a scrub clears. The address is shown in reviews, so it is cleared too."""

    keywords: tuple[str, ...] = (*CLEAR_KEYWORDS, "InstitutionAddress")
    pattern: str = CLEAR_PATTERN


@dataclass(frozen=True)
class TemplateRules:
    labels: tuple[str, ...] = LABELS_A
    sections: tuple[str, ...] = SECTIONS_A
    fields: tuple[tuple[str, str], ...] = FIELDS_A
    anchor: str = ANCHOR_A
    anchors_b: tuple[str, ...] = ANCHORS_B
