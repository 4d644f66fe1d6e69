"""The mapping table as CSV: read with its header checked by name, written in fixed order, in one rename."""

from __future__ import annotations

import csv
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veilframe.rules import MAPPING_COLUMNS, MAPPING_REQUIRED

NAMES = ("s_no", "original_key", "anon_id", "name", "fingerprints", "last_anonymized")
SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in NAMES), T.StructField("extra", T.MapType(T.StringType(), T.StringType())), T.StructField("ordinal", T.LongType())])


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, later ones empty where an older file lacks them, others kept in `extra`; ordinal is the row's place.

    A missing file is an empty table and is not made; a missing required column is refused. The
    table is one driver-written file of one row a subject, so the driver reads it.
    """
    rows = []
    if os.path.exists(path):
        with open(path, encoding="utf-8-sig", newline="") as f:
            reader = csv.DictReader(f)
            if missing := [c for c in MAPPING_REQUIRED if c not in (reader.fieldnames or ())]:
                raise ValueError(f"the mapping lacks column(s): {', '.join(missing)}")
            for i, r in enumerate(reader):
                extra = {k: v for k, v in r.items() if k is not None and k not in MAPPING_COLUMNS}
                rows.append((*((r.get(c) or "") for c in MAPPING_COLUMNS), extra, i))
    return spark.createDataFrame(rows, SCHEMA)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Rows in order of ordinal, extra columns after the fixed ones; another file is written and renamed over the old."""
    extra: list[str] = sorted({k for r in mapping.selectExpr("explode(map_keys(extra)) AS k").distinct().collect() for k in [r.k]})
    own = tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="", dir=os.path.dirname(os.path.abspath(path)), delete=False)
    with own as f:
        w = csv.writer(f)
        w.writerow([*MAPPING_COLUMNS, *extra])
        for r in mapping.orderBy("ordinal").toLocalIterator():
            w.writerow([*(r[n] if r[n] is not None else "" for n in NAMES), *((r.extra or {}).get(k, "") for k in extra)])
    os.replace(own.name, path)


def check_locations(mapping: str, source: str, output: str) -> None:
    """Refuses outputs in the source or the other way round, and a mapping in either."""
    m, s, o = (os.path.realpath(p) for p in (mapping, source, output))
    inside = lambda a, b: a == b or a.startswith(b.rstrip(os.sep) + os.sep)
    if inside(o, s) or inside(s, o):
        raise ValueError("source and output must not hold each other")
    if inside(m, s) or inside(m, o):
        raise ValueError("the mapping must not lie in the source or the output")


def mapping_path(override: str | None, output: str | None, study: str, default: str) -> str:
    """The override, else beside the output, else in the default folder."""
    name = f"mapping_{study}.csv"
    return override or os.path.join(os.path.dirname(os.path.abspath(output)) if output else default, name)
