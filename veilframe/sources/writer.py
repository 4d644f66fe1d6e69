"""Binary outputs: one file a row, written beside its place and renamed, so attempts that run again leave one whole file."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def write_files(rows: DataFrame) -> DataFrame:
    """rows (out, content) written through the URI's file system: (out, written, error). Nothing runs before the result is read."""

    def run(batches):
        for b in batches:
            errors = []
            for out, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    fs, path = pafs.FileSystem.from_uri(out if "://" in out else f"file://{out}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    own = f"{path}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(own) as f:
                        f.write(content or b"")
                    if fs.get_file_info(path).type != pafs.FileType.NotFound:
                        fs.delete_file(path)
                    fs.move(own, path)
                    errors.append(None)
                except OSError as e:
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e is None for e in errors]), pa.array(errors, pa.string())], names=["out", "written", "error"])

    return rows.select("out", "content").mapInArrow(run, "out string, written boolean, error string")
