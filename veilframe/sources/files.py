"""Catalogues of files. Listing is Spark's; what its readers hide is found by a second listing and refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.rules import FOLDER_TOKEN, SIDE_WORD


def hidden(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> list[str]:
    """Paths below root with one of the suffixes whose name, or a folder's on the way, starts with `_` or `.`: readers skip those silently."""
    jvm, out = spark.sparkContext._jvm, []
    path = jvm.org.apache.hadoop.fs.Path(root)
    it = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    base = len(path.toUri().getPath().rstrip("/"))
    while it.hasNext():
        p = it.next().getPath().toUri().getPath()
        if p.lower().endswith(suffixes) and any(x.startswith(("_", ".")) for x in p[base:].strip("/").split("/")):
            out.append(p)
    return sorted(out)


def catalog(spark: SparkSession, root: str, suffix: str, recursive: bool = True) -> DataFrame:
    """(path, rel, name, package, parent, length, mtime, content) of files with the suffix in any case. content is read only where it is used.

    Raises if hidden files have the suffix, so none is lost in silence.
    """
    if found := hidden(spark, root, (suffix,)):
        raise ValueError(f"{len(found)} file(s) below the root are hidden from readers by their names")
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//[^/]*)?", ""), "^" + _quoted(at) + "/*", "")
    d = d.withColumn("rel", rel)
    parts = F.split("rel", "/")
    return d.select("path", "rel", F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("package"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("parent"), "length", F.col("modificationTime").alias("mtime"), "content")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def subject_folders(files: DataFrame, all_folders: bool = False) -> DataFrame:
    """Packages in order of name; without all_folders those with the folder token only."""
    d = files.where("package <> ''").select("package").distinct()
    return (d if all_folders else d.where(F.col("package").rlike(FOLDER_TOKEN))).orderBy("package")


def side_folder(parent: Column) -> Column:
    return F.when(F.lower(parent).contains(SIDE_WORD), parent)
