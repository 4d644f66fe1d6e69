"""Text expressions with the white-space and case rules the extraction needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends; trim() knows spaces only."""
    return F.regexp_replace(c, _EDGE, "")


def collapse(c: Column | str) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def literal_pattern(value: Column) -> Column:
    """A regular expression for the value: literal, in any case, its spaces any white space, so wrapped lines match."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?iu)"), F.regexp_replace(quoted, r"(?U)\s+", "\\\\E\\\\s+\\\\Q"))


def whole_value_pattern(value: Column) -> Column:
    """literal_pattern that meets the value only where it doesn't go on in letters or figures: `1` is no part of `12`."""
    edge = lambda at, look: F.when(value.rlike(r"(?U)^\w" if at else r"(?U)\w$"), F.lit(look)).otherwise("")
    return F.concat(edge(True, r"(?<![\p{L}\p{N}])"), literal_pattern(value), edge(False, r"(?![\p{L}\p{N}])"))


def literal_replacement(value: Column) -> Column:
    """A replacement that stands for itself."""
    return F.regexp_replace(value, r"([\\$])", r"\\$1")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def short_path(path: Column | str) -> Column:
    """The last two segments."""
    parts = F.split(path, r"[\\/]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def mapping_key(kind: Column, value: Column, prefix: str) -> Column:
    """The identity as mappings store it: the first kind as it is, a lab number with its prefix."""
    return F.when(kind == "A", value).when(kind == "B", F.concat(F.lit(prefix), value))


def is_placeholder(value: Column, placeholders: tuple[str, ...]) -> Column:
    return F.lower(strip(value)).isin(*placeholders)


def subject_file_name(subject: Column, path: Column) -> Column:
    """The subject id before the file name without its first folder token and what then leads it."""
    name = basename(path)
    rest = strip(F.regexp_replace(name, r"^(.*?)(?i:NP\s*0*[0-9]+)", "$1"))
    return F.concat_ws("_", subject, F.coalesce(none_if_empty(F.regexp_replace(rest, r"^[_\- ]+", "")), name))
