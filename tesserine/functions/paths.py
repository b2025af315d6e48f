"""Paths of files and addresses, and lines of a diff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_path(url: Column) -> Column:
    """The path of an address without query and fragment; / where it has none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def proximity(a: Column, b: Column) -> Column:
    """Shared leading directories over the deeper path's parts."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    lead = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + (s["on"] & e).cast("int")).alias("n")), lambda s: s["n"])
    return lead / F.greatest(F.size(x), F.size(y))


def name_status(line: Column) -> Column:
    """A line of ``git diff --name-status`` as (status, old_path, path); a rename or copy has two paths."""
    p = F.split(line, "\t")
    return F.when(F.size(p) >= 2, F.struct(F.substring(p[0], 1, 1).alias("status"), F.when(F.size(p) > 2, p[1]).alias("old_path"), F.element_at(p, -1).alias("path")))


def hunk(line: Column) -> Column:
    """A hunk header as (old_start, old_lines, new_start, new_lines); a missing length is 1; NULL for other lines."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.regexp_extract(line, pattern, i)
    number = lambda i: F.when(part(i) == "", F.lit(1)).otherwise(F.try_to_number(part(i), F.lit("9999999999")).cast("long"))
    return F.when(F.regexp_like(line, F.lit(pattern)), F.struct(number(1).alias("old_start"), number(2).alias("old_lines"), number(3).alias("new_start"), number(4).alias("new_lines")))
