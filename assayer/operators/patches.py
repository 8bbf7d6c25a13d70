"""Unified diffs as rows, and whether they fit their sources.

Cutting a diff into lines is sequential, as the counts in a hunk's header and not the
first character of a line say where the hunk ends; that part is a small table function
per diff. All checks on the rows are joins, windows and groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from assayer.functions import columns as C

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def diff_rows(diff: str | None) -> Iterator[tuple]:
    """(section, path, hunk, seq, tag, old_line, new_line, text); tag is ` `, `-`, `+`, or `!` for what is not admissible."""
    section, hunk, seq, path = 0, 0, 0, None
    old_left = new_left = 0
    old_at = new_at = 0
    lines = (diff or "").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for n, line in enumerate(lines):
        if old_left or new_left:
            tag = line[:1] or " "
            seq += 1
            if tag == " " and old_left and new_left:
                yield section, path, hunk, seq, tag, old_at, new_at, line[1:]
                old_at, new_at, old_left, new_left = old_at + 1, new_at + 1, old_left - 1, new_left - 1
            elif tag == "-" and old_left:
                yield section, path, hunk, seq, tag, old_at, None, line[1:]
                old_at, old_left = old_at + 1, old_left - 1
            elif tag == "+" and new_left:
                yield section, path, hunk, seq, tag, None, new_at, line[1:]
                new_at, new_left = new_at + 1, new_left - 1
            else:
                yield section, path, hunk, seq, "!", None, None, "a line that the counts do not allow"
                return
        elif line.startswith("--- a/"):
            section, hunk, path = section + 1, 0, None
            if n + 1 >= len(lines) or lines[n + 1] != "+++ b/" + line[6:]:
                yield section, line[6:], 0, 0, "!", None, None, "headers that do not pair"
                return
        elif line.startswith("+++ b/") and section and path is None:
            path = line[6:]
        elif (m := _HUNK.match(line)) and path is not None:
            hunk, seq = hunk + 1, 0
            old_left, new_left = (int(x) if x is not None else 1 for x in (m[2], m[4]))
            # A side without lines is numbered by the line before it.
            old_at, new_at = (int(start) + (left == 0) for start, left in ((m[1], old_left), (m[3], new_left)))
        else:
            yield section, path, hunk, seq, "!", None, None, "a line outside of hunks"
            return
    if old_left or new_left:
        yield section, path, hunk, seq + 1, "!", None, None, "a hunk shorter than its counts"


_KINDS = {"section": "int", "path": "string", "hunk": "int", "seq": "int", "tag": "string", "old_line": "int", "new_line": "int", "text": "string"}


@udtf(returnType=T.StructType([T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in _KINDS.items()]))
class DiffLines:
    def eval(self, diff: str):
        yield from diff_rows(diff)


def patch_lines(patches: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, section, path, hunk, seq, tag, old_line, new_line, text)"""
    return patches.select(key, diff).lateralJoin(DiffLines(F.col(diff).outer())).drop(diff)


def context_checks(lines: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, path, hunk, exact): whether all context and removed lines equal the source (key, path, text)."""
    old = lines.filter("tag in (' ', '-')")
    joined = old.join(sources.select(key, "path", C.lines_of(F.col("text")).alias("_lines")), [key, "path"], "left")
    equal = F.coalesce(F.get("_lines", F.col("old_line") - 1) == F.col("text"), F.lit(False))
    return joined.groupBy(key, "path", "hunk").agg(F.bool_and(equal).alias("exact"))


def overlaps(lines: DataFrame, key: str) -> DataFrame:
    """(key, path, hunk): hunks that begin before the one before them ends."""
    hunks = lines.filter("tag in (' ', '-')").groupBy(key, "section", "path", "hunk").agg(F.min("old_line").alias("first"), F.max("old_line").alias("last"))
    end = F.max("last").over(Window.partitionBy(key, "section").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1))
    return hunks.withColumn("_end", end).filter("_end >= first").select(key, "path", "hunk")


def verdicts(patches: DataFrame, lines: DataFrame, sources: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, state): fail for a blank diff, an inadmissible line, a hunk that overlaps or does not fit."""
    bad = lines.filter("tag = '!'").select(key).union(context_checks(lines, sources, key).filter(~F.col("exact")).select(key)).union(overlaps(lines, key).select(key)).distinct().withColumn("_bad", F.lit(True))
    blank = F.trim(F.coalesce(diff, F.lit(""))) == ""
    return patches.join(bad, key, "left").select(key, F.when(blank | F.coalesce("_bad", F.lit(False)), "fail").otherwise("pass").alias("state"))
