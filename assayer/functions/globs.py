"""Shell patterns as regular expressions that Java and Python read alike.

The whole syntax: `*`, `?`, and classes with ranges and `!`; `*` crosses slashes. A class
that is never closed is a plain bracket; a range that runs backwards holds nothing; `^`,
`&`, `[`, `~` and `|` mean nothing special.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPECIAL = re.compile(r"[*?\[]")


def literal(text: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else c for c in text)


def class_ranges(body: str) -> list[tuple[str, str]]:
    """(first, last) of the ranges of a class; backward ones left out."""
    out, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            first, last, i = body[i], body[i + 2], i + 3
        else:
            first = last = body[i]
            i += 1
        if first <= last:
            out.append((first, last))
    return out


def character_class(body: str) -> str:
    """The regular expression of what stands between the brackets."""
    negated = body.startswith("!")
    ranges = class_ranges(body[negated:])
    if not ranges:
        return "." if negated else "(?!)"
    return "[" + "^" * negated + "".join(literal(a) if a == b else f"{literal(a)}-{literal(b)}" for a, b in ranges) + "]"


def regex(glob: str) -> str:
    """The regular expression of whole paths that a pattern matches."""
    out, i = [], 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            # The first letter of a class, behind a `!`, may be a closing bracket.
            end = glob.find("]", i + (glob[i : i + 1] == "!") + 1)
            if end < 0:
                out.append(literal(c))
            else:
                out.append(character_class(glob[i:end]))
                i = end + 1
        else:
            out.append(literal(c))
    return r"(?s)\A(?:" + "".join(out) + r")(?![\s\S])"


def fixed_folder(pattern: Column) -> Column:
    """The folder that all paths of a pattern lie in: what stands before its first special letter, up to a slash."""
    return F.regexp_extract(F.regexp_extract(pattern, r"(?s)^[^*?\[]*", 0), r"(?s)^(.*/)?", 0)


def folders(path: Column) -> Column:
    """All folders that a path lies in, each with its slash; the first is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))


@pandas_udf(T.BooleanType())
def matches(paths: pd.Series, patterns: pd.Series) -> pd.Series:
    """Whether each path matches its own pattern; a pattern is compiled once a batch."""
    compiled = {p: re.compile(regex(p)) for p in patterns.dropna().unique()}
    return pd.Series([p is not None and g is not None and compiled[g].match(p) is not None for p, g in zip(paths, patterns, strict=True)])
