"""Column expressions over evaluation records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import globs

# Names of platforms and architectures, and what they stand for.
OS_ALIASES = {"linux": "linux", "darwin": "darwin", "macos": "darwin", "win32": "windows", "windows": "windows"}
ARCH_ALIASES = {"x86_64": "x86_64", "amd64": "x86_64", "aarch64": "arm64", "arm64": "arm64"}
# Kinds of content-derived ids.
ID_KINDS = ("env", "bundle", "snap", "task", "rew", "episode", "trace", "patch", "finding", "sem", "scen", "replay")
PSEUDO_SIGNALS = ("native", "oracle")


def canonical_json(value: Column) -> Column:
    """Minimal JSON of a struct whose fields are in alphabetical order; nulls are kept.

    For strings, whole numbers and booleans; see identity.canonical_text for open JSON.
    """
    return F.to_json(value, {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def content_id(kind: str, canonical: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.sha2(canonical.cast("binary"), 256))


def lf(text: Column) -> Column:
    """CRLF and CR to LF."""
    return F.regexp_replace(text, "\r\n|\r", "\n")


def content_hash(text: Column, is_binary: Column) -> Column:
    """Binary content as it is, other content with LF line ends."""
    return digest(F.when(is_binary, text).otherwise(lf(text)))


def canonical_mode(octal: Column) -> Column:
    """0755 if any execute bit is set, else 0644."""
    return F.when(F.conv(octal, 8, 10).cast("int").bitwiseAND(0o111) != 0, "0755").otherwise("0644")


def safe_path(path: Column) -> Column:
    """A relative POSIX path without empty and `.` parts; null if absolute, escaping or empty."""
    raw = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != "."))
    bad = raw.startswith("/") | (F.substring(raw, 2, 1) == ":") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether some shell pattern matches the whole path."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | path.rlike(globs.regex(pattern))
    return found


def writable(path: Column, patterns: list[str]) -> Column:
    """Whether some pattern is the root, a `dir/` that holds the path, or a glob that matches it; fingerprint.uncovered has patterns from a table."""
    if {".", "./"} & set(patterns):
        return F.lit(True)
    found = matches_any(path, patterns)
    for folder in [p for p in patterns if p.endswith("/")]:
        found = found | path.startswith(folder)
    return found


def signal_id(value: Column) -> Column:
    return value.rlike(r"^[a-z][a-z0-9_]{0,63}\z")


def candidate_key(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,63}\z") & ~value.contains("--")


def command(argv: Column) -> Column:
    """Absolute paths among the words of a command to what follows their last slash, which may be nothing."""
    return F.transform(argv, lambda t: F.when(t.startswith("/"), F.regexp_extract(t, "(?s)([^/]*)\\z", 1)).otherwise(t))


def command_id(tool: Column, args: Column, cwd: Column) -> Column:
    return content_id("cmd", canonical_json(F.struct(args.alias("args"), F.coalesce(cwd, F.lit(".")).alias("cwd"), tool.alias("tool"))))


def platform(value: Column) -> Column:
    """Struct (os, arch) of `os-arch`, known aliases folded, others in lower case."""
    def alias(part: Column, names: dict[str, str]) -> Column:
        low = F.lower(part)
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return F.coalesce(F.try_element_at(known, low), low)

    cut = F.split(value, "-", 2)
    return F.struct(alias(F.get(cut, F.lit(0)), OS_ALIASES).alias("os"), alias(F.coalesce(F.get(cut, F.lit(1)), F.lit("unknown")), ARCH_ALIASES).alias("arch"))


def termination(executes: Column, timed_out: Column) -> Column:
    return F.when(~executes, "not_executed").when(timed_out, "timed_out").otherwise("exited")


def overridden(states: Column, failed: Column) -> Column:
    """Every state but the pseudo signals' becomes error where the run itself failed."""
    return F.when(failed, F.transform_values(states, lambda k, v: F.when(k.isin(*PSEUDO_SIGNALS), v).otherwise(F.lit("error")))).otherwise(states)


def relation(left: Column, right: Column) -> Column:
    """left_higher, right_higher, equal, or incomparable where a reward is missing."""
    return F.when(left.isNull() | right.isNull(), "incomparable").when(left > right, "left_higher").when(right > left, "right_higher").otherwise("equal")


def lines_of(text: Column) -> Column:
    """Lines of a text; a final line feed adds none, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1))


def span(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end, 1-based; null outside the text."""
    return F.when((start >= 1) & (end >= start) & (end <= F.size(lines)), F.array_join(F.slice(lines, start, end - start + 1), "\n"))


def pair_member(task: Column, left: Column, right: Column) -> Column:
    return F.format_string("comparisons/%s/%s--%s.json", task.cast("string"), left, right)


def request_key(head: Column, args: Column) -> Column:
    return F.concat(F.coalesce(head, F.lit("")), F.lit("::"), F.to_json(args))


def truncated(content: Column, limit: int) -> Column:
    """Struct (content, truncated) of bytes."""
    return F.struct(F.substring(content, 1, limit).alias("content"), (F.octet_length(content) > limit).alias("truncated"))


def strict_utf8(content: Column) -> Column:
    """The text of valid UTF-8, else null."""
    return F.try_validate_utf8(content.cast("string"))


def first_prose(text: Column, limit: int = 96) -> Column:
    """The first line that says something, emphasis, code marks and quote marks taken out; empty where there is none.

    Headings, markup, rules, images, tables and `Label:` lines (a capital letter and up to 18
    more) say nothing.
    """
    line = lambda x: F.regexp_replace(F.regexp_replace(x, "[*_`>]", ""), r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+$", "")
    says = F.filter(F.transform(F.split(text, "\n"), line), lambda x: (x != "") & ~x.rlike(r"^(#|<|---|!|\||[A-Z][\w ]{0,18}:)"))
    return F.substring(F.coalesce(F.get(says, F.lit(0)), F.lit("")), 1, limit)


def gate_verdict(code: Column) -> Column:
    """The verdict that an exit code of a gate stands for; only `decision` allows."""
    return F.when(code == 0, "decision").when(code == 1, "no-admissible").when(code == 2, "parse-error").when(code == 3, "escalation").otherwise("error")


def gate_allows(governed: Column, enforcing: Column, code: Column) -> Column:
    return F.when(~governed, ~enforcing).otherwise(code == 0)


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
