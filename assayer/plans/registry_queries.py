"""Verifier seam, open JSON, adapters and per-item functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import identity
from assayer.functions.registry import Fold, Registry, Rule, each
from assayer.operators import patches

from . import views as V
from .catalog import register
from .views import sql


def _state_of(signal):
    return Rule(lambda: F.coalesce(F.try_element_at("verification", F.lit(signal)), F.lit("error")))


REGISTRY = Registry({s: ("1", _state_of(s)) for s in ("s1", "s2", "s3")})


@register("udf01_verifier_seam", sql("SELECT episode_key, signal, state, '1' AS version, 'registry' AS source FROM verification WHERE signal IN ('s1', 's2')", "verification"))
def udf01(spark, d):
    return REGISTRY.run(V.episodes(spark, d), ["s1", "s2"])


@register("udf02_registry", sql("SELECT signal, CASE WHEN signal <= 's3' THEN 'available' ELSE 'absent' END AS status FROM rubric", "rubric"))
def udf02(spark, d):
    signals = V.signal_states(spark, d).select("signal").distinct()
    return signals.join(F.broadcast(REGISTRY.frame(spark)), "signal", "left").select("signal", F.when(F.col("version").isNull(), "absent").otherwise("available").alias("status"))


@register("udf03_injected_verifiers", sql("SELECT episode_key, signal, CASE WHEN signal = 's5' THEN 'error' WHEN signal = 's4' THEN 'pass' ELSE state END AS state, CASE signal WHEN 's4' THEN 'x' WHEN 's5' THEN NULL ELSE '1' END AS version, CASE signal WHEN 's4' THEN 'injected' WHEN 's5' THEN 'none' ELSE 'registry' END AS source FROM verification WHERE signal IN ('s3', 's4', 's5')", "verification"))
def udf03(spark, d):
    extra = {"s4": ("x", lambda context: context.select("episode_key", F.lit("pass").alias("state")))}  # a verifier that takes the table
    return REGISTRY.run(V.episodes(spark, d), ["s3", "s4", "s5"], extra)


_FOLDS = {
    "spread": ("1", Fold(lambda: F.when(F.count_distinct("signal") >= 3, "pass").otherwise("not_applicable"))),
    "clean": ("2", Fold(lambda: F.when(F.bool_or(F.col("state") == "error"), "error").when(F.bool_or(F.col("state") == "fail"), "fail").otherwise("pass"))),
    "mostly": ("1", Fold(lambda: F.when(F.count_if(F.col("state") == "pass") * 2 > F.count(F.lit(1)), "pass").otherwise("fail"))),
}


@register("udf03_table_verifiers", sql("""SELECT episode_key, f.signal, CASE f.signal WHEN 'spread' THEN CASE WHEN n >= 3 THEN 'pass' ELSE 'not_applicable' END WHEN 'clean' THEN CASE WHEN bad THEN 'error' WHEN failed THEN 'fail' ELSE 'pass' END ELSE CASE WHEN passed * 2 > n THEN 'pass' ELSE 'fail' END END AS state,
CASE f.signal WHEN 'clean' THEN '2' ELSE '1' END AS version, 'injected' AS source FROM (SELECT episode_key, count(*) AS n, bool_or(state = 'error') AS bad, bool_or(state = 'fail') AS failed, count(*) FILTER (state = 'pass') AS passed FROM signal_states GROUP BY 1), (VALUES ('spread'), ('clean'), ('mostly')) f(signal)""", "signal_states"))
def udf03_tables(spark, d):
    """Three verifiers that each see all signals of an episode."""
    return REGISTRY.run(V.episodes(spark, d), list(_FOLDS), _FOLDS, table=V.signal_states(spark, d))


@register("udf04_identity_adapter", "SELECT doc_id, 'src-' || length(text) AS id FROM documents")
def udf04(spark, d):
    def by_length(texts: pd.Series) -> pd.Series:
        return "src-" + texts.str.len().astype("Int64").astype("string")

    return V.table(spark, d, "documents").select("doc_id", identity.lowered(F.col("text"), by_length).alias("id"))


@register("udf05_per_item", """SELECT page_id, CASE WHEN url LIKE '%?%' OR url IS NULL OR url NOT LIKE '%://%' THEN NULL ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || ' ' || (len(string_split(url, '/')) - 3) END AS output,
CASE WHEN url LIKE '%?%' OR url IS NULL OR url NOT LIKE '%://%' THEN 'ValueError' END AS error FROM pages""")
def udf05(spark, d):
    def described(urls: list[str]) -> list[str]:
        """Host and number of path parts; a URL with a query, and what is no URL, is refused."""
        from urllib.parse import urlsplit

        if any(u is None or "://" not in u for u in urls):
            raise ValueError("no URL")
        parts = [urlsplit(u) for u in urls]
        if any(p.query or u.endswith("?") for p, u in zip(parts, urls, strict=True)):
            raise ValueError("a query")
        return [f"{p.netloc} {u.count('/') - 2}" for p, u in zip(parts, urls, strict=True)]

    return each(V.table(spark, d, "pages"), "page_id", "url", described)


@register("sca01_open_json", """SELECT event_id, '{"a":[1,2],"k":' || coalesce('"' || (props->>'$.k') || '"', 'null') || '}' AS canonical FROM events""")
def sca01_open(spark, d):
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{ "k" : '), F.coalesce(F.concat(F.lit('"'), k, F.lit('"')), F.lit("null")), F.lit(', "a": [1, 2] }'))
    return V.table(spark, d, "events").select("event_id", identity.canonical_text(body).alias("canonical"))


def diffs(spark, d):
    """(doc_id, diff, text, path): a diff of each file's first and last lines, some of them wrong."""
    doc, lines = F.col("doc_id"), F.col("lines")
    line = lambda i: F.get(lines, i)
    rows = V.table(spark, d, "documents").filter("text <> ''").select("doc_id", "text", C.lines_of(F.col("text")).alias("lines")).withColumn("n", F.size("lines"))
    head = F.concat(F.lit("--- a/f\n+++ b/"), F.when(doc % 13 == 0, "g\n").otherwise("f\n"))
    first = F.when(doc % 3 == 0, F.concat(line(0), F.lit("?"))).otherwise(line(0))
    one = F.concat(F.when(doc % 5 == 0, "@@ -1,2 +1,2 @@\n-").otherwise("@@ -1 +1,2 @@\n-"), first, F.lit("\n+new\n+"), line(0), F.lit("\n"))
    tail = F.format_string("@@ -%d,2 +%d,2 @@\n %s\n-%s\n+end\n", F.col("n") - 1, F.col("n"), line(F.col("n") - 2), line(F.col("n") - 1))
    over = F.format_string("@@ -1,2 +2,2 @@\n %s\n-%s\n+end\n", line(0), line(1))
    two = F.when((doc % 5 == 0) | (F.col("n") < 4), "").when(doc % 11 == 0, over).otherwise(tail)
    diff = F.when(doc % 7 == 0, " ").otherwise(F.concat(head, one, two))
    return rows.select("doc_id", diff.alias("diff"), "text", F.lit("f").alias("path"))


_FILES = "(SELECT doc_id, l, len(l) AS n, doc_id % 7 <> 0 AND doc_id % 13 <> 0 AS ok, doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND doc_id % 5 <> 0 AND len(l) >= 4 AS two, doc_id % 11 = 0 AS over FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''))"
_BODY = f"""SELECT doc_id, 1 AS hunk, 1 AS seq, '-' AS tag, 1 AS old_line, NULL AS new_line, CASE WHEN doc_id % 3 = 0 THEN l[1] || '?' ELSE l[1] END AS text FROM {_FILES} WHERE ok
UNION ALL SELECT doc_id, 1, 2, '+', NULL, 1, 'new' FROM {_FILES} WHERE ok UNION ALL SELECT doc_id, 1, 3, '+', NULL, 2, l[1] FROM {_FILES} WHERE ok
UNION ALL SELECT doc_id, 2, 1, ' ', CASE WHEN over THEN 1 ELSE n - 1 END, CASE WHEN over THEN 2 ELSE n END, CASE WHEN over THEN l[1] ELSE l[n - 1] END FROM {_FILES} WHERE two
UNION ALL SELECT doc_id, 2, 2, '-', CASE WHEN over THEN 2 ELSE n END, NULL, CASE WHEN over THEN l[2] ELSE l[n] END FROM {_FILES} WHERE two
UNION ALL SELECT doc_id, 2, 3, '+', NULL, CASE WHEN over THEN 3 ELSE n + 1 END, 'end' FROM {_FILES} WHERE two"""


@register("udf06_diff_lines", f"""SELECT doc_id, hunk, seq, tag, text FROM ({_BODY})
UNION ALL SELECT doc_id, 1, 4, '!', 'a hunk shorter than its counts' FROM {_FILES} WHERE ok AND doc_id % 5 = 0
UNION ALL SELECT doc_id, 0, 0, '!', CASE WHEN doc_id % 7 = 0 THEN 'a line outside of hunks' ELSE 'headers that do not pair' END FROM {_FILES} WHERE NOT ok""")
def udf06(spark, d):
    return patches.patch_lines(diffs(spark, d), "doc_id", "diff").select("doc_id", "hunk", "seq", "tag", "text")


@register("jn22_patch_context", f"SELECT doc_id, 1 AS hunk, doc_id % 3 <> 0 AS exact FROM {_FILES} WHERE ok UNION ALL SELECT doc_id, 2, true FROM {_FILES} WHERE two")
def jn22(spark, d):
    rows = diffs(spark, d)
    return patches.context_checks(patches.patch_lines(rows, "doc_id", "diff"), rows, "doc_id").select("doc_id", "hunk", "exact")


@register("win04_hunk_cursor", f"SELECT doc_id, hunk, tag, old_line, new_line FROM ({_BODY})")
def win04(spark, d):
    return patches.patch_lines(diffs(spark, d), "doc_id", "diff").filter("tag <> '!'").select("doc_id", "hunk", "tag", "old_line", "new_line")


@register("win04_hunk_overlaps", f"SELECT doc_id, 2 AS hunk FROM {_FILES} WHERE two AND over")
def win04_overlaps(spark, d):
    return patches.overlaps(patches.patch_lines(diffs(spark, d), "doc_id", "diff"), "doc_id").select("doc_id", "hunk")


@register("agg16_patch_verdict", f"SELECT doc_id, CASE WHEN NOT ok OR doc_id % 5 = 0 OR doc_id % 3 = 0 OR (two AND over) THEN 'fail' ELSE 'pass' END AS state FROM {_FILES}")
def agg16(spark, d):
    rows = diffs(spark, d)
    return patches.verdicts(rows, patches.patch_lines(rows, "doc_id", "diff"), rows, "doc_id", "diff")
