"""Claims, citations and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.operators import claims

from . import views as V
from .catalog import register
from .views import sql

_RESOLVED = """SELECT c.snapshot, c.path, c.doc_id, c.start_line, c.end_line, CASE WHEN f.path IS NULL THEN 'unknown' WHEN c.end_line > len(f.lines) THEN 'range'
WHEN array_to_string(f.lines[c.start_line:c.end_line], chr(10)) = c.quote THEN 'pass' ELSE 'mismatch' END AS outcome
FROM citations c LEFT JOIN (SELECT snapshot, path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM files) f USING (snapshot, path)"""


@register("jn06_citation_resolve", sql(f"SELECT snapshot, path, start_line, end_line, outcome FROM ({_RESOLVED})", "citations", "files"))
def jn06(spark, d):
    return claims.resolved(V.citations(spark, d), V.files(spark, d), ["snapshot", "path"]).select("snapshot", "path", "start_line", "end_line", "outcome")


@register("agg12_citations_verdict", sql(f"""SELECT doc_id // 2 AS finding, CASE WHEN bool_and(outcome = 'pass' AND doc_id % 11 <> 0 AND doc_id % 13 <> 0) THEN 'pass' ELSE 'fail' END AS state FROM ({_RESOLVED}) GROUP BY 1
UNION ALL SELECT -1 - c_custkey, 'fail' FROM customer""", "citations", "files"))
def agg12(spark, d):
    """Two documents make a finding of two claims, some of which cite nothing; a customer's finding has no claims."""
    doc = F.col("doc_id")
    cited = F.when(doc % 13 == 0, F.lit(None)).when(doc % 11 == 0, F.array().cast(claims.CITATIONS)).otherwise(F.array(F.struct("path", "start_line", "end_line", "quote")).cast(claims.CITATIONS))
    claim = F.struct(F.lit("says").alias("statement"), cited.alias("citations"))
    findings = V.citations(spark, d).groupBy(F.floor(doc / 2).alias("finding")).agg(F.collect_list(claim).alias("claims"))
    empty = V.table(spark, d, "customer").select((-1 - F.col("c_custkey")).cast("long").alias("finding"), F.when(F.col("c_custkey") % 2 == 0, F.array()).cast(findings.schema["claims"].dataType).alias("claims"))
    return claims.verdicts(claims.resolved(claims.cited(findings.union(empty), "finding"), V.files(spark, d), ["path"]), "finding")


@register("agg13_completeness_verdict", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN 'pass' ELSE 'fail' END AS state FROM orders")
def agg13(spark, d):
    k = F.col("o_orderkey")
    citation = F.struct(F.when(k % 3 == 0, "").otherwise("a/b").alias("path"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"), F.lit("q").alias("quote"))
    cited = F.when(k % 7 == 0, F.slice(F.array(citation), 1, 0)).otherwise(F.array(citation))
    claim = F.array(F.struct(F.when(k % 10 == 0, "  ").when(k % 5 == 0, "\t\n\u00a0 ").otherwise(" says\n").alias("statement"), cited.alias("citations")))
    return V.table(spark, d, "orders").select("o_orderkey", claim.alias("claims")).select("o_orderkey", claims.complete(F.col("claims")).alias("state"))


@register("sca16_span_text", sql("SELECT path, array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[1:2], chr(10)) AS span FROM files WHERE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) >= 2", "files"))
def sca16(spark, d):
    return V.files(spark, d).select("path", C.span(C.lines_of(F.col("text")), F.lit(1), F.lit(2)).alias("span")).filter("span is not null")


@register("win03_line_numbering", sql("SELECT path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM files WHERE text <> '')", "files"))
def win03(spark, d):
    return V.files(spark, d).select("path", F.posexplode(C.lines_of(F.col("text"))).alias("i", "text")).select("path", (F.col("i") + 1).cast("long").alias("line"), "text")


_ID = r"\b(?:env|bundle|snap|task|rew|episode|trace|patch|finding|sem|scen|replay)-[0-9a-f]{8,}\b"
_PLANTED = "text || ' ' || ['task', 'sem', 'cmd', 'scen', 'xrew', 'replay'][doc_id % 6 + 1] || '-' || substr(md5(doc_id::VARCHAR), 1, 5 + doc_id % 20) || ' x'"


def _planted():
    kind = F.element_at(F.array(*map(F.lit, ("task", "sem", "cmd", "scen", "xrew", "replay"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return F.concat("text", F.lit(" "), kind, F.lit("-"), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(1), (5 + F.col("doc_id") % 20).cast("int")), F.lit(" x"))


@register("flt13_id_literals", f"SELECT doc_id, unnest(regexp_extract_all({_PLANTED}, '{_ID}')) AS literal FROM documents")
def flt13(spark, d):
    return claims.id_literals(V.table(spark, d, "documents").select("doc_id", _planted().alias("t")), "doc_id", "t")


@register("flt13_id_violations", f"""WITH f AS (SELECT doc_id, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.json' ELSE '.txt' END AS path, doc_id % 4 AS turn, CASE WHEN doc_id % 3 <> 0 THEN {_PLANTED} ELSE '"snap-' || md5(doc_id::VARCHAR) || '"' END AS t FROM documents)
SELECT path, 'literal' AS reason, unnest(regexp_extract_all(t, '{_ID}')) AS found FROM f WHERE doc_id % 3 <> 0 OR turn < 3 UNION ALL SELECT path, 'not_json', NULL FROM f WHERE doc_id % 3 = 0 AND turn >= 2
UNION ALL SELECT path, 'key', unnest(['task_id', 'env_id', 'env_id']) FROM f WHERE doc_id % 3 = 0 AND turn = 0 UNION ALL SELECT path, 'key', 'semantic_artifact_id' FROM f WHERE doc_id % 3 = 0 AND turn = 1""")
def flt13_violations(spark, d):
    """Every third document is a JSON file, some of which do not parse; keys lie at several depths."""
    doc = F.col("doc_id")
    own = F.concat(F.lit('"snap-'), F.md5(doc.cast("string").cast("binary")), F.lit('"'))
    json = (
        F.when(doc % 4 == 0, F.concat(F.lit('{"a": [{"b": {"task_id": 1, "c": [[{"env_id": null}]]}}, {"env_id": '), own, F.lit("}]}")))
        .when(doc % 4 == 1, F.concat(F.lit('[{"note": "task_id", "semantic_artifact_id": {"id": '), own, F.lit("}}]")))
        .when(doc % 4 == 2, F.concat(F.lit('{"task_id": '), own))
        .otherwise("")
    )
    files = V.table(spark, d, "documents").select(F.concat(doc.cast("string"), F.when(doc % 3 == 0, ".json").otherwise(".txt")).alias("path"), F.when(doc % 3 == 0, json).otherwise(_planted()).alias("text"))
    return claims.id_violations(files, [])


_HEADED = "CASE doc_id % 6 WHEN 0 THEN '# T' || chr(10) || chr(10) || '> *Quoted* `line` ' || doc_id || chr(10) WHEN 1 THEN 'Last updated: now' || chr(10) || '- _item_' || chr(10) WHEN 2 THEN '--- ' || chr(10) || '| a |' || chr(10) || '![x](y)' || chr(10) || '[link](z)' || chr(10) WHEN 3 THEN '<p>' || chr(10) || 'note: lower' || chr(10) WHEN 4 THEN chr(9) || ' **Bold**: text' || chr(10) ELSE '' END || text"


@register("sca25_first_prose_line", f"""SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split({_HEADED}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[*_`>]', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|<|---|!|[|]|[A-Z][\\w ]{{0,18}}:)'))[1], 1, 96), '') AS line
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def sca25(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", C.first_prose(F.expr(_HEADED.replace("chr(9)", "char(9)").replace("chr(10)", "char(10)"))).alias("line"))


@register("quotes_located", "SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT p_partkey, p_type FROM part UNION ALL SELECT -1 - c_custkey, c_mktsegment || ' ' || c_nationkey FROM customer) b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def quotes(spark, d):
    """Quotes without a place; those of parts and customers have fewer than five words."""
    short = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("quote")).union(V.table(spark, d, "customer").select(-1 - F.col("c_custkey"), F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))))
    bench = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")).union(short)
    found = claims.located(V.table(spark, d, "documents").select("doc_id", "text"), bench, "doc_id", "item_id")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
