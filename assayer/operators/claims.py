"""Claims and their citations against source lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import identity
from assayer.functions.folders import settled


def resolved(citations: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """citations with `outcome`: malformed (a field is missing), unknown (no such file), range, mismatch or pass.

    The file's text meets its citations by an equi-join; the span is cut out of it there,
    so no file is exploded into rows of lines.
    """
    joined = citations.join(files.select(*keys, F.col("text").alias("_text")), keys, "left")
    got = C.span(C.lines_of(F.col("_text")), F.col("start_line"), F.col("end_line"))
    outcome = F.when(F.col("path").isNull() | F.col("start_line").isNull() | F.col("end_line").isNull() | F.col("quote").isNull(), "malformed").when(F.col("_text").isNull(), "unknown").when(got.isNull(), "range").when(got == F.col("quote"), "pass").otherwise("mismatch")
    return joined.withColumn("outcome", outcome).drop("_text")


CITATIONS = "array<struct<path:string,start_line:int,end_line:int,quote:string>>"


def cited(findings: DataFrame, key: str, claims: str = "claims") -> DataFrame:
    """(key, claim, citation, path, start_line, end_line, quote): a row for each citation, one of nulls for a claim or a finding without."""
    each = findings.select(key, F.posexplode_outer(claims).alias("claim", "_claim"))
    rows = each.select(key, "claim", F.posexplode_outer(F.col("_claim")["citations"].cast(CITATIONS)).alias("citation", "_cited"))
    return rows.select(key, "claim", "citation", "_cited.*")


def verdicts(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, state) of resolved rows of cited(): pass where a finding has claims, each has citations, and all resolve.

    A finding or claim without citations is a row without an outcome of `pass`, so it fails.
    """
    good = F.bool_and(F.coalesce(F.col("outcome") == "pass", F.lit(False)))
    return outcomes.groupBy(key).agg(F.when(good, "pass").otherwise("fail").alias("state"))


def complete(claims: Column) -> Column:
    """pass where every claim says something and every citation is well formed."""
    # Blank as Python's str.strip has it.
    blank = r"^[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\z"
    cited = lambda c: (F.size(c["citations"]) > 0) & F.forall(c["citations"], lambda x: (x["path"] != "") & (x["start_line"] >= 1) & (x["end_line"] >= x["start_line"]) & x["quote"].isNotNull())
    good = (F.size(claims) > 0) & F.forall(claims, lambda c: ~c["statement"].rlike(blank) & cited(c))
    return F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail")


def id_literals(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, literal): content-derived ids written out in a text, with eight hex digits or more."""
    kinds = "|".join(C.ID_KINDS)
    return texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(rf"(?U)\b((?:{kinds})-[0-9a-f]{{8,}})\b"), F.lit(1))).alias("literal"))


def id_violations(files: DataFrame, keys: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """(keys, path, reason, found): ids that files assert though nothing has derived them.

    `literal` is an id written out anywhere; in `.json` files `key` is a field, at any depth,
    that names an id, and `not_json` a file that does not parse. Open JSON is walked as a
    variant, a level of all documents at a time, so depth costs rounds and not a stack; a
    file with a field twice is `not_json` here.
    """
    rows = files.select(*keys, F.col(path).alias("path"), F.col(text).alias("_text"))
    literals = id_literals(rows.withColumn("_key", F.struct(*keys, "path")), "_key", "_text").select("_key.*", F.lit("literal").alias("reason"), F.col("literal").alias("found"))
    docs = rows.filter(F.col("path").endswith(".json")).select(*keys, "path", F.try_parse_json("_text").alias("_node"))
    broken = docs.filter("_node is null").select(*keys, "path", F.lit("not_json").alias("reason"), F.lit(None).cast("string").alias("found"))
    level, fields = docs.filter("_node is not null"), None
    names = ", ".join(f"`{k}`" for k in [*keys, "path"])
    while True:
        nested = level.filter(F.schema_of_variant("_node").rlike("^(OBJECT|ARRAY)"))
        level = settled(nested)
        if level.isEmpty():
            break
        view = f"_walk_{uuid.uuid4().hex}"
        level.createOrReplaceTempView(view)
        children = level.sparkSession.sql(f"SELECT {names}, v.key AS _name, v.value AS _node FROM {view}, LATERAL variant_explode(_node) AS v")
        found = children.filter(F.col("_name").isin(*identity.IDENTITY_KEYS)).select(*keys, "path", F.lit("key").alias("reason"), F.col("_name").alias("found"))
        fields = found if fields is None else fields.union(found)
        level = children.drop("_name")
    every = literals.union(broken)
    return every if fields is None else every.union(fields)


#: Words of a quote that are looked up together.
ANCHOR = 3
#: Short quotes that a text is searched for at a time.
SHORT = 1000


def _grams(text: Column) -> Column:
    """Hashes of the runs of ANCHOR words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    spans = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - ANCHOR), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(ANCHOR)]))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= ANCHOR, spans(w)).otherwise(F.array().cast("array<bigint>"))), F.lit(0))


def located(texts: DataFrame, quotes: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item) of texts that hold a quote (item, quote), a row for each text's row.

    A quote's words but the first and last are whole words of a text that holds it, so one
    run of them, the one with the least hash, is met by an equi-join over hashes; only texts
    with that run are read again and searched. Quotes of fewer than ANCHOR + 2 words have no
    such run: their distinct texts, cut into parts of SHORT of them, meet every text, which
    is searched for them where it lies.
    """
    grams = _grams(F.col("quote"))
    inner = F.slice(grams, F.lit(2), F.greatest(F.size(grams) - 2, F.lit(0)))
    anchored = quotes.select(item, "quote", F.array_min(inner).alias("gram"))
    rows = texts.select(key, "text", F.xxhash64(key, "text").alias("_row"))
    long = anchored.filter("gram is not null")
    runs = rows.select("_row", F.explode(F.array_distinct(_grams(F.col("text")))).alias("gram"))
    pairs = runs.join(long.select(item, "gram"), "gram").select("_row", item).distinct()
    found = rows.join(pairs, "_row").join(long.select(item, "quote"), item).filter(F.contains("text", "quote")).select(key, item)
    short = anchored.filter("gram is null and quote is not null").select("quote").distinct()
    part = F.pmod(F.xxhash64("quote"), F.lit(-(-short.count() // SHORT) or 1))
    groups = short.groupBy(part.alias("_part")).agg(F.collect_list("quote").alias("_quotes"))
    # A stated list of quotes against all rows, SHORT of them at a time.
    met = rows.select(key, "text").join(groups).select(key, F.explode(F.filter("_quotes", lambda q: F.contains("text", q))).alias("quote"))
    return found.union(met.join(anchored.filter("gram is null").select(item, "quote"), "quote").select(key, item))
