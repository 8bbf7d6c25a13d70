"""URL filter by the ratio of two character language models.

Rules of a host and a path prefix judge some URLs. From these, two variable-order
Markov models of characters are counted, one of accepted and one of rejected URLs:
the chance of a character after its last 3, smoothed by the chance after its last 2,
1 and 0 characters. A URL that no rule fits is judged by the mean log-likelihood
difference of its characters against a threshold. For that, the URLs with a rule whose
MD5 begins with a digit of KEPT_APART (3 in 16) are not counted in the models; the
threshold lies half-way between the mean of the accepted and that of the rejected among
them.

All counts are sums over all rows; the logarithms are rounded to millionths and added
as whole numbers, so neither the order of rows nor the number of tasks moves a verdict.

Defined cases: a URL that is null or has no `://` has an empty host and path, fits no
rule and is judged by the model over its whole text (null: the empty text). With no
accepted or no rejected URL at all, the counts are zero, every difference is smoothed
alone, and ties with the threshold are allowed. Where none of a class was kept apart, its
mean is that of all its URLs; without such the threshold is zero. Equal URLs get equal
verdicts, one row each; URLs are read whole, however long; an empty table gives no rows;
other columns are carried along, but one with a result's name gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, settled

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Weight of the shorter context's estimate, in characters seen.
BACKOFF = 2.0
MICRO = 1_000_000
#: Beyond so many rows the table of gram scores is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: First digits of the MD5 of URLs that calibrate the threshold.
KEPT_APART = "012"
#: So many distinct URLs are a task's share.
URLS_A_TASK = 50_000
RESULTS = ("host", "path", "rule", "verdict", "ratio")
BEFORE, AFTER = "\u0002", "\u0003"


def split_url(url: Column) -> tuple[Column, Column]:
    part = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return lower_ascii(part(1)), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _grams(url: Column) -> Column:
    """Every character with the 3 before it; the end counts as a character."""
    padded = F.concat(F.lit(BEFORE * 3), F.coalesce(url, F.lit("")), F.lit(AFTER))
    return F.transform(
        F.array(F.regexp_extract_all(padded, F.lit("(?s)(.)"), F.lit(1))),
        lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - 3), lambda i: F.concat(*[F.get(cs, i + k) for k in (-1, 0, 1, 2)])),
    )[0]


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, micro): the log ratio of accepted to rejected in millionths, from counts (gram, n_a, n_r)."""
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_r")]
    tail = lambda df, k: df.groupBy(F.substring("gram", -k, k).alias(f"g{k}")).agg(F.sum("n_a").alias(f"a{k}"), F.sum("n_r").alias(f"r{k}"))
    head = lambda df, k: df.groupBy(F.substring(f"g{k}", 1, k - 1).alias(f"c{k}")).agg(F.sum(f"a{k}").alias(f"ca{k}"), F.sum(f"r{k}").alias(f"cr{k}"))
    ones = tail(grams, 1)
    total = ones.agg(F.coalesce(F.sum("a1"), F.lit(0)).alias("ca1"), F.coalesce(F.sum("r1"), F.lit(0)).alias("cr1"), F.count(F.lit(1)).alias("kinds"))
    chance = ones.join(F.broadcast(total)).select("g1", *[((F.col(f"{s}1") + 1).cast("double") / (F.col(f"c{s}1") + F.col("kinds")).cast("double")).alias(f"p{s}") for s in "ar"])
    for k in (2, 3, 4):
        level = grams.groupBy(F.col("gram").alias("g4")).agg(F.sum("n_a").alias("a4"), F.sum("n_r").alias("r4")) if k == 4 else tail(grams, k)
        level = level.withColumn(f"c{k}", F.substring(f"g{k}", 1, k - 1)).join(head(level, k), f"c{k}").withColumn(f"g{k - 1}", F.substring(f"g{k}", 2, k - 1))
        mixed = [((F.col(f"{s}{k}") + F.lit(BACKOFF) * F.col(f"p{s}")) / (F.col(f"c{s}{k}") + F.lit(BACKOFF))).alias(f"p{s}") for s in "ar"]
        chance = level.join(chance, f"g{k - 1}").select(f"g{k}", *mixed)
    return chance.select(F.col("g4").alias("gram"), F.round((F.log("pa") - F.log("pr")) * MICRO).cast("long").alias("micro"))


def judged(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and the model's mean difference `ratio` (millionths)."""
    named = {c: f"_kept_{i}" for i, c in enumerate(pages.columns)}
    host, path = split_url(F.col("_raw"))
    ruled = pages.select(*[pages[c].alias(n) for c, n in named.items() if c not in RESULTS], pages[url].alias("_raw")).withColumn("_host", host).withColumn("_path", path)
    ruled = ruled.withColumn("_fit", fitting_rule(F.col("_host"), F.col("_path"), rules)).withColumn("_url", F.coalesce("_raw", F.lit("")))
    kinds = settled(ruled.groupBy("_url", F.col("_fit.verdict").alias("_by_rule")).agg(F.count(F.lit(1)).alias("_n")))
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, kinds.count() // URLS_A_TASK)
    kinds = kinds.repartition(tasks).withColumn("_apart", F.substring(F.md5(F.col("_url").cast("binary")), 1, 1).isin(*KEPT_APART))
    per_gram = kinds.select("_url", "_by_rule", "_n", "_apart", F.explode(_grams(F.col("_url"))).alias("gram"))
    counted = lambda verdict: F.sum(F.when((F.col("_by_rule") == verdict) & ~F.col("_apart"), F.col("_n")).otherwise(0))
    counts = settled(per_gram.groupBy("gram").agg(counted("allow").alias("n_a"), counted("block").alias("n_r")))
    scores = settled(gram_scores(counts))
    if scores.count() <= BROADCAST_ROWS:
        scores = F.broadcast(scores)
    # A distinct URL's grams lie in one task, so the sums shrink to a row a URL before the shuffle.
    ratios = settled(
        per_gram.join(scores, "gram").groupBy("_url", "_by_rule", "_n", "_apart").agg((F.sum("micro") / F.count(F.lit(1))).alias("_mean"))
        .select("_url", "_by_rule", "_n", "_apart", F.round("_mean").cast("long").alias("_ratio"))
    )

    def mean(verdict: str) -> Column:
        of = lambda rows: F.sum(F.when(rows, F.col("_ratio") * F.col("_n"))) / F.sum(F.when(rows, F.col("_n")))
        return F.coalesce(of((F.col("_by_rule") == verdict) & F.col("_apart")), of(F.col("_by_rule") == verdict))

    cut = ratios.agg(F.coalesce((mean("allow") + mean("block")) / 2, F.lit(0.0)).alias("_cut"))
    by_model = ratios.join(F.broadcast(cut)).select("_url", "_ratio", F.when(F.col("_ratio") >= F.col("_cut"), "allow").otherwise("block").alias("_by_model"))
    results = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), F.col("_by_model")).alias("verdict"), F.col("_ratio").alias("ratio")]
    return ruled.join(by_model, "_url").select(*[F.col(n).alias(c) for c, n in named.items() if c not in RESULTS], *results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "ratio")


def _oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    levels, last = [], "p1"
    for k in (2, 3, 4):
        mixed = ", ".join(f"(l.{s} + {BACKOFF} * p.p{s}) / (c.{s} + {BACKOFF}) AS p{s}" for s in "ar")
        levels.append(f"""l{k} AS (SELECT right(gram, {k}) AS g, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
c{k} AS (SELECT left(g, {k - 1}) AS g, sum(a) AS a, sum(r) AS r FROM l{k} GROUP BY 1),
p{k} AS (SELECT l.g, {mixed} FROM l{k} l JOIN c{k} c ON c.g = left(l.g, {k - 1}) JOIN {last} p ON p.g = right(l.g, {k - 1}))""")
        last = f"p{k}"
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
parts AS (
  SELECT page_id, coalesce(url, '') AS u, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), ruled AS (
  SELECT *, (SELECT max_by({{'rule': h || p, 'verdict': v}}, length(h || p)) FROM rules WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p)) AS fit FROM parts
), urls AS (SELECT u, fit.verdict AS v, count(*) AS n, md5(u)[1] IN ({", ".join(f"'{x}'" for x in KEPT_APART)}) AS apart, repeat(chr(2), 3) || u || chr(3) AS x FROM ruled GROUP BY 1, 2),
grams AS (SELECT u, v, n, apart, unnest(list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4))) AS gram FROM urls),
counts AS (SELECT gram, sum(CASE WHEN v = 'allow' AND NOT apart THEN n ELSE 0 END) AS a, sum(CASE WHEN v = 'block' AND NOT apart THEN n ELSE 0 END) AS r FROM grams GROUP BY 1),
l1 AS (SELECT right(gram, 1) AS g, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
p1 AS (SELECT g, (a + 1)::DOUBLE / (sum(a) OVER () + count(*) OVER ())::DOUBLE AS pa, (r + 1)::DOUBLE / (sum(r) OVER () + count(*) OVER ())::DOUBLE AS pr FROM l1),
{", ".join(levels)},
scores AS (SELECT g AS gram, round((ln(pa) - ln(pr)) * {MICRO})::BIGINT AS micro FROM p4),
ratios AS (SELECT u, v, n, apart, round(sum(micro)::DOUBLE / count(*)::DOUBLE)::BIGINT AS ratio FROM grams JOIN scores USING (gram) GROUP BY 1, 2, 3, 4),
means AS (SELECT v, coalesce(sum(CASE WHEN apart THEN ratio * n END)::DOUBLE / sum(CASE WHEN apart THEN n END), sum(ratio * n)::DOUBLE / sum(n)) AS m FROM ratios GROUP BY 1),
cut AS (SELECT coalesce((max(CASE WHEN v = 'allow' THEN m END) + max(CASE WHEN v = 'block' THEN m END)) / 2, 0.0) AS t FROM means)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN ratio >= t THEN 'allow' ELSE 'block' END) AS verdict, ratio
FROM ruled JOIN ratios USING (u), cut
"""


ORACLE_SQL = _oracle()
