"""A corpus from documents: toxic ones go, one of each group of near-duplicates stays,
ones that hold benchmark items go, and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
Documents are told apart by doc_id; rows without one are judged by their text where a
stage allows that and are kept by the others. Columns besides doc_id and text are carried
along, whatever their names; of rows with one id the first one in the order of its columns
stays (maps do not count). Texts are taken whole, however long; an empty text is judged like
any other, and all texts without words are one group of near-duplicates. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, overlap, toxicity
from assayer.llm.shared import settled, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    # Other columns go by names that no result of the classifier has.
    named = {c: c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    scored = toxicity.scored(docs.select(*[docs[c].alias(n) for c, n in named.items()]), labels)
    return scored.filter(F.col("predicted") == 0).select(*[F.col(n).alias(c) for c, n in named.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that share 0.8 or more of their 5-word shingles; one row of it."""
    rows = settled(overlap.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n")))
    kept = without(docs, rows.filter(~F.col("stays")), "doc_id")
    repeated = rows.filter(F.col("stays") & (F.col("n") > 1))
    if repeated.isEmpty():
        return kept
    others = [c for c in docs.columns if c != "doc_id"]
    ordered = [c for c in others if not any(t in docs.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    single = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*others), F.struct(*ordered)).alias("row")).select("doc_id", "row.*")
    return without(kept, repeated, "doc_id").unionByName(single).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return without(docs, decontaminate.matches(docs.select("doc_id", "text"), benchmark).filter("doc_id is not null"), "doc_id").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the ids and of the text decoded from them."""
    return bpe.digested(docs.select("doc_id", "text"), "text", bpe.default_tokenizer()).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier nor XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
