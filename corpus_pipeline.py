"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage
before kept.  All but the last return the columns of ``documents``.  ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again, so a lost
executor repeats a part of one stage at most.

Defined results, for every stage: null and empty texts have no words, so the quality
rules reject them; repeated rows are near-duplicates of each other, so one stays; rows
that share an id are one document, of which the row of the smallest text stays; rows
with a null id are documents by their texts; ties go to the smaller id, then the
smaller text; texts of any length are whole; an empty table gives an empty table; all
columns but the text (and ``n_chars`` where it was cut) pass unchanged, whatever their
names, to the last stage, which returns the id and its own columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm import bpe, decontaminate, jaccard_join, quality_rules, shared, suffix_dedup

POLICY = "strict-1"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass every rule of the policy."""
    return quality_rules.passing(docs, quality_rules.POLICIES[POLICY])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest id, or a row of a null id if there is no other."""
    names = docs.columns
    # a row with a null id goes by a number made of its text, beyond all ids of other rows in use
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    keyed = docs.select(*names, own.alias("_key"))
    found = jaccard_join.components(keyed.select("_key", "text"), id_col="_key")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    kept = keyed.join(gone.distinct(), F.col("_key") == F.col("_gone"), "left_anti")
    # rows that share an id are one node: one of them stays
    shared = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("_key").alias("_shared")).persist()
    if shared.isEmpty():
        return kept.select(*names)
    alone = kept.join(shared, F.col("_key") == F.col("_shared"), "left_anti")
    first = kept.join(shared, F.col("_key") == F.col("_shared"), "left_semi").groupBy("_key").agg(F.min(F.struct("text", *(c for c in names if c != "text"))).alias("_row"))
    return alone.select(*names).unionByName(first.select(*(F.col("_row")[c].alias(c) for c in names)))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes that start in a document of a smaller id; documents without any text left go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.dedup(docs, carry=others)
    text = F.col("kept").cast("string")
    # a cut may split a character: what is left of it goes
    whole = F.when(F.size("spans") > 0, F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))).otherwise(text)
    kept = cut.withColumn("text", whole)
    kept = kept.filter((F.size("spans") == 0) | (F.trim("text") != ""))
    values = {c: F.col(c) if c in ("doc_id", "text") else F.col("carried")[c] for c in docs.columns}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(v.alias(c) for c, v in values.items()))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents into which no benchmark item leaked."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed, little-endian), and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep_text=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.encode("text", "UTF-8")).alias("exact"),
    )


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontaminate", decontaminated),
    ("bpe", encoded),
]

#: SQL cannot express the stages; the tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    root = shared.folder(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # its rows have been read for the last time
            shared.remove(spark, before)
        before = path
    return docs
