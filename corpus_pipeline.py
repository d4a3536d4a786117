"""A training corpus from documents: rules, near and passage duplicates, the mix of sources, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.llm.common import discard, materialise, scratch_scope
from docrecon.llm.minhash import near_duplicates, without_ids
from docrecon.llm.mixing import mix
from docrecon.llm.packing import pack
from docrecon.llm.quality import quality_filter
from docrecon.llm.suffix import remove_passages


REMEMBERED_WORDS = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_filter(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id. Rows without a doc_id stay."""
    return without_ids(docs, near_duplicates(docs).filter("not kept").select("doc_id"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that one of smaller doc_id has; n_chars follows the text."""
    out = remove_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Workers, which other stages use too, remember fewer words than where packing runs alone."""
    return pack(docs, remembered=REMEMBERED_WORDS)


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", minhash_dedup), ("suffix-array dedup", suffix_dedup), ("source mix", source_mix), ("packing", packing)]

#: Neither MinHash, suffix sorting nor tokenising can be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written and read again, and then its input and scratch tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_scope() as kept:
            out = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), docs)
            kept.append(out)
        docs = out
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written already
    discard(docs)
    return packed
