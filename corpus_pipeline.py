"""A corpus pipeline over documents: each stage's output is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattix.llm.bpe import bpe_round_trip
from lattix.llm.common import cut, drop_folders, table, tables_written, with_row_hash
from lattix.llm.decontaminate import find_leaks
from lattix.llm.jaccard_join import jaccard_components
from lattix.llm.queries import tokenizer_path
from lattix.llm.suffix_dedup import dedup_substrings
from lattix.llm.toxicity import score_texts, train_on

#: A trained classifier and suffix arrays cannot be put in SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go. Null and empty texts get the score of a text without n-grams, so they go only where most texts are toxic. Repeated rows are scored alike; rows with a null id are scored, but not learnt from."""
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model, out_col="_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of documents whose five-word shingle sets reach a similarity of 0.8, directly or over others: that of the smallest id, a null id last.

    Rows count, not ids: of rows that share an id each is judged by its own text, and a row that stands twice with all its columns equal is
    one document. Null, empty and wordless texts are linked with nothing and stay.
    """
    rows, key = with_row_hash(docs)
    classes = jaccard_components(rows, width=5, percent=80, id_col=key).select(F.col("doc_id").alias(key), "component_id").distinct()
    low = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    named = rows.select("doc_id", key).distinct().join(classes, key)
    kept = named.groupBy("component_id").agg(F.min(low).alias("low")).select(F.col(f"low.{key}").alias(key))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated 200-byte strings cover; n_chars follows. All rows stay, also those of which nothing is left; a null text comes out empty. Repeated rows and null ids are told by id and text."""
    out = dedup_substrings(docs, texts=True).withColumn("row", F.col("row").withField("text", F.col("kept")).withField("n_chars", F.char_length("kept").cast("long")))
    return out.select("row.*").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go. Each row is judged by its own text, whether its id is null or shared; null and empty texts stay."""
    rows, key = with_row_hash(docs)
    leaks = find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaks, key, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: its id, its number of token ids, and digests of these and of what they decode to. Null and empty texts have no ids."""
    return bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminate", decontaminate), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a stage's table stands, the one before and all that the stage wrote on its way are deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with tables_written() as inner:
            made = stage(spark, docs, sf_dir)
        with tables_written() as written:
            docs = cut(made, name)
        drop_folders(spark, [*inner, *before])
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
