"""A training corpus from documents in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm.contamination import contamination
from sparktide.llm.packing import pack
from sparktide.llm.queries import table, tokenizer_path
from sparktide.llm.shared import bounded_batches, shared_path
from sparktide.llm.shingle_join import near_duplicates
from sparktide.llm.substring import repeated_words
from sparktide.llm.toxicity import score_toxicity, toxicity_model

#: Documents with this toxicity or more go.
TOXIC = 0.7


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id and text with all other columns in one, so that no name clashes with those an operator adds."""
    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_end")).alias("_rest"))


def unwrapped(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones among docs that may be learned from."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return unwrapped(score_toxicity(wrapped(docs), model).where(F.col("score") < TOXIC), docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once if its row repeats; documents without id all stay."""
    bounded_batches(spark)
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those with passages that a smaller id has too without these, their words joined by one blank."""
    found = repeated_words(wrapped(docs), carry=("_rest",))
    changed = F.col("n_removed") > 0
    new = unwrapped(found.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).withColumn("_rest", F.col("_rest").withField("_changed", changed)), [*docs.columns, "_changed"])
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("_changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = contamination(wrapped(docs), table(spark, sf_dir, "benchmark"), carry=("_rest",))
    return unwrapped(found.where(~F.col("contaminated")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all that is left."""
    bounded_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A learned score and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
