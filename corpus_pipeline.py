"""From documents to training sequences: quality rules, quality classifier, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; docs has the columns of documents,
and so has what every stage but the last returns. Models are learned from the labelled rows of documents in sf_dir, a bounded
sample of them, so that a stage's model doesn't depend on what earlier stages left.

Cases, for every stage: an empty docs gives no rows, and where nothing is labelled the models keep all that pass the base rules;
rows that repeat are kept or dropped together; a null or empty text has no words and fails the quality rules, later stages would
keep it; rows with a null id count, told apart by their text; texts are judged whole; extra columns pass through whatever their
names, as a row travels as one struct. Packing returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywacke.llm import decontaminate, minhash, packing, quality_classifier, quality_rules
from graywacke.llm.common import Scratch, bounded, cut
from graywacke.llm.queries import TOKENIZER, table


def held(docs: DataFrame) -> DataFrame:
    """Each row of docs as one column, row."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows of the ids and text hashes in found."""
    gone = bounded(cut(found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()))
    return held(docs).join(gone, F.expr("row.doc_id <=> gone_id and xxhash64(row.text) = gone_hash"), "left_anti").select("row.*")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or is an anomaly among labelled documents."""
    forests = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.judge(held(docs), forests, "row.text").filter("rules.kept").select("row.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is likelier of label 0."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.score(held(docs), model, "row.text").filter("score >= 0.5").select("row.*")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest id."""
    return without(docs, minhash.near_duplicates(docs.select("doc_id", "text"), hashes=True).filter("not kept"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a run of words with the benchmark."""
    return without(docs, decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).filter("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed_documents(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash", minhash_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each but the last is written to the shared folder and read again, until the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    packed = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop()  # packing has saved its pieces
    return packed
