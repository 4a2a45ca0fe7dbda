"""A training-data pipeline over ``documents``: quality rules, quality classifier, n-gram Jaccard
join, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import jaccard_join, packing, pii, quality_classifier, quality_rules
from fairlead.llm.common import discard, if_small, table, written
from fairlead.llm.queries import BATCH_ROWS, TOKENIZER


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): what operators look at, with the whole document beside it, so that no column of
    the input can clash with theirs."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go, as they have fewer than ten words. All
    columns of the documents stay as they are, whatever their names; repeated rows stay repeated."""
    return quality_rules.judge(carried(docs), columns=["row"]).filter("kept").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. It learns from the labels of the whole table of
    documents, not only of those that the stages before have left, which hold hardly a bad one.
    Without a labelled good document all stay. All columns stay as they are, whatever their names;
    null and empty texts are scored as texts without words; repeated rows stay repeated."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.classify(carried(docs).select("text", "row"), model).filter("predicted = 1").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar five-word shingles (Jaccard 0.8): the one with
    the smallest doc_id (null last), then text hash; of rows with equal doc_id and text, one. A document that shares
    its doc_id with a copy, but not its text, stays. Documents without words (null and empty texts
    too) are nobody's copies and all stay. All columns stay as they are, whatever their names."""
    found = jaccard_join.similar(docs, size=5, percent=80)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    told = found.filter("component IS NOT NULL").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.any_value(~first).alias("copy"))
    told = written(told.filter("copy OR n > 1").select(F.col("doc_id").alias("id"), "key", "copy"), "near-copies")
    rows = carried(docs).join(if_small(told), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key")), "left")
    single = rows.filter("copy IS NULL").select("row.*")
    return single.union(rows.filter("NOT copy").dropDuplicates(["doc_id", "text"]).select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind, n_chars (if there) counted anew. Null texts stay null, empty
    ones empty, repeated rows repeated; all other columns stay as they are, whatever their names."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences, with their ids. Null and empty texts are documents of the end
    id alone; repeated rows are packed each; columns other than doc_id are left out, so none can clash."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near copies", near_copies), ("personal data", personal_data), ("packing", pack)]

#: Packing and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's table is deleted when the next one's is written, but for the last, which
    the result reads."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        if hasattr(before, "written_to"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
